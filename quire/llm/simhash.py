"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

A fingerprint holds, bit by bit, the majority over the XXH64 values (seed 42) of a text's word
shingles, repeats included.  Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is
``k`` words joined by one space, a text of fewer words is one shingle, and a text without words has
the fingerprint zero.

Two fingerprints within ``2 r`` bits have a common variant within ``r`` bits of both, and two that
share such a variant are within ``2 r``: the triangle inequality verifies every collision.  So each
distinct fingerprint takes all its variants within ``r`` bits (2,081 for r = 2) and those that meet
on a variant are linked.  The variants' leading bits say which task a variant belongs to.  A
fingerprint is shuffled once to each such prefix (37 for 8 bits) rather than once per variant, and
the rest of the ball is spelled out there; variants are sorted in bounded pieces, split on further
bits wherever a prefix is crowded.  Each task keeps a spanning forest of the links, never all
pairs of a crowded group.

Defined results: null texts count as empty; repeated rows and equal ids share one fingerprint and
one component; rows with a null id keep their fingerprint and take their component from equal
fingerprints; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import storage, words
from quire.llm.components import connected_components

SEED = 42
#: Fingerprints for each prefix of variants, on average, and variants that a task sorts at once.
PER_PREFIX, PIECE = 1024, 1 << 19
#: Fingerprints that one task spreads over prefixes, about.
PER_TASK = 1 << 14


def prefix_bits(n: int) -> int:
    """Leading bits that choose a variant's group, so that groups keep their size as n grows."""
    return min(32, max(4, (n // PER_PREFIX).bit_length()))


def _shingle_hashes(block: words.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a block, row after row, and how many each row has."""
    joined, begin, end = words.joined(block)
    counts = np.diff(block.bounds)
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(block.bounds[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    last = first + np.repeat(np.minimum(counts, k), shingles) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first)), shingles


def _majorities(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """For each row the bits that over half of its hashes have; 0 for rows without any."""
    made, some = np.zeros(len(shingles), np.uint64), np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
        made[some] = np.packbits(2 * ones > shingles[some][:, None], axis=1).reshape(-1).view(">u8")
    return made


def fingerprints_of(column: pa.Array, k: int) -> np.ndarray:
    """The fingerprints of a column of texts, as unsigned 64-bit numbers."""
    made = [_majorities(*_shingle_hashes(block, k)) for block in words.blocks(column, words.NOT_SPACE, lower=True)]
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], text_col: str, name: str, k: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array(fingerprints_of(batch.column(text_col), k).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, name])


def fingerprints(docs: DataFrame, *, k: int = 4, text_col: str = "text", keep: list[str] | None = None, name: str = "simhash") -> DataFrame:
    """The columns ``keep`` (all, if None) and the fingerprint as a signed long, its name ended in
    underscores while the input has such a column."""
    kept = docs.columns if keep is None else keep
    name = storage.free(kept, name)
    source = docs.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.LongType())])
    return source.mapInArrow(partial(_fingerprint_batches, text_col=text_col, name=name, k=k, keep=kept), schema)


def ball_masks(bits: int, radius: int) -> np.ndarray:
    """All masks over ``bits`` low bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], dtype=np.uint64)


def _pieces(points: np.ndarray, left: np.ndarray, bits: int) -> Iterator[list[np.ndarray]]:
    """Variants over ``bits`` low bits within ``left`` flips of each point, in pieces of equal higher
    bits, as index and variant arrays; a piece of more than PIECE variants is split on its next bit."""
    sizes = np.array([len(ball_masks(bits, r)) for r in range(int(left.max(initial=0)) + 1)])
    if bits > 0 and int(sizes[left].sum()) > PIECE:
        bit = np.uint64(1 << (bits - 1))
        for value in (np.uint64(0), bit):
            flips = (points & bit) != value
            keep = np.flatnonzero(left >= flips)
            for index, variants in _pieces(points[keep], (left - flips)[keep], bits - 1):
                yield [keep[index], variants | value]
        return
    low = points & np.uint64((1 << bits) - 1)
    index, variants = [], []
    for r in range(len(sizes)):
        own, masks = np.flatnonzero(left == r), ball_masks(bits, r)
        index.append(np.repeat(own, len(masks)))
        variants.append((low[own][:, None] ^ masks[None, :]).reshape(-1))
    yield [np.concatenate(index), np.concatenate(variants)]


def meeting_links(points: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """A spanning forest, as index pairs, of the links between points that share a variant."""
    root = np.arange(len(points))
    for index, variants in _pieces(points, left, bits):
        order = np.argsort(variants, kind="stable")
        index, variants = index[order], variants[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        if not len(same):
            continue
        pairs = np.unique(np.stack([index[same], index[same + 1]], axis=1), axis=0)
        root = _join(root, pairs[:, 0], pairs[:, 1])
    linked = np.flatnonzero(root != np.arange(len(points)))
    return np.stack([root[linked], linked], axis=1)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges trees along edges; ``root[i]`` stays the smallest index of i's tree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper


def _spread_batches(batches: Iterator[pa.RecordBatch], radius: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for every prefix that its variants have."""
    masks = ball_masks(bits, radius)
    for batch in batches:
        points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        prefixes = ((points >> np.uint64(64 - bits))[:, None] ^ masks[None, :]).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(prefixes.astype(np.int64)), pa.array(np.repeat(points, len(masks)).view(np.int64))], ["prefix", "point"])


def _links_of_prefix(prefix: int, table: pa.Table, radius: int, bits: int) -> pa.Table:
    points = np.unique(table.column("point").to_numpy().view(np.uint64))
    apart = (points >> np.uint64(64 - bits)) ^ np.uint64(prefix)
    left = radius - np.bitwise_count(apart).astype(np.int64)
    links = meeting_links(points, left, 64 - bits)
    return pa.table({"u": points[links[:, 0]].view(np.int64), "v": points[links[:, 1]].view(np.int64)})


def ball_links(points: DataFrame, *, distance: int = 4) -> DataFrame:
    """``(u, v)`` links whose components are those of all pairs of distinct fingerprints within
    ``distance`` bits (even); ``points`` has one long column."""
    if distance % 2:
        raise ValueError("distance must be even: each side takes half of it")
    radius, points = distance // 2, storage.write_table(points.distinct(), "points")[0]
    n = points.count()
    bits = prefix_bits(n)
    points = points.repartition(max(1, n // PER_TASK), points.columns[0])  # each grows about bits squared / 2 times
    spread = points.mapInArrow(partial(_spread_batches, radius=radius, bits=bits), "prefix long, point long")

    def link(key, table):
        return _links_of_prefix(key[0].as_py(), table, radius, bits)

    return spread.groupBy("prefix").applyInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, *, k: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, simhash, component)`` for each row; component is the smallest id reachable over links
    between fingerprints within ``distance`` bits."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    marked = fingerprints(source, k=k, text_col="body", keep=["id"], name="simhash")
    marked, _ = storage.write_table(marked, "simhash")
    classes = marked.groupBy("simhash").agg(F.min("id").alias("least"))
    components = connected_components(ball_links(classes.select("simhash"), distance=distance))
    joined = classes.join(components.select(F.col("node").alias("simhash"), F.col("component").alias("root")), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    named, _ = storage.write_table(storage.with_group_min(joined, "root", "least", "component").select("simhash", "component"), "simhash")
    return marked.join(named, "simhash").select("id", "simhash", "component")

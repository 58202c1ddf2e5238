"""Near copies: groups of texts linked by a Jaccard similarity of 0.8 or more of their distinct shingles.

Shingles are those of ``simhash`` (XXH64 of ``k`` words, lower case, a shorter text is one), each
counted once.  Texts of equal shingle sets are one class, named by a 128-bit hash of the set.

Candidates come from SimHash.  At a similarity of 0.8 about 15 bits in a hundred differ, more than the
balls around one fingerprint of 64 bits bridge, so a fingerprint has ``BITS`` bits, cut into ``SLICES``
slices of ``SLICE`` bits.  A slice's bits are majorities of its shingles' votes; a shingle's vote in bit j
is a sign of its hash times the Walsh function of eleven further bits of it at j, so a text's bits cost one
fast transform.  Slices within two bits of each other share a variant within one bit of both: every
slice takes its variants and those meet (``simhash``'s ball hashing, slice by slice).  A meeting whose
remaining bits differ too much is passed over.  What meets makes *families*; in a family all
classes are compared by their whole fingerprints, and pairs that may be alike are verified on their shingles,
shortest distance first, until nothing unverified could join two groups.  Only verified links count.

A pair at 0.8 misses all its slices with a chance under 1 in 10,000 (texts of a dozen words: under 1 in 100).
Each task sends on a forest of links, never all pairs.  A family of more than ``PIECE`` classes is dealt
over cells of two pieces, so memory is bounded; the comparisons in one family grow with its square.

Defined results: null texts count as empty; texts without words are one class; repeated rows and
equal ids share a class; rows with a null id take their component from their class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import simhash, storage, words
from quire.llm.components import connected_components

#: Bits of a fingerprint, its 64-bit parts; slices, two of a part, and their bits.
BITS, PARTS, SLICES, SLICE = 2048, 32, 64, 28
#: Bits that may differ in the rest of a slice's part and in the part after it, for a meeting to count.
REST, CHECK = 11, 16
#: Bits that may differ in all, for sets of MANY shingles or more, and for smaller ones.
MANY, NEAR, NEAR_FEW = 32, 400, 560
#: Classes, and bytes of their sets, in a piece of a family; classes of a cell of slices, about.
PIECE, PIECE_BYTES, CELL = 1024, 8 << 20, 1 << 21
#: Rows of a fixed-size side that is broadcast at most.
SMALL = 1 << 20
_ORDER = np.random.default_rng(20).permutation(BITS)
_ENTRY = np.dtype([("tag", "<i8"), ("part", "<u8"), ("check", "<u8")])
_LOW = np.uint64((1 << SLICE) - 1)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block the distinct shingles' hashes of rows, ascending in each, and how many each has."""
    for block in words.blocks(column, words.NOT_SPACE, lower=True):
        hashes, shingles = simhash._shingle_hashes(block, k)
        row = np.repeat(np.arange(len(shingles)), shingles)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        yield hashes[new], np.bincount(row[new], minlength=len(shingles))


def _walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def fingerprints_of_sets(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of PARTS unsigned 64-bit numbers, the majorities of each set's votes; 0 for an empty set."""
    ends, out = np.cumsum(sizes), np.zeros((len(sizes), PARTS), np.uint64)
    for lo in range(0, len(sizes), 512):
        hi = min(lo + 512, len(sizes))
        own = hashes[ends[lo] - sizes[lo] : ends[hi - 1]]
        row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        votes = np.bincount(row * BITS + (own >> np.uint64(53)).astype(np.int64), weights=np.where(own & np.uint64(1), 1.0, -1.0), minlength=(hi - lo) * BITS)
        total = _walsh(votes.reshape(hi - lo, BITS).astype(np.float32))
        out[lo:hi] = np.ascontiguousarray(np.packbits(np.take(total, _ORDER, axis=1) > 0, axis=1)).view(np.uint64)
    return out


def _names(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _prints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARTS)


def _mark(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for hashes, sizes in sets_of(batch.column("body"), k):
            own = batch.slice(at, len(sizes))
            at += len(sizes)
            made = [pa.array(_names(hashes, sizes), pa.binary()), pa.array(sizes.astype(np.int64)), _binary(fingerprints_of_sets(hashes, sizes))]
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("hash"), *made], ["id", "hash", "name", "size", "print"])


def prefix_bits(n: int) -> int:
    """Leading bits of a slice that choose its cell, so that cells keep their size as n grows."""
    bits = 0
    while n * (1 + bits) >> bits > CELL and bits < SLICE - 4:
        bits += 1
    return bits


def _deal(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each slice of each class to every cell that its variants lie in, packed."""
    masks = simhash.ball_masks(bits, 1)
    for batch in batches:
        parts = _prints(batch.column("print"))
        cells, packed = [], []
        for number in range(SLICES):
            part = parts[:, number // 2] if number % 2 == 0 else np.bitwise_or(parts[:, number // 2] >> np.uint64(32), parts[:, number // 2] << np.uint64(32))
            entries = np.empty(len(parts), _ENTRY)
            entries["tag"], entries["part"], entries["check"] = batch.column("tag").to_numpy(), part, parts[:, (number // 2 + 1) % PARTS]
            prefixes = (((part & _LOW) >> np.uint64(SLICE - bits))[:, None] ^ masks[None, :]).astype(np.int64)
            row = np.repeat(np.arange(len(parts)), len(masks))
            order = np.argsort(prefixes.reshape(-1), kind="stable")
            prefixes, row = prefixes.reshape(-1)[order], row[order]
            cuts = [0, *(np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1).tolist(), len(prefixes)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    cells.append((number << 32) + int(prefixes[a]))
                    packed.append(entries[row[a:b]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(packed, pa.binary())], ["cell", "entries"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether meetings count: entries whose parts and checks differ little enough."""
    return (_apart(a["part"] & ~_LOW, b["part"] & ~_LOW) <= REST) & (_apart(a["check"], b["check"]) <= CHECK)


def _links_of_run(run: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """From one member to others, so that all that meet are connected: each part grows by comparing its
    newest members with what is left."""
    rest = run
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            member = front.pop()
            met = _meet(entries[member], entries[rest])
            if met.any():
                yield member, rest[met]
                front += rest[met].tolist()
                rest = rest[~met]


def meetings(prefix: int, entries: np.ndarray, bits: int) -> np.ndarray:
    """A forest, as pairs of indices, of the entries of a cell that meet."""
    points = entries["part"] & _LOW
    left = 1 - np.bitwise_count((points >> np.uint64(SLICE - bits)) ^ np.uint64(prefix)).astype(np.int64)
    root = np.arange(len(entries))
    for index, variants in simhash._pieces(points, left, SLICE - bits):
        order = np.lexsort((entries["check"][index], variants))
        index, variants = index[order], variants[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        if not len(same):
            continue
        a, b = index[same], index[same + 1]
        met = _meet(entries[a], entries[b])
        root = simhash._join(root, a[met], b[met])
        first = np.flatnonzero(np.append(True, variants[1:] != variants[:-1]))
        sizes = np.diff(np.append(first, len(variants)))
        roots = root[index]
        several = (np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)) & (sizes > 2)
        for at, n in zip(first[several].tolist(), sizes[several].tolist(), strict=True):
            run = index[at : at + n]
            if (root[run] == root[run[0]]).all():
                continue
            for member, others in _links_of_run(run, entries):
                root = simhash._join(root, np.full(len(others), member), others)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([root[linked], linked], axis=1)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, ascending, have a similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 9 * common >= 4 * (len(a) + len(b))


def _near_pairs(prints: np.ndarray, sizes: np.ndarray, piece: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be alike, by their distance."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    limit = np.where(sizes >= MANY, NEAR, NEAR_FEW)
    for lo in range(0, len(prints), 32):
        here = slice(lo, min(lo + 32, len(prints)))
        apart = _apart(prints[here, None], prints[None]).sum(axis=2, dtype=np.int64)
        able = (apart <= np.maximum(limit[here, None], limit[None])) & (np.arange(len(prints))[here, None] < np.arange(len(prints))[None])
        able &= (5 * sizes[here, None] >= 4 * sizes[None]) & (5 * sizes[None] >= 4 * sizes[here, None])
        if not alone:
            able &= piece[here, None] != piece[None]
        i, j = np.nonzero(able)
        found.append((i + lo, j, apart[i, j]))
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(apart, kind="stable")
    return i[order], j[order]


def _verified(prints: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], piece: np.ndarray, alone: bool) -> Iterator[tuple[int, int]]:
    """Verified links that connect what all links connect: a pair is passed over if it is connected already."""
    i, j = _near_pairs(prints, sizes, piece, alone)
    root, step = np.arange(len(prints)), 256
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        while len(a):
            apart = np.flatnonzero(root[a] != root[b])
            a, b = a[apart], b[apart]
            done = len(a)
            for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if alike(sets[x], sets[y]):
                    yield x, y
                    root = simhash._join(root, np.array([x]), np.array([y]))
                    done = n + 1
                    break
            a, b = a[done:], b[done:]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in storage.groups(batches, "cell"):
        names, sizes, piece = table.column("name").to_pylist(), table.column("size").to_numpy(), table.column("piece").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        links = list(_verified(_prints(table.column("print")), sizes, sets, piece, table.column("alone")[0].as_py()))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([names[x[side]] for x in links], pa.binary()) for side in (0, 1)], ["u", "v"])


def _shingle(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of classes, each once in a task; a text whose set has another name shares the text hash only."""
    seen: set[bytes] = set()
    for batch in batches:
        at = 0
        for hashes, sizes in sets_of(batch.column("body"), k):
            wanted, rows, raw = batch.column("name").slice(at, len(sizes)).to_pylist(), [], []
            at += len(sizes)
            for row, (name, e, n) in enumerate(zip(_names(hashes, sizes), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                if name == wanted[row] and name not in seen:
                    seen.add(name)
                    rows.append(name)
                    raw.append(hashes[e - n : e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(raw, pa.binary())], ["name", "shingles"])


def links_of_classes(classes: DataFrame, source: DataFrame, k: int) -> DataFrame:
    """``(u, v)``: verified links between names.  ``classes`` is stored: name, tag, hash, size, print."""
    bits = prefix_bits(classes.count())

    def meet(key, table):
        entries = np.unique(np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY))
        links = meetings(key[0].as_py() % (1 << 32), entries, bits)
        tags = entries["tag"]
        return pa.table({"u": tags[links[:, 0]], "v": tags[links[:, 1]]})

    dealt = classes.where("size > 0").select("tag", "print").mapInArrow(partial(_deal, bits=bits), "cell long, entries binary")
    found = connected_components(dealt.groupBy("cell").applyInArrow(meet, "u long, v long"))
    members, path = storage.write_table(classes.join(found.select(F.col("node").alias("tag"), F.col("component").alias("family")), "tag"), "similar")

    wanted = storage.broadcast_if_small(members.select("hash", "name"), SMALL)
    bodies = source.select("hash", "body").join(wanted, "hash").select("name", "body")
    sets = bodies.mapInArrow(partial(_shingle, k=k), "name binary, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles"))
    pieces, pieces_path = storage.write_table(members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("size") * 8 / PIECE_BYTES)).cast("int").alias("pieces")), "similar")
    dealt = members.join(pieces, "family").withColumn("piece", F.pmod(F.xxhash64("name"), "pieces").cast("int"))
    dealt = dealt.join(sets, "name").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cell = F.concat_ws("-", F.col("family").cast("string"), F.least("piece", "other"), F.greatest("piece", "other"))
    # pairs inside a piece are compared in the piece's own cell only
    dealt = dealt.select(cell.alias("cell"), (F.col("piece") == F.col("other")).alias("alone"), "piece", "name", "size", "print", "shingles")
    links, _ = storage.write_table(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "u binary, v binary"), "similar")
    storage.drop_table(source.sparkSession, path)
    storage.drop_table(source.sparkSession, pieces_path)
    return links


def similar_groups(docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash, name, component)``: component is the smallest id of the texts reachable over links."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("body"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("hash", T.LongType()), T.StructField("name", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("print", T.BinaryType())])
    marked, _ = storage.write_table(source.mapInArrow(partial(_mark, k=k), schema), "similar")
    classes = marked.groupBy("name").agg(F.min("id").alias("least"), F.min("hash").alias("hash"), F.first("size").alias("size"), F.first("print").alias("print"))
    classes, _ = storage.write_table(classes.withColumn("tag", F.xxhash64("name")), "similar")
    found = connected_components(links_of_classes(classes, source, k))
    joined = classes.select("name", "least").join(found.select(F.col("node").alias("name"), F.col("component").alias("root")), "name", "left").withColumn("root", F.coalesce("root", "name"))
    named = storage.with_group_min(joined, "root", "least", "component").select("name", "component")
    return marked.select("id", "hash", "name").join(named, "name")


def keep_first(docs: DataFrame, *, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of ``similar_groups``: the one with the smallest id.  Rows with one
    id stay or go as their texts do; a null id gives way to any other, and stays if its group has
    no other."""
    found = similar_groups(docs.select(id_col, text_col), k=k, id_col=id_col, text_col=text_col)
    gone_id, gone_hash = storage.free(docs.columns, "id"), storage.free(docs.columns, "hash")
    gone = found.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash)).distinct()
    gone, _ = storage.write_table(gone, "similar")
    return docs.join(storage.broadcast_if_small(gone, SMALL), F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_hash)), "left_anti")

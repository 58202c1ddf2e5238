"""Benchmark decontamination: training texts scanned for the word windows of test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is ``n``
consecutive words of an item; an item of fewer words (but not none) is one window.  The windows'
64-bit hashes go to the executors as a broadcast set.  Each text's windows are looked up there, and
every hit is verified against the item's own words before it counts.

The broadcast is bounded: a set holds the items of at most ``block_bytes`` of text, as plain arrays (the
text, and 32 bytes for each window: hash, place and item).  A larger benchmark makes several
sets.  Documents are read once: a task buffers ``CHUNK_BYTES`` of texts and takes the sets one after the other, one in
memory at a time.  An item longer than a set is a set of its own.

Defined results.  Null and empty texts have no words and no hits.  Null or empty items have no
windows; an item with null ``item_id`` marks hits but adds nothing to ``items``.  Repeated items,
repeated rows and repeated ids each count as they stand; ``items`` holds distinct ids.  Empty
tables give empty or clean results.  Input columns are kept; result columns are named by
``prefix``, which is ended in underscores while the input has a column of such a name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import words

BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 32 << 20
_RUNS = words.RunHash(5)


@dataclass
class Windows:
    """The distinct windows of one width: hashes, ascending, where each stands in the items' words, and
    whose it is (``owners[at[i] : at[i + 1]]``)."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    owners: np.ndarray


class WindowSet:
    """The windows of a block of items, by width."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], n: int):
        items = list(items)
        self.ids = [item_id for item_id, _ in items]
        texts, size, parts = [], 0, {}
        for block in words.blocks(pa.array([text or "" for _, text in items], pa.large_string()), words.ALNUM, lower=True):
            text, begin, end = words.joined(block, words.ALNUM)
            counts = np.diff(block.bounds)
            prefix = _RUNS.prefix(words.word_hashes(block))
            for width in np.unique(np.minimum(counts, n)[counts > 0]).tolist():
                first = words.window_starts(block.bounds, width)
                row = np.searchsorted(block.bounds, first, side="right") - 1
                mine = np.minimum(counts[row], n) == width
                first, row = first[mine], row[mine]
                parts.setdefault(width, []).append((_RUNS.between(prefix, first, first + width), begin[first] + size, end[first + width - 1] + size, row + block.first))
            texts.append(text)
            size += len(text)
        self.text = b"".join(texts)
        self.widths = {width: self._distinct(*(np.concatenate(x) for x in zip(*found, strict=True))) for width, found in parts.items()}

    def _distinct(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> Windows:
        order = np.argsort(hashes, kind="stable")
        hashes, begin, end, owner = hashes[order], begin[order], end[order], owner[order]
        kind, heads = np.zeros(len(hashes), np.int64), [0]
        for i in range(1, len(hashes)):  # equal words are one window; words that share a hash only are not
            if hashes[i] == hashes[i - 1]:
                spelled, h = self.text[begin[i] : end[i]], len(heads) - 1
                while h >= 0 and hashes[heads[h]] == hashes[i] and self.text[begin[heads[h]] : end[heads[h]]] != spelled:
                    h -= 1
                if h >= 0 and hashes[heads[h]] == hashes[i]:
                    kind[i] = h
                    continue
            kind[i] = len(heads)
            heads.append(i)
        order = np.lexsort((owner, kind))
        kind, owner = kind[order], owner[order]
        new = np.ones(len(kind), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        counts = np.bincount(kind[new], minlength=len(heads))
        return Windows(hashes[heads], begin[heads], end[heads], np.append(0, np.cumsum(counts)).astype(np.int32), owner[new].astype(np.int32))

    def nbytes(self) -> int:
        return len(self.text) + sum(getattr(w, name).nbytes for w in self.widths.values() for name in w.__dataclass_fields__)


def scan(column: pa.Array, windows: WindowSet) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Each row's number of words; for rows with hits the word ranges that are hit and the items hit."""
    counts: list[int] = []
    hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for block in words.blocks(column, words.ALNUM, lower=True):
        prefix, body = _RUNS.prefix(words.word_hashes(block)), None
        for width, known in windows.widths.items():
            first = words.window_starts(block.bounds, width)
            hashes = _RUNS.between(prefix, first, first + width)
            place = np.searchsorted(known.hashes, hashes)
            found = np.flatnonzero(known.hashes[np.minimum(place, len(known.hashes) - 1)] == hashes)
            if not len(found):
                continue
            body = body or words.joined(block, words.ALNUM)
            rows = np.searchsorted(block.bounds, first[found], side="right") - 1
            for at, i, hashed, row in zip(first[found].tolist(), place[found].tolist(), hashes[found].tolist(), rows.tolist(), strict=True):
                spelled = body[0][body[1][at] : body[2][at + width - 1]]
                while i < len(known.hashes) and known.hashes[i] == hashed:
                    if windows.text[known.begin[i] : known.end[i]] == spelled:
                        spans, items = hits.setdefault(row + block.first, ([], set()))
                        start = at - int(block.bounds[row])
                        spans.append((start, start + width))
                        items.update(windows.ids[o] for o in known.owners[known.at[i] : known.at[i + 1]].tolist())
                        break
                    i += 1
        counts += np.diff(block.bounds).tolist()
    return counts, hits


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, ascending, that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _load(shared) -> WindowSet:
    """A broadcast set, read anew where the worker has it as a file, so that the last one can go."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path else shared.value


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    chunk, size = [], 0
    for batch in batches:
        chunk.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _scan_batches(batches: Iterator[pa.RecordBatch], sets: list, text_col: str, prefix: str) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    only = _load(sets[0]) if len(sets) == 1 else None
    for chunk in _chunks(batches) if only is None else ([batch] for batch in batches):
        counts = [[] for _ in chunk]
        found: list[dict[int, tuple[list[tuple[int, int]], set[str]]]] = [{} for _ in chunk]
        for shared in sets:
            windows = only or _load(shared)
            for number, batch in enumerate(chunk):
                counts[number], hits = scan(batch.column(text_col), windows)
                for row, (spans, items) in hits.items():
                    held = found[number].setdefault(row, ([], set()))
                    held[0].extend(spans)
                    held[1].update(items)
            del windows
        for batch, n_words, hits in zip(chunk, counts, found, strict=True):
            rows = [hits.get(row, ([], set())) for row in range(batch.num_rows)]
            made = {
                f"{prefix}n_words": pa.array(n_words, pa.int64()),
                f"{prefix}spans": pa.array([[{"start": s, "end": e} for s, e in merged(spans)] for spans, _ in rows], span),
                f"{prefix}items": pa.array([sorted(items - {None}) for _, items in rows], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Streams the items to the driver, a block at a time."""
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        n = len(text.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """The prefix that ``find_hits`` uses for these columns: none of them starts with it."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    return prefix


def find_hits(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "hit_", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``<prefix>n_words``, ``<prefix>spans`` (disjoint hit word ranges, end exclusive,
    ascending) and ``<prefix>items`` (sorted ids of items with an occurring window)."""
    prefix = free_prefix(docs, prefix)
    context = docs.sparkSession.sparkContext
    sets = [context.broadcast(WindowSet(items, n)) for items in item_blocks(benchmark, item_col, item_text_col, block_bytes)]
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}n_words", T.LongType()), T.StructField(f"{prefix}spans", _SPANS), T.StructField(f"{prefix}items", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(partial(_scan_batches, sets=sets, text_col=text_col, prefix=prefix), schema)


def n_hit(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated(n_words, spans):
    """At least a twentieth of the words, and at least one, lie in windows of the benchmark."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    prefix = options["prefix"] = free_prefix(docs, options.get("prefix", "hit_"))
    found = find_hits(docs, benchmark, **options)
    return found.where(~is_contaminated(F.col(f"{prefix}n_words"), F.col(f"{prefix}spans"))).select(*docs.columns)


def _cut_batches(batches: Iterator[pa.RecordBatch], text_col: str, prefix: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(text_col)
        texts, row = column.to_pylist(), 0
        spans = batch.column(f"{prefix}spans").to_pylist()
        for block in words.blocks(column, words.ALNUM, lower=True):
            for r in range(block.rows):
                if spans[row]:
                    raw, at, base, kept = texts[row].encode(), 0, int(block.offsets[r]), []
                    for span in spans[row]:
                        word = int(block.bounds[r])
                        kept.append(raw[at : int(block.starts[word + span["start"]]) - base])
                        at = int(block.ends[word + span["end"] - 1]) - base
                    texts[row] = b"".join([*kept, raw[at:]]).decode()
                row += 1
        columns = [pa.array(texts, pa.string()) if name == text_col else batch.column(name) for name in batch.schema.names if not name.startswith(prefix)]
        yield pa.RecordBatch.from_arrays(columns, [name for name in batch.schema.names if not name.startswith(prefix)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents; the text from the first to the last word of each hit range is cut out."""
    prefix = options["prefix"] = free_prefix(docs, options.get("prefix", "hit_"))
    found = find_hits(docs, benchmark, **options)
    return found.mapInArrow(partial(_cut_batches, text_col=options.get("text_col", "text"), prefix=prefix), docs.schema)

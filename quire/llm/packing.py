"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Only the lengths matter for packing, and there are at most ``capacity`` of them, so the packing is
planned on the driver over a histogram whose size doesn't grow with the corpus:

* reduction, from the longest length down.  A bin {a} is fixed where nothing fits beside a; {a, b}
  where b fills the rest exactly, where at most one more piece fits and b is the longest that does,
  and where at most two more fit and no two of them together are longer than b.  In each case the
  fixed set dominates: whatever else might stand beside a can change places with b.  All copies of
  a case are fixed at once;
* best fit in decreasing order for the lengths that are left: each goes to the bins with the least
  room that is enough.

The plan is a list of runs: pieces ``lo`` to ``hi`` of one length, by rank, go to consecutive bins,
so many a bin, from one offset on.  Ranks within a length are made in Spark, over salted groups and
prefix sums of the groups' counts, so a frequent length is no hot task.

Defined results: null and empty texts are one piece holding the end id; longer documents are cut
into pieces of ``capacity`` ids, the last may be shorter; equal rows are pieces like any other;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import storage, tokens

#: Groups of equal length among which ranks are dealt.
SALT = 64


class Plan:
    """Where the pieces of each length go; ``runs`` are (length, lo, hi, first bin, a bin, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        if any(not 1 <= length <= capacity for length in histogram):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        self.capacity, self.bins, self.fixed_bins = capacity, 0, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._left = {length: n for length, n in histogram.items() if n > 0}
        self._lengths = sorted(self._left)
        self._ranked = dict.fromkeys(self._left, 0)
        self._reduce()
        self.fixed_bins = self.bins
        self._best_fit()

    def _place(self, length: int, n: int, bin_: int, each: int, offset: int) -> None:
        lo = self._ranked[length]
        self.runs.append((length, lo, lo + n, bin_, each, offset))
        self._ranked[length] = lo + n
        self._left[length] -= n
        if not self._left[length]:
            del self._left[length]
            self._lengths.pop(bisect.bisect_left(self._lengths, length))

    def _fix(self, a: int, b: int | None, times: int) -> None:
        first, self.bins = self.bins, self.bins + times
        if b == a:
            self._place(a, 2 * times, first, 2, 0)
            return
        self._place(a, times, first, 1, 0)
        if b is not None:
            self._place(b, times, first, 1, a)

    def _smallest(self, n: int, beside: int) -> list[int]:
        """The n shortest pieces left, one piece of length ``beside`` set apart."""
        out: list[int] = []
        for length in self._lengths:
            out += [length] * min(n - len(out), self._left[length] - (length == beside))
            if len(out) == n:
                break
        return out

    def _longest(self, room: int, beside: int) -> int | None:
        at = bisect.bisect_right(self._lengths, room) - 1
        if at >= 0 and self._lengths[at] == beside and self._left[beside] == 1:
            at -= 1
        return self._lengths[at] if at >= 0 else None

    def _longest_two(self, room: int, beside: int) -> int:
        """The largest sum, within ``room``, of two pieces left."""
        best, hi = 0, bisect.bisect_right(self._lengths, room) - 1
        for lo, short in enumerate(self._lengths):
            while hi >= lo and short + self._lengths[hi] > room:
                hi -= 1
            if hi < lo:
                break
            for at in (hi, hi - 1, hi - 2):  # one length may lack the copies that a pair needs
                need = {short: 2} if at >= 0 and self._lengths[at] == short else {short: 1, self._lengths[at]: 1}
                if at >= lo and all(self._left[x] - (x == beside) >= n for x, n in need.items()):
                    best = max(best, short + self._lengths[at])
                    break
        return best

    def _reduce(self) -> None:
        for a in sorted(self._left, reverse=True):
            while a in self._left:
                room, n = self.capacity - a, self._left[a]
                b = self._longest(room, a)
                if b is None:
                    self._fix(a, None, 1 if 2 * a <= self.capacity else n)
                    continue
                times = n // 2 if b == a else min(n, self._left[b])
                if b == room:
                    self._fix(a, b, times)
                    continue
                few = self._smallest(3, a)
                if len(few) < 2 or few[0] + few[1] > room:
                    self._fix(a, b, times if len(few) > 2 else 1)
                elif (len(few) < 3 or sum(few) > room) and self._longest_two(room, a) <= b:
                    self._fix(a, b, 1)
                else:
                    break

    def _best_fit(self) -> None:
        rooms: list[int] = []  # sorted; rooms[i] has the bins open[rooms[i]]
        open_: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    bisect.insort(rooms, room)
                    open_[room] = []
                open_[room].append((first, n))

        for length in sorted(self._left, reverse=True):
            while length in self._left:
                at = bisect.bisect_left(rooms, length)
                n = self._left[length]
                if at == len(rooms):
                    bins = -(-n // (self.capacity // length))
                    put(self.capacity, self.bins, bins)
                    self.bins += bins
                    continue
                room = rooms[at]
                first, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                each = min(room // length, n)
                take = min(bins, n // each)
                self._place(length, take * each, first, each, self.capacity - room)
                put(room - each * length, first, take)
                put(room, first + take, bins - take)

    def lookup(self) -> dict[str, np.ndarray]:
        """The runs as columns, ordered by length and rank."""
        rows = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        return dict(zip(["length", "lo", "hi", "bin", "each", "offset"], rows.T.copy(), strict=True))


def _assign_batches(batches: Iterator[pa.RecordBatch], runs: dict[str, np.ndarray], length_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    top = int(max(runs["hi"].max(initial=0), 1))
    keys = runs["length"].astype(object) * top + runs["lo"] if top > 1 << 48 else runs["length"] * top + runs["lo"]
    for batch in batches:
        length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.searchsorted(keys, length.astype(keys.dtype) * top + rank, side="right") - 1
        nth = rank - runs["lo"][run]
        made = [pa.array(runs["bin"][run] + nth // runs["each"][run]), pa.array(runs["offset"][run] + nth % runs["each"][run] * length)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "sequence_id", "offset"])


def pack(pieces: DataFrame, *, capacity: int = 4096, length_col: str = "length", order: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` must be a stored table, as it is
    read twice; ``order`` are columns that tell its rows apart (equal rows may change places)."""
    keep, counts = pieces.columns, [tuple(r) for r in pieces.groupBy(length_col).agg(F.count("*")).collect()]
    plan = Plan({r[0]: r[1] for r in counts}, capacity)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALT)).cast("int"))
    groups = salted.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(length_col).orderBy("_salt")) - F.col("_n")
    groups = groups.select(F.col(length_col).alias("_length"), F.col("_salt").alias("_group"), before.alias("_before"))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(groups, (F.col(length_col) == F.col("_length")) & (F.col("_salt") == F.col("_group")))
    ranked = ranked.select(*keep, (F.col("_before") + F.col("_nth")).alias("_rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(partial(_assign_batches, runs=plan.lookup(), length_col=length_col, keep=keep), schema)


def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, pieces, end_id: int | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, tail = tokens.encoder(tokenizer, pieces), np.array([] if end_id is None else [end_id], np.uint32)
    for batch in batches:
        out: list[tuple] = []
        size = 0

        def flush(out=out):
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[: len(columns)], strict=True)], names[: len(columns)])

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate([encoder.encode(text.as_py()), tail]).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                raw = ids[start : start + capacity].tobytes()
                out.append((doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                size += len(raw) * with_ids
            if size > 16 << 20:
                yield flush()
                out.clear()
                size = 0
        if out:
            yield flush()


def token_pieces(docs: DataFrame, tokenizer: str, *, pieces=tokens.WORD_PIECES, end_id: int | None = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids, the end id last, cut into pieces: ``(doc_id, piece, start, length,
    ids_crc32)`` and, ``with_ids``, the ids as little-endian unsigned 32-bit numbers."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return source.mapInArrow(partial(_piece_batches, tokenizer=tokenizer, pieces=pieces, end_id=end_id, capacity=capacity, with_ids=with_ids), schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, with_ids: bool = False, **options) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``."""
    stored, _ = storage.write_table(token_pieces(docs, tokenizer, capacity=capacity, with_ids=with_ids, **options), "pieces")
    return pack(stored, capacity=capacity, order=["doc_id", "piece", "start", "ids_crc32"])


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from pieces packed ``with_ids``: at most ``capacity`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

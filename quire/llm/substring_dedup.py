"""Exact substring dedup over words, with recompression to reveal what repeats.

A document's words (``[^\\x20\\x09-\\x0D]+``, unchanged) are recompressed: each round names every
maximal run of one symbol, then every pair of a left and a right symbol, sides being a coin of the
name.  A name is a 64-bit hash of what it stands for, so all tasks of a Spark round give equal
substrings equal interior symbols without a shared dictionary.  A symbol's *context* is the words
that settle its place and name: wherever those words occur, it occurs.

A window of ``width`` words stands under the smallest-hashed symbol of the highest level whose
context lies within the window, keyed by the words of that context (by its own words, should no
symbol fit, as in long runs).  Equal windows stand under equal keys, and about one word in four starts a
new key.  Neighbouring windows under one key make a *stretch*.  So the work is:

1. documents are dealt into cells of about ``CELL_BYTES``; each cell sends its distinct keys, which
   meet by hash: keys of two documents or more come back to their cells;
2. each cell sends the stretches under those keys, once each, as their words, with the smallest id that
   holds them; where they meet, windows are told apart by their words, and the windows that a cell
   holds with a larger id come back to it, again as words, with the smallest id overall;
3. each cell looks its windows up among those, word for word, and removes the words of windows that
   start in a document with a smaller id.

Hashes only bring together what may be equal.  What is removed was compared as words twice, so no
collision can remove a word.  Keys and stretches travel packed, one row for each pair of cell and bucket
that has any, so a passage in a third of all documents is one entry a cell.  The bucket count follows
the input's size alone.  Repeated rows are dealt by their input partition too, not all into one cell.

Defined results: null and empty texts have no words; documents with fewer words than a window are
whole; equal ids are not smaller than one another; a null id is larger than all others; an empty
table gives an empty table.  Only the id and the results are returned, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words

CELL_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
LEVELS = 2
NO_ID = np.iinfo(np.int64).max
_CONTEXT, _WINDOW = words.RunHash(21), words.RunHash(22)
_NAMES = [np.uint64(2 * n + 1) for n in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)]


def levels(names: np.ndarray, bounds: np.ndarray, rounds: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each round of recompression, the contexts of the symbols as (starts, ends) in words.

    Both ascend.  A context that reaches beyond its document, where only the document's edge settled
    a symbol, ends one word outside it."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lo, hi = bounds[:-1] - 1, bounds[1:] + 1
    starts, ends = np.arange(len(names)), np.arange(1, len(names) + 1)
    for salt in range(1, rounds + 1):
        n = len(names)
        if not n:
            yield starts, ends
            continue
        # runs: the neighbours on both sides settle that a run ends there
        new = np.ones(n, dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        after = np.append(first[1:], n)
        size = (after - first).astype(np.uint64)
        left, right = np.maximum(first - 1, 0), np.minimum(after, n - 1)
        run_doc = doc[first]
        run_starts = np.where((first > 0) & (doc[left] == run_doc), starts[left], lo[run_doc])
        run_ends = np.where((after < n) & (doc[right] == run_doc), ends[right], hi[run_doc])
        names = np.where(size == 1, names[first], words.mix(names[first] * _NAMES[0] + size))
        doc, starts, ends, n = run_doc, run_starts, run_ends, len(first)
        # pairs: a left symbol and the right symbol behind it
        right_side = (words.mix(names + np.uint64(salt) * _NAMES[1]) & np.uint64(1)).astype(bool)
        same = np.zeros(n + 1, dtype=bool)  # same[i]: symbols i - 1 and i are of one document
        same[1:n] = doc[1:] == doc[:-1]
        opens = np.zeros(n, dtype=bool)
        opens[:-1] = ~right_side[:-1] & right_side[1:] & same[1:n]
        closes = np.zeros(n, dtype=bool)
        closes[1:] = opens[:-1]
        nxt, prev = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        looks_right = ~right_side  # a pair, or a left symbol that found no right one
        ends = np.where(looks_right, np.where(same[1:], ends[nxt], hi[doc]), ends)
        alone = right_side & ~closes
        starts = np.where(alone, np.where(same[:n], starts[prev], lo[doc]), starts)
        names = np.where(opens, words.mix(names * _NAMES[2] + words.mix(names[nxt] + _NAMES[0])), names)
        keep = ~closes
        names, doc, starts, ends = names[keep], doc[keep], starts[keep], ends[keep]
        yield starts, ends


def window_keys(names: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the key that each stands under."""
    first = words.window_starts(bounds, width)
    prefix = _CONTEXT.prefix(names)
    keys = _CONTEXT.between(prefix, first, first + width)
    rest = np.arange(len(first))
    for starts, ends in reversed(list(levels(names, bounds))):
        fits = ends - starts <= width
        starts, ends = starts[fits], ends[fits]
        if not len(rest) or not len(starts):
            continue
        inside = np.clip(starts, 0, len(names)), np.clip(ends, 0, len(names))
        hashes = _CONTEXT.between(prefix, *inside)
        at = np.searchsorted(starts, first[rest], side="left")
        end = np.searchsorted(ends, first[rest] + width, side="right")
        some = at < end
        todo, at, end = rest[some], at[some], end[some]
        rest = rest[~some]
        best, active = hashes[at], np.arange(len(todo))
        while len(active):
            at[active] += 1
            active = active[at[active] < end[active]]
            best[active] = np.minimum(best[active], hashes[at[active]])
        keys[todo] = best
    return first, keys


def _cuts(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start, and the end."""
    return np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]]) if len(numbers) else np.zeros(1, np.int64)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit hashes each key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(arrays: list[np.ndarray], cuts: np.ndarray) -> list[pa.Array]:
    """Each array's parts between cuts, as bytes."""
    return [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()) for x in arrays]


def _folded(stretches: list[bytes], cuts: np.ndarray) -> pa.Array:
    """The stretches between cuts, divided by newlines and compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(b"\n".join(stretches[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _unfolded(table: pa.Table) -> list[bytes]:
    return [zstandard.ZstdDecompressor().decompress(x) for x in table.column("bodies").to_pylist()]


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _rows_of(table: pa.Table, column: str, kind) -> np.ndarray:
    """For each element of the joined arrays, the row it came from."""
    return np.repeat(np.arange(table.num_rows), [len(x) // np.dtype(kind).itemsize for x in table.column(column).to_pylist()])


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(table: pa.Table) -> Iterator[tuple[words.Block, np.ndarray]]:
    for block in words.blocks(table.column("body"), words.NOT_SPACE, lower=False):
        yield block, words.word_hashes(block)


def _send_keys(table: pa.Table, width: int, buckets: int) -> pa.Table:
    """The distinct keys of a cell, and which are of two of its documents."""
    ids, found = _ids(table), []
    for block, names in _blocks(table):
        first, keys = window_keys(names, block.bounds, width)
        owner = ids[np.searchsorted(block.bounds, first, side="right") - 1 + block.first]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        found.append((keys[new], owner[new]))
    keys, owners = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    last = np.append(start[1:], len(keys)) - 1
    several = owners[start] != owners[last] if len(keys) else np.zeros(0, dtype=bool)
    keys = keys[start]
    bucket = _buckets(keys, buckets)
    cuts = _cuts(bucket)
    cell = np.full(len(cuts) - 1, table.column("cell")[0].as_py())
    return pa.table([pa.array(bucket[cuts[:-1]]), pa.array(cell, pa.int64()), *_packed([keys, several.astype(np.uint8)], cuts)], names=["bucket", "cell", "keys", "several"])


def _meet_keys(table: pa.Table) -> pa.Table:
    """Keys of two documents or more, for each cell that has them."""
    keys, several = _joined(table, "keys", np.uint64), _joined(table, "several", np.uint8).astype(bool)
    cell = table.column("cell").to_numpy()[_rows_of(table, "keys", np.uint64)]
    unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    shared |= np.bincount(place, weights=several, minlength=len(unique)) > 0
    mask = shared[place]
    order = np.argsort(cell[mask], kind="stable")
    keys, cell = keys[mask][order], cell[mask][order]
    cuts = _cuts(cell)
    return pa.table([pa.array(cell[cuts[:-1]], pa.int64()), *_packed([keys], cuts)], names=["cell", "keys"])


def _send_stretches(table: pa.Table, marks: pa.Table, width: int, buckets: int) -> pa.Table:
    """The distinct stretches under shared keys, with the smallest id that holds them in the cell and whether
    another one does too."""
    ids, shared = _ids(table), np.sort(_joined(marks, "keys", np.uint64))
    found: dict[bytes, list[int]] = {}  # key, smallest id, largest id
    for block, names in _blocks(table) if len(shared) else ():
        first, keys = window_keys(names, block.bounds, width)
        mine = shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys
        first, keys = first[mine], keys[mine]
        row = np.searchsorted(block.bounds, first, side="right") - 1
        new = np.ones(len(first), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (first[1:] != first[:-1] + 1) | (row[1:] != row[:-1])
        begins = np.flatnonzero(new)
        last = np.append(begins[1:], len(first)) - 1 if len(first) else begins
        text, begin, end = words.joined(block)
        owners = ids[row[begins] + block.first]
        for a, b, key, owner in zip(begin[first[begins]].tolist(), end[first[last] + width - 1].tolist(), keys[begins].tolist(), owners.tolist(), strict=True):
            held = found.setdefault(text[a:b], [key, owner, owner])
            if owner < held[1]:
                held[1] = owner
            elif owner > held[2]:
                held[2] = owner
    stretches = sorted(found.items(), key=lambda x: (x[1][0], x[0]))
    key = np.array([x[1][0] for x in stretches], np.uint64)
    least, most = (np.array([x[1][i] for x in stretches], np.int64) for i in (1, 2))
    bucket = _buckets(key, buckets)
    cuts = _cuts(bucket)
    cell = np.full(len(cuts) - 1, table.column("cell")[0].as_py() if table.num_rows else 0)
    bodies = _folded([x[0] for x in stretches], cuts)
    return pa.table([pa.array(bucket[cuts[:-1]]), pa.array(cell, pa.int64()), bodies, *_packed([least, (least != most).astype(np.uint8)], cuts)], names=["bucket", "cell", "bodies", "owner", "several"])


def _parsed(bodies: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that newlines divide: their text, and of each of their windows the number of its stretch and
    where it begins and ends."""
    text = b"\n".join(bodies)
    raw = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero((raw == 32) | (raw == 10))
    begin, end = np.append(0, breaks + 1), np.append(breaks, len(raw))
    bounds = np.append(np.append(0, np.flatnonzero(raw[breaks] == 10) + 1), len(begin))
    if not len(raw):
        return text, *(np.zeros(0, np.int64),) * 3
    first = words.window_starts(bounds, width)
    return text, np.searchsorted(bounds, first, side="right") - 1, begin[first], end[first + width - 1]


def _meet_stretches(table: pa.Table, width: int) -> pa.Table:
    """The windows that a cell holds with a larger id than the smallest overall, as stretches again."""
    owner, several = _joined(table, "owner", np.int64), _joined(table, "several", np.uint8).astype(bool)
    cell = table.column("cell").to_numpy()[_rows_of(table, "owner", np.int64)]
    text, stretch, begin, end = _parsed(_unfolded(table), width)
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(text[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, which, owner[stretch])
    least = least[which]
    tell = np.flatnonzero((least < owner[stretch]) | several[stretch])
    tell = tell[np.argsort(cell[stretch[tell]], kind="stable")]
    new = np.ones(len(tell), dtype=bool)
    new[1:] = (tell[1:] != tell[:-1] + 1) | (stretch[tell[1:]] != stretch[tell[:-1]])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(tell)) if len(tell) else begins
    to = cell[stretch[tell[begins]]]
    cuts = _cuts(to)
    bodies = [text[a:b] for a, b in zip(begin[tell[begins]].tolist(), end[tell[ends - 1]].tolist(), strict=True)]
    return pa.table([pa.array(to[cuts[:-1]], pa.int64()), _folded(bodies, cuts), *_packed([least[tell]], np.append(begins, len(tell))[cuts])], names=["cell", "bodies", "owner"])


def _hashes(bodies: list[bytes], width: int) -> np.ndarray:
    """The hash of each window of stretches, as documents' windows are hashed."""
    column, out = pa.array([b.decode() for x in bodies for b in x.split(b"\n")], pa.large_string()), []
    for block in words.blocks(column, words.NOT_SPACE, lower=False):
        first = words.window_starts(block.bounds, width)
        out.append(_WINDOW.between(_WINDOW.prefix(words.word_hashes(block)), first, first + width))
    return np.concatenate(out)


def _remove(table: pa.Table, marks: pa.Table, width: int) -> pa.Table:
    ids, bodies = _ids(table), _unfolded(marks)
    text, _, begin, end = _parsed(bodies, width)
    earlier = dict(zip((text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)), _joined(marks, "owner", np.int64).tolist(), strict=True))
    known = np.unique(_hashes(bodies, width)) if len(begin) else np.zeros(0, np.uint64)
    n_words, n_removed, kept = [], [], []
    for block, names in _blocks(table):
        gone = np.zeros(len(names) + 1, np.int64)
        if len(known):
            first = words.window_starts(block.bounds, width)
            hashes = _WINDOW.between(_WINDOW.prefix(names), first, first + width)
            first = first[known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes]
            body, begin, end = words.joined(block)
            owner = ids[np.searchsorted(block.bounds, first, side="right") - 1 + block.first]
            smallest = np.fromiter((earlier.get(body[a:b], NO_ID) for a, b in zip(begin[first].tolist(), end[first + width - 1].tolist(), strict=True)), np.int64, len(first))
            hit = first[smallest < owner]
            gone[hit] += 1
            np.subtract.at(gone, hit + width, 1)
        gone = np.cumsum(gone[:-1]) > 0
        total = np.append(0, np.cumsum(gone))
        n_words.append(np.diff(block.bounds))
        n_removed.append(total[block.bounds[1:]] - total[block.bounds[:-1]])
        kept.append(_kept_text(block, ~gone))
    if not n_words:
        return _RESULT.empty_table()
    return pa.table(
        [table.column("id").combine_chunks(), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.chunked_array(kept, pa.string())],
        schema=_RESULT,
    )


_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept_text(block: words.Block, keep: np.ndarray) -> pa.Array:
    """Each row's kept words, joined by one blank."""
    starts, ends, rows = block.starts[keep], block.ends[keep], words.row_of_words(block)[keep]
    edge = np.zeros(len(block.data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1  # words are apart, so no place starts one and ends another
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    later = np.zeros(len(starts), dtype=bool)
    later[1:] = rows[1:] == rows[:-1]
    data = block.data.copy()
    data[starts[later] - 1] = 32
    mask[starts[later] - 1] = True
    offsets = np.append(0, np.cumsum(mask))[block.offsets].astype(np.int32)
    return pa.StringArray.from_buffers(block.rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes()))


def dedup_substrings(docs: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", cell_bytes: int = CELL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept)``; ``kept`` is the words that stay, joined by one blank."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    total = source.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    cells, buckets = int(total // cell_bytes) + 1, int(total // bucket_bytes) + 1
    dealt = source.withColumn("cell", F.pmod(F.xxhash64("id", "body", F.spark_partition_id()), F.lit(cells))).repartition("cell")

    def send_keys(table):
        return _send_keys(table, width, buckets)

    def send_stretches(table, marks):
        return _send_stretches(table, marks, width, buckets)

    def meet_stretches(table):
        return _meet_stretches(table, width)

    def remove(table, marks):
        return _remove(table, marks, width)

    keys = dealt.groupBy("cell").applyInArrow(send_keys, "bucket long, cell long, keys binary, several binary")
    shared = keys.groupBy("bucket").applyInArrow(_meet_keys, "cell long, keys binary")
    stretches = dealt.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(send_stretches, "bucket long, cell long, bodies binary, owner binary, several binary")
    earlier = stretches.groupBy("bucket").applyInArrow(meet_stretches, "cell long, bodies binary, owner binary")
    return dealt.groupBy("cell").cogroup(earlier.groupBy("cell")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string")

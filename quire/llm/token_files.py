"""Token ids in binary files: fixed-width bit packing with block offsets.

Layout of a file, all numbers little-endian:

* header, 48 bytes: ``QTID``, version (u32), bits an id (u32), ids a block (u32), ids (u64),
  documents (u64), place of the block offsets (u64), place of the document table (u64);
* blocks: each packs its ids at the minimum bits for the vocabulary, lowest bit first, ended to a
  whole byte;
* block offsets: blocks + 1 places in the file (u64);
* document table: starts (documents + 1, u64, ids before each document in this file), ids of the
  documents (i64), and one byte each that is 1 where the document has no id.

Any range of ids is read by seeking to its blocks.  ``write_token_files`` writes documents in
ascending id order (null ids first, equal ids by a hash of their text; empty and null texts hold
just the end id) as one or more files a task, under names no other attempt uses; the returned
manifest lists the files of the attempts that counted, in order, so lost executors and repeated
tasks leave no wrong file in use.  Files close at ``file_ids`` ids; a task keeps at most one file
of packed ids plus one document in memory.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import storage, tokens

MAGIC, VERSION = b"QTID", 1
HEADER = struct.Struct("<4sIIIQQQQ")
BLOCK_IDS = 4096


def width_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class FileWriter:
    """Collects documents and gives the bytes of one file."""

    def __init__(self, width: int):
        self.width, self.blocks, self.rest, self.starts, self.doc_ids = width, [], [], [0], []
        self._pending = 0

    @property
    def ids(self) -> int:
        return self.starts[-1]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self._pending += len(ids)
        if self._pending >= 64 * BLOCK_IDS:
            self._pack(False)

    def _pack(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        self.blocks += [pack(ids[i : min(i + BLOCK_IDS, whole)], self.width) for i in range(0, whole, BLOCK_IDS)]
        self.rest, self._pending = [ids[whole:]], len(ids) - whole

    def parts(self) -> Iterator[bytes]:
        self._pack(True)
        places = HEADER.size + np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype("<u8")
        table = int(places[-1]) + places.nbytes
        yield HEADER.pack(MAGIC, VERSION, self.width, BLOCK_IDS, self.ids, len(self.doc_ids), int(places[-1]), table)
        yield from self.blocks
        yield places.tobytes()
        yield np.array(self.starts, "<u8").tobytes()
        yield np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        yield np.array([d is None for d in self.doc_ids], np.uint8).tobytes()


@dataclass
class FileReader:
    """Random access to the ids of one open file."""

    handle: object

    def __post_init__(self):
        magic, version, self.width, self.block_ids, self.ids, self.documents, offsets, table = HEADER.unpack(self.handle.read_at(HEADER.size, 0))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file of this version")
        self.places = np.frombuffer(self.handle.read_at(table - offsets, offsets), "<u8").astype(np.int64)
        n = self.documents
        rows = self.handle.read_at(17 * n + 8, table)
        self.starts = np.frombuffer(rows, "<u8", n + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(rows, "<i8", n, 8 * (n + 1))
        self.no_id = np.frombuffer(rows, np.uint8, n, 8 * (2 * n + 1)).astype(bool)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        data = self.handle.read_at(int(self.places[last + 1] - self.places[first]), int(self.places[first]))
        if self.block_ids * self.width % 8 == 0:  # whole bytes a block: neighbours unpack as one run
            ids = unpack(data, min(self.ids, (last + 1) * self.block_ids) - first * self.block_ids, self.width)
        else:
            base = self.places[first]
            ids = np.concatenate([unpack(data[self.places[b] - base : self.places[b + 1] - base], min(self.block_ids, self.ids - b * self.block_ids), self.width) for b in range(first, last + 1)])
        return ids[start - first * self.block_ids : end - first * self.block_ids]


def open_file(uri: str) -> FileReader:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return FileReader(fs.open_input_file(path))


def _store(uri: str, writer: FileWriter) -> str:
    name = f"{uri}/part-{uuid.uuid4().hex}.qtid"
    fs, path = pyarrow.fs.FileSystem.from_uri(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for part in writer.parts():
            out.write(part)
    return name


MANIFEST = "task int, part int, path string, documents long, ids long"


def _write_batches(batches: Iterator[pa.RecordBatch], uri: str, tokenizer: str, pieces, end_id: int | None, file_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(tokenizer, pieces)
    width, tail = width_for(encoder.vocab_size), np.array([] if end_id is None else [end_id], np.uint32)
    made, writer = [], FileWriter(width)

    def close():
        made.append((TaskContext.get().partitionId(), len(made), _store(uri, writer), len(writer.doc_ids), writer.ids))

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            writer.add(doc_id, np.concatenate([encoder.encode(text.as_py()), tail]))
            if writer.ids >= file_ids:
                close()
                writer = FileWriter(width)
    if writer.doc_ids:
        close()
    if made:
        yield pa.RecordBatch.from_pydict(dict(zip(["task", "part", "path", "documents", "ids"], map(list, zip(*made, strict=True)), strict=True)), schema=pa.schema([("task", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer: str, *, pieces=tokens.BYTE_PIECES, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None, file_ids: int = 8 << 20) -> list[dict]:
    """Writes the files and returns their manifest in ascending id order: path, documents, ids and
    ``start``, the ids in all files before."""
    spark = docs.sparkSession
    uri = uri or storage.new_path(spark, "tokens")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    ordered = source.repartitionByRange("id", F.xxhash64("body")).sortWithinPartitions("id", F.xxhash64("body"))
    write = partial(_write_batches, uri=uri, tokenizer=tokenizer, pieces=pieces, end_id=end_id, file_ids=file_ids)
    found = sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: (r["task"], r["part"]))
    start, out = 0, []
    for row in found:
        out.append({"path": row["path"], "documents": row["documents"], "ids": row["ids"], "start": start})
        start += row["ids"]
    return out


def _read_batches(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = open_file(path)
            yield from each(reader, start)


def _ids_of_rows(reader: FileReader, start: int) -> Iterator[pa.RecordBatch]:
    step = 256
    for lo in range(0, reader.documents, step):
        hi = min(lo + step, reader.documents)
        base = int(reader.starts[lo])
        ids = reader.read(base, int(reader.starts[hi]))
        cuts = reader.starts[lo : hi + 1] - base
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[lo:hi], mask=reader.no_id[lo:hi]),
                pa.array(reader.starts[lo:hi] + start),
                pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            ],
            ["doc_id", "start", "ids"],
        )


def _digests_of_rows(reader: FileReader, start: int) -> Iterator[pa.RecordBatch]:
    for batch in _ids_of_rows(reader, start):
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _manifest_table(spark, manifest: list[dict]) -> DataFrame:
    """One row and one task a file."""
    table = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return table.repartition(max(1, len(manifest)))


def read_token_files(spark, manifest: list[dict]) -> DataFrame:
    """``(doc_id, start, ids)`` from the files; ids as little-endian unsigned 32-bit numbers."""
    return _manifest_table(spark, manifest).mapInArrow(partial(_read_batches, each=_ids_of_rows), "doc_id long, start long, ids binary")


def read_digests(spark, manifest: list[dict]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, computed from the files where they are read."""
    return _manifest_table(spark, manifest).mapInArrow(partial(_read_batches, each=_digests_of_rows), "doc_id long, start long, n_tokens long, ids_crc32 long")

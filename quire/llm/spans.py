"""Spans found in texts: how per-text finders run over a table and how spans are written down.

A finder gives ``(start, end, kind)`` triples in code points, end exclusive.  Results carry spans
as an array of structs ordered by start, then by the order in which kinds are listed, then by end.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import storage

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _batches(batches: Iterator[pa.RecordBatch], make: Callable, text_col: str, name: str, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    find, place = make(), {kind: i for i, kind in enumerate(kinds)}
    for batch in batches:
        rows = []
        for text in batch.column(text_col):
            found = sorted(find(text.as_py() or ""), key=lambda s: (s[0], place[s[2]], s[1]))
            rows.append([{"kind": kind, "start": start, "end": end} for start, end, kind in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], [*batch.schema.names, name])


def with_spans(docs: DataFrame, make: Callable, kinds: tuple[str, ...], *, text_col: str, name: str) -> DataFrame:
    """``docs`` and a column of spans; ``make()`` builds the finder once for each task.  Where the
    input has a column of that name, the new one ends in as many underscores as make it free."""
    name = storage.free(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])
    return docs.mapInArrow(partial(_batches, make=make, text_col=text_col, name=name, kinds=kinds), schema)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def only(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _mask_batches(batches: Iterator[pa.RecordBatch], text_col: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(name).to_pylist(), strict=True):
            at, out = 0, []
            for span in spans or ():
                if span["end"] > at:
                    out += [text[at : max(at, span["start"])], f"[{span['kind']}]"] if span["start"] >= at else []
                    at = span["end"]
            texts.append(text if text is None else "".join([*out, text[at:]]))
        kept = [c for c in batch.schema.names if c != name]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in kept], kept)


def masked(found: DataFrame, *, text_col: str, name: str) -> DataFrame:
    """The table without its spans, each span in the text replaced by its kind in brackets; of
    overlapping spans the first names the place and all are covered."""
    schema = T.StructType([f for f in found.schema.fields if f.name != name])
    return found.mapInArrow(partial(_mask_batches, text_col=text_col, name=name), schema)

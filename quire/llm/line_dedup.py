"""Line dedup over overlapping windows of three lines.

Lines are what ``\\n`` separates.  Each window of ``width`` consecutive lines of a document gets a
128-bit hash; of all places that hold the same window the first, by document id and line, stays.
Every other place is a later occurrence: its lines are removed, and overlapping places are merged,
so a line goes if any later occurrence covers it.  Windows are judged on the input.

Places of a frequent window are never gathered: the first place is a minimum, combined before the
shuffle, and joins back by a sort-merge join that adaptive execution may split.

Defined results: texts of fewer lines than a window, null and empty texts stay as they are; rows
with one id and the same text are one document and are treated alike; rows with one id and different
texts are ordered by a hash of the text; null ids come before all others; empty tables stay empty.
Other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import storage

def removed_lines(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _hash, _cover)``: for each document with removed lines, first lines of the windows
    that are later occurrences."""
    lines = F.split(F.col(text_col), "\n")
    count = F.size("_lines") - width + 1
    keys = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i + 1, width), "\n"))))
    windows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), lines.alias("_lines")).where(F.size("_lines") >= width)
    places = windows.select("_id", "_hash", F.posexplode(keys).alias("_line", "_key"))
    first = places.groupBy("_key").agg(F.min(F.struct("_id", "_hash", "_line")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = places.join(first, "_key").where(~F.struct("_id", "_hash", "_line").eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_hash").agg(F.collect_set("_line").alias("_cover"))


def dedup_lines(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the removed lines cut from their texts; ``count_col``, its name ended in underscores
    while the input has such a column, gets how many went."""
    gone = removed_lines(docs, width=width, id_col=id_col, text_col=text_col).alias("g")
    joined = docs.alias("d").join(gone, F.col(f"d.{id_col}").eqNullSafe(F.col("g._id")) & (F.xxhash64(f"d.{text_col}") == F.col("g._hash")), "left")
    lines = F.split(F.col(f"d.{text_col}"), "\n")
    covered = F.array_distinct(F.flatten(F.transform("g._cover", lambda p: F.sequence(p, p + width - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda i: F.get(lines, i))
    text = F.when(F.col("g._cover").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns]
    if count_col is not None:
        columns.append(F.coalesce(F.size(covered), F.lit(0)).cast("long").alias(storage.free(docs.columns, count_col)))
    return joined.select(*columns)

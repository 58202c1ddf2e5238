"""Text lines: the rows on which recognition and extraction work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def text_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", height: float = 10.0, pitch: float = 12.0) -> DataFrame:
    """One row a line of plain text, boxes laid out by line number; no page size, so no provenance."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    y = F.col("line_no") * pitch
    return lines.select("doc_id", "line_no", "text", F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(1000.0).alias("x1"), (y + height).alias("y1"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("page_index"), F.lit(0.0).alias("page_width"), F.lit(0.0).alias("page_height"))


def document_text(lines: DataFrame) -> DataFrame:
    """``(doc_id, text)``: lines joined in reading order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def with_offsets(lines: DataFrame) -> DataFrame:
    """``char_start`` and ``char_end`` of each line in the joined text, end exclusive."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(before) - 1
    return lines.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("text"))


def text_scale(lines: DataFrame) -> DataFrame:
    """``(doc_id, scale)``: the median height of a document's lines, 0 where none has any."""
    height = F.col("y1") - F.col("y0")
    return lines.groupBy("doc_id").agg(F.coalesce(F.median(F.when(height > 0, height)), F.lit(0.0)).alias("scale"))


def mean_confidence(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))


def provenance(line) -> F.Column:
    """The box as shares of its page; null where the page's size is unknown."""
    w, h = line["page_width"], line["page_height"]
    box = F.array(line["x0"] / w, line["y0"] / h, line["x1"] / w, line["y1"] / h)
    return F.when((w > 0) & (h > 0), F.struct(line["page_index"].alias("page_index"), box.alias("bbox")))


def rescaled(lines: DataFrame, factor: float) -> DataFrame:
    """Boxes in other units, such as 72 / 200 from pixels to points."""
    return lines.withColumns({c: F.col(c) * factor for c in ("x0", "y0", "x1", "y1")})


def word_spans(line_text, words) -> F.Column:
    """Where each of ``words`` stands in a line, from left to right; words not found are skipped."""
    empty = F.array().cast("array<struct<start:int,end:int,word:string>>")

    def step(state, word):
        at = F.position(word, line_text, state["at"])
        found = F.struct((at - 1).alias("start"), (at - 1 + F.length(word)).alias("end"), word.alias("word"))
        return F.when((at > 0) & (word != ""), F.struct((at + F.length(word)).alias("at"), F.concat(state["spans"], F.array(found)).alias("spans"))).otherwise(state)

    return F.aggregate(words, F.struct(F.lit(1).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def image_dominant(chars, image_areas, page_area) -> F.Column:
    """Few characters beside images that cover over four fifths of the page."""
    covered = F.aggregate(image_areas, F.lit(0.0), lambda total, a: total + F.abs(a)) / page_area * 100
    return (chars < 600) & (page_area > 0) & (covered > 80)


def exploded_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of several lines as one row each, boxes kept; blank lines go."""
    parts = F.posexplode(text.paragraphs(F.col("text"))).alias("part_no", "part")
    kept = lines.select("*", parts).withColumn("text", F.col("part")).drop("part")
    order = Window.partitionBy("doc_id").orderBy("line_no", "part_no")
    return kept.withColumn("line_no", F.row_number().over(order) - 1).drop("part_no")


def reader_for(path) -> F.Column:
    """Which reader a file needs, or null for types that none reads."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(suffix.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"), "image")

"""Page conversion: what is missing, which ranges to try again, and the retry loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEDULE = (16, 8, 4, 2, 1)
LOW_LAYOUT = 0.8


def coverage(expected: Column, processed: Column, status: Column) -> Column:
    """``struct(expected_pages, processed_pages, missing_pages, complete, reasons)``."""
    want = F.array_sort(F.array_distinct(expected))
    missing = F.array_except(want, processed)
    clean = status.isNull() | (status == "success")
    gone = F.concat(F.lit("incomplete conversion: "), F.size(missing).cast("string"), F.lit(" of "), F.size(want).cast("string"), F.lit(" page(s) produced no result (dropped, likely out-of-memory): pages ["), F.array_join(missing.cast("array<string>"), ", "), F.lit("]"))
    unclean = F.concat(F.lit("converter status not a clean success: '"), status, F.lit("'"))
    reasons = F.array_compact(F.array(F.when(F.size(missing) > 0, gone), F.when(~clean, unclean)))
    return F.struct(F.size(want).alias("expected_pages"), (F.size(want) - F.size(missing)).alias("processed_pages"), missing.alias("missing_pages"), ((F.size(missing) == 0) & clean).alias("complete"), reasons.alias("reasons"))


def low_layout_pages(scores: Column, threshold: float = LOW_LAYOUT) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, s: s < threshold)))


def contiguous_runs(pages: DataFrame) -> DataFrame:
    """``(doc_id, run_start, run_end)`` of pages ``(doc_id, page)``."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.distinct().withColumn("_island", island).groupBy("doc_id", "_island").agg(F.min("page").alias("run_start"), F.max("page").alias("run_end")).drop("_island")


def ranges(runs: DataFrame, size: int) -> DataFrame:
    """Runs cut into ranges of at most ``size`` pages."""
    starts = F.explode(F.sequence(F.col("run_start"), F.col("run_end"), F.lit(size).cast("int"))).alias("range_start")
    return runs.select("doc_id", "run_end", starts).select("doc_id", "range_start", F.least(F.col("range_start") + size - 1, F.col("run_end")).alias("range_end"))


def check_schedule(schedule: list[int] | tuple[int, ...]) -> None:
    if not schedule or any(n <= 0 for n in schedule) or any(a <= b for a, b in zip(schedule, schedule[1:], strict=False)) or schedule[-1] != 1:
        raise ValueError(f"a schedule must be positive, strictly decreasing and end at 1: {schedule}")


def converter_status(status: Column) -> Column:
    return F.when(status == "SUCCESS", "success").when(status == "PARTIAL_SUCCESS", "partial_success").otherwise("failure")


def reconcile(documents: DataFrame, convert: Callable[[DataFrame], DataFrame], *, schedule=SCHEDULE) -> tuple[DataFrame, DataFrame]:
    """Converts in ranges of decreasing size until all pages are there or single pages fail.

    ``documents`` is ``(doc_id, pages)``; ``convert`` takes ranges ``(doc_id, range_start, range_end)``
    and returns ``(doc_id, range_start, range_end, page, layout_score, status)``, a row for each
    produced page (page null for a range that gave none).  Returns produced pages with their range's
    width and round, and the missing ones.  A round is one Spark job; there are as many as sizes."""
    check_schedule(schedule)
    everything = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    done: DataFrame | None = None
    for number, size in enumerate(schedule):
        left = everything if done is None else everything.join(done, ["doc_id", "page"], "left_anti")
        if done is not None and left.isEmpty():
            break
        made = convert(ranges(contiguous_runs(left), size)).where(F.col("page").between(F.col("range_start"), F.col("range_end")))
        now = made.select("doc_id", "page", "layout_score", (F.col("range_end") - F.col("range_start") + 1).alias("width"), F.lit(number).alias("round"))
        done = (now if done is None else done.unionByName(now)).persist()
    return done, everything.join(done, ["doc_id", "page"], "left_anti")


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """``(doc_id, attempts, nonclean)`` of attempts ``(doc_id, range_start, range_end, status)``: how many there were, and
    the ranges that were no clean success, in order."""
    odd = F.when(F.col("status") != "success", F.struct("range_start", "range_end", "status"))
    return attempts.groupBy("doc_id").agg(F.count("*").cast("int").alias("attempts"), F.array_sort(F.collect_list(odd)).alias("nonclean"))


def stream_name(head: Column) -> Column:
    """A page image's name by its first bytes: JPEG, else PNG."""
    return F.when(F.hex(F.substring(head, 1, 3)) == "FFD8FF", "page.jpg").otherwise("page.png")


def positioned_spans(items: DataFrame, pages: DataFrame, produced: DataFrame) -> DataFrame:
    """``(doc_id, item_no, page_no, text, page_width, page_height, x0, y0, x1, y1)`` of a converter's items ``(doc_id,
    item_no, page_no, text, l, t, r, b, bottom_left)`` on produced pages ``(doc_id, page_no)``; blank items go.

    Boxes count from the top left; those that count from the bottom are turned where the page's height is known.  A
    page whose width or height is missing or zero has no size, so its items have no place on it."""
    sized = pages.select("doc_id", "page_no", F.col("width").alias("_w"), F.col("height").alias("_h"))
    found = items.where(~F.col("text").rlike(r"(?U)^\s*$")).join(produced.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    turn = F.col("bottom_left") & F.col("_h").isNotNull()
    top, bottom = (F.when(turn, F.col("_h") - F.col(c)).otherwise(F.col(c)) for c in ("t", "b"))
    whole = (F.col("_w") != 0) & (F.col("_h") != 0)
    size = {"page_width": F.when(whole, F.col("_w")), "page_height": F.when(whole, F.col("_h"))}
    box = {"x0": F.least("l", "r"), "y0": F.least(top, bottom), "x1": F.greatest("l", "r"), "y1": F.greatest(top, bottom)}
    joined = found.join(sized, ["doc_id", "page_no"], "left")
    return joined.select("doc_id", "item_no", "page_no", "text", *(c.alias(name) for name, c in {**size, **box}.items()))

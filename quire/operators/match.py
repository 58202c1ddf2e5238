"""Template recognition: which declarative template a document's lines follow.

Anchors are compared on ``match_key``.  Containment is a native expression; only anchors that a
document holds nowhere exactly go to the fuzzy branch, an Arrow UDF over distinct pairs.
"""

from __future__ import annotations

import collections
import difflib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text

RATIO = 0.75
SHORTEST = 4
#: Needles that are broadcast at once, by number and by characters.
MOST_NEEDLES, MOST_CHARACTERS = 4096, 1 << 20
#: Characters of lines that are compared at once.
AT_ONCE = 1 << 20


def near_enough(needle: str, line: str) -> bool:
    """The needle, or a stretch about as long that differs by few characters, is in the line."""
    return bool(near_lines(needle, [line])[0])


def near_lines(needle: str, lines: list[str]) -> np.ndarray:
    """``near_enough`` of many lines at once."""
    out = np.array([bool(needle) and needle in line for line in lines], bool)
    if len(needle) < SHORTEST:
        return out
    some, held = [], 0
    for k in np.flatnonzero(~out).tolist():
        some.append(k)
        held += len(lines[k]) + 1
        if held > AT_ONCE:
            out[some] = _near_stretches(needle, [lines[k] for k in some])
            some, held = [], 0
    if some:
        out[some] = _near_stretches(needle, [lines[k] for k in some])
    return out


def _near_stretches(needle: str, lines: list[str]) -> np.ndarray:
    """Lines a stretch of which is like the needle.  How many letters a stretch shares with the needle, order aside, and then in
    order, bounds the likeness from above and is counted for all stretches at once; only those that could reach it are compared."""
    joined = "\n".join(lines)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(line) + 1 for line in lines]) - 1
    sizes = [size for size in range(len(needle) - 1, len(needle) + 2) if size <= len(codes)]
    kind = np.uint8 if len(needle) < 255 else np.int32  # counts of a stretch are right though those of the whole wrap around
    shared = {size: np.zeros(len(codes) - size + 1, kind) for size in sizes}
    letters = collections.Counter(needle)
    for letter, times in letters.items():
        before = np.zeros(len(codes) + 1, kind)
        np.cumsum(codes == ord(letter), dtype=kind, out=before[1:])
        for size, total in shared.items():
            total += np.minimum(before[size:] - before[:-size], kind(times))
    out = np.zeros(len(lines), bool)
    matcher = difflib.SequenceMatcher(None)
    known: dict[str, bool] = {}
    for size, total in shared.items():
        least = next(n for n in range(len(needle) + size + 1) if 2.0 * n / (len(needle) + size) >= RATIO)
        at = np.flatnonzero(total >= least) if least <= len(needle) else np.zeros(0, "int64")
        line = np.searchsorted(ends, at)
        able = (at + size <= ends[line]) & ~out[line]
        at, line = at[able], line[able]
        if len(needle) <= 64:
            able = _in_order(needle, codes, at, size) >= least
            at, line = at[able], line[able]
        for start, k in zip(at.tolist(), line.tolist(), strict=True):
            if not out[k]:
                stretch = joined[start : start + size]
                if stretch not in known:
                    matcher.set_seqs(needle, stretch)
                    known[stretch] = matcher.ratio() >= RATIO
                out[k] = known[stretch]
    return out


def _in_order(needle: str, codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Length of the longest common subsequence of the needle and each stretch: bits of a word are the needle's letters."""
    places: dict[int, int] = {}
    for k, letter in enumerate(needle):
        places[ord(letter)] = places.get(ord(letter), 0) | 1 << k
    known = np.array(sorted(places), np.uint32)
    masks = np.array([places[c] for c in known.tolist()] + [0], np.uint64)
    free = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for k in range(size):
        letter = codes[at + k]
        found = np.searchsorted(known, letter).clip(max=len(known) - 1)
        met = free & masks[np.where(known[found] == letter, found, len(known))]
        free = (free + met) | (free - met)
    return np.bitwise_count(~free & np.uint64((1 << len(needle)) - 1)).astype("int64")


@F.pandas_udf(T.BooleanType())
def _near(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for needles, lines in pairs:
        out = pd.Series(False, index=needles.index)
        for needle, some in lines.groupby(needles):
            out[some.index] = near_lines(needle, some.tolist())
        yield out


def templates_table(spark: SparkSession, templates: list[dict]) -> DataFrame:
    """Templates in their order, which decides among several that match."""
    rows = [(t["template_id"], i, t.get("category"), t.get("match", {}).get("all_anchors", []), json.dumps(t)) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, "template_id string, template_order int, category string, anchors array<string>, body string")


def read_templates(spark: SparkSession, folder: str, category: str | None = None) -> DataFrame:
    """Templates from JSON files, ordered by file name."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    made = files.select(
        F.get_json_object("value", "$.template_id").alias("template_id"),
        (F.row_number().over(Window.orderBy("file")) - 1).alias("template_order"),
        F.get_json_object("value", "$.category").alias("category"),
        F.from_json(F.get_json_object("value", "$.match.all_anchors"), "array<string>").alias("anchors"),
        F.col("value").alias("body"),
    )
    return made if category is None else made.where(F.col("category") == category)


def _anchors(templates: DataFrame) -> DataFrame:
    each = templates.select("template_id", "template_order", F.size("anchors").alias("needed"), F.posexplode("anchors").alias("anchor_no", "anchor"))
    return each.withColumn("needle", text.match_key(F.col("anchor")))


def _by_leading(keyed: DataFrame, needles: DataFrame) -> DataFrame:
    """Lines and the needles that they hold, by equality of a needle's first characters with some of a line's."""
    out = None
    for size in range(1, SHORTEST + 1):
        some = needles.where(F.length("needle") >= size if size == SHORTEST else F.length("needle") == size)
        starts = F.when(F.length("key") >= size, F.sequence(F.lit(1), F.length("key") - size + 1))
        grams = F.array_distinct(F.transform(starts, lambda at: F.col("key").substr(at, F.lit(size))))
        spread = keyed.select("doc_id", "line_no", "key", F.explode(grams).alias("lead"))
        met = spread.join(some.withColumn("lead", F.substring("needle", 1, size)), "lead").where(F.col("key").contains(F.col("needle")))
        out = met if out is None else out.unionByName(met)
    return out.select("doc_id", "needle", "line_no")


def find_anchors(lines: DataFrame, anchors: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """``(doc_id, needle, line_no)``: the first line that holds each needle.

    ``anchors`` has a column ``needle``.  Needles are counted first and are the broadcast side of the join while they
    are few; more of them meet lines by their leading characters, and the fuzzy branch takes them block by block."""
    keyed = lines.select("doc_id", "line_no", text.match_key(F.col("text")).alias("key"))
    needles = anchors.select("needle").where("needle <> ''").distinct()
    number, characters = needles.agg(F.count("*"), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    blocks = 1 + max(number // MOST_NEEDLES, characters // MOST_CHARACTERS)
    if blocks == 1:
        exact = keyed.join(F.broadcast(needles), F.col("key").contains(F.col("needle"))).select("doc_id", "needle", "line_no")
    else:
        exact = _by_leading(keyed, needles)
    if not fuzzy:
        return exact.groupBy("doc_id", "needle").agg(F.min("line_no").alias("line_no"))
    able, keys = needles.where(F.length("needle") >= SHORTEST), keyed.select("key").distinct()
    like = ~F.col("key").contains(F.col("needle")) & (F.length("key") >= F.length("needle") - 1)
    near = None
    for block in range(blocks):
        some = able if blocks == 1 else able.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block)
        found = keys.join(F.broadcast(some), like).select("key", "needle").where(_near("needle", "key"))
        near = found if near is None else near.unionByName(found)
    loose = keyed.join(near, "key").select("doc_id", "needle", "line_no")
    return exact.unionByName(loose).groupBy("doc_id", "needle").agg(F.min("line_no").alias("line_no"))


def match_templates(lines: DataFrame, templates: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """``(doc_id, template_id, template_order)``: the first template of which all anchors are found;
    a template without anchors matches nothing, a document without a match has no row."""
    anchors = _anchors(templates)
    found = find_anchors(lines, anchors, fuzzy=fuzzy)
    held = found.join(anchors, "needle").groupBy("doc_id", "template_id", "template_order", "needed").agg(F.count_distinct("anchor_no").alias("held"))
    return held.where("held = needed").groupBy("doc_id").agg(F.min_by("template_id", "template_order").alias("template_id"), F.min("template_order").alias("template_order"))


def verified_anchors(full_text, anchors) -> F.Column:
    """Proposed anchors that the text holds literally, case aside; blank ones go."""
    return F.filter(anchors, lambda a: (F.trim(a) != "") & F.contains(F.lower(full_text), F.lower(F.trim(a))))

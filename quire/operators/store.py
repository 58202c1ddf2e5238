"""Tables that change: each operation builds the next version of a table from the last one.

Parquet has no updates, so a change is a plan over the old rows and the changes, written to a new
path; a path that is being read is never written.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a policy and a key may name.
EXECUTION_MODES = ("sync", "async_immediate", "async_nightly")
CONFORMITY_ACTIONS = ("block", "block_holder", "flag_and_continue")
USE_CASES = ("ci_pii", "sop_contract")
STATUSES = ("received", "processing", "needs_review", "done", "rejected", "failed")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Values of ``changes`` that are not null replace the old ones."""
    other = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = table.join(other, table[key] == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), table[c]).alias(c) if c in changes.columns and c != key else table[c] for c in table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str, *, version: str | None = None, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows replace those with their key; ``version`` counts up and ``keep`` stays as it was."""
    old, new = table.alias("o"), rows.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == version:
            return F.when(fresh, F.coalesce(F.col(f"o.{c}"), F.lit(0)) + 1).otherwise(F.col(f"o.{c}"))
        new_value = F.col(f"n.{c}") if c in rows.columns else F.col(f"o.{c}")
        return F.when(fresh & F.col(f"o.{key}").isNotNull() & F.lit(c in keep), F.col(f"o.{c}")).when(fresh, new_value).otherwise(F.col(f"o.{c}"))

    return joined.select(*(value(c).alias(c) for c in table.columns))


def insert_missing(table: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Seeds never overwrite what is there."""
    return append(table, seeds.join(table, key, "left_anti"))


def delete(table: DataFrame, keys: DataFrame, key: str, *, protected: tuple[str, ...] = ()) -> DataFrame:
    return table.join(keys.where(~F.col(key).isin(*protected)) if protected else keys, key, "left_anti")


def queue(jobs: DataFrame, status: str, lane: str | None = None) -> DataFrame:
    found = jobs.where(F.col("status") == status)
    return (found if lane is None else found.where(F.col("execution_lane") == lane)).orderBy("job_id")


def claim(jobs: DataFrame, now) -> DataFrame:
    """The oldest received job of each lane starts; the rest stay."""
    oldest = jobs.where("status = 'received'").groupBy("execution_lane").agg(F.min("job_id").alias("_claimed")).select("_claimed")
    joined = jobs.join(oldest, F.col("job_id") == F.col("_claimed"), "left")
    hit = F.col("_claimed").isNotNull()
    return joined.select(*(F.when(hit, F.lit("processing")).otherwise(F.col("status")).alias(c) if c == "status" else (F.col("attempts") + hit.cast("int")).alias(c) if c == "attempts" else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in jobs.columns))


def recover_stale(jobs: DataFrame, now, *, lease_seconds: int = 1800, max_attempts: int = 3) -> DataFrame:
    """Jobs whose lease ran out go back to the queue, or fail after too many attempts."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds)))
    given_up = stale & (F.col("attempts") >= max_attempts)
    reason = F.concat(F.lit("stale lease after "), F.col("attempts").cast("string"), F.lit(" attempt(s) — gave up"))
    return jobs.withColumns(
        {
            "status": F.when(given_up, "failed").when(stale, "received").otherwise(F.col("status")),
            "reasons": F.when(given_up, F.concat("reasons", F.array(reason))).otherwise(F.col("reasons")),
        }
    )


def first_reviews(reviews: DataFrame) -> DataFrame:
    """One review a job: the first that was opened."""
    columns = [c for c in reviews.columns if c != "job_id"]
    return reviews.groupBy("job_id").agg(F.min_by(F.struct(*columns), "review_id").alias("r")).select("job_id", "r.*")


def review_queue(jobs: DataFrame, reviews: DataFrame, status: str = "needs_review") -> DataFrame:
    return jobs.where(F.col("status") == status).join(first_reviews(reviews), "job_id", "left")


def sweep(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions take effect on jobs that wait for review: accepted ones are done, corrections
    applied to their record; rejected ones failed.  Others are untouched, so a sweep can repeat."""
    decided = first_reviews(reviews).where("decision IN ('accept', 'reject')").select("job_id", "decision", "field_corrections")
    joined = jobs.join(decided, "job_id", "left")
    waiting = F.col("status") == "needs_review"
    accepted, refused = waiting & (F.col("decision") == "accept"), waiting & (F.col("decision") == "reject")
    merged = F.map_zip_with("record_fields", F.coalesce("field_corrections", F.create_map().cast("map<string,string>")), lambda _, old, new: F.coalesce(new, old))
    status = F.when(accepted, "done").when(refused, "failed").otherwise(F.col("status"))
    return joined.select(*(status.alias(c) if c == "status" else F.when(accepted, merged).otherwise(F.col(c)).alias(c) if c == "record_fields" else F.col(c) for c in jobs.columns))


def valid_corrections(old: Column, proposed: Column) -> Column:
    """``struct(changes, unknown)``: changes without those that change nothing, and names that the
    record lacks, which refuse the whole proposal."""
    unknown = F.array_except(F.map_keys(proposed), F.map_keys(old))
    return F.struct(F.map_filter(proposed, lambda k, v: ~v.eqNullSafe(F.try_element_at(old, k))).alias("changes"), unknown.alias("unknown"))


def deduplicated(jobs: DataFrame) -> DataFrame:
    """One job for each request: the first."""
    return jobs.join(jobs.groupBy("request_id").agg(F.min("job_id").alias("job_id")), ["request_id", "job_id"], "left_semi")


def active_templates(templates: DataFrame, category: str | None = None) -> DataFrame:
    """Templates in use, of one category if named, by id."""
    found = templates.where("active")
    return (found if category is None else found.where(F.col("category") == category)).orderBy("template_id")


def by_key(table: DataFrame, key: str, value) -> DataFrame:
    """One row by its key, in use or not."""
    return table.where(F.col(key) == value)


def known_categories(templates: DataFrame) -> DataFrame:
    """``(category)`` of templates in use, each once, in order."""
    return active_templates(templates).where("category <> ''").select("category").distinct().orderBy("category")


def without_policy(templates: DataFrame, policies: DataFrame) -> DataFrame:
    """Categories of templates in use that no policy names."""
    return known_categories(templates).join(policies.select("category"), "category", "left_anti")


def pending_suggestions(reviews: DataFrame, templates: DataFrame) -> DataFrame:
    """``(review_id, job_id, template_id, validation)``: suggestions that wait; a draft brings its own checks, others
    those of the template that they name, if it is there."""
    known = templates.select("template_id", F.col("validation").alias("_known"))
    waiting = reviews.where("suggestion_status = 'pending'").join(known, "template_id", "left")
    return waiting.select("review_id", "job_id", "template_id", F.coalesce("draft_validation", "_known").alias("validation"))


def decoded_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews as they are read: a suggestion is there if and only if it has a status."""
    made = F.struct("template_id", F.from_json("anchors", "array<string>").alias("anchors"), F.col("suggestion_status").alias("status"))
    return reviews.select("review_id", "job_id", F.when(F.col("suggestion_status").isNotNull(), made).alias("suggestion"))


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions, comments and corrections by review: what is not given stays; corrections replace the whole map."""
    return partial_update(reviews, decisions, "review_id")


def replayed(requests: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """``requests`` ``(host, seq, request_id)`` with ``replay``: whether a host still remembers the answer.  A host keeps
    the last ``capacity`` ids in the order in which they came first; a replay doesn't renew one.  A sequential pass over
    sorted rows that holds those ids only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, kept = None, {}
        for batch in batches:
            seen = []
            for name, request in zip(batch["host"], batch["request_id"], strict=True):
                if name != host:
                    host, kept = name, {}
                seen.append(request in kept)
                if request not in kept:
                    if len(kept) >= capacity:
                        del kept[next(iter(kept))]
                    kept[request] = None
            yield batch.assign(replay=seen)

    schema = T.StructType([*(requests.schema[c] for c in ("host", "seq", "request_id")), T.StructField("replay", T.BooleanType())])
    return requests.select("host", "seq", "request_id").repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, schema)


def settled(table: DataFrame, rows: DataFrame, key: str, now: Column, *, column: str | None = None, allowed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """A settings table after ``rows``, and the rows refused as their ``column`` has no known value, with ``error``.

    A row that replaces one keeps when that was created; both times of a new one are ``now``."""
    timed = rows.withColumns({"created_at": now, "updated_at": now})
    if column is None:
        return upsert(table, timed, key), timed.withColumn("error", F.lit(None).cast("string")).where(F.lit(False))
    fine = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    error = F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("none")))
    return upsert(table, timed.where(fine), key), rows.where(~fine).withColumn("error", error)


def listing(table: DataFrame, key: str) -> DataFrame:
    """All rows in order of their key."""
    return table.orderBy(key)


def seeded(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """Templates after a start that reads them from files: each is in use again and its version counts up."""
    return upsert(table, seeds.withColumn("active", F.lit(True)), "template_id", version="version")


def issue_key(spark: SparkSession, label: str, use_case: str) -> tuple[str, DataFrame]:
    """A fresh key for its caller, and the row ``(key_hash, label, use_case)`` that is stored, without the key."""
    if use_case not in USE_CASES:
        raise ValueError(f"unknown use_case: {use_case!r}")
    raw = secrets.token_urlsafe(32)
    row = (hashlib.sha256(raw.encode()).hexdigest(), label, use_case)
    return raw, spark.createDataFrame([row], "key_hash string, label string, use_case string")


def encoded(value: Column) -> Column:
    """A map or list as the JSON text of a column."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def decoded(value: Column, schema: str) -> Column:
    """The map or list of a JSON column, empty where the text is missing or empty; text that can't be read is an error."""
    return F.from_json(F.coalesce(F.nullif(value, F.lit("")), F.lit("[]" if schema.startswith("array") else "{}")), schema, {"mode": "FAILFAST"})

"""What follows from recognition and checks: lanes, outcomes, reactions, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.mrz import passing
from quire.operators import extract

NO_RULES = "structured template matched but has no single-doc validation rules (e.g. ID card uses the recto+verso pair flow, process_ci_pair)"
NO_TEXT = "no structured match and no extractable text (image needs an OCR engine)"

#: The recto's fields and what the machine-readable zone calls them.
OVERFLOW_ACTIONS = ("defer", "reject_503")
KEYS = {"numero_document": "document_number", "nom": "surname", "prenoms": "given_names", "date_naissance": "birth_date", "date_expiration": "expiry_date"}


def _empty() -> Column:
    return F.array().cast("array<string>")


def _when(condition: Column, *reasons: Column) -> Column:
    return F.when(condition, F.array(*reasons)).otherwise(_empty())


def route(df: DataFrame) -> DataFrame:
    """``lane``, ``verdict`` and ``reasons`` of documents with ``template_id``, ``has_rules``,
    ``verdict`` and ``reasons`` of their checks, and ``text``."""
    matched = F.col("template_id").isNotNull()
    blank = F.coalesce(text.strip(F.col("text")), F.lit("")) == ""
    verdict = F.when(matched, F.when(F.col("has_rules"), F.col("verdict")).otherwise("review"))
    reasons = F.when(matched, F.when(F.col("has_rules"), F.col("reasons")).otherwise(F.array(F.lit(NO_RULES)))).otherwise(_when(blank, F.lit(NO_TEXT)))
    return df.withColumns({"lane": F.when(matched, "structured").otherwise("rag"), "verdict": verdict, "reasons": reasons})


def with_integrity(df: DataFrame) -> DataFrame:
    """A text whose characters are damaged is never accepted automatically, and never softened."""
    seen = df.withColumn("_seen", text.integrity(F.col("text")))
    damaged = F.coalesce(F.col("_seen.disposition") != "clean", F.lit(False))
    verdict = F.when(damaged & (F.col("verdict") == "auto"), "review").otherwise(F.col("verdict"))
    return seen.withColumns({"verdict": verdict, "disposition": F.coalesce("_seen.disposition", F.lit("clean"))}).drop("_seen")


def type_mismatch(df: DataFrame) -> DataFrame:
    """Of documents with a declared type, those that follow a template of another category only:
    columns ``declared``, ``scoped_id`` (match within the type), ``free_id`` and ``free_category``."""
    wrong = F.col("scoped_id").isNull() & F.col("free_id").isNotNull() & F.col("declared").isNotNull() & (F.col("free_category") != F.col("declared"))
    reason = F.concat(F.lit("type mismatch: declared '"), "declared", F.lit("', recognized '"), "free_category", F.lit("' (template "), "free_id", F.lit(")"))
    return df.where(wrong).withColumn("reason", reason)


def with_policy(df: DataFrame, policies: DataFrame, key: Column, *, on: str = "category") -> DataFrame:
    """Each row with the policy of its key, or of ``*``; columns of ``policies`` prefixed ``p_``."""
    values = [c for c in policies.columns if c != on]
    own = policies.where(F.col(on) != "*").select(F.col(on).alias("_k"), F.lit(True).alias("_own"), *(F.col(c).alias(f"_own_{c}") for c in values))
    rest = policies.where(F.col(on) == "*").select(F.lit(True).alias("_any"), *(F.col(c).alias(f"_any_{c}") for c in values))
    keyed = df.withColumn("_key", key)
    joined = keyed.join(own, F.col("_key") == F.col("_k"), "left").join(F.broadcast(rest.limit(1)), F.lit(True), "left")  # one row has the key *
    chosen = F.when(F.col("_own"), F.col("_key")).when(F.col("_any"), F.lit("*"))
    return joined.select(*df.columns, chosen.alias(f"p_{on}"), *(F.when(F.col("_own"), F.col(f"_own_{c}")).otherwise(F.col(f"_any_{c}")).alias(f"p_{c}") for c in values))


def execution(df: DataFrame, policies: DataFrame, *, category: str = "category", requested: str = "requested_mode") -> DataFrame:
    """``mode``, ``policy_category`` and ``mode_reasons`` by policy, then by the caller's wish."""
    held = with_policy(df, policies, F.coalesce(F.col(category), F.lit("")))
    none = F.col("p_category").isNull()
    asked = F.coalesce(F.col(requested) != F.col("p_execution_mode"), F.lit(False))
    granted = asked & F.col("p_override_allowed")
    mode = F.when(none, "sync").when(granted, F.col(requested)).otherwise(F.col("p_execution_mode"))
    name = F.concat(F.lit("'"), "p_category", F.lit("'"))
    reasons = F.concat(
        _when(none, F.lit("no execution policy found — defaulting to sync")),
        _when(~none & granted, F.concat(F.lit("execution mode: "), mode, F.lit(" (caller processing_mode honored, policy "), name, F.lit(" allows override)"))),
        _when(~none & asked & ~granted, F.concat(F.lit("processing_mode '"), requested, F.lit("' ignored — policy "), name, F.lit(" locks "), "p_execution_mode")),
        _when(~none & ~granted & (mode != "sync"), F.concat(F.lit("execution mode: "), mode, F.lit(" (policy "), name, F.lit(")"))),
    )
    return held.select(*df.columns, mode.alias("mode"), F.coalesce("p_category", F.lit("*")).alias("policy_category"), reasons.alias("mode_reasons"))


def nonconformity(df: DataFrame, policies: DataFrame, *, default: str = "block") -> DataFrame:
    """The reaction to proven non-conformities, by the declared type first: ``action``, ``status``,
    ``final_verdict`` and ``final_reasons``."""
    held = with_policy(df, policies, F.coalesce("declared", "category"))
    action = F.coalesce("p_action", F.lit(default))
    flagged = action == "flag_and_continue"
    reasons = F.when(flagged, F.concat(F.array(F.lit("non-conformity FLAGGED (policy: process continues)")), "reasons")).otherwise(F.col("reasons"))
    return held.select(*df.columns, action.alias("action"), F.when(flagged, "needs_review").otherwise("rejected").alias("status"), F.when(flagged, "review").otherwise("reject").alias("final_verdict"), reasons.alias("final_reasons"))


def open_holder_blocks(jobs: DataFrame, reviews: DataFrame, policies: DataFrame) -> DataFrame:
    """``(expected_holder_name, job_id)``: the first open non-conformity that blocks each holder.
    Names are compared as they are written; a trace without retained evidence blocks nothing."""
    first = reviews.groupBy("job_id").agg(F.min_by("decision", "review_id").alias("decision"))
    rejected = jobs.where("status = 'rejected' AND expected_holder_name IS NOT NULL AND expected_holder_name <> '' AND document_ref IS NOT NULL")
    held = with_policy(rejected, policies, F.col("category")).where("p_action = 'block_holder'")
    return held.join(first, "job_id", "left").where("decision IS NULL").groupBy("expected_holder_name").agg(F.min("job_id").alias("job_id"))


def reconcile(recto: Column, mrz: Column) -> Column:
    """``struct(verdict, compared, failed, reasons)`` from the recto's fields, a map, and the zone's
    struct: a key that differs rejects; a failed digit, or nothing to compare, is for review."""
    value = lambda key: F.try_element_at(recto, F.lit(key))
    both = {k: value(k).isNotNull() & mrz[m].isNotNull() for k, m in KEYS.items()}
    differs = {k: both[k] & (text.strict_key(value(k)) != text.strict_key(mrz[m])) for k, m in KEYS.items()}
    compared = F.array_compact(F.array(*(F.when(both[k], F.lit(k)) for k in KEYS)))
    wrong = F.array_compact(F.array(*(F.when(differs[k], F.concat(F.lit(f"{k}: recto="), text.quoted(value(k)), F.lit(" != mrz="), text.quoted(mrz[m]))) for k, m in KEYS.items())))
    failed = F.map_keys(F.map_filter(mrz["checks"], lambda _, held: ~held))
    listed = F.concat(F.lit("MRZ check digits failed: ["), F.array_join(F.transform(failed, lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    review = F.concat(_when(F.size(failed) > 0, listed), _when(F.size(compared) == 0, F.lit("no shared key could be compared")))
    verdict = F.when(F.size(wrong) > 0, "reject").when(F.size(review) > 0, "review").otherwise("auto")
    return F.struct(verdict.alias("verdict"), compared.alias("compared"), failed.alias("failed"), F.concat(wrong, review).alias("reasons"))


def consolidated(recto: Column, mrz: Column) -> Column:
    """The recto's fields, gaps filled from the zone: ``map<name, struct(value, origin)>``."""
    made = []
    for key, name in {**KEYS, "sexe": "sex"}.items():
        own, other = F.nullif(F.try_element_at(recto, F.lit(key)), F.lit("")), F.nullif(mrz[name], F.lit(""))
        made.append(F.struct(F.lit(key).alias("key"), F.struct(F.coalesce(own, other).alias("value"), F.when(own.isNotNull(), "anchor").when(other.isNotNull(), "mrz").alias("origin")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*made), lambda e: e["value"]["value"].isNotNull()))


def submission(has_recto: Column, has_verso: Column) -> Column:
    """``struct(status, missing, reason)`` of an identity card's sides."""
    both, neither = has_recto & has_verso, ~has_recto & ~has_verso
    side = F.when(has_recto, "verso").otherwise("recto")
    missing = F.when(both, _empty()).when(neither, F.array(F.lit("recto"), F.lit("verso"))).otherwise(F.array(side))
    reason = F.when(neither, "no CI recto template matched and no MRZ found in the upload").when(~both, F.concat(F.lit("missing the "), side, F.lit(" side — please upload it")))
    status = F.when(both, "complete").when(neither, "unrecognized").otherwise("incomplete")
    return F.struct(status.alias("status"), missing.alias("missing"), reason.alias("reason"))


def better_read(reads: DataFrame) -> DataFrame:
    """Of a side's reads ``(doc_id, tier, checks)`` the one with most digits that hold; the cheapest on
    a tie.  Reads of a tier count only while no cheaper one is trustworthy."""
    scored = reads.withColumn("_score", passing(F.col("checks")))
    trusted = reads.where((F.size("checks") > 0) & F.forall(F.map_values("checks"), lambda x: x)).groupBy("doc_id").agg(F.min("tier").alias("_enough"))
    lazy = scored.join(trusted, "doc_id", "left").where("_enough IS NULL OR tier <= _enough")
    return lazy.groupBy("doc_id").agg(F.max_by(F.struct("tier", "checks"), F.struct("_score", -F.col("tier"))).alias("best")).select("doc_id", "best.*")


def client_status(status: Column) -> Column:
    return F.when(status.isin("done", "needs_review", "rejected", "failed"), "done").otherwise("pending")


def http_status(status: Column) -> Column:
    return F.when(client_status(status) == "pending", 202).otherwise(200)


def job_status(verdict: Column) -> Column:
    return F.when(verdict == "auto", "done").when(verdict == "reject", "rejected").otherwise("needs_review")


def setting(value: Column, kind: str, default) -> Column:
    """A capacity setting: a limit of 1 or more, or one of the overflow actions; else the default."""
    if kind == "limit":
        number = F.when(F.trim(value).rlike(r"^\+?\d+$"), F.trim(value).try_cast("int"))
        return F.when(number >= 1, number).otherwise(F.lit(default))
    return F.when(value.isin(*OVERFLOW_ACTIONS), value).otherwise(F.lit(default))


def use_case(jobs: DataFrame, keys: DataFrame, *, default: str = "ci_pii") -> DataFrame:
    """The use case of each presented key: the default where none is, null where it is unknown."""
    joined = jobs.withColumn("_hash", F.sha2("api_key", 256)).join(keys.select(F.col("key_hash").alias("_hash"), F.col("use_case").alias("_case")), "_hash", "left")
    return joined.withColumn("use_case", F.when(F.col("api_key").isNull(), default).otherwise(F.col("_case"))).drop("_hash", "_case")


def attestations(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Validated attestations on file: closed jobs whose template names all three roles, with every
    role's value.  ``record_fields`` is a map of values; ``roles`` a struct of field names."""
    roles = templates.where("roles.holder_field <> '' AND roles.issue_date_field <> '' AND roles.expiry_date_field <> ''").select("template_id", "roles")
    read = lambda role: F.try_element_at(F.col("record_fields"), F.col(f"roles.{role}"))
    made = jobs.where("status = 'done'").join(roles, "template_id").select("job_id", read("holder_field").alias("holder_name"), read("issue_date_field").alias("issue_date"), read("expiry_date_field").alias("expiry_date"))
    return made.where("holder_name <> '' AND issue_date <> '' AND expiry_date <> ''")


def recto_fields(docs: DataFrame, found: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``(doc_id, template_id, fields)``: what a document's recto says, a map of values by pattern; documents that
    follow no template ``(doc_id, template_id)`` have no row."""
    values = F.create_map(*(x for name, pattern in patterns.items() for x in (F.lit(name), extract.pattern_value(F.col("text"), pattern))))
    return docs.join(found, "doc_id").select("doc_id", "template_id", values.alias("fields"))


def field_values(fields: Column) -> Column:
    """What checks read: names and values, without places."""
    return F.transform_values(fields, lambda _, field: field["value"])


def batch_views(records: DataFrame) -> dict[str, DataFrame]:
    """A batch's records by outcome: to centralise, for a human, proven invalid."""
    return {name: records.where(F.col("outcome") == outcome) for name, outcome in (("auto", "auto"), ("review", "review"), ("rejected", "reject"))}


def wire_status(verdict: Column) -> Column:
    return F.when(verdict == "auto", "validated").when(verdict == "review", "needs_review").when(verdict == "reject", "rejected")


def ci_records(submissions: DataFrame) -> DataFrame:
    """Records of identity cards: ``outcome``, ``detail``, ``reasons`` and ``missing`` from ``status``, the pair's
    ``verdict`` and ``record_reasons``, and the submission's ``reasons`` and ``missing``."""
    whole = (F.col("status") == "complete") & F.col("verdict").isNotNull()
    outcome = F.when(whole, F.col("verdict")).otherwise("review")
    return submissions.withColumns({"outcome": outcome, "detail": F.col("status"), "reasons": F.when(whole, F.col("record_reasons")).otherwise(F.col("reasons")), "missing": F.when(whole, _empty()).otherwise(F.col("missing"))})


def door_edge(records: DataFrame) -> DataFrame:
    """What the door does with a card's record: a side that is missing leaves a closed trace, a doubtful pair waits
    for the escalation lane, others are final.  Adds ``job_status``, ``execution_lane``, ``wire``, ``wire_verdict``, ``http``
    and ``trace``."""
    unmet, doubtful = F.col("detail").isin("incomplete", "unrecognized"), F.col("outcome") == "review"
    sides = F.concat(F.lit("missing side(s): "), F.array_join("missing", ", "))
    return records.withColumns(
        {
            "job_status": F.when(unmet, "done").when(doubtful, "received").otherwise(job_status(F.col("outcome"))),
            "execution_lane": F.when(~unmet & doubtful, "escalation").otherwise("fast"),
            "wire": F.when(unmet, F.col("detail")).when(doubtful, "pending").otherwise(wire_status(F.col("outcome"))),
            "wire_verdict": F.when(~unmet & ~doubtful, F.col("outcome")),
            "http": F.when(~unmet & doubtful, 202).otherwise(200),
            "trace": F.concat("reasons", _when(unmet & (F.size("missing") > 0), sides)),
        }
    )


def worker_edge(records: DataFrame) -> DataFrame:
    """What the worker writes: nobody waits for an answer, so an incomplete card is for review too.  ``job_reasons`` come
    first; ``verso_read_path``, where there is one, last.  Adds ``job_status`` and ``written``."""
    via = F.concat(F.lit("verso read via: "), "verso_read_path")
    return records.withColumns({"job_status": job_status(F.col("outcome")), "written": F.concat("job_reasons", "reasons", _when(F.col("verso_read_path").isNotNull(), via))})


def job_rows(outcomes: DataFrame, **given: Column) -> DataFrame:
    """Records as rows of the job table; ``given`` columns, such as the upload's own name, come before the record's."""
    own = {"source": "source", "category_lane": "lane", "status": "status", "verdict": "verdict", "category": "category", "template_id": "template_id", "record_fields": "fields", "reasons": "reasons"}
    made = {name: F.col(c) for name, c in own.items()} | {"execution_lane": F.lit("fast")} | given
    return outcomes.select(*(c.alias(name) for name, c in made.items()))


def door_answer(admitted: Column, limit: Column, action: Column, reasons: Column) -> Column:
    """``struct(http, execution_lane, reasons, retry_after)`` of a call for an answer at once: none of these where it
    found a slot; else it is refused, or waits as ``action`` has it."""
    full = F.concat(F.lit("sync capacity saturated ("), limit.cast("string"), F.lit(" in flight) — "))
    refused, waits = ~admitted & (action == "reject_503"), ~admitted & (action != "reject_503")
    why = F.when(refused, F.array(F.concat(full, F.lit("retry")))).when(waits, F.concat(reasons, F.array(F.concat(full, F.lit("deferred per overflow policy"))))).otherwise(reasons)
    return F.struct(F.when(refused, 503).when(waits, 202).alias("http"), F.when(waits, "deferred").alias("execution_lane"), why.alias("reasons"), F.when(refused, 5).alias("retry_after"))


def policy_payload(policies: DataFrame) -> DataFrame:
    """What the settings page shows of a policy."""
    return policies.select("category", "execution_mode", "override_allowed", "updated_at")

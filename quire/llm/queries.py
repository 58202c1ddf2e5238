"""The registered queries of this subpackage: thin digests over its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, decontaminate, line_dedup, packing, pii, quality, secret_scan, simhash, spans, substring_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _span_digest(found: DataFrame, name: str, base: tuple[str, ...]) -> DataFrame:
    all_spans = F.col(name)
    return found.select(
        "doc_id",
        *(spans.count(all_spans, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(spans.written(spans.only(all_spans, base)), 256).alias("base_sha256"),
        spans.written(all_spans).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secret_scan.find_secrets(_documents(spark, sf_dir)), "secrets", secret_scan.BASE)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_documents(spark, sf_dir), count_col="n_removed")
    return found.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find_pii(_documents(spark, sf_dir)), "pii", pii.BASE)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_documents(spark, sf_dir), width=13)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_digests(spark, manifest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"), n=13)
    return found.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        decontaminate.n_hit(F.col("hit_spans")).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("hit_n_words"), F.col("hit_spans")).alias("contaminated"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, k=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_secret_scan, op3_nearest, op4_line_dedup, op5_decontaminate, op6_pii, op7_substring_dedup, op8_token_files, op9_packing, op10_simhash)}

ORACLE_SQL: dict[str, str] = {}

#: Words as the decontamination contract has them, and every window with its place.
ORACLE_SQL["op5_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS s
         FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
 widths AS (SELECT DISTINCT n FROM win),
 dw AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS s
        FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, widths WHERE len(w) >= n)),
 hits AS (SELECT dw.rid, dw.n, dw.i, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
 pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
 its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.rid = d.rid LEFT JOIN its ON its.rid = d.rid
"""

#: Three-line windows; a line goes if a window that is not the first of its kind covers it.
ORACLE_SQL["op4_line_dedup"] = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
 win AS (SELECT doc_id, text, i, array_to_string(l[i:i+2], chr(10)) AS s
         FROM (SELECT doc_id, text, l, unnest(generate_series(1, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
 ranked AS (SELECT doc_id, text, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM win),
 gone AS (SELECT DISTINCT doc_id, text, i + k AS line FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
 lines AS (SELECT doc_id, text, unnest(generate_series(1, len(l))) AS line, unnest(l) AS body FROM d),
 kept AS (SELECT lines.doc_id, lines.text, string_agg(body, chr(10) ORDER BY lines.line) FILTER (gone.line IS NULL) AS kept,
            count(gone.line) AS n_removed
          FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.text = gone.text AND lines.line = gone.line
          GROUP BY lines.doc_id, lines.text)
SELECT documents.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id AND documents.text = kept.text
"""

#: Thirteen-word windows and the smallest id that holds each.
ORACLE_SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS s
         FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
 least AS (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM win),
 gone AS (SELECT DISTINCT rid, i + k AS p FROM least, (SELECT unnest(generate_series(0, 12)) AS k) WHERE first_id < doc_id),
 each AS (SELECT rid, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d),
 kept AS (SELECT each.rid, string_agg(word, ' ' ORDER BY each.p) FILTER (gone.p IS NULL) AS body, count(gone.p) AS n_removed
          FROM each LEFT JOIN gone ON each.rid = gone.rid AND each.p = gone.p GROUP BY each.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid
"""

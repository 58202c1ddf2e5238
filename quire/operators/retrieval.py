"""Passages: packing text into chunks, ranking them, summarising without a model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import lines as L
from quire.operators.flow import NO_TEXT

_CHUNKS = "array<struct<text:string,tokens:int>>"


def packed(parts: Column, sizes: Column, target: int) -> Column:
    """Parts joined in order until their sizes reach the target, then a new chunk; the rest is the
    last chunk.  A running sum with reset is no window, so it is a fold."""
    zipped = F.arrays_zip(parts.alias("part"), sizes.alias("size"))
    start = F.struct(F.array().cast(_CHUNKS).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("sum"))

    def add(state, item):
        parts_now, total = F.concat(state["open"], F.array(item["part"])), state["sum"] + item["size"]
        closed = F.concat(state["done"], F.array(F.struct(F.array_join(parts_now, "\n").alias("text"), total.alias("tokens"))))
        full = F.struct(closed.alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("sum"))
        return F.when(total >= target, full).otherwise(F.struct(state["done"].alias("done"), parts_now.alias("open"), total.alias("sum")))

    def finish(state):
        rest = F.array(F.struct(F.array_join(state["open"], "\n").alias("text"), state["sum"].alias("tokens")))
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], rest)).otherwise(state["done"])

    return F.aggregate(zipped, start, add, finish)


def chunk_documents(docs: DataFrame, *, target: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, chunk_no, text, tokens)``: paragraphs packed to about ``target`` content words."""
    split = docs.select(F.col(id_col).alias("doc_id"), text.paragraphs(F.col(text_col)).alias("part"))
    sized = split.withColumn("size", F.transform("part", lambda p: F.size(text.tokens(p))))
    made = sized.select("doc_id", F.posexplode(packed(F.col("part"), F.col("size"), target)).alias("chunk_no", "c"))
    return made.select("doc_id", "chunk_no", "c.text", "c.tokens")


def chunk_lines(lines: DataFrame, *, target: int = 120) -> DataFrame:
    """``(doc_id, chunk_no, text, tokens, spans)``: lines packed like paragraphs, with the place on its
    page of each line that has one."""
    clean = lines.select("*", text.strip(F.col("text")).alias("_text")).where("_text <> ''")
    row = F.struct("line_no", F.col("_text").alias("part"), F.size(text.tokens(F.col("_text"))).alias("size"), L.provenance({c: F.col(c) for c in lines.columns}).alias("span"))
    grouped = clean.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("chunks"))

    def add(state, item):
        total = state["sum"] + item["size"]
        full = total >= target
        return F.struct(F.when(full, 0).otherwise(total).alias("sum"), (state["chunk"] + full.cast("int")).alias("chunk"), F.concat(state["chunks"], F.array(state["chunk"])).alias("chunks"))

    dealt = grouped.withColumn("chunks", F.aggregate("rows", start, add, lambda s: s["chunks"]))
    each = dealt.select("doc_id", F.explode(F.arrays_zip("chunks", "rows")).alias("z")).select("doc_id", F.col("z.chunks").alias("chunk_no"), "z.rows.*")
    made = each.groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "part", "span"))).alias("r"), F.sum("size").cast("int").alias("tokens"))
    spans = F.filter(F.transform("r", lambda x: x["span"]), lambda x: x.isNotNull())
    return made.select("doc_id", "chunk_no", F.array_join(F.transform("r", lambda x: x["part"]), "\n").alias("text"), "tokens", spans.alias("spans"))


def read_result(docs: DataFrame) -> DataFrame:
    """Documents without a template: ``(doc_id, chunk_count, keywords, key_sentences, reasons)``.
    ``docs`` has ``missing_pages`` and ``low_form_pages``, arrays or null."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    missing = F.concat(F.lit("incomplete conversion: "), F.size("missing_pages").cast("string"), F.lit(" page(s) never produced (routed to human review): pages "), listed("missing_pages"))
    low = F.concat(F.lit("low-form pages (layout below threshold, structure not confidently recovered): pages "), listed("low_form_pages"))
    blank = F.coalesce(text.strip(F.col("text")), F.lit("")) == ""
    reasons = F.array_compact(F.array(F.when(blank, NO_TEXT), F.when(F.size("missing_pages") > 0, missing), F.when(F.size("low_form_pages") > 0, low)))
    counts = chunk_documents(docs).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    words = keywords(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda k: k["term"]).alias("keywords"))
    best = key_sentences(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda s: s["sentence"]).alias("key_sentences"))
    none = F.array().cast("array<string>")
    joined = docs.select("doc_id", reasons.alias("reasons")).join(counts, "doc_id", "left").join(words, "doc_id", "left").join(best, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("key_sentences", none).alias("key_sentences"), "reasons")


def segment_articles(lines: DataFrame, *, max_tokens: int = 400) -> DataFrame:
    """``(doc_id, article_no, heading, chunk_no, text, tokens)`` of documents with two headings or
    more, articles in order of first appearance, each id's longest occurrence kept (a table of
    contents repeats headings without a body); other documents are one run without heading."""
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    clean = lines.select("doc_id", "line_no", text.strip(F.col("text")).alias("text")).where("text <> ''")
    marked = clean.withColumn("h", text.article_heading(F.col("text")))
    marked = marked.withColumn("section", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(by_line))
    marked = marked.withColumn("size", F.size(text.tokens(F.col("text"))))
    headings = Window.partitionBy("doc_id")
    marked = marked.withColumn("headings", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(headings))
    flat = marked.withColumn("section", F.when(F.col("headings") < 2, 0).otherwise(F.col("section"))).where("headings < 2 OR section > 0")
    sections = flat.groupBy("doc_id", "section").agg(
        F.min_by("h", "line_no").alias("h"),
        F.first("headings").alias("headings"),
        F.sum("size").alias("body"),
        F.array_sort(F.collect_list(F.struct("line_no", "text", "size"))).alias("parts"),
    )
    key = F.when(F.col("headings") >= 2, F.col("h.id"))
    best = sections.groupBy("doc_id", key.alias("article")).agg(F.min("section").alias("first"), F.max_by(F.struct("h", "parts"), F.struct("body", -F.col("section"))).alias("s"))
    best = best.withColumn("article_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1)
    title = F.col("s.h.title")
    heading = F.when(F.col("article").isNotNull(), F.concat(F.lit("Article "), "article", F.when(title != "", F.concat(F.lit(" "), title)).otherwise("")))
    chunks = packed(F.transform("s.parts", lambda p: p["text"]), F.transform("s.parts", lambda p: p["size"]), max_tokens)
    return best.select("doc_id", "article_no", heading.alias("heading"), F.posexplode(chunks).alias("chunk_no", "c")).select("doc_id", "article_no", "heading", "chunk_no", "c.text", "c.tokens")


def term_counts(chunks: DataFrame, key: list[str]) -> DataFrame:
    return chunks.select(*key, F.explode(text.tokens(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))


def terms_of(queries: DataFrame) -> DataFrame:
    """The distinct content words of ``queries``."""
    return queries.select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()


def index(chunks: DataFrame, key: list[str], *, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(term, idf)`` and ``(key, term, weight)`` with weights of unit length for each chunk; of ``terms``
    only, if given, though lengths are of all."""
    counts = term_counts(chunks, key)
    total = chunks.select(F.count("*").alias("chunks"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", (F.log((F.col("chunks") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return idf, _unit(counts.join(idf, "term"), key, terms)


def _unit(weighted: DataFrame, key: list[str], terms: DataFrame | None = None) -> DataFrame:
    raw = weighted.select(*key, "term", (F.col("n") * F.col("idf")).alias("w"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kept = raw if terms is None else raw.join(terms, "term", "left_semi")
    return kept.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def search(queries: DataFrame, idf: DataFrame, weights: DataFrame, key: list[str], *, k: int = 3) -> DataFrame:
    """The ``k`` best chunks of each query ``(query_id, text)`` by cosine; words that the index lacks
    weigh nothing; chunks without a common word score zero and are not listed."""
    asked = _unit(term_counts(queries, ["query_id"]).join(idf, "term"), ["query_id"])
    scores = asked.select("query_id", "term", F.col("weight").alias("q")).join(weights, "term").groupBy("query_id", *key).agg(F.sum(F.col("q") * F.col("weight")).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), *key)))
    return ranked.where(F.col("rank") <= k)


def dense_search(vectors: DataFrame, is_query: Column, *, k: int = 10, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, rank, score)``: for each row that ``is_query``, the ``k`` other rows with the
    best product of unit vectors, ties by id.  Exact: queries go over all rows in blocks of ``block``,
    and each batch of rows sends on only its best ``k`` for each query."""
    asked = vectors.where(is_query).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    found, queries = None, []

    def scan(queries: list) -> DataFrame:
        ids, matrix = np.array([q["id"] for q in queries], np.int64), _unit_rows([q["v"] for q in queries])

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = batch["vec_id"].to_numpy()
                scores = matrix @ _unit_rows(batch["v"].tolist()).T
                scores[ids[:, None] == own[None, :]] = -np.inf
                for q, line in zip(ids, scores, strict=True):
                    top = np.lexsort((own, -np.round(line, 9)))[:k]
                    top = top[np.isfinite(line[top])]
                    yield pd.DataFrame({"query_id": q, "vec_id": own[top], "score": line[top]})

        if not queries:
            return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
        return rows.mapInPandas(best, "query_id long, vec_id long, score double")

    for query in asked.toLocalIterator():
        queries.append(query)
        if len(queries) == block:
            found, queries = scan(queries) if found is None else found.unionByName(scan(queries)), []
    if queries or found is None:
        found = scan(queries) if found is None else found.unionByName(scan(queries))
    by_score = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _unit_rows(rows: list) -> np.ndarray:
    if not rows:
        return np.zeros((0, 0))
    made = np.array(rows, np.float64)
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    return made / np.where(norm == 0, 1, norm)


_WORD, _END = re.compile(text.TOKEN), re.compile(r"(?<=[.!?])\s+")
_STOP = frozenset(text.STOPWORDS)


def _words(body: str) -> list[str]:
    return [w for w in (x.lower() for x in _WORD.findall(body)) if len(w) >= text.MIN_TOKEN and w not in _STOP]


def _per_document(docs: DataFrame, rows_of: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Rows that each text gives by itself: a document is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows_of(body or "") for body in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def keywords(docs: DataFrame, *, k: int = 8) -> DataFrame:
    """``(doc_id, rank, term, n)``: the most frequent content words, earlier ones first on a tie."""

    def rows(body: str) -> list[tuple]:
        return [(i, term, n) for i, (term, n) in enumerate(Counter(_words(body)).most_common(k), 1)]

    return _per_document(docs, rows, [("rank", pa.int32()), ("term", pa.string()), ("n", pa.int64())], "rank int, term string, n long")


def key_sentences(docs: DataFrame, *, k: int = 3) -> DataFrame:
    """``(doc_id, sentence_no, sentence, score)``: the sentences with the best mean word count, in
    reading order.  Counts cover all content words of the document."""

    def rows(body: str) -> list[tuple]:
        counts = Counter(_words(body))
        sentences = [s for s in (x.strip() for x in _END.split(body)) if len(s) > 1]
        scored = []
        for number, sentence in enumerate(sentences):
            if found := _words(sentence):
                scored.append((number, sentence, sum(counts[w] for w in found) / len(found)))
        return sorted(sorted(scored, key=lambda s: (-round(s[2], 9), s[0]))[:k])

    return _per_document(docs, rows, [("sentence_no", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())], "sentence_no int, sentence string, score double")


def token_batches(texts: DataFrame, *, budget: int = 2000) -> DataFrame:
    """``(group, doc_id, batch_no)`` of texts ``(doc_id, group, pos, tokens)``: a batch closes before a text
    that would take it over the budget.  A sequential pass over sorted rows that holds one sum, however
    large a group is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, number, total = None, 0, 0
        for batch in batches:
            numbers = []
            for name, tokens in zip(batch["group"], batch["tokens"], strict=True):
                if name != group:
                    group, number, total = name, 0, 0
                if total > 0 and total + tokens > budget:
                    number, total = number + 1, 0
                total += tokens
                numbers.append(number)
            yield batch[["group", "doc_id"]].assign(batch_no=np.array(numbers, np.int32))

    ordered = texts.select("group", "doc_id", "pos", "tokens").repartition("group").sortWithinPartitions("group", "pos", "doc_id")
    return ordered.mapInPandas(run, f"group {texts.schema['group'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}, batch_no int")


def hops(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The edges that start at one of ``chunks`` ``(chunk_id)``: one step through the reference graph."""
    return edges.join(chunks.select(F.col("chunk_id").alias("source")).distinct(), "source", "left_semi")


def reference_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges ``(edge_id, source, ancien, nouveau)`` between passages, kept where ``ancien`` names a
    document element, each end resolved to the first chunk ``(chunk_id, heading)`` whose heading
    holds its key; an end that is named but not found dangles.  Headings give all the keys that they hold,
    so ends and headings meet by equality."""
    kept = edges.where(text.is_document_reference(F.col("ancien")))
    held = chunks.where("heading IS NOT NULL").select("chunk_id", F.explode(text.keys_in(text.heading_key(F.col("heading")))).alias("_key"))

    def resolve(df: DataFrame, end: str) -> DataFrame:
        hits = held.groupBy("_key").agg(F.min("chunk_id").alias(f"{end}_target"))
        return df.withColumn("_key", text.reference_key(F.col(end))).join(hits, "_key", "left").drop("_key").withColumn(f"{end}_dangling", F.col(end).isNotNull() & F.col(f"{end}_target").isNull())

    return resolve(resolve(kept, "ancien"), "nouveau")

"""The pipeline's stages against the operators' plain rules, on its own tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import storage


def test_each_stage_works_on_what_its_predecessor_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = storage.write_table(stage(spark, kept, sf_dir), name)
        assert after.columns == columns, name
        ids = after.select("doc_id")
        assert ids.exceptAll(kept.select("doc_id")).count() == 0
        assert ids.count() == ids.distinct().count() > 0.5 * kept.count()
        kept = after
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert sorted(map(tuple, packed.drop("sequence_id", "offset").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()))


def test_stages_take_odd_and_empty_tables(spark, sf_dir, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if "piece" in out.columns:
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            else:
                assert out.columns == docs.columns and out.count() <= docs.count(), name


def test_stages_keep_columns_that_clash(spark, sf_dir, edge_docs):
    names = ["score", "good", "body", "_id", "_hash", "_cover", "id", "hash", "part0", "hit_spans", "cell", "bucket", "piece", "start", "length", "sequence_id", "offset", "label"]
    odd = edge_docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() >= 0
        assert "piece" in out.columns if name == "best_fit_packing" else out.columns == odd.columns


def test_stages_match_plain_versions(spark, sf_dir):
    """Each stage on what the stage before kept, held against a plain version of its rule."""
    import re

    import public_tokenizers
    import pyarrow as pa
    from test_text_operators import plain_line_dedup
    from tokenizers import Tokenizer

    from quire.llm import quality

    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    model = quality.train(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before = rows(kept)
    kept, _ = storage.write_table(stages["quality_classifier"](spark, kept, sf_dir), "plain")
    scores = model.scores(quality.features_of(pa.array([t for _, t in before])))
    assert rows(kept) == [r for r, s in zip(before, scores, strict=True) if s >= 0.3]

    before = rows(kept)
    kept, _ = storage.write_table(stages["line_dedup"](spark, kept, sf_dir), "plain")
    assert rows(kept) == [(i, t) for (i, _), t in zip(before, plain_line_dedup(before), strict=True)]

    before = rows(kept)
    kept, _ = storage.write_table(stages["simhash_near_dedup"](spark, kept, sf_dir), "plain")
    lower = {i: i + 32 for i in range(65, 91)}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for _, t in before)]
    label = list(range(len(before)))
    for i, one in enumerate(sets):  # all pairs, by the similarity of five-word shingles
        for j, other in enumerate(sets[:i]):
            if one == other or 5 * len(one & other) >= 4 * len(one | other):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    assert rows(kept) == [r for i, r in enumerate(before) if label[i] == i]

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = split(r["text"])
        windows |= {tuple(words[i : i + 13]) for i in range(max(len(words) - 12, 1))} if words else set()
    widths = {len(w) for w in windows}
    before, clean = rows(kept), []
    for i, t in before:
        words = split(t)
        hit = {p for n in widths for at in range(len(words) - n + 1) if tuple(words[at : at + n]) in windows for p in range(at, at + n)}
        if not hit or 20 * len(hit) < len(words):
            clean.append((i, t))
    kept, _ = storage.write_table(stages["benchmark_decontamination"](spark, kept, sf_dir), "plain")
    assert rows(kept) == clean

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages["best_fit_packing"](spark, kept, sf_dir).collect()
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean}
    used = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1

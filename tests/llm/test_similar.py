"""The pipeline's near-dedup against brute-force similarities of distinct five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import similar


def fresh(name, n):
    return [f"{name}x{i}" for i in range(n)]


def plain_groups(texts):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


def kept(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}


def test_templates_and_repeats_do_not_chain(spark):
    texts = [fresh("t", 160) + fresh(f"a{i}", 44) for i in range(150)]
    texts += [fresh(f"r{i}", 40) + ["same"] * 120 for i in range(20)]
    assert kept(spark, texts) == set(plain_groups(texts)) == set(range(len(texts)))


def test_pairs_just_above_the_threshold_are_linked(spark):
    texts = []
    for i in range(250):
        one, changed = fresh(f"p{i}", 204), 17 + i % 6
        texts += [one, one[:-changed] + fresh(f"q{i}", changed)]
    assert kept(spark, texts) == set(range(0, 500, 2))


@pytest.mark.parametrize("piece", [8, 1024])
def test_crowded_buckets_lose_no_pair(spark, monkeypatch, piece):
    monkeypatch.setattr(similar, "PIECE", piece)
    texts = []
    for i in range(80):
        one = fresh("t", 170) + fresh(f"a{i}", 34)
        texts += [one, one[:-20] + fresh(f"b{i}", 20), one[:-8] + fresh(f"c{i}", 8)]
    assert kept(spark, texts) == set(plain_groups(texts))


def test_pairs_at_every_similarity_match_brute_force(spark):
    rnd, texts = random.Random(8), []
    for i in range(120):  # from 0.6 to 1, of 5 to 400 words, some with repeats
        one = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((5, 8, 9, 12, 30, 90, 400)))]
        other = list(one)
        for _ in range(rnd.randrange(1 + len(one) // 12)):
            other[rnd.randrange(len(one))] = f"x{rnd.randrange(10**6)}"
        texts += [one, other, one + [f"end{i}"] * rnd.randrange(30)]
    label = plain_groups(texts)
    assert kept(spark, texts) == set(label)


@pytest.mark.parametrize("cell", [16, 1 << 21])
def test_cells_of_slices_lose_no_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)  # prefixes of several bits, as large tables have
    texts = []
    for i in range(60):
        one = fresh(f"p{i}", 104)
        texts += [one, one[:-9] + fresh(f"q{i}", 9)]
    assert similar.prefix_bits(120) == (0 if cell > 16 else 6)
    assert kept(spark, texts) == set(range(0, 120, 2))


def test_meetings_connect_what_brute_force_connects():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (40, similar.PARTS), dtype=np.uint64)
    prints = np.repeat(centres, 12, axis=0)
    for row in prints:  # flips of a tenth of the bits or fewer
        for bit in rng.choice(similar.BITS, rng.integers(0, similar.BITS // 8), replace=False).tolist():
            row[bit // 64] ^= np.uint64(1 << (bit % 64))
    entries = np.empty(len(prints), similar._ENTRY)
    entries["tag"], entries["part"], entries["check"] = np.arange(len(prints)), prints[:, 0], prints[:, 1]
    close = (similar._apart(entries["part"][:, None] & similar._LOW, entries["part"][None] & similar._LOW) <= 2) & similar._meet(entries[:, None], entries[None])
    label = np.arange(len(prints))
    while (new := np.array([label[row].min() for row in close])).tolist() != label.tolist():
        label = new
    links, root = similar.meetings(0, entries, 0), np.arange(len(prints))
    root[links[:, 1]] = links[:, 0]
    assert root.tolist() == label.tolist()


def test_groups_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (None, "one two"), (3, "one two"), (4, "ONE two"), (5, " \n"), (6, "one two three four five six " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = sorted((str(r["id"]), r["component"]) for r in similar.similar_groups(docs).collect())
    assert made == sorted([("1", 1), ("2", 1), ("5", 1), ("3", 3), ("3", 3), ("None", 3), ("4", 3), ("6", 6)])
    assert similar.similar_groups(docs.limit(0)).count() == 0
    odd = docs.withColumns({c: F.lit(1) for c in ("id", "hash", "name", "component", "body", "tag")})
    assert similar.keep_first(odd).columns == odd.columns

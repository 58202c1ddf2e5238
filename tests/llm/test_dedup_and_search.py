"""Substring dedup, SimHash and nearest neighbours against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, components, queries, simhash, similar, storage, substring_dedup, words

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# substring dedup


def plain_dedup(rows, width=13):
    """For each (id, text): words, removed, kept."""
    first = {}
    big = 1 << 63
    texts = [(big if i is None else i, split(t or "")) for i, t in rows]
    for i, w in texts:
        for at in range(len(w) - width + 1):
            key = tuple(w[at : at + width])
            first[key] = min(first.get(key, big), i)
    out = []
    for i, w in texts:
        gone = {at + k for at in range(len(w) - width + 1) if first[tuple(w[at : at + width])] < i for k in range(width)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def check_dedup(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_dedup(rows, options.get("width", 13))))
    made = substring_dedup.dedup_substrings(docs, **options).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in made) == want


def test_substring_dedup_matches_brute_force(edge_docs, no_docs, real_docs):
    check_dedup(edge_docs)
    check_dedup(edge_docs, cell_bytes=2000, bucket_bytes=300)
    check_dedup(real_docs.limit(120), cell_bytes=20000)
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_over_few_words(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(120)]
    rows += [(200 + i, "c " * rnd.randrange(60)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (1, 2, 5, 13):
        check_dedup(docs, width=width, cell_bytes=500)


def complement(n):
    """Two words of 2 ** n letters that collide under every polynomial modulo a power of two, if n >= 10."""
    one = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in one), "".join("ba"[x] for x in one)


def test_words_that_collide_are_told_apart(spark):
    a, b = complement(11)
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([b, *rest])), (4, " ".join([a, b] * 10)), (5, " ".join([b, a] * 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r["id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert made == {1: 0, 2: 0, 3: 13, 4: 0, 5: 20}
    check_dedup(docs)


def test_no_hash_is_trusted(spark, monkeypatch):
    """Even if all hashes of a kind are equal, only equal words go."""
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choice(complement(10)) if rnd.random() < 0.2 else rnd.choice("abc") for _ in range(rnd.randrange(40)))) for i in range(40)]
    table = pa.table({"id": pa.array([i for i, _ in rows]), "body": pa.array([t for _, t in rows]), "cell": pa.array([0] * len(rows))})
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_dedup(rows, 3)))
    for weak in (None, "word_hashes", "between"):
        if weak == "word_hashes":
            monkeypatch.setattr(words, "word_hashes", lambda block: np.full(len(block.starts), 7, np.uint64))
        if weak == "between":
            monkeypatch.setattr(words.RunHash, "between", lambda self, prefix, starts, ends: np.full(len(starts), 5, np.uint64))
        keys = substring_dedup._meet_keys(substring_dedup._send_keys(table, 3, 4))
        sent = substring_dedup._send_stretches(table, keys, 3, 4)
        made = substring_dedup._remove(table, substring_dedup._meet_stretches(sent, 3), 3)
        assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in made.to_pylist()) == want


def test_repeated_rows_are_dealt_over_cells(spark):
    body = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, body)] * 300 + [(2, body)] * 300, "doc_id long, text string").repartition(8)
    made = substring_dedup.dedup_substrings(docs, cell_bytes=20000, bucket_bytes=5000)
    assert {(r["id"], r["n_removed"]): r["n"] for r in made.groupBy("id", "n_removed").agg(F.count("*").alias("n")).collect()} == {(1, 0): 300, (2, 200): 300}


def test_equal_windows_stand_under_equal_keys():
    rnd = np.random.default_rng(1)
    shared = rnd.integers(0, 6, 40)
    for _ in range(50):
        a = np.concatenate([rnd.integers(0, 6, rnd.integers(0, 20)), shared, rnd.integers(0, 6, rnd.integers(0, 20))]).astype(np.uint64)
        b = np.concatenate([rnd.integers(0, 6, rnd.integers(0, 20)), shared, rnd.integers(0, 6, rnd.integers(0, 20))]).astype(np.uint64)
        names, bounds = np.concatenate([a, b]) * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(a), len(a) + len(b)])
        first, keys = substring_dedup.window_keys(names, bounds, 13)
        seen = {}
        for f, k in zip(first, keys):
            assert seen.setdefault(names[f : f + 13].tobytes(), k) == k


# SimHash


def plain_fingerprint(text, k):
    w = split((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, distance):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    points = list(root)
    for i, p in enumerate(points):
        for q in points[:i]:
            if bin(p ^ q).count("1") <= distance:
                root[find(p)] = find(q)
    return {p: find(p) for p in points}


def test_simhash_query_matches_brute_force(spark, sf_dir, real_docs):
    texts = {r["doc_id"]: r["text"] for r in real_docs.collect()}
    prints = {i: plain_fingerprint(t, 4) for i, t in texts.items()}
    group = plain_components(prints.values(), 4)
    least = {}
    for i, p in prints.items():
        least[group[p]] = min(i, least.get(group[p], i))
    made = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert made == {i: (f"{p:016x}", least[group[p]]) for i, p in prints.items()}


def test_ball_links_find_every_component(spark, monkeypatch):
    rnd = random.Random(5)
    points = [rnd.getrandbits(64) for _ in range(150)]
    points += [p ^ sum(1 << b for b in rnd.sample(range(64), d)) for p in points for d in (1, 3, 4, 5)]
    points += [(1 << 63) ^ sum(1 << b for b in rnd.sample(range(9), 4)) for _ in range(60)]  # a crowded prefix
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in points]
    links = simhash.ball_links(spark.createDataFrame(signed * 2, "p long"))
    made = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    want = plain_components([p for p in points], 4)
    groups = {}
    for p, g in want.items():
        groups.setdefault(g, set()).add(int(np.uint64(p).astype(np.int64)))
    for members in groups.values():
        assert {made.get(p, p) for p in members} == {min(members)}
    for left in (0, 1, 2):  # pieces split on further bits give the same links
        x = np.unique(np.array(points, np.uint64))
        whole = simhash.meeting_links(x, np.full(len(x), left), 64)
        monkeypatch.setattr(simhash, "PIECE", 5000)
        assert simhash.meeting_links(x, np.full(len(x), left), 64).tolist() == whole.tolist()
        monkeypatch.undo()


def test_simhash_takes_odd_rows(edge_docs, no_docs):
    rows = {(r["id"], r["simhash"]): r["component"] for r in simhash.near_duplicates(edge_docs).collect()}
    assert rows[(2, 0)] == rows[(3, 0)] == rows[(9, 0)] == 2
    assert rows[next(k for k in rows if k[0] == 4)] == 1
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = [r["doc_id"] for r in similar.keep_first(edge_docs).collect()]
    assert 2 in kept and 3 not in kept and 4 not in kept and 1 in kept
    odd = edge_docs.withColumns({c: F.lit(1) for c in ("simhash", "id", "hash", "part0", "name", "component", "body")})
    assert simhash.fingerprints(odd).columns == [*odd.columns, "simhash_"]
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert sorted(str(r["doc_id"]) for r in similar.keep_first(odd).collect()) == sorted(map(str, kept))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (1, 0)]
    made = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert made == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1300), 1000)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# nearest neighbours


def plain_nearest(ids, x, q, k):
    scores = x @ x[q]
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-scores[i], ids[i]))[:k]
    return [(ids[i], scores[i]) for i in order]


def test_nearest_neighbours_recall_and_scores(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], np.float32).astype(np.float64)
    made = {}
    for r in queries.op3_nearest(spark, sf).collect():
        made.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert set(made) == set(asked)
    hits = 0
    for q in asked:
        want = plain_nearest(ids, x, ids.index(q), 20)
        rows = sorted(made[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        for _, i, s in rows:
            assert s == pytest.approx(x[ids.index(i)] @ x[ids.index(q)], abs=1e-12)
        hits += len({r[1] for r in rows} & {i for i, _ in want})
    assert hits >= 0.9 * 20 * len(asked)


def test_nearest_neighbours_take_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (105, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (120, [])]
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(60, [-0.0, 3.0]), (61, [0.0, 3.0]), (62, [2.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    made = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0).orderBy("rank").collect():
        made.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert set(made) == {0, 20, 40, 60}
    assert made[20] == [(62, 2.0)] + [(i, 1.0) for i in range(19)]
    assert made[60][:2] == [(61, 9.0), (62, 6.0)] and made[60][2:] == [(i, 0.0) for i in range(18)]
    assert ann.nearest(table.where("vec_id > 99"), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(table.where("vec_id = 60"), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("lengths", ["unit", "unequal", "tail"])
def test_nearest_neighbours_on_several_leaves(spark, lengths):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths != "unit":
        x *= rng.uniform(0.3, 3, (4000, 1))
    if lengths == "tail":  # one vector is 100 times longer than the next
        x[17] *= 300
    x = x.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    made = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, beam=64).collect():
        made.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(made[q] & {i for i, _ in plain_nearest(list(range(4000)), x, q, 20)}) for q in range(0, 4000, 20))
    assert hits >= 0.93 * 20 * 200


def test_rounds_improve_a_graph(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vector array<float>")
    longest = float(np.linalg.norm(x, axis=1).max())
    codes, _ = storage.write_table(table.mapInArrow(lambda b: ann._encode(b, longest), "node long, band int, code binary"), "test")
    band = {r["node"]: r["band"] for r in codes.select("node", "band").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    bands = np.array([band[i] for i in range(3000)])
    sims[bands[:, None] != bands[None]] = -2
    np.fill_diagonal(sims, -2)

    def recall(rounds):
        near = {}
        for r in ann.build_graph(codes, 24, degree=16, trees=2, rounds=rounds).collect():
            near.setdefault(r["u"], set()).add(r["v"])
        return np.mean([len(near.get(i, set()) & set(np.argsort(-sims[i])[:16].tolist())) / 16 for i in range(3000) if (bands == bands[i]).sum() > 300])

    start, settled = recall(0), recall(None)
    assert settled > 0.85 and settled > start + 0.2, (start, settled)


def test_vectors_of_each_dimension_are_a_table(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(6)] + [(20 + i, [1.0, 0.0, float(i)]) for i in range(9)] + [(40, [5.0])]
    made = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0, k=3).orderBy("rank").collect():
        made.setdefault(r["query_id"], []).append(r["id"])
    assert made == {0: [5, 4, 3], 20: [21, 22, 23]}
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "node", "vector", "code", "rank")})
    assert ann.nearest(odd, F.col("id") % 20 == 0, k=3).count() == 6


def test_nearly_equal_vectors_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    rng = np.random.default_rng(9)
    x = np.ones((600, 8)) + rng.normal(size=(600, 8)) * 1e-3
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(np.float64)
    made = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, k=5).collect():
        made.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(made[q] & {i for i, _ in plain_nearest(list(range(600)), x, q, 5)}) for q in range(0, 600, 20))
    assert hits >= 0.9 * 5 * 30


def test_substring_oracle_agrees_on_odd_rows(edge_docs, tmp_path):
    path = str(tmp_path / "d.parquet")
    edge_docs.where("doc_id IS NOT NULL").toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql(queries.ORACLE_SQL["op7_substring_dedup"]).fetchall())
    made = substring_dedup.dedup_substrings(edge_docs.where("doc_id IS NOT NULL")).select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, made)) == want

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, descent


def unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(table, **settings):
    made = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, **settings).collect():
        made.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return made


def recall(made, x, k):
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({i for _, i, _ in made[q]} & set(np.argsort(-scores)[:k].tolist()))
    return hits / k / len(range(0, len(x), 20))


def test_rounds_improve_a_graph_in_memory():
    x = unit(3000, 24, 1)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    due = np.argsort(-sims, axis=1)[:, :10]

    def share(rounds):
        graph = descent.descend(x, 16, 2, rounds, np.random.default_rng(2))
        ids, far = descent.rows_of(graph), descent.sims_of(graph)
        assert all(len(set(r)) == 16 and i not in r for i, r in enumerate(ids.tolist())) and (np.diff(far, axis=1) <= 0).all()
        assert np.allclose(far, np.take_along_axis(sims, ids, axis=1), atol=1e-5)
        return np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), due.tolist(), strict=True)])

    start, settled = share(0), share(None)
    assert settled > 0.85 and settled > start + 0.2, (start, settled)


@pytest.mark.parametrize("n", [1, 2, 3, 300])
def test_small_and_equal_rows_have_graphs(n):
    graph = descent.descend(np.full((n, 4), 0.5, np.float32), 48, 3, None, np.random.default_rng(0))
    near = descent.links(graph, 8)
    assert graph.shape == (n, min(48, n - 1)) and near.shape == (n, 16) and (near <= n).all() and (near != np.arange(n)[:, None]).all()


def test_a_search_works_in_one_pass_over_the_table(spark, monkeypatch):
    """The graph's rounds were joins of the table with itself before, and each round of the search was another."""
    monkeypatch.setattr(ann, "PART", 700)
    x = unit(4000, 16, 3)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    spark.sparkContext.setJobGroup("one pass", "op3")
    made = found(table)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one pass")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 70, len(jobs)
    assert recall(made, x.astype(np.float64), 20) > 0.93


def test_queries_go_to_the_cells_that_can_answer(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 300)
    chosen, choose = [], ann.choose
    monkeypatch.setattr(ann, "choose", lambda tried, cells, *a: chosen.append((*choose(tried, cells, *a), cells)) or chosen[-1][:2])
    x = (unit(8, 16, 4)[np.arange(2400) % 8] + 0.1 * unit(2400, 16, 5)).astype(np.float32)
    made = found(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>"))
    assert chosen[0][0] < chosen[0][2] and recall(made, x.astype(np.float64), 20) > 0.93


def test_equal_ids_with_other_vectors_are_queries_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    made = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(made[20]) == [(1, 1, 2.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 0.0)]

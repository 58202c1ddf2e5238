"""Approximate nearest neighbours by inner product: NN-descent graphs and greedy search on them.

Index.  Equal vectors are one node, with its smallest ids.  Nodes are dealt into *bands* of lengths within a
factor of ``FACTOR`` (all below ``2 ** -SHORT`` of the longest are one), since among vectors of about one
length cosines order inner products.  A band is dealt into *cells* around centers that are fitted on a bounded
sample; a cell of more than ``PART`` nodes or so goes on at random.  Such a part fits into a task, which builds its
graph in memory (``descent``): it starts from random trees of small leaves, whose nodes are compared; NN-descent
then compares each node's neighbours of neighbours, and every node keeps its best ``degree``; rounds end when few
enough edges change.  A node travels once for its graph, not in every round.

Search.  A query goes to the cells that are likeliest to hold its nearest, by the mean and spread of their sample.
In each part it starts at the nearest of a bounded sample of nodes; in every round it visits the best nodes it
hasn't visited and keeps the ``beam`` best seen; it ends when all of those are visited.  The best are scored
exactly, in double precision on the original vectors, and their ids are ranked.

Recall is measured on each table: ``PROBES`` queries are compared with every node and are searched for in every part,
with beams of several widths.  The number of cells and the beam are the cheapest with which ``TARGET`` of their
nearest were found; if even the widest beam in all cells finds fewer, all nodes are looked at.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; vectors
of several dimensions are tables of their own, as products across them mean nothing; equal vectors are
ranked by id; equal ids count as rows of their own, except that a query never meets its own id; an empty
table has no rows.  Whatever grows with the table stays in Spark: the driver sees samples only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import descent, storage

#: Bands of lengths.
FACTOR, SHORT = 1.25, 6
#: Graph: neighbours a node, trees, nodes of a part, tasks that a small table is dealt to and the least nodes of
#: each, bound of a band's sample.
DEGREE, TREES, PART, PARTS, LEAST, SAMPLE = 48, 3, 32768, 6, 4096, 16384
#: Search: neighbours of a node that it looks at, each way; the narrowest beam, and how often that may double.
LINKS, BEAM, WIDER = 48, 32, 4
PROBES, TARGET = 64, 0.95
#: Standard deviations above a cell's mean product where a query's best there is expected; nodes that are scored
#: exactly beyond those that are wanted.
ABOVE, SPARE = 3.5, 12


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part; -0.0 becomes 0.0."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")))


def nodes_of(rows: DataFrame, members: int) -> DataFrame:
    """``(node, vector, members)``: one row for each distinct vector; its smallest ids, ascending,
    of which ``node`` is the first.  A running limit keeps frequent vectors from piling up."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_nth") <= members)
    grouped = ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return grouped.select(F.col("members")[0].alias("node"), "vector", "members")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal sizes, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encoded(x: np.ndarray) -> pa.Array:
    """Vectors as bytes."""
    raw = np.ascontiguousarray(x, "<f4")
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * (4 * raw.shape[1])), pa.py_buffer(raw)])


def _decoded(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def _directions(x: np.ndarray) -> np.ndarray:
    """Unit rows; no square leaves the range of numbers."""
    scaled = x / np.abs(x).max(axis=1, keepdims=True).astype(np.float64)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _encode(batches: Iterator[pa.RecordBatch], longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("vector")).astype(np.float64)
        largest = np.abs(x).max(axis=1, keepdims=True)
        share = np.minimum(np.linalg.norm(x / largest, axis=1) * (largest[:, 0] / longest), 1)
        band = np.minimum(np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(FACTOR)), np.floor(SHORT * np.log(2) / np.log(FACTOR)))
        named = {n: batch.column(n) for n in batch.schema.names if n != "vector"} | {"band": pa.array(band.astype(np.int32)), "code": _encoded(x)}
        yield pa.RecordBatch.from_arrays(list(named.values()), list(named))


class Cells:
    """A band's cells: centers fitted on a sample by k-means, with the means and spreads of their vectors."""

    def __init__(self, sample: np.ndarray, cells: int, rng: np.random.Generator):
        unit = _directions(sample)
        self.middle = unit.mean(axis=0)
        y = unit - self.middle
        self.centers = y[rng.choice(len(y), min(cells, len(y)), replace=False)]
        for _ in range(8 if cells > 1 else 0):
            own = self.place(sample)
            sums = np.zeros((len(self.centers), y.shape[1]))
            np.add.at(sums, own, y)
            counts = np.bincount(own, minlength=len(sums))
            self.centers = (sums[counts > 0] / counts[counts > 0, None]).astype(np.float32)
        own = self.place(sample)
        long = sample.astype(np.float64)
        self.means, self.spreads = np.zeros(self.centers.shape), np.zeros(len(self.centers))
        for cell in range(len(self.centers)):
            members = long[own == cell] if (own == cell).any() else long
            self.means[cell] = members.mean(axis=0)
            self.spreads[cell] = np.sqrt(members.var(axis=0).mean())

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return np.argmax((_directions(x) - self.middle) @ self.centers.T - (self.centers**2).sum(axis=1) / 2, axis=1)


def _ranking(q: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """All cells, those likeliest to hold a query's nearest first."""
    lengths = np.linalg.norm(q.astype(np.float64), axis=1, keepdims=True)
    return np.argsort(-(q @ means.T + ABOVE * lengths * spreads), axis=1, kind="stable")


def _deal(codes: DataFrame, dim: int, rng: np.random.Generator, sample: int = SAMPLE) -> tuple[DataFrame, str, np.ndarray, np.ndarray, list[list[int]]]:
    """``codes`` with ``cell`` and ``part``, stored, and its path; the cells' means, spreads and parts."""
    sizes = {r["band"]: r["n"] for r in codes.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a few dozen
    part = min(PART, max(LEAST, -(-sum(sizes.values()) // PARTS)))
    bands, first = {}, {}
    means, spreads = [np.zeros((0, dim))], [np.zeros(0)]
    for band, n in sorted(sizes.items()):
        wanted = sample if n > part else 1024
        some = codes.where((F.col("band") == band) & (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(1, n // (2 * wanted)))) == 0))
        got = some.select("code").orderBy(F.xxhash64("node"), "node", "code").limit(wanted).collect() or codes.where(F.col("band") == band).select("code").limit(wanted).collect()  # bounded by the parameter
        first[band] = sum(len(m) for m in means)
        bands[band] = Cells(np.frombuffer(b"".join(r["code"] for r in got), "<f4").reshape(-1, dim), -(-n // part), rng)
        means.append(bands[band].means)
        spreads.append(bands[band].spreads)

    def deal(batches):
        for batch in batches:
            band, cell = batch.column("band").to_numpy(), np.zeros(batch.num_rows, np.int32)
            x = _decoded(batch.column("code"), dim)
            for b in np.unique(band).tolist():
                cell[band == b] = first[b] + bands[b].place(x[band == b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in codes.schema.fields)
    dealt, path = storage.write_table(codes.mapInArrow(deal, f"{kinds}, cell int"), "cells")
    parts: list[list[int]] = [[] for _ in range(sum(len(m) for m in means))]
    total = 0
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():  # a row a cell
        pieces = -(-r["n"] // max(1, part + part // 2))
        parts[r["cell"]] = list(range(total, total + pieces))
        total += pieces
    start = F.lit(np.array([p[0] if p else 0 for p in parts], np.int64).tolist())
    pieces = F.lit(np.array([max(1, len(p)) for p in parts], np.int64).tolist())
    dealt = dealt.withColumn("part", F.get(start, F.col("cell")) + F.pmod(F.xxhash64("code", F.lit(4)), F.get(pieces, F.col("cell"))))
    return dealt, path, np.concatenate(means), np.concatenate(spreads), parts


def _built(table: pa.Table, dim: int, degree: int, trees: int, rounds: int | None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A part's rows in the order of a tree's leaves, their vectors, and their graph."""
    by_node = np.argsort(table.column("node").to_numpy(), kind="stable")
    x = _decoded(table.column("code"), dim)[by_node]
    unit, rng = _directions(x), np.random.default_rng([5, len(x)])
    order = np.concatenate(list(descent.leaves(unit, rng)))
    return table.take(pa.array(by_node[order])), x[order], descent.descend(unit[order], degree, trees, rounds, rng)


def build_graph(codes: DataFrame, dim: int, *, degree: int = DEGREE, trees: int = TREES, sample: int = SAMPLE, rounds: int | None = None) -> DataFrame:
    """``(u, v, sim)``: each node's neighbours of its part by NN-descent, ``rounds`` rounds or, if None, until it
    settles.  ``codes`` is a stored table ``(node, band, code)``."""

    def build(table):
        table, _, graph = _built(table, dim, degree, trees, rounds)
        u, at = np.nonzero(graph != descent.NONE)
        ids = table.column("node").to_numpy()
        return pa.table({"u": ids[u], "v": ids[descent.rows_of(graph)[u, at]], "sim": descent.sims_of(graph)[u, at]})

    return _deal(codes, dim, np.random.default_rng(5), sample)[0].groupBy("part").applyInArrow(build, "u long, v long, sim float")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision, from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i].astype(np.float64) * b[:, i]
    return total


def _finished(q: np.ndarray, x: np.ndarray, found: np.ndarray, starts: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of each query's best nodes (the number of nodes stands for none), exactly scored: counts, ids, scores."""
    who, at = np.nonzero(found < len(x))
    node = found[who, at]
    score = _products(q[who], x[node])
    sizes = starts[node + 1] - starts[node]
    own = np.repeat(np.arange(len(node)), sizes)
    ids = members[np.repeat(starts[node] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))]
    who, score = who[own], score[own]
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    counts = np.bincount(who, minlength=len(q))
    keep = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts) < k
    return np.minimum(counts, k), ids[keep], score[keep]


def _beams(beam: int) -> list[int]:
    return [beam << i for i in range(WIDER + 1)]


INDEX = "part long, place int, code binary, members array<long>, near binary, probe int, beam int, nth int, id long, score double"


def build_index(dealt: DataFrame, dim: int, probes: np.ndarray, ranks: np.ndarray, k: int, *, degree: int, trees: int, links: int, beam: int, rounds: int | None) -> DataFrame:
    """Each part's rows in their ``place`` with their neighbours' places, and, with no place, what each probe's search
    found there by each beam: the best ``k`` scores and which of the probe's cells that is; beam 0: all nodes compared."""

    def build(table):
        part, cell = table.column("part")[0].as_py(), table.column("cell")[0].as_py()
        table, x, graph = _built(table, dim, degree, trees, rounds)
        near = descent.links(graph, links)
        lists = table.column("members").combine_chunks()
        starts, members = lists.offsets.to_numpy(), lists.values.to_numpy()
        tried: list[tuple[np.ndarray, ...]] = []
        for width in [0, *_beams(beam)] if len(probes) else []:
            found = descent.greedy(x, near, probes, width or len(x))[:, : k + SPARE]
            counts, ids, score = _finished(probes, x, found, starts, members, k)
            who = np.repeat(np.arange(len(probes)), counts)
            tried.append((who, np.full(len(who), width), ranks[who, cell], ids, score))
        who, width, nth, ids, score = (np.concatenate(c) for c in zip(*tried, strict=True)) if tried else (np.zeros(0),) * 5
        n, m = len(x), len(who)
        near = np.ascontiguousarray(near, "<i4")
        near = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * near.shape[1])), pa.py_buffer(near)])
        void = lambda kind: pa.nulls(n, kind)
        rows = pa.table([pa.array(np.full(n, part)), pa.array(np.arange(n, dtype=np.int32)), table.column("code"), lists, near, void(pa.int32()), void(pa.int32()), void(pa.int32()), void(pa.int64()), void(pa.float64())], names)
        seen = [pa.array(np.full(m, part)), *(pa.nulls(m, rows.schema.field(c).type) for c in names[1:5]), *(pa.array(v.astype(np.int32)) for v in (who, width, nth)), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.float64))]
        return pa.concat_tables([rows, pa.table(seen, names)])

    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    return dealt.groupBy("part").applyInArrow(build, INDEX)


def choose(tried: DataFrame, cells: int, total: int, k: int, probes: int, target: float, beam: int) -> tuple[int, int]:
    """The number of cells and the beam with the least work among those that found ``target`` of the probes' nearest;
    where ties let none find so many of the very ids, other ids with scores as good count too."""
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    best = tried.where("beam = 0").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k)
    worst = best.groupBy("probe").agg(F.min("score").alias("worst"), F.collect_set("id").alias("due"))
    good = tried.where("beam > 0").join(worst, "probe").where(F.col("score") >= F.col("worst") - F.abs("worst") * 1e-9)
    hits = good.groupBy("beam", "probe", "nth").agg(F.count_if(F.array_contains("due", F.col("id"))).alias("same"), F.count("*").alias("alike"))
    found = {(kind, width): np.zeros((probes, cells)) for kind in ("same", "alike") for width in _beams(beam)}
    for r in hits.collect():  # some rows for each probe and beam
        for kind in ("same", "alike"):
            found[kind, r["beam"]][r["probe"], r["nth"]] += r[kind]
    due = min(k, total)
    for kind in ("same", "alike"):
        options = []
        for width in _beams(beam):
            right = np.minimum(np.cumsum(found[kind, width], axis=1), due).sum(axis=0) >= target * due * probes
            if right.any():
                options.append(((int(np.argmax(right)) + 1) * (width + 32), int(np.argmax(right)) + 1, width))
        if options:
            return min(options)[1:]
    return cells, 1 << 30


def search(index: DataFrame, routed: DataFrame, dim: int, k: int, beam: int) -> DataFrame:
    """``(q, found)``: the best of each query ``(part, q, code)`` in each part, ``found`` an array of the negative score
    and the id.  A task holds one part at a time; its queries pass by in batches."""

    def look(batches):
        part, rows, loaded = None, [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
            for a, b in zip(cuts, cuts[1:]):
                some = batch.slice(a, b - a)
                if parts[a] != part:
                    part, rows, loaded = parts[a], [], None
                n = int(some.column("q").is_null().to_numpy(zero_copy_only=False).sum())
                if n:
                    rows.append(some.slice(0, n))
                if n == some.num_rows:
                    continue
                if loaded is None:
                    table = pa.Table.from_batches(rows)
                    lists = table.column("members").combine_chunks()
                    near = np.frombuffer(b"".join(table.column("near").to_pylist()), "<i4").reshape(table.num_rows, -1)
                    loaded, rows = (_decoded(table.column("code"), dim), near, lists.offsets.to_numpy(), lists.values.to_numpy()), []
                x, near, starts, members = loaded
                some = some.slice(n)
                asked = _decoded(some.column("code"), dim)
                counts, ids, score = _finished(asked, x, descent.greedy(x, near, asked, beam)[:, : k + SPARE], starts, members, k)
                each = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], ["minus", "id"])
                yield pa.RecordBatch.from_arrays([some.column("q"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), each)], ["q", "found"])

    rows = index.select("part", F.lit(None).cast("long").alias("q"), "place", "code", "members", "near")
    asking = routed.select("part", "q", F.lit(None).cast("int").alias("place"), "code", F.lit(None).cast("array<long>").alias("members"), F.lit(None).cast("binary").alias("near"))
    both = rows.unionByName(asking).repartition("part").sortWithinPartitions("part", F.col("q").asc_nulls_first(), "place")
    each = both.mapInArrow(look, "q long, found array<struct<minus:double,id:long>>")
    return each.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def nearest(vectors: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, links: int = LINKS, beam: int = BEAM, rounds: int | None = None, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, id, score)``: for every row that ``is_query`` (a condition on ``id``), the
    ``k`` nearest other rows found by inner product, ties by id."""
    spark = vectors.sparkSession
    rows, path = storage.write_table(usable(vectors, id_col, vector_col), "vectors")
    answers = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    for size in [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]:
        answers = answers.unionByName(_nearest_of(rows.where(F.size("vector") == size), is_query, size, k, degree, links, beam, rounds, target))
    storage.drop_table(spark, path)
    return answers


def _nearest_of(rows: DataFrame, is_query, dim: int, k: int, degree: int, links: int, beam: int, rounds: int | None, target: float) -> DataFrame:
    spark = rows.sparkSession
    nodes, nodes_path = storage.write_table(nodes_of(rows, k + 1), "nodes")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    total, longest = nodes.agg(F.count("*"), F.max(F.sqrt(square))).first()
    longest = float(longest)

    def encode(batches):
        return _encode(batches, longest)

    def as_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("q"), _encoded(_matrix(batch.column("vector")))], ["q", "code"])

    asking = rows.where(is_query).select("id", "vector")
    asked, _ = storage.write_table(asking.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    by_class, _ = storage.write_table(asking.join(asked, "vector").select(F.col("id").alias("query_id"), "q"), "queries")
    queries = asked.mapInArrow(as_bytes, "q long, code binary")
    some = queries.orderBy(F.xxhash64("code"), "code").limit(PROBES).collect()  # bounded by the constant
    probes = np.frombuffer(b"".join(r["code"] for r in some), "<f4").reshape(-1, dim)
    dealt, dealt_path, means, spreads, parts = _deal(nodes.mapInArrow(encode, "node long, members array<long>, band int, code binary"), dim, np.random.default_rng(5))
    ranks = np.argsort(_ranking(probes, means, spreads), axis=1)
    index, _ = storage.write_table(build_index(dealt, dim, probes, ranks, k + 1, degree=degree, trees=TREES, links=links, beam=beam, rounds=rounds), "index")
    for path in (nodes_path, dealt_path):
        storage.drop_table(spark, path)
    cells, width = choose(index.where("place IS NULL"), len(means), total, k + 1, len(probes), target, beam) if len(probes) else (1, beam)

    def route(batches):
        for batch in batches:
            order = _ranking(_decoded(batch.column("code"), dim), means, spreads)[:, :cells]
            for nth in range(order.shape[1]):
                to = [parts[c] for c in order[:, nth]]
                at = np.repeat(np.arange(len(to)), [len(p) for p in to])
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([i for p in to for i in p], np.int64)), *own.columns], ["part", *own.schema.names])

    lists = search(index.where("place IS NOT NULL"), queries.mapInArrow(route, "part long, q long, code binary"), dim, k + 1, width)
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    answers = by_class.join(lists, "q").select("query_id", F.posexplode(others).alias("place", "f"))
    return answers.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), (-F.col("f.minus")).alias("score"))

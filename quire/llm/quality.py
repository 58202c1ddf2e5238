"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; unlabelled web text is training rows without a
label.  A small network over dense text features is fitted by minimising the non-negative unbiased
risk  ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``  with the logistic loss; where the second
term would be negative, the step goes up that term, as published.  The class prior is estimated from
training labels: the share of 1 among them, shrunk towards one half by two pseudo-labels.

The network's logits are shifted so that 0.3, the usual threshold, falls where the prior's share of
the unlabelled sample lies above, but no higher than ``KEPT`` of the trusted positives allow.

Features are of the text alone: shares of its bytes, of byte classes in word starts and ends, and
how far words, word pairs and lines repeat.  Fitting reads a bounded sample, ``max_positives`` and
``max_unlabelled`` rows with the smallest id hashes; every text is scored.

Defined results: null and empty texts have the features of an empty text and are scored; labels
that are null are ignored, and such rows count as unlabelled; a document with several labels counts once for
each; of rows with one id one is fitted on; repeated rows get equal scores; with no positives or no unlabelled rows every score is the estimated prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import storage, words

MAX_POSITIVES, MAX_UNLABELLED = 6000, 12000
#: The share of trusted positives that the threshold must keep, and a margin below, in logits.
THRESHOLD, KEPT, MARGIN = 0.3, 0.998, 0.35
_PAIRS = words.RunHash(11)
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_CLASS = np.zeros(256, dtype=np.int64)  # of a byte: control and blank, punctuation, digit, capital, small, beyond ASCII
_CLASS[33:128] = 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 2, 3, 4, 5


def _repeats(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: its share of distinct keys, and of its most frequent key; 1 and 0 if none."""
    total = np.bincount(rows, minlength=n)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(keys)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, rows[at], sizes)
    some = np.maximum(total, 1)
    return np.where(total > 0, np.bincount(rows[at], minlength=n) / some, 1.0), most / some


def features_of(column: pa.Array) -> np.ndarray:
    """One row of features a text."""
    out = [np.zeros((0, WIDTH), np.float32)]
    plain = np.ones(256, dtype=bool)
    plain[10] = False
    for block, lines in zip(words.blocks(column, words.NOT_SPACE, lower=False), words.blocks(column, plain, lower=False), strict=True):
        n, size = block.rows, np.diff(block.offsets)
        row_of = np.repeat(np.arange(n), size)
        counts = np.bincount(row_of * 256 + block.data, minlength=n * 256).reshape(n, 256)
        per_byte = np.sqrt(counts / np.maximum(size, 1)[:, None])
        in_row, n_words = words.row_of_words(block), np.diff(block.bounds)
        of = np.maximum(n_words, 1)[:, None]
        first = np.bincount(in_row * 6 + _CLASS[block.data[block.starts]], minlength=n * 6).reshape(n, 6) / of
        last = np.bincount(in_row * 6 + _CLASS[block.data[block.ends - 1]], minlength=n * 6).reshape(n, 6) / of
        length = np.bincount(in_row, weights=block.ends - block.starts, minlength=n)[:, None] / of
        hashes = words.word_hashes(block)
        prefix = _PAIRS.prefix(hashes)
        pair = words.window_starts(block.bounds, 2)
        spread = [*_repeats(hashes, in_row, n), *_repeats(_PAIRS.between(prefix, pair, pair + 2), in_row[pair], n), *_repeats(words.word_hashes(lines), words.row_of_words(lines), n)]
        sizes = np.stack([np.log1p(n_words) / 10, np.diff(lines.bounds) / of[:, 0], n_words == 0], axis=1)
        out.append(np.concatenate([per_byte, first, last, length / 10, np.stack(spread, axis=1), sizes], axis=1).astype(np.float32))
    return np.concatenate(out)


WIDTH = 256 + 6 + 6 + 1 + 6 + 3


@dataclass
class Model:
    """A network with one hidden layer; without weights it gives the prior."""

    prior: float
    weights: tuple[np.ndarray, ...] = ()
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return (np.maximum(((x - mean) / scale).clip(-8, 8) @ w1 + b1, 0) @ w2 + b2).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) + self.shift) if self.weights else np.full(len(x), self.prior)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, hidden: int = 32, epochs: int = 60, rate: float = 2e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises the non-negative risk with Adam on mini-batches that mix both samples."""
    if not len(positive) or not len(unlabelled):
        return Model(prior)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (((x - mean) / scale).clip(-8, 8) for x in (positive, unlabelled))
    params = [rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.array(np.log(prior / (1 - prior)))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in params]
    steps, t = max(1, len(u) // 256), 0
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for step in range(steps):
            xp, xu = p[order_p[step::steps]] if len(p) >= steps else p, u[order_u[step::steps]]
            x = np.concatenate([xp, xu])
            h = np.maximum(x @ params[0] + params[1], 0)
            s = _sigmoid(h @ params[2] + params[3])
            n, m = len(xp), len(xu)
            sp, su = s[:n], s[n:]
            rest = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
            # d loss / d z: the logistic loss has s - 1 for the label 1 and s for the label 0
            positive_part, rest_part = np.zeros(n + m), np.zeros(n + m)
            positive_part[:n] = prior * (sp - 1) / n
            rest_part[:n], rest_part[n:] = -prior * sp / n, su / m
            dz = positive_part + rest_part if rest >= 0 else -rest_part
            dh = np.outer(dz, params[2]) * (h > 0)
            grads = [x.T @ dh + decay * params[0], dh.sum(axis=0), h.T @ dz + decay * params[2], dz.sum()]
            t += 1
            now = rate * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                a, b = moments[i]
                a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
                moments[i] = (a, b)
                params[i] = params[i] - now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    model = Model(prior, tuple(np.asarray(w, np.float32) for w in (mean, scale, *params)))
    cut = min(np.quantile(model.logits(positive), 1 - KEPT), np.quantile(model.logits(unlabelled), 1 - prior))
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut + MARGIN)
    return model


def is_held_out(id_col: Column) -> Column:
    """One of five folds, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = features_of(batch.column("body"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("good"), pa.array([row.tobytes() for row in made], pa.binary())], ["id", "good", "features"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """Fits on training folds only.  Ids, then texts, of the bounded sample reach the driver."""
    spark = docs.sparkSession
    seen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    if prior is None:
        n, good = seen.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.lit(0))).first()
        prior = (good + 1) / (n + 2)
    ids = docs.where(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).select(F.col(id_col).alias("id")).distinct()
    some = seen.where("label = 1").join(ids, "id", "left_semi").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_positives).withColumn("good", F.lit(True))
    others = ids.join(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id")), "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(max_unlabelled).withColumn("good", F.lit(False))
    chosen = some.unionByName(others).collect()  # bounded by max_positives + max_unlabelled
    if not chosen:
        return Model(prior)
    picked = spark.createDataFrame(chosen, some.schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(picked), "id").select("id", "good", "body")
    schema = T.StructType([texts.schema["id"], T.StructField("good", T.BooleanType()), T.StructField("features", T.BinaryType())])
    rows = texts.mapInArrow(_feature_batches, schema).groupBy("id").agg(F.first("good").alias("good"), F.min("features").alias("features")).collect()  # one row an id
    made = {kind: np.frombuffer(b"".join(sorted(r["features"] for r in rows if r["good"] is kind)), np.float32).reshape(-1, WIDTH) for kind in (True, False)}
    return fit(made[True], made[False], prior)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, name: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.scores(features_of(batch.column(text_col)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, name])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and the score, its name ended in underscores while the input
    has such a column."""
    kept = docs.columns if keep is None else keep
    name = storage.free(kept, name)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])
    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(partial(_score_batches, model=model, text_col=text_col, name=name, keep=kept), schema)


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that score at least ``threshold``."""
    name = storage.free(docs.columns, "score")
    return score(docs, model, text_col=text_col, name=name).where(F.col(name) >= threshold).drop(name)

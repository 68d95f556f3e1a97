"""Toxicity: non-negative positive-unlabelled learning over hashed words and their beginnings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_sample, cut, text_slices, with_columns_from_text

WORDS = re.compile(r"[^\W_]+")
BITS = 18


def features(word: str) -> list[int]:
    """The hashed word and its hashed beginnings of three to six letters, which inflected forms share."""
    parts = [word, *(f"{word[:k]}-" for k in range(3, 7) if len(word) >= k)]
    return [xxhash.xxh32_intdigest(p) & ((1 << BITS) - 1) for p in parts]


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, positive, unlabelled): in how many texts of (positive, text) a feature is. A task sends one row per feature at most."""

    def count(batches):
        ids, seen = Memo(features, 100_000), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                for positive, t in zip(part.column("positive").to_pylist(), texts, strict=True):
                    own = {i for w in set(WORDS.findall(t.lower())) for i in ids[w]}
                    seen[int(positive), np.fromiter(own, np.int64, len(own))] += 1
                    ids.trim()
        found = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[1, found]), pa.array(seen[0, found])], ["feature", "positive", "unlabelled"])

    parts = rows.mapInArrow(count, "feature int, positive bigint, unlabelled bigint")
    return parts.groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("unlabelled").alias("unlabelled"))


def active_features(rows: DataFrame, place: dict[int, int]) -> DataFrame:
    """positive and ids array<int>: the places of each text's features that have one."""

    def make():
        ids = Memo(lambda w: tuple(place[i] for i in features(w) if i in place), 100_000)

        def run(texts):
            out = []
            for t in texts:
                out.append(sorted({i for found in filter(None, map(ids.__getitem__, set(WORDS.findall(t.lower())))) for i in found}))
                ids.trim()
            return [out]

        return run

    return with_columns_from_text(rows, "text", "ids array<int>", make, ["positive"])


class Sparse:
    """Rows of active features with value 1, as one flat array."""

    def __init__(self, ids: pa.ListArray):
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.flat = ids.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature and row number of each entry of these rows."""
        n = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.starts[rows], n) + offset], owner


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_gradient(w: np.ndarray, positive: tuple[np.ndarray, np.ndarray], n_positive: int, unlabelled: tuple[np.ndarray, np.ndarray], n_unlabelled: int, prior: float) -> np.ndarray:
    """The gradient, by weights and bias (last), of prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).

    Where the second part is negative (it cannot be, for true negatives), it is that of the negated second part: a step then unlearns what
    the model has fitted to single unlabelled texts. Entries are features and row numbers, as ``Sparse.take`` gives them.
    """
    (fp, rp), (fu, ru) = positive, unlabelled
    sp = sigmoid(np.bincount(rp, w[fp], n_positive) + w[-1])
    su = sigmoid(np.bincount(ru, w[fu], n_unlabelled) + w[-1])
    slope_p, slope_u = prior * sp * (1 - sp) / n_positive, su * (1 - su) / n_unlabelled
    if su.mean() - prior * sp.mean() >= 0:
        dp, du = -2 * slope_p, slope_u
    else:
        dp, du = slope_p, -slope_u
    grad = np.bincount(fp, dp[rp], len(w)).astype(float) + np.bincount(fu, du[ru], len(w))
    grad[-1] = dp.sum() + du.sum()
    return grad


def nnpu(positive: Sparse, unlabelled: Sparse, prior: float, features: int, *, steps: int = 1000, batch: int = 384, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (``risk_gradient``), by Adam.

    The loss is the sigmoid of the wrong side's score, which a single text can't drive far. Weights are averaged over the second half of the steps.
    """
    rng = np.random.default_rng(seed)
    w, m, v, total = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        p, u = rng.integers(0, len(positive), min(batch, len(positive))), rng.integers(0, len(unlabelled), 2 * batch)
        grad = risk_gradient(w, positive.take(p), len(p), unlabelled.take(u), len(u), prior)
        grad[:-1] += decay * w[:-1]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            total += w
    w = total / (steps - steps // 2)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", *, train_rows: Column | None = None, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 12000, min_count: int = 4, min_lift: float = 3.0) -> dict:
    """Learns from rows of ``docs`` that ``labels`` confirms as toxic (1) and from unlabelled rows.

    ``train_rows``, a condition on the key, says which labels may be used. About ``max_positive`` and ``max_unlabelled`` rows are used
    at most, chosen by a hash of the key, and features in ``min_count`` positives at
    least, and ``min_lift`` times as common there as in unlabelled texts: these documented bounds hold what the driver fits, the
    active features of the sampled texts.
    ``prior``, the share of toxic texts, is the share among the allowed labels where it isn't given. Without toxic labels every score is 0.
    """
    allowed = labels if train_rows is None else labels.where(train_rows)
    usable = allowed.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("y")).where("y is not null and __key is not null").groupBy("__key").agg(F.max("y").alias("y"))
    known, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic:
        return {"weights": {}, "bias": -40.0}
    prior = min(max(prior or toxic / known, 1e-4), 1 - 1e-4)
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    confirmed = bounded_sample(usable.where("y = 1"), max_positive, F.col("__key"), "toxic", toxic)
    # the confirmed keys are at most about max_positive, so they may be broadcast
    positive = texts.join(F.broadcast(confirmed.select("__key")), "__key").select(F.lit(True).alias("positive"), "text")
    rows = cut(positive.unionByName(bounded_sample(texts, max_unlabelled, F.col("__key"), "unlabelled").select(F.lit(False).alias("positive"), "text")))
    n = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    if len(n) < 2:
        return {"weights": {}, "bias": -40.0}
    lift = (F.col("positive") / n[True]) / ((F.col("unlabelled") + 1) / n[False])
    counts = feature_counts(rows).where((F.col("positive") >= min(min_count, max(2, n[True] // 20))) & (lift >= min_lift))
    active = sorted(r["feature"] for r in counts.select("feature").collect())
    found = active_features(rows, {f: i for i, f in enumerate(active)}).toArrow()
    side = lambda positive: Sparse(found.filter(pc.equal(found["positive"], positive)).column("ids").combine_chunks())
    w, bias = nnpu(side(True), side(False), prior, len(active))
    return {"weights": dict(zip(active, w.tolist(), strict=True)), "bias": bias}


def score(df: DataFrame, model: Broadcast, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to every row; columns of these names, in any case, give way.

    The score is the sigmoid of the summed weights of the distinct features of the whole text, however long; null and empty texts get the bias
    alone. Repeated rows get the same score each, and an empty table gives an empty one.
    """

    def make():
        weights, bias = model.value["weights"], model.value["bias"]
        active = Memo(lambda w: tuple(i for i in features(w) if i in weights))

        def run(texts):
            z = []
            for t in texts:
                found = filter(None, map(active.__getitem__, set(WORDS.findall((t or "").lower()))))
                z.append(bias + sum(weights[i] for i in {i for ids in found for i in ids}))
                active.trim()
            s = sigmoid(np.array(z))
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return run

    return with_columns_from_text(df, text, "score double, predicted int", make, df.columns)

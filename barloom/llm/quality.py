"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Memo, beside, bounded_sample, text_slices
from .toxicity import WORDS, sigmoid

BITS = 16
FACTORS = 8
STATISTICS = 12


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    """Statistics of the whole text, each from 0 to 1, from one histogram of its bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h = np.zeros(256)
    for start in range(0, len(raw), 1 << 22):
        h += np.bincount(raw[start : start + (1 << 22)], minlength=256)
    n, w = max(1.0, h.sum()), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    letters = h[65:91].sum() + h[97:123].sum()
    ends = h[[33, 46, 63]].sum()
    return [
        h[65:91].sum() / max(1.0, letters),
        h[48:58].sum() / n,
        min(1.0, 4 * h[[35, 36, 37, 38, 42, 60, 62]].sum() / n),
        min(1.0, 4 * h[124] / n),
        min(1.0, 20 * h[33] / n),
        min(1.0, ends / w),
        min(1.0, n / w / 16),
        1 - len(set(lines)) / max(1, len(lines)),
        distinct / w,
        min(1.0, len(lines) / w * 8),
        min(1.0, math.log1p(len(words)) / 12),
        h[128:].sum() / n,
    ]


def cells(values: list[float], name: str) -> list[int]:
    """Each statistic as one of 16 bins, hashed like a word."""
    return [xxhash.xxh32_intdigest(f"\x00{name}{i}:{min(15, int(16 * x))}") & ((1 << BITS) - 1) for i, x in enumerate(values)]


def featuriser(metadata: int):
    """A function from texts and metadata rows to flat feature ids, their values and each row's start.

    Words are distinct and weigh 1 / sqrt(their number); bins of statistics and metadata (log scale) weigh 1.
    """
    ids = Memo(lambda w: xxhash.xxh32_intdigest(w) & ((1 << BITS) - 1))

    def run(texts: list[str | None], extra: list[list[float]] | None = None):
        flat, value, starts = [], [], [0]
        for i, t in enumerate(texts):
            text = t or ""
            words = WORDS.findall(text.lower())
            own = set(words)
            hashed = np.fromiter(map(ids.__getitem__, own), np.int64, len(own))
            marks = cells(structure(text, words, len(own)), "s")
            if extra is not None:
                marks += cells([min(1.0, math.log1p(abs(x or 0.0)) / 24) for x in extra[i]], "m")
            flat += [hashed, np.array(marks, np.int64)]
            value += [np.full(len(own), 1 / math.sqrt(max(1, len(own)))), np.ones(len(marks))]
            starts.append(starts[-1] + len(own) + len(marks))
            ids.trim()
        return np.concatenate(flat), np.concatenate(value), np.array(starts)

    return run


def machine(flat: np.ndarray, value: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits, in time linear in the features: all pairs cost (sum of v x)^2 - sum of (v x)^2, halved. Also the sums of v x."""
    at = starts[:-1]
    vx = v[flat] * value[:, None]
    s = np.add.reduceat(vx, at, axis=0)
    return bias + np.add.reduceat(w[flat] * value, at) + 0.5 * (s * s - np.add.reduceat(vx * vx, at, axis=0)).sum(axis=1), s


def fit(flat: np.ndarray, words: np.ndarray, starts: np.ndarray, y: np.ndarray, *, epochs: int = 8, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 6) -> dict:
    """Adam on the logistic loss. Row i has the features flat[starts[i] : starts[i + 1]], the first words[i] of them words."""
    rng = np.random.default_rng(seed)
    used = np.unique(flat)
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    length = np.diff(starts)
    theta = np.concatenate([np.zeros((len(used), 1)), rng.normal(0, 0.01, (len(used), FACTORS))], axis=1)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            n = length[part]
            at = np.concatenate([[0], np.cumsum(n)])
            offset = np.arange(at[-1]) - np.repeat(at[:-1], n)
            ids = place[flat[np.repeat(starts[part], n) + offset]]
            value = np.where(offset < np.repeat(words[part], n), np.repeat(1 / np.sqrt(np.maximum(1, words[part])), n), 1.0)
            z, s = machine(ids, value, at, theta[:, 0], theta[:, 1:], bias)
            d = (sigmoid(z) - y[part]) / len(part)
            dx = np.repeat(d, n) * value
            touched, inverse = np.unique(ids, return_inverse=True)
            g = np.concatenate([dx[:, None], dx[:, None] * (np.repeat(s, n, axis=0) - theta[ids, 1:] * value[:, None])], axis=1)
            grad = np.stack([np.bincount(inverse, g[:, j], len(touched)) for j in range(1 + FACTORS)], axis=1) + decay * theta[touched]
            step += 1
            m1[touched] += 0.1 * (grad - m1[touched])
            m2[touched] += 0.01 * (grad * grad - m2[touched])
            theta[touched] -= rate * m1[touched] / (1 - 0.9 ** min(step, 300)) / (np.sqrt(m2[touched] / (1 - 0.99 ** min(step, 3000))) + 1e-8)
            bias -= rate * d.sum()
    w, v = np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS))
    w[used], v[used] = theta[:, 0], theta[:, 1:]
    return {"w": w.astype(np.float32), "v": v.astype(np.float32), "bias": bias}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", *, metadata: tuple[str, ...] = (), train_rows: Column | None = None, max_rows: int = 10000) -> dict:
    """Learns from rows of ``docs`` that ``labels`` marks, about ``max_rows`` at most (a documented bound), chosen by a hash of the key.

    ``metadata`` names numeric columns of ``docs`` that are features; null counts as 0. Without labels every score is 0.5.
    """
    allowed = labels if train_rows is None else labels.where(train_rows)
    known = allowed.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("y")).where("y is not null and __key is not null").groupBy("__key").agg(F.max("y").alias("y"))
    chosen = bounded_sample(known, max_rows, F.col("__key"), "quality")
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text"), F.array(*[F.col(f"`{c}`").cast("double") for c in metadata]).cast("array<double>").alias("extra"))
    # chosen has about max_rows rows at most, so it may be broadcast
    joined = rows.join(F.broadcast(chosen), "__key").select("y", "extra", F.col("text"))

    def features(batches):
        run = featuriser(len(metadata))
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                flat, value, starts = run(texts, part.column("extra").to_pylist() if metadata else None)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype(np.int32)))
                words = np.diff(starts) - STATISTICS - len(metadata)
                yield pa.RecordBatch.from_arrays([part.column("y"), lists, pa.array(words.astype(np.int32))], ["y", "ids", "words"])

    sample = joined.mapInArrow(features, "y double, ids array<int>, words int").toArrow()
    if not sample.num_rows:
        return {"w": np.zeros(1 << BITS, np.float32), "v": np.zeros((1 << BITS, FACTORS), np.float32), "bias": 0.0}
    ids = sample.column("ids").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit(ids.flatten().to_numpy(zero_copy_only=False), sample.column("words").to_numpy(), starts, sample.column("y").to_numpy())


def score(df: DataFrame, model: Broadcast, text: str = "text", *, metadata: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold`` on) to every row; columns of these names, in any case, give way.

    Null and empty texts are scored by their statistics alone, like any text; whole texts count, however long. Repeated rows get the same score
    each, and an empty table gives an empty one.
    """

    def judge(df, at):
        carried = df.select(*df.columns, F.array(*[F.col(at(c)).cast("double") for c in metadata]).cast("array<double>").alias("__extra"), F.col(at(text)).alias("__text"))
        schema = StructType(list(df.schema.fields)).add("score", "double").add("predicted", "integer")
        keep = df.columns

        def run(batches):
            m, make = model.value, featuriser(len(metadata))
            for batch in batches:
                for part, texts in text_slices(batch, "__text"):
                    flat, value, starts = make(texts, part.column("__extra").to_pylist() if metadata else None)
                    z, _ = machine(flat, value.astype(np.float32), starts, m["w"], m["v"], m["bias"])
                    s = sigmoid(z.astype(float))
                    columns = [part.column(c) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

        return carried.mapInArrow(run, schema)

    return beside(df, ["score", "predicted"], judge)

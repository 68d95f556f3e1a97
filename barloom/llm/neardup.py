"""MinHash near-duplicates: bands propose pairs, odd sketches judge them, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, beside, cut, filtered, forget, narrowed, slot_of, text_slices, with_columns_from_text

BANDS, ROWS = 32, 4
"""A pair of similarity 0.75 shares none of 32 bands of 4 with a probability of 5e-6."""
FIRST_BANDS = 8
"""Bands of the first round of hubs: it joins most copies, so that later rounds have few to compare."""
SKETCH_BITS = 512
SHINGLE = 5
HOT = 256
"""Partners of a hub that one task is given at a time."""


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACE_FACTORS = splitmix(1, SHINGLE) | np.uint64(1)
SAMPLE_FACTORS = splitmix(2, BANDS * ROWS) | np.uint64(1)


def shingle_set(text: str, hashes: Memo) -> np.ndarray:
    """The distinct 5-word shingles as sorted 64-bit hashes; fewer words are one shingle."""
    words = text.encode().lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(len(h), SHINGLE)
    if not k:
        return h
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += h[j : j + n] * PLACE_FACTORS[j]
    return np.unique(mix(total))


def samples(shingles: np.ndarray, step: int = 2048) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), step):
        np.minimum(least, (shingles[i : i + step, None] * SAMPLE_FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """[texts, BANDS] keys from [texts, samples]."""
    grouped = least.reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def odd_sketches(least: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """[texts, words of 64 bits]: each sample toggles one bit of its text's bitmap, so equal samples cancel out in the XOR of two."""
    bit = mix(least + np.arange(least.shape[1], dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(bits)
    flat = np.arange(len(least))[:, None] * bits + bit.astype(np.int64)
    odd = (np.bincount(flat.ravel(), minlength=len(least) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(least), bits), axis=1).view(np.int64)


def most_odd_bits(threshold: float, k: int = BANDS * ROWS, n: int = SKETCH_BITS, sigmas: float = 5.5) -> int:
    """The XOR population count that a pair of similarity ``threshold`` stays within, but for ``sigmas`` deviations.

    Two things deviate: how many of the k samples differ, and how many toggles meet in one of the n bits.
    """
    differ = k * (1 - threshold)
    left = (1 - 2 / n) ** (2 * differ)
    spread = (2 * left) ** 2 * k * threshold * (1 - threshold) + 4 * (2 * differ) ** 2 / (2 * n)
    return int(n / 2 * (1 - left) + sigmas * spread**0.5)


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, 50_000)


def signatures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """n_shingles, digest (of the set; null without words), bands and sketch of every row."""

    def make():
        hashes = word_hashes()

        def run(texts):
            sets = []
            least = np.zeros((len(texts), BANDS * ROWS), np.uint64)
            for i, t in enumerate(texts):
                s = shingle_set(t or "", hashes)
                hashes.trim()
                sets.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None))
                if len(s):
                    least[i] = samples(s)
            keys, sketch = band_keys(least), odd_sketches(least)
            return [[n for n, _ in sets], [d for _, d in sets], list(keys), list(sketch)]

        return run

    return with_columns_from_text(docs, text, "n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>", make, keep)


def occurrences(texts: DataFrame) -> DataFrame:
    """(shingle, node): each shingle of each node's set."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for part, own in text_slices(batch, "text"):
                sets = [shingle_set(t, hashes) for t in own]
                hashes.trim()
                nodes = np.repeat(part.column("node").to_numpy(), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(nodes)], ["shingle", "node"])

    return texts.select("node", "text").mapInArrow(spell, "shingle bigint, node bigint")


def rare_shingles(texts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, left): of each node's set those rarest shingles of which two similar sets must have one in common.

    Shingles are ordered by the number of sets that have them. Two sets whose overlap is at least percent * n of the larger one have a common shingle
    among the first n - percent * n + 1 of each; ``left`` is how many of its set stand from it on, so that the overlap of two sets whose first
    common shingle it is can't be larger. Shingles of one set come first, but are not returned.
    """
    every = cut(occurrences(texts))
    shared = every.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    common = every.join(shared, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("common")).join(sizes, "node")
    first = F.greatest(F.size("common") + 1 - F.ceil(F.lit(percent) * F.col("n") / 100), F.lit(0)).cast("int")
    rows = common.select("node", "n", F.size("common").alias("size"), F.posexplode(F.slice("common", 1, first)).alias("at", "rare"))
    return rows.select("rare.shingle", "node", "n", (F.col("size") - F.col("at")).alias("left"))


def odd_bits(a: Column, b: Column, bits: int = SKETCH_BITS) -> Column:
    words = bits // 64
    total = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for i in range(1, words):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def connected(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label): the least node of each component of ``edges`` (a, b), by least neighbours and pointer jumping.

    ``known`` has labels of some of the edges, from which it goes on. Neighbours are combined before they are shuffled, so a node with very
    many edges weighs one row per task.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    if known is not None:
        first = first.join(known.withColumnRenamed("label", "old"), "node", "left").select("node", F.least("label", "old").alias("label"))
    labels = cut(first)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut(lower.join(jump, "label").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("was")).alias("moved")))
        forget(labels)
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            forget(both)
            return labels


def with_text(rows: DataFrame, pairs: DataFrame, side: str, other: str, texts: DataFrame, name: str) -> DataFrame:
    """``rows``, of the table ``pairs`` or more columns beside it, with the text of ``side`` as ``name``.

    A node with more than HOT partners is dealt to several tasks by a hash of the partner, its text once to each. Which nodes these are is told
    by slots that they hash to, so what is broadcast has a fixed size, and a node that shares such a slot is merely dealt finer.
    """
    near = narrowed(texts, F.col("node"), pairs, F.col(side)).select(F.col("node").alias(side), F.col("text").alias(name))
    heavy = cut(pairs.groupBy(side).count().where(F.col("count") > HOT))
    if heavy.isEmpty():
        return rows.join(near, side)
    slots = heavy.groupBy(slot_of(F.col(side))).agg(F.ceil(F.max("count") / HOT).alias("__k"))

    def dealt(df: DataFrame) -> DataFrame:
        marked = df.withColumn("__slot", slot_of(F.col(side))).join(F.broadcast(slots), "__slot", "left").drop("__slot")
        return marked.withColumn("__salt", F.pmod(F.xxhash64(other), F.coalesce("__k", F.lit(1)))).drop("__k")

    copies = near.join(dealt(pairs).select(side, "__salt").distinct(), side)
    return dealt(rows).join(copies, [side, "__salt"]).drop("__salt")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Rows come by b, whose set is kept for the next one."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, hub = word_hashes(), None, None
        for batch in batches:
            a, b, similar = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, other in enumerate(b):
                if other != last:
                    last, hub = other, shingle_set(batch.column("y")[i].as_py(), hashes)
                own = shingle_set(batch.column("x")[i].as_py(), hashes)
                hashes.trim()
                common = len(np.intersect1d(own, hub, assume_unique=True))
                similar.append(100 * common >= percent * (len(own) + len(hub) - common))
            keep = np.flatnonzero(similar)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], ["a", "b"])

    both = with_text(with_text(pairs, pairs, "a", "b", texts, "x"), pairs, "b", "a", texts, "y")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint")


def verdicts(located: DataFrame, percent: int, hub_rounds: int) -> DataFrame:
    """(id, hash, n_shingles, component, group) of the distinct ids and hashes of ``located`` (id, hash, text); group is null without words."""
    signed = cut(signatures(located, "text", ["id", "hash"]))
    nodes = cut(
        signed.where("digest is not null").groupBy("digest")
        .agg(F.min("id").alias("id"), F.max(F.struct("id", "hash")).alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    bucketed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = bucketed.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = cut(shared)
    members = cut(narrowed(bucketed, F.col("bucket"), shared, F.col("bucket")).join(shared, "bucket").select("bucket", F.col("band").cast("tinyint").alias("band"), "node"))
    forget(shared)
    sketches = cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "sketch", "n", "at"))
    wanted = sketches.select("node", F.col("at.id").alias("__id"), F.col("at.hash").alias("__hash"))
    likely = narrowed(located, F.col("hash"), wanted, F.col("__hash"))
    texts = cut(likely.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).dropDuplicates(["node"]).select("node", "text"))

    limit = most_odd_bits(percent / 100)
    sketch = sketches.select("node", "sketch", "n")

    def found(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes, odd sketches and then the full sets confirm."""
        a, b = sketch.toDF("a", "sa", "na"), sketch.toDF("b", "sb", "nb")
        sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        close = cut(pairs.join(a, "a").join(b, "b").where(sized & (odd_bits(F.col("sa"), F.col("sb")) <= limit)).select("a", "b"))
        links = cut(confirmed(close, texts, percent))
        forget(close)
        return links

    labels, links = None, None
    for turn in range(hub_rounds + 1):
        hubs = turn < hub_rounds
        some = members.where(F.col("band") < FIRST_BANDS) if hubs and turn == 0 else members
        now = some.withColumn("label", F.col("node")) if labels is None else some.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        pick = F.struct(F.xxhash64("node", F.lit(turn)), "node")
        parts = now.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.min(pick).alias("pick"))
        major = parts.groupBy("bucket").agg(F.max(F.struct("size", "label", "pick.node")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("bucket", F.col("m.label").alias("major"), F.col("m.node").alias("hub"))
        if hubs:
            met = now.join(major, "bucket").where("label != major")
            pairs = met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        else:
            left = cut(now.join(major, "bucket").select("node", "label").distinct())
            pairs = by_rare_shingles(narrowed(texts, F.col("node"), left, F.col("node")).join(left, "node", "left_semi"), left, sketch.select("node", "n"), percent)
        new = found(pairs)
        before, links = links, new if links is None else cut(links.unionByName(new))
        labels_before, labels = labels, connected(links, labels)
        forget(*[t for t in (before, labels_before, new) if t is not None and t is not links])

    least = nodes.join(labels, "node").groupBy("label").agg(F.min("id").alias("least"))
    classes = nodes.join(labels, "node", "left").join(least, "label", "left").select("digest", F.coalesce("least", "id").alias("component"), F.coalesce("label", "node").alias("group"))
    judged = signed.select("id", "hash", "digest", "n_shingles").groupBy("id", "hash", "digest", "n_shingles").count().join(classes, "digest", "left")
    return judged.select("id", "hash", "n_shingles", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "group", "count")


def by_rare_shingles(texts: DataFrame, labels: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes with different labels that have one of their rarest shingles in common; no similar pair is without.

    Shingles of nodes of one label only are left out, and in each of the others the nodes outside its largest label meet the rest, so neither
    a family of copies nor a passage that many texts repeat forms all pairs.
    """
    rows = cut(rare_shingles(texts, sizes, percent).join(labels, "node"))
    parts = rows.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    major = parts.groupBy("shingle").agg(F.max(F.struct("size", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("shingle", F.col("m.label").alias("major"))
    marked = cut(narrowed(rows, F.col("shingle"), major, F.col("shingle")).join(major, "shingle"))
    x = marked.where("label != major").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "label", "n", "left")])
    y = marked.withColumn("main", F.col("label") == F.col("major")).select(F.col("shingle").alias("other"), *[F.col(c).alias(f"{c}_y") for c in ("node", "label", "n", "left", "main")])
    apart = (F.col("label_x") != F.col("label_y")) & (F.col("main_y") | (F.col("node_x") < F.col("node_y")))
    enough = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    return x.join(y, (F.col("shingle") == F.col("other")) & apart & enough).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def judged_rows(df: DataFrame, text: str, key: str, percent: int, hub_rounds: int) -> DataFrame:
    """Every row with __n, __component, __group, and __count, the number of its repetitions; ``text`` and ``key`` are placeholders."""
    located = df.withColumn("__hash", F.xxhash64(text))
    made = verdicts(located.select(F.col(key).alias("id"), F.col("__hash").alias("hash"), F.col(text).alias("text")), percent, hub_rounds)
    named = made.toDF("__id", "__h", "__n", "__component", "__group", "__count")
    return located.join(named, located[key].eqNullSafe(F.col("__id")) & F.col("__hash").eqNullSafe(F.col("__h")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 75, hub_rounds: int = 2) -> DataFrame:
    """Adds n_shingles, component_id (the least ``key`` that links reach, itself included) and kept to every row of ``docs``.

    Rows with 100 * shared shingles >= ``percent`` * all shingles are linked. Columns of the new names, in any case, give way. A null or empty text
    has no words: it is linked with nothing and kept. Repeated rows are of one component; rows that share the least key are kept alike. A null key
    counts as no key: component_id is the least other key, or null; kept then if both are null. An empty table gives an empty one; texts are
    taken whole, however long.

    Texts with one set are one node, so exact copies never form pairs. Nodes that share a band stand in a bucket. Rather than
    all pairs of a bucket, each round takes a hub from each bucket's largest component and compares it with the nodes of others; links
    merge components, and buckets of one component are done. The nodes of buckets that still have several after ``hub_rounds`` meet where they
    share one of their rarest shingles, as every similar pair does (``by_rare_shingles``). Odd sketches and set sizes settle
    most comparisons; the rest are confirmed on the full sets, a hub with many partners by several tasks (``with_text``).
    """
    new = {"n_shingles": F.col("__n"), "component_id": F.col("__component")}

    def judge(df, at):
        rows = judged_rows(df, at(text), at(key), percent, hub_rounds)
        return rows.withColumns(new | {"kept": F.col(at(key)).eqNullSafe(F.col("__component"))})

    return beside(docs, [*new, "kept"], judge)


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 75, hub_rounds: int = 2) -> DataFrame:
    """One row of each group of near-duplicates, and every row without words, with its own columns; cases as in ``near_duplicates``.

    Of a group the rows with the least key are in question. Where those are several (repeated rows, or texts that share a key or have none), one of
    them stays; only such rows are shuffled once more.
    """

    def judge(df, at):
        rows = judged_rows(df, at(text), at(key), percent, hub_rounds).where(F.col(at(key)).eqNullSafe(F.col("__component")) | F.col("__group").isNull())
        rivals = cut(rows.select("__group", "__count", "__hash", F.col(at(key)).alias("__key")).distinct().groupBy("__group").agg(F.sum("__count").alias("__rows")).where("__rows > 1 and __group is not null"))
        marked = rows.join(rivals, "__group", "left") if not rivals.isEmpty() else rows.withColumn("__rows", F.lit(None).cast("bigint"))
        return marked.where("__rows is null").unionByName(marked.where("__rows is not null").dropDuplicates(["__group"]))

    return filtered(docs, judge, F.lit(True))

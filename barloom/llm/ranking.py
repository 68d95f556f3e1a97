"""Ranked lexical search: shards of documents with posting lists, lists of term pairs with their joint maxima, and MaxScore over both."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, text_slices

TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
"""UTF-8 to terms: letters, digits and all beyond ASCII; only A-Z are lower-cased, all else is a space."""
SHARD_BYTES = 8 << 20
BLOCK_TERMS = 200_000
"""Queries are searched in blocks of about so many terms."""
MAX_PAIRS = 100_000
SEED_SHARDS = 8
SALTS = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def pairs_of(ranked: list) -> list[tuple]:
    """Terms two by two, from the lightest on; the heaviest may stand alone."""
    return list(zip(ranked[::2], ranked[1::2], strict=False))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1").astype(np.int64)


def cells(batch: pa.RecordBatch, i: int) -> dict:
    """The columns of row ``i`` of a table of shards: arrays of numbers, terms and pairs as lists of bytes."""
    at = lambda name: batch.column(name)[i].as_buffer().to_pybytes()
    out = {"keys": batch.column("keys")[i].values, "starts": np.frombuffer(at("starts"), np.int64), "sizes": np.frombuffer(at("sizes"), np.int64), "terms": at("terms").split(b" ")}
    for name in ("docs", "tfs"):
        out[name] = unpacked(at(name), int(out["starts"][-1]))
    if "joint" in batch.schema.names:
        ends = np.frombuffer(at("pair_starts"), np.int64)
        out |= {"pairs": at("pairs").split(b"\n") if len(ends) > 1 else [], "joint": np.frombuffer(at("joint"), np.int64), "pair_starts": ends, "common": unpacked(at("common"), int(ends[-1]))}
    return out


def row(keys: pa.Array, **columns: bytes | int) -> pa.RecordBatch:
    parts = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
    parts += [pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays(parts, ["keys", *columns])


SHARD_FIELDS = "sizes binary, terms binary, starts binary, docs binary, tfs binary"


def shards(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for about each SHARD_BYTES of text: its documents with a term (keys, sizes), their number, all their terms, and each term's documents and frequencies.

    Numbers are packed in bytes, so that a row is a few MB in all. starts has where the postings of each term begin, and their end; docs are places in keys, ascending.
    """
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, sizes, found, times, ids = 0, [], [], [], [], defaultdict()
        ids.default_factory = ids.__len__

        def out() -> pa.RecordBatch:
            term = np.concatenate(found)
            order = np.argsort(term, kind="stable")
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in found])[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(ids)))])
            return row(
                pa.concat_arrays(keys), n_docs=len(keys), length=sum(sizes), sizes=np.array(sizes, np.int64).tobytes(), terms=b" ".join(ids), starts=starts.astype(np.int64).tobytes(), docs=packed(doc), tfs=packed(np.concatenate(times)[order])
            )

        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                own = part.column("__key")
                for i, body in enumerate(texts):
                    terms = terms_of(body)
                    if terms:
                        counts = Counter(terms)
                        found.append(np.fromiter(map(ids.__getitem__, counts), np.int32, len(counts)))
                        times.append(np.fromiter(counts.values(), np.int32, len(counts)))
                        keys.append(own.slice(i, 1))
                        sizes.append(len(terms))
                        held += len(body)
                    if held >= SHARD_BYTES:
                        yield out()
                        held, keys, sizes, found, times = 0, [], [], [], []
                        ids.clear()
        if keys:
            yield out()

    schema = f"keys array<{kind}>, n_docs bigint, length bigint, {SHARD_FIELDS}"
    return docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def document_counts(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                spelled = pa.array(terms.as_py().split(b" "), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([spelled, pa.array(np.diff(np.frombuffer(starts.as_py(), np.int64)))], ["term", "df"])

    return shards.select("terms", "starts").mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms, times) of each row: its different terms in order, and how often each stands in it."""
    kind = queries.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                counts = [sorted(Counter(terms_of(t)).items()) for t in texts]
                terms = pa.array([[t.decode() for t, _ in c] for c in counts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("__key"), terms, pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int64()))], ["key", "terms", "times"])

    return queries.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"key {kind}, terms array<string>, times array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Index:
    """shards: a row per shard, with impacts and pair lists; df: (term, df); n_docs and length: documents with a term, and all their terms."""

    shards: DataFrame
    df: DataFrame
    n_docs: int
    length: int


@dataclass
class Pairs:
    """Pairs of terms to be listed: their names (both terms with a space between them), and the terms with their weights."""

    names: list[bytes]
    terms: tuple[pa.Array, pa.Array]
    weights: tuple[np.ndarray, np.ndarray]


def impacts_of(tfs: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 75 + (25 * sizes * n_docs) // length
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs])


def joint_lists(terms: pa.Array, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int, wanted: Pairs) -> dict[str, bytes]:
    """Of the wanted pairs whose terms a shard of ``n`` documents has: which, the joint maximum of their weighted impacts, and the documents with both."""
    a, b = (pc.fill_null(pc.index_in(x, value_set=terms), -1).to_numpy() for x in wanted.terms)
    here = np.flatnonzero((a >= 0) & (b >= 0))
    most, common, ends = np.zeros(len(here), np.int64), [], np.zeros(len(here) + 1, np.int64)
    of_first = np.zeros(n, np.int64)
    for i, p in enumerate(here):
        x, y = slice(starts[a[p]], starts[a[p] + 1]), slice(starts[b[p]], starts[b[p] + 1])
        of_first[docs[x]] = impacts[x]
        found = of_first[docs[y]]
        hit = found > 0  # an impact is never 0
        of_first[docs[x]] = 0
        both = docs[y][hit]
        if len(both):
            most[i] = (wanted.weights[0][p] * found[hit] + wanted.weights[1][p] * impacts[y][hit]).max()
        common.append(both)
        ends[i + 1] = ends[i] + len(both)
    return {"pairs": b"\n".join(wanted.names[p] for p in here), "joint": most.tobytes(), "pair_starts": ends.tobytes(), "common": packed(np.concatenate(common)) if common else b""}


def build_index(docs: DataFrame, workload: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", max_pairs: int = MAX_PAIRS) -> Index:
    """The index of all rows of ``docs`` that have a term, written as tables in the shared checkpoint folder.

    A term's impact in a document is (10^9 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L. Pairs of terms get a list of the documents with both and
    the largest sum of their weighted impacts, by shard: the ``max_pairs`` pairs that stand together in most queries of ``workload``, whose
    terms are paired from the lightest on (a bounded choice, which only decides how much is skipped; results are the same with any pairs or none).
    A null text has no term; repeated rows are documents of their own. Columns of any other names are ignored.
    """
    spark = docs.sparkSession
    plain = cut(shards(docs, key, text))
    n_docs, length = plain.select(F.sum("n_docs"), F.sum("length")).first()
    n_docs, length = n_docs or 0, length or 0
    df = cut(document_counts(plain))
    chosen = []
    if workload is not None:
        # A term's weight falls with its df, so the terms of a query go from the lightest on by df downwards.
        terms = query_terms(workload, query_key, query_text).withColumn("q", F.monotonically_increasing_id()).select("q", F.explode("terms").alias("term")).join(df, "term")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("df"), "term")) - 1
        two = terms.withColumn("at", place).groupBy("q", F.floor(F.col("at") / 2)).agg(F.min(F.struct("at", "term", "df")).alias("a"), F.max(F.struct("at", "term", "df")).alias("b"))
        pairs = two.where("a.at < b.at").groupBy(F.col("a.term").alias("a"), F.col("b.term").alias("b"), F.col("a.df").alias("n"), F.col("b.df").alias("k")).count()
        chosen = pairs.orderBy(F.desc("count"), "a", "b").limit(max_pairs).collect()
    wanted = Pairs(
        [f"{r.a} {r.b}".encode() for r in chosen], (pa.array([r.a.encode() for r in chosen], pa.binary()), pa.array([r.b.encode() for r in chosen], pa.binary())),
        (np.array([weight(n_docs, r.n) for r in chosen], np.int64), np.array([weight(n_docs, r.k) for r in chosen], np.int64)),
    )
    listed = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = cells(batch, i)
                impacts = impacts_of(c["tfs"], c["sizes"], c["docs"], n_docs, length)
                same = {name: batch.column(name)[i].as_py() for name in ("sizes", "terms", "starts", "docs", "tfs")}
                yield row(c["keys"], **same, most=np.maximum.reduceat(impacts, c["starts"][:-1]).tobytes(), **joint_lists(pa.array(c["terms"], pa.binary()), c["starts"], c["docs"], impacts, len(c["keys"]), listed.value))

    kind = plain.schema["keys"].dataType.simpleString()
    made = cut(plain.mapInArrow(run, f"keys {kind}, {SHARD_FIELDS}, most binary, pairs binary, joint binary, pair_starts binary, common binary"))
    forget(plain)
    return Index(made, df, n_docs, length)


class Shard:
    """One shard's lists, and the scores of queries against it."""

    def __init__(self, batch: pa.RecordBatch, i: int, block: Block):
        c = cells(batch, i)
        self.keys, self.starts, self.docs, self.joint, self.pair_starts, self.common = (c[n] for n in ("keys", "starts", "docs", "joint", "pair_starts", "common"))
        self.impacts = impacts_of(c["tfs"], c["sizes"], c["docs"], block.n_docs, block.length)
        self.most = np.frombuffer(batch.column("most")[i].as_buffer(), np.int64)
        self.place, self.pair_place = (pc.fill_null(pc.index_in(wanted, value_set=pa.array(own, pa.binary())), -1).to_numpy() for wanted, own in ((block.vocabulary, c["terms"]), (block.pairs, c["pairs"])))
        self.scores = np.zeros(len(self.keys), np.int64)

    def add(self, term: int, times: int, candidates: np.ndarray | None) -> None:
        """Adds a term's weighted impacts to the scores: to all its documents, or where the candidates are few, to those."""
        at = self.place[term]
        if at < 0:
            return
        part = slice(self.starts[at], self.starts[at + 1])
        docs, impacts = self.docs[part], self.impacts[part]
        if candidates is not None and 8 * len(candidates) < len(docs):
            where = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            hit = docs[where] == candidates
            self.scores[candidates[hit]] += times * impacts[where[hit]]
        else:
            self.scores[docs] += times * impacts

    def search(self, query: Query, least: int, k: int) -> list[tuple[int, object]]:
        """(score, key) of the documents that may be among the best ``k``: all those of ``least`` or more among this shard's best, ties with the last included.

        Terms come in pairs from the lightest on. A pair adds no more to a document than the larger of its own two maxima and the joint maximum of the
        documents with both, so the bounds of the lighter pairs, added up, tell which pairs alone can't lift a document to ``least``: documents are only
        taken from the lists of the others. From there on a document stays as long as its score and the bound of the pairs left may reach ``least``, where
        a document outside of a pair's list of both counts with the larger of the two.
        """
        at = self.place[query.terms]
        alone = np.where(at >= 0, self.most[at], 0) * query.weights if len(self.most) else np.zeros(len(at), np.int64)
        a, b = alone[::2], np.append(alone[1::2], np.zeros(len(alone) % 2, np.int64))
        either = np.maximum(a, b)
        listed = self.pair_place[query.pairs] if len(self.joint) else np.full(len(query.pairs), -1)
        listed = np.where(query.pairs >= 0, listed, -1)
        joint = np.where(listed >= 0, self.joint[listed] if len(self.joint) else 0, 0) * query.pair_times
        # A pair without a list here: one of its terms may be missing in the shard, and then its bound is the other's.
        bound = np.where(listed >= 0, np.minimum(np.maximum(either, joint), a + b), a + b)
        upto = np.concatenate([[0], np.cumsum(bound)])
        needed = int(np.searchsorted(upto[1:], least, "left"))  # pairs before this one can't reach ``least`` even together
        if needed == len(bound):
            return []
        self.scores[:] = 0
        for term, times in zip(query.terms[2 * needed :], query.weights[2 * needed :], strict=True):
            self.add(term, times, None)
        kept = np.flatnonzero(self.scores)
        for j in range(needed - 1, -1, -1):
            room = np.full(len(kept), bound[j])
            if listed[j] >= 0:
                common = self.common[self.pair_starts[listed[j]] : self.pair_starts[listed[j] + 1]]
                where = np.minimum(np.searchsorted(common, kept), max(len(common) - 1, 0))
                both = common[where] == kept if len(common) else np.zeros(len(kept), bool)
                room = np.where(both, bound[j], either[j])
            kept = kept[self.scores[kept] + room + upto[j] >= least]
            if not len(kept):
                return []
            for term, times in zip(query.terms[2 * j : 2 * j + 2], query.weights[2 * j : 2 * j + 2], strict=True):
                self.add(term, times, kept)
        scores = self.scores[kept]
        if len(kept) > k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        best = scores >= max(least, 1)
        return list(zip(scores[best].tolist(), self.keys.take(pa.array(kept[best])).to_pylist(), strict=True))


@dataclass
class Query:
    """terms: places in the block's vocabulary, from the lightest on, with their weights; pairs: places in its list of pairs, -1 for a term alone."""

    number: int
    terms: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    pair_times: np.ndarray


@dataclass
class Block:
    """Queries with their vocabulary and the names of their pairs, and what impacts depend on."""

    vocabulary: pa.Array
    pairs: pa.Array
    queries: list[Query]
    n_docs: int
    length: int


def block_of(rows: list, df: dict[str, int], n_docs: int, length: int) -> Block:
    """The queries (q, terms, times) of one block; terms of no document are left out."""
    vocabulary = {t: i for i, t in enumerate(df)}
    w = {t: weight(n_docs, n) for t, n in df.items()}
    pairs: dict[tuple[str, str], int] = {}
    queries = []
    for r in rows:
        times = {t: n for t, n in zip(r.terms, r.times, strict=True) if t in df}
        ranked = sorted(times, key=lambda t: (-df[t], t))
        own = [pairs.setdefault(p, len(pairs)) for p in pairs_of(ranked)]
        # The joint maximum holds for each term once, so it is taken as often as the more frequent of the two stands in the query.
        often = [max(times[a], times[b]) for a, b in pairs_of(ranked)]
        alone = len(ranked) % 2
        queries.append(Query(r.q, np.array([vocabulary[t] for t in ranked], np.int64), np.array([times[t] * w[t] for t in ranked], np.int64), np.array(own + [-1] * alone, np.int64), np.array(often + [1] * alone, np.int64)))
    return Block(pa.array([t.encode() for t in df], pa.binary()), pa.array([f"{a} {b}".encode() for a, b in pairs], pa.binary()), queries, n_docs, length)


def by_rank(found: tuple[int, object]) -> tuple:
    return -found[0], found[1] is None, found[1]


def searched(shards: DataFrame, block, k: int, floors) -> DataFrame:
    """(q, key, score): the best ``k`` of each query among the shards of each task. floors: scores that each query's k-th best document has at least."""
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, floor = block.value, floors.value if floors else {}
        tops: dict[int, list] = {q.number: [] for q in work.queries}
        key_type = None
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for i in range(batch.num_rows):
                shard = Shard(batch, i, work)
                for q in work.queries:
                    top = tops[q.number]
                    if len(q.terms):
                        least = max(floor.get(q.number, 1), top[k - 1][0] if len(top) >= k else 1)
                        found = shard.search(q, least, k)
                        if found:
                            tops[q.number] = sorted(top + found, key=by_rank)[:k]
        if key_type is not None:
            out = [(q, key, score) for q, top in tops.items() for score, key in top]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], key_type), pa.array([s for _, _, s in out], pa.int64())], ["q", "key", "score"])

    return shards.mapInArrow(run, f"q bigint, key {kind}, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query with their rank; first among tasks with one remainder, so that no task gets a row of every other."""
    order = [F.desc("score"), F.asc_nulls_last("key")]
    part = found.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("q", "__salt").orderBy(*order))).where(F.col("rank") <= k).drop("__salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, rank, doc, score): the ``k`` documents of highest score above 0 for each row of ``queries``, equal scores by ascending document key (null last).

    The score sums weight times impact over the query's terms, repeats included, in whole numbers; the weight is floor(1000 ln((2 N + 2) / (2 df + 1))).
    Queries without a term, or with terms of no document only, have no rows; repeated rows are queries of their own and give equal rows. Each
    block of about BLOCK_TERMS query terms is sent to all tasks, which search their shards by ``Shard.search``. A first search of a few shards gives each query a score that its
    k-th best document has at least, so that the others can skip what can't reach it.
    """
    spark = queries.sparkSession
    asked = cut(query_terms(queries, key, text).withColumn("q", F.monotonically_increasing_id()).where(F.size("terms") > 0))
    n_terms = asked.select(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-n_terms // BLOCK_TERMS))
    n_shards = index.shards.select(F.count("*")).first()[0]
    few = index.shards.where(F.pmod(F.xxhash64("keys"), F.lit(max(1, n_shards // SEED_SHARDS))) == 0)
    parts = []
    for i in range(n_blocks):
        block_rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == i)
        known = block_rows.select(F.explode("terms").alias("term")).distinct().join(index.df, "term").collect()
        block = spark.sparkContext.broadcast(block_of(block_rows.collect(), {r.term: r.df for r in sorted(known)}, index.n_docs, index.length))
        floors = None
        if n_shards > SEED_SHARDS:
            floors = spark.sparkContext.broadcast({r.q: r.score for r in best_of(searched(few, block, k, None), k).where(F.col("rank") == k).select("q", "score").collect()})
        found = best_of(searched(index.shards, block, k, floors), k)
        parts.append(found if n_blocks == 1 else cut(found))
    every = reduce(DataFrame.unionAll, parts)
    return every.withColumnRenamed("key", "doc").join(asked.select("q", "key"), "q").select("key", "rank", "doc", "score")

"""Benchmark decontamination: suffix arrays of the training text, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import beside, cut, filtered, forget, text_slices

WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LONGEST = T.StructType().add("item_id", "string").add("doc_word", "integer").add("item_word", "integer").add("n_words", "integer")
STATE = T.StructType().add("__n_words", "long").add("__spans", T.ArrayType(T.IntegerType())).add("__items", T.ArrayType(T.StringType())).add("__longest", LONGEST)


def words_of(text: str) -> list[bytes]:
    """Words of digits, letters with A-Z lower-cased, and anything beyond ASCII."""
    return text.encode().translate(WORD_BYTES).split()


class Block:
    """A block of test items: their words as numbers from 1, and each window of ``n`` words with the items and places it has.

    A window is a test suffix cut after ``n`` words; an item of fewer words is one window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [np.array([number(w, len(self.vocabulary) + 1) for w in words], ">u4") for _, words in items]
        self.names = [name for name, _ in items]
        rows, owner, place, size = [], [], [], []
        for i, c in enumerate(coded):
            short = 0 < len(c) < n
            for p in range(1 if short else max(0, len(c) - n + 1)):
                rows.append(np.concatenate([c, np.zeros(n - len(c), ">u4")]) if short else c[p : p + n])
                owner.append(i), place.append(p), size.append(min(n, len(c)))
        keys = as_strings(np.array(rows, ">u4").reshape(-1, n))
        self.windows, inverse = np.unique(keys, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.starts = np.searchsorted(inverse[order], np.arange(len(self.windows) + 1))
        self.item, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.size = np.array(size, np.int64)[order][self.starts[:-1]] if len(rows) else np.zeros(0, np.int64)
        raw = self.windows.view(np.uint8).reshape(-1, n, 4).copy() if len(rows) else np.zeros((0, n, 4), np.uint8)
        raw[np.arange(n)[None, :] >= self.size[:, None]] = 255
        self.above = as_strings(raw.reshape(-1, n * 4).view(">u4"))
        self.least = int(self.size.min()) if len(rows) else n


def as_strings(tokens: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, whose order is that of the rows."""
    return np.ascontiguousarray(tokens).view(f"S{4 * tokens.shape[1]}").reshape(-1)


def suffix_array(tokens: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their first ``depth`` tokens as strings), in the order of the suffixes.

    A 0 is a word that no test item has, so nothing matches across it: suffixes with fewer than ``least`` words before the next 0
    can hold no window and are left out; what follows a 0 counts as 0.
    """
    zeros = np.flatnonzero(tokens == 0)
    edges = np.concatenate([zeros, [len(tokens)]])
    run = edges[np.searchsorted(zeros, np.arange(len(tokens)))] - np.arange(len(tokens))
    places = np.flatnonzero(run >= least)
    padded = np.concatenate([tokens, np.zeros(depth, tokens.dtype)]).astype(">u4")
    heads = padded[places[:, None] + np.arange(depth)]
    heads[np.arange(depth)[None, :] >= run[places][:, None]] = 0
    keys = as_strings(heads)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def search(block: Block, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of every window, by binary search in the suffix array of ``tokens``."""
    places, keys = suffix_array(tokens, block.n, block.least)
    if not len(places) or not len(block.windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.searchsorted(keys, block.windows, "left"), np.searchsorted(keys, block.above, "right")
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    return window, places[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def longest_match(block: Block, window: np.ndarray, place: np.ndarray, step: int = 1 << 18) -> tuple[int, int, int, int] | None:
    """(words, -place, item, place in item) of one document's longest verbatim match: windows on one diagonal that follow each other.

    Its occurrences are followed in pieces of bounded size, each window's items among them.
    """
    order = np.argsort(place, kind="stable")
    window, place = window[order], place[order]
    ends: dict[tuple[int, int], tuple[int, int]] = {}
    best = None
    per = block.starts[window + 1] - block.starts[window]
    pieces = np.searchsorted(np.cumsum(per), np.arange(step, per.sum() + step, step))
    for a, b in zip([0, *(pieces + 1)], [*(pieces + 1), len(window)], strict=True):
        w, p, m = window[a:b], place[a:b], per[a:b]
        if not len(w):
            continue
        at = np.repeat(block.starts[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        item, start, q, size = block.item[at], np.repeat(p, m), block.place[at], np.repeat(block.size[w], m)
        by = np.lexsort((start, start - q, item))
        item, start, q, size = item[by], start[by], q[by], size[by]
        new = np.ones(len(by), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] - q[1:] != start[:-1] - q[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(by)) - 1
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            key = int(item[i]), int(start[i] - q[i])
            began, ended = ends.get(key, (0, -2))
            begin = began if ended + 1 == start[i] else int(start[i])
            ends[key] = begin, int(start[j])
            found = int(start[j] + size[j]) - begin, -begin, key[0], begin - key[1]
            best = found if best is None or found > best else best
    return best


def match_slice(block: Block, texts: list[str | None], states: list[dict] | None) -> list[tuple]:
    """STATE of each text, its earlier state (from other blocks) taken in."""
    words = [words_of(t) if t else [] for t in texts]
    ids = [np.fromiter(map(block.vocabulary.get, w, repeat(0)), np.int64, len(w)) for w in words]
    starts = np.cumsum([0] + [len(i) + 1 for i in ids])
    tokens = np.zeros(starts[-1], np.int64)
    for i, s in zip(ids, starts, strict=False):
        tokens[s : s + len(i)] = i
    window, place = search(block, tokens)
    doc = np.searchsorted(starts, place, "right") - 1
    order = np.argsort(doc, kind="stable")
    window, place, doc = window[order], place[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, w in enumerate(words):
        a, b = bounds[k], bounds[k + 1]
        old = states[k] if states else {"__spans": [], "__items": [], "__longest": None}
        spans, items, longest = old["__spans"], old["__items"], old["__longest"]
        if a < b:
            at, own = place[a:b] - starts[k], window[a:b]
            edge = np.zeros(len(w) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + block.size[own], -1)
            for s, e in zip(spans[::2], spans[1::2], strict=True):
                edge[s] += 1
                edge[e] -= 1
            hit = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
            spans = np.flatnonzero(hit).tolist()
            used = np.unique(own)
            found = {int(i) for u in used for i in block.item[block.starts[u] : block.starts[u + 1]]}
            items = sorted({*items, *(block.names[i] for i in found)})
            n, begin, item, q = longest_match(block, own, at)
            if longest is None or n > longest["n_words"]:
                longest = {"item_id": block.names[item], "doc_word": -begin, "item_word": q, "n_words": n}
        out.append((len(w), spans, items, longest))
    return out


def blocks(benchmark: DataFrame, key: str, text: str, n: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words, dealt by Spark and read one at a time; at least one, if empty."""
    items = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("name"), F.col(f"`{text}`").alias("body"))
    words = items.agg(F.sum(F.regexp_count("body", F.lit(WORD)))).first()[0] or 0
    count = max(1, -(-words // block_words))
    for i in range(count):
        mine = items if count == 1 else items.where(F.pmod(F.xxhash64("name", "body"), F.lit(count)) == i)
        yield Block([(name, words_of(body or "")) for name, body in mine.collect()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, item_key: str = "item_id", item_text: str = "text", n: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """Adds to every row of ``docs``: n_words, n_hit (words inside any verbatim occurrence of a window of ``n`` item words), items
    (ids with such windows, as sorted strings), spans (word places: begin, end, begin, end, ...), longest (the longest verbatim
    match and where it is) and contaminated. Columns of these names, in any case, give way.

    Each task turns slices of its texts into suffix arrays (shards) and searches every test suffix in each; nothing is shuffled.
    A block of about ``block_words`` test words is held by the driver and broadcast at a time. Of a larger benchmark each block but the last
    writes what was found so far to the shared checkpoint folder and is given up before the next. Null and empty texts have no words
    and no hit; an empty benchmark hits nothing; an empty table gives an empty one; repeated rows stay; texts of any length are taken whole.
    """
    names = ["n_words", "n_hit", "items", "spans", "longest", "contaminated"]

    def judge(df, at):
        context, own = df.sparkSession.sparkContext, df.columns
        df = df.withColumn("__text", F.col(at(text)))
        base, table, shared = df.schema.fields, None, None
        for block in blocks(benchmark, item_key, item_text, n, block_words):
            if shared is not None:
                before, table = table, cut(df)
                shared.unpersist()
                if before is not None:
                    forget(before)
                df = table
            shared, later = context.broadcast(block), shared is not None
            df = df.mapInArrow(matcher(shared, later), T.StructType(base + STATE.fields))
        hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda s, x: x - s)  # end - begin + end - begin ..., as places ascend in pairs
        return df.select(*own, F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans"), F.col("__longest").alias("longest"), (F.size("__spans") > 0).alias("contaminated"))

    return beside(docs, names, judge)


def matcher(block: Broadcast, later: bool):
    state = to_arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                names = [c for c in part.schema.names if c not in state.names]
                old = part.select(state.names).to_pylist() if later else None
                columns = zip(*match_slice(block.value, texts, old), strict=True)
                arrays = [part.column(c) for c in names] + [pa.array(list(v), f.type) for v, f in zip(columns, state, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([part.schema.field(c) for c in names] + list(state)))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their own columns; cases as in ``find_leaks``."""
    return filtered(docs, lambda df, at: find_leaks(df, benchmark, at(text), **options), "not contaminated")

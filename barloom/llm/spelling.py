"""Spelling variants: words one letter apart, by bitsets over the vocabulary for each (position, letter), and the common form of each."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, slot_of, text_slices

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
"""Latin-1 to letters, of which only A-Z are lower-cased; all else is a space."""
HELD_WORDS = 400_000
"""A task hands its counts on when it holds so many words."""
HOT = 20_000
"""A block of more words is searched in parts of about so many."""


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", *, slips: int | None = None, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of the whole texts, A-Z lower-cased, of ``least_letters`` found ``least_count`` times.

    With ``slips``, words get planted errors: h is the crc32 of "<key>:<run>"; where ``slips`` divides h, the run's letter h mod length is left out.
    A null text has no words, a null key counts as the text ``null``, repeated rows count again, and an empty table gives an empty one. Columns of any
    other names are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                for doc, body in zip(part.column("__key").to_pylist(), texts, strict=True):
                    seed = zlib.crc32(f"{doc}:".encode())
                    for w, k in Counter((body or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                        if len(w) < least_letters:
                            continue
                        if slips:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                            if h % slips == 0:
                                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                                if len(w) < least_letters:
                                    continue
                        counts[w] = counts.get(w, 0) + k
                if len(counts) > HELD_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    words = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("__key"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bitsets of words, one for each (position, letter) and each length; bit i stands for word i."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        width, at, size = len(words) // 8 + 1, {}, {}
        for i, w in enumerate(words):
            byte, bit = i >> 3, 1 << (i & 7)
            for place in [*enumerate(w), len(w)]:
                held = size if isinstance(place, int) else at
                if place not in held:
                    held[place] = bytearray(width)
                held[place][byte] |= bit
        self.at = {k: int.from_bytes(v, "little") for k, v in at.items()}
        self.size = {k: int.from_bytes(v, "little") for k, v in size.items()}
        longest = max(self.size, default=0)
        self.longer = [0] * (longest + 1)  # by position: the words that have a letter there
        for n in range(longest, 0, -1):
            self.longer[n - 1] = self.longer[n] | self.size.get(n, 0)

    def near(self, word: str) -> tuple[int, int, int]:
        """The words that differ from ``word`` by one letter replaced, one letter more, and one letter less.

        All words go along at once, letter by letter: those equal so far, and those with their one error behind them. A word with a letter more is
        compared one position further on, one with a letter less one position back.
        """
        at, longer, end = self.at, self.longer, len(self.longer) - 1
        equal, replaced, more, less, back = self.all, 0, 0, 0, 0
        for i, letter in enumerate(word):
            here = at.get((i, letter), 0)
            has = longer[i] if i < end else 0
            more = (more | equal & has) & at.get((i + 1, letter), 0)
            less = less & at.get((i - 1, letter), 0) | equal
            replaced = replaced & here | equal & has & ~here
            equal &= here
            if not (equal or replaced or more or less):
                break
        n = len(word)
        return replaced & self.size.get(n, 0), (more | equal) & self.size.get(n + 1, 0), less & self.size.get(n - 1, 0)


def members(bits: int, words: list) -> Iterator:
    while bits:
        low = bits & -bits
        yield words[low.bit_length() - 1]
        bits ^= low


def near_in_block(short: int, prefix: bool, rows: list[tuple]) -> Iterator[tuple]:
    """(word, its n, near word, its n) of a block's words of ``short`` or one letter more; rows: (word, n, is in the index, is searched).

    The words of a block agree in their first letters, or else in their last ones, so only the rest is indexed. Two words that agree in both belong to the
    block of the first letters.
    """
    first = short // 2
    last = short - first
    rest = (lambda w: w[first:]) if prefix else (lambda w: w[: len(w) - last])
    indexed = [(w, n) for w, n, here, _ in rows if here]
    index = PositionIndex([rest(w) for w, _ in indexed])
    for w, n, _, searched in rows:
        if searched:
            replaced, more, less = index.near(rest(w))
            for near, near_n in members(replaced | more if len(w) == short else less, indexed):
                if prefix or w[:first] != near[:first]:
                    yield w, n, near, near_n


def near_words(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): every pair of different words of ``vocabulary`` (word, n; each word once) that are one letter apart, both ways round.

    Of two such words, the shorter of c letters, either the first c // 2 letters agree or all the last c - c // 2. So words meet in blocks of length and
    first or last letters, and each block has its bitsets. A block of more than ``hot`` words is split: each part's index meets each part's words.
    """
    length = F.char_length("word")
    blocks = []
    for short in (length, length - 1):
        first = F.floor(short / 2).cast("int")
        blocks += [
            F.struct(short.alias("short"), F.lit(True).alias("prefix"), F.left("word", first).alias("letters")),
            F.struct(short.alias("short"), F.lit(False).alias("prefix"), F.right("word", short - first).alias("letters")),
        ]
    placed = vocabulary.select("word", "n", F.explode(F.array(*blocks)).alias("block")).where("block.short > 0")
    slots = placed.groupBy("block").count().where(F.col("count") > hot).groupBy(slot_of(F.col("block")).alias("__slot")).agg(F.ceil(F.max("count") / hot).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    each = F.sequence(F.lit(0), parts - 1)
    as_index = F.transform(each, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("indexed"), (j == own).alias("searched")))
    as_word = F.filter(F.transform(each, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("searched"))), lambda x: x["i"] != own)
    dealt = placed.withColumn("__slot", slot_of(F.col("block"))).join(F.broadcast(slots), "__slot", "left").select("block.*", "word", "n", F.explode(F.concat(as_index, as_word)).alias("at"))
    by = ["short", "prefix", "letters", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found: list[tuple] = []
        for (short, prefix, *_), group in groupby(rows, itemgetter(0, 1, 2, 3, 4)):
            block = [r[5:] for r in group]
            if len(block) > 1:
                for pair in near_in_block(short, prefix, block):
                    found.append(pair)
                    if len(found) >= 20_000:
                        yield batch_of(found)
                        found = []
        if found:
            yield batch_of(found)

    sorted_rows = dealt.select("short", "prefix", "letters", "at.i", "at.j", "word", "n", "at.indexed", "at.searched").repartition(*by).sortWithinPartitions(*by)
    return sorted_rows.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def batch_of(pairs: Iterable[tuple]) -> pa.RecordBatch:
    word, n, near, near_n = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["word", "n", "near", "near_n"])


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: the form's form and so on to the last. Each round doubles the steps taken."""
    roots = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while roots.where("moved").limit(1).count():
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        forget(roots)
        roots = step
    return roots.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``vocabulary`` (word, n; each word once).

    The form is the near word of largest n (the first in code-point order of equal ones) if that n is ``ratio`` times the word's at least, else null, and
    form_n its n. The root is the last of the word's form, the form's form and so on; the word itself where there is none. An empty table gives an empty one.
    """
    vocabulary = cut(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    seen = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = vocabulary.join(seen, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    judged = cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"))
    roots = last_forms(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

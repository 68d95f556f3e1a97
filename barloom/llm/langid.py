"""Language ID: unigram pieces, scored by the sum over all segmentations of each word."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unit_hash, with_columns_from_text

LETTERS = re.compile(r"[^\W\d_]+")
RESCALE = 32
"""Steps after which forward sums are scaled: the floor of ``estimate`` to this power is still a normal double."""
MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str) -> list[str]:
    """The lower-case letter pieces of a public vocabulary file; ids are places in this list, and one more stands for unknown letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix(MARK) or "a") and p == p.lower())


def words_of(text: str) -> list[str]:
    """Lower-case letter runs, however long."""
    return LETTERS.findall(text.lower())


class Pieces:
    """A trie of the vocabulary that is walked from one place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.single, self.letter = np.full(0x110000, self.n, np.int32), np.zeros(0x110000, np.int32)
        longer = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.letter[[ord(c) for c in longer]] = np.arange(1, len(longer) + 1)
        nodes: list[dict[str, int]] = [{}]
        of = [-1]
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.single[ord(p)] = i
                continue
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    of.append(-1)
                at = nodes[at][c]
            of[at] = i
        self.piece = np.array(of, np.int32)
        self.child = np.zeros((len(nodes), len(longer) + 1), np.int32)
        for i, node in enumerate(nodes):
            for c, to in node.items():
                self.child[i, self.letter[ord(c)]] = to

    def arcs(self, words: list[str]) -> tuple[np.ndarray, Iterator[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Lengths (the mark included) and, start by start, a list of (letters, rows, piece ids) of all pieces in the words; n is an unknown letter."""
        marked = [MARK + w for w in words]
        lengths = np.array([len(w) for w in marked])
        width = int(lengths.max())
        codes = np.array(marked, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        letter, single = self.letter[codes], self.single[codes]

        def walk():
            for start in range(width):
                rows = np.flatnonzero(lengths > start)
                found = [(1, rows, single[rows, start])]
                at = self.child[0, letter[rows, start]]
                for place in range(start + 1, width):
                    live = (at > 0) & (lengths[rows] > place)
                    rows = rows[live]
                    if not len(rows):
                        break
                    at = self.child[at[live], letter[rows, place]]
                    ids = self.piece[at]
                    hit = (at > 0) & (ids >= 0)
                    if hit.any():
                        found.append((place - start + 1, rows[hit], ids[hit]))
                yield found

        return lengths, walk()


def by_length(words: list[str], languages: int, cells: int = 1 << 18) -> Iterator[list[int]]:
    """Places of words in parts of like length, each of at most so many letters times ``languages``, or of one word."""
    part: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if part and (len(part) + 1) * (len(words[i]) + 1) * max(4, languages) > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def forward(finder: Pieces, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log of the summed probability of all segmentations, [words, languages]; probability is [pieces + 1, languages].

    The sums of a piece's length back are held at a time, and scaled every RESCALE letters, so a word may have any number of letters.
    """
    out = np.empty((len(words), probability.shape[1]))
    ring = finder.longest + 2
    for part in by_length(words, probability.shape[1]):
        lengths, arcs = finder.arcs([words[i] for i in part])
        alpha, scale = np.zeros((ring, len(part), probability.shape[1])), np.zeros((len(part), probability.shape[1]))
        alpha[0] = 1
        place = np.array(part)
        ends, last = np.sort(lengths), np.argsort(lengths, kind="stable")
        for start, found in enumerate(arcs):
            here = alpha[start % ring]
            done = last[np.searchsorted(ends, start) : np.searchsorted(ends, start, "right")]
            out[place[done]] = np.log(here[done]) + scale[done]
            if start % RESCALE == RESCALE - 1:
                by = np.where(here > 0, here, 1)
                scale += np.log(by)
                alpha /= by
            for k, rows, ids in found:
                alpha[(start + k) % ring, rows] += here[rows] * probability[ids]
            here[:] = 0
        width = int(ends[-1])
        done = last[np.searchsorted(ends, width) :]
        out[place[done]] = np.log(alpha[width % ring][done]) + scale[done]
    return out


def expected_counts(finder: Pieces, probability: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language under its ``probability`` [pieces + 1], by forward and backward sums of logarithms."""
    counts, log = np.zeros(finder.n + 1), np.log(probability)
    for part in by_length(words, 1):
        lengths, walk = finder.arcs([words[i] for i in part])
        arcs, width = list(walk), int(lengths.max())
        alpha, beta = np.full((width + 1, len(part)), -np.inf), np.full((width + 1, len(part)), -np.inf)
        alpha[0] = 0
        for start, found in enumerate(arcs):
            for k, rows, ids in found:
                alpha[start + k, rows] = np.logaddexp(alpha[start + k, rows], alpha[start, rows] + log[ids])
        every = np.arange(len(part))
        beta[lengths, every] = 0
        whole = alpha[lengths, every]
        for start in range(width - 1, -1, -1):
            for k, rows, ids in arcs[start]:
                onward = log[ids] + beta[start + k, rows]
                counts += np.bincount(ids, np.exp(alpha[start, rows] + onward - whole[rows]) * weight[part][rows], finder.n + 1)
                beta[start, rows] = np.logaddexp(beta[start, rows], onward)
    return counts


def train(labelled: DataFrame, text: str, lang: str, key: str, *, pieces: str = PIECES, per_language: int = 3000, rounds: int = 3) -> dict:
    """Piece probabilities per language by expectation-maximisation; rows without a language are left out.

    About ``per_language`` rows of each language are used (all, if it has fewer), chosen by a hash of ``key`` in one pass. Spark counts their
    words, whole however long, and sums expected counts; what reaches the driver is one row per language and piece. An empty table gives a model without languages.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").alias("key")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    vocabulary = load_pieces(pieces)
    if not langs:
        return {"langs": [], "pieces": vocabulary, "probability": np.ones((len(vocabulary) + 1, 0)), "prior": np.ones(0)}
    rate = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_language / totals[x]))])
    sample = rows.where(unit_hash(F.col("key"), "langid") < F.element_at(rate, F.col("lang")))
    tokens = with_columns_from_text(sample, "text", "words array<string>", lambda: lambda texts: [[words_of(t or "") for t in texts]], ["lang"])
    words = cut(tokens.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count())
    probability = np.full((len(vocabulary) + 1, len(langs)), 1.0 / (len(vocabulary) + 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probability)

        def count(batches):
            finder, column = Pieces(vocabulary), {x: i for i, x in enumerate(langs)}
            totals = np.zeros((len(vocabulary) + 1, len(langs)))
            for batch in batches:
                of, word, n = (batch.column(i).to_pylist() for i in range(3))
                for x in set(of):
                    at = [i for i, y in enumerate(of) if y == x]
                    totals[:, column[x]] += expected_counts(finder, shared.value[:, column[x]], [word[i] for i in at], np.array([n[i] for i in at], float))
            piece, language = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(totals[piece, language])], ["piece", "language", "n"])

        summed = words.mapInArrow(count, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(probability)
        counts[summed.piece, summed.language] = summed.n
        probability = estimate(counts)
        shared.unpersist()
    weights = np.array([totals[x] for x in langs], float)
    return {"langs": langs, "pieces": vocabulary, "probability": probability, "prior": weights / weights.sum()}


def estimate(counts: np.ndarray) -> np.ndarray:
    """Additive smoothing, so that no piece is impossible in a language."""
    smooth = counts + 0.02
    return np.maximum(smooth / smooth.sum(axis=0), 1e-7)


def predict(df: DataFrame, text: str, model: Broadcast, *, use_prior: bool = True) -> DataFrame:
    """Adds lang_pred and score (the posterior of that language, 0 to 1) to every row; columns of these names, in any case, give way.

    A null text, one without a letter, or a model without languages: lang_pred 'und', score 0. Ties go to the first language by name.
    Repeated rows get the same score each, an empty table gives an empty one, and a text of any length counts whole.
    ``model`` is a broadcast of what ``train`` gives. Scores of words are remembered per task, up to a fixed number.
    """

    def make():
        m = model.value
        finder, probability = Pieces(m["pieces"]), m["probability"]
        prior = np.log(m["prior"]) if use_prior else np.zeros(len(m["langs"]))
        place: dict[str, int] = {}
        room = max(1 << 13, min(1 << 18, (64 << 20) // (8 * max(1, len(m["langs"])))))
        scores = np.empty((room, len(m["langs"])))

        def add(words: set[str]) -> None:
            new = list(words)
            if len(place) + len(new) > len(scores):
                place.clear()
            for start in range(0, len(new), room):
                part = new[start : start + room]
                base = len(place)
                scores[base : base + len(part)] = forward(finder, probability, part)
                place.update(zip(part, range(base, base + len(part)), strict=True))

        def missing(words: list[str]) -> set[str]:
            return {w for w in set(words) if w not in place}

        def total(words: list[str]) -> np.ndarray:
            out = prior.copy()
            for start in range(0, len(words), room // 2):
                part = words[start : start + room // 2]
                try:
                    at = list(map(place.__getitem__, part))
                except KeyError:
                    add(missing(part))
                    add(missing(part))  # the first may have emptied the memory
                    at = list(map(place.__getitem__, part))
                out += scores[at].sum(axis=0)
            return out

        def judge(words: list[str]) -> tuple[str, float]:
            if not len(prior) or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
                return "und", 0.0
            t = total(words)
            best = int(np.argmax(t))
            return m["langs"][best], float(1 / np.exp(t - t[best]).sum())

        def run(texts: list[str | None]) -> list[list]:
            every = [words_of(t or "") for t in texts]
            fresh: set[str] = set()
            for words in every:
                fresh |= missing(words)
                if len(fresh) > room // 4:
                    if len(fresh) <= room // 2:
                        add(fresh)
                    fresh = set()
            if 0 < len(fresh) <= room // 2:
                add(fresh)
            found = list(map(judge, every))
            return [[x for x, _ in found], [y for _, y in found]]

        return run

    return with_columns_from_text(df, text, "lang_pred string, score double", make, df.columns)


def language_of(df: DataFrame, labelled: DataFrame, text: str = "text", *, known_as: tuple[str, str, str] = ("text", "lang", "doc_id"), **options) -> DataFrame:
    """Trains on ``labelled``, whose text, language and key columns are ``known_as``, and predicts for every row of ``df``."""
    model = df.sparkSession.sparkContext.broadcast(train(labelled, *known_as, **options))
    return predict(df, text, model)


def rejected(lang_pred: Column, score: Column, min_score: float) -> Column:
    return (lang_pred == "und") | (score < min_score)

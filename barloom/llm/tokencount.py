"""Token counts: Aho-Corasick finds a vocabulary's pieces, dynamic programming keeps the best score and its number of pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, with_columns_from_text

MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
LONGEST_KEPT = 64
"""Counts of longer words are computed again each time rather than remembered."""


def unigram_vocabulary(path: str = PIECES) -> list[tuple[str, float]]:
    """A public vocabulary file as (piece, log probability): the file gives pieces by rank, and Zipf's law gives rank r the probability 1 / (r H).

    Control, unknown and byte pieces are no text: they are left out, so that ``<s>`` in a text counts as its letters. Bytes are counted for letters
    without a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / r for r in range(1, n + 1)))
    text = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in text]


def words_of(text: str) -> list[str]:
    """The text with spaces as marks, cut before each mark; a mark is put in front of a text that has none there."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    return [MARK + w for w in (marked[1:] if marked[0] == MARK else marked).split(MARK)]


class Viterbi:
    """Counts the pieces of the best-scored segmentation of a word.

    Ties as the unigram tokenizer has them: scores add up from the left, a later candidate for an end must be strictly better, and
    candidates come by ascending start. A letter without a piece of its own costs the least score less UNKNOWN_PENALTY; a run of
    such letters becomes one piece per UTF-8 byte.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces, filled = [-math.inf] * (n + 1), [0] * (n + 1), 0
        score[0] = 0.0
        single = -1
        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            while filled < last:  # ends that no piece reaches; they are reached by an unknown letter
                filled += 1
                if single != filled:
                    self.step(word, score, pieces, filled)
            begin = end - length
            if length == 1:
                single = end
            if score[begin] + own > score[end]:
                score[end], pieces[end] = score[begin] + own, pieces[begin] + 1
        while filled < n:
            filled += 1
            if single != filled:
                self.step(word, score, pieces, filled)
        return pieces[n]

    def step(self, word: str, score: list[float], pieces: list[int], end: int) -> None:
        candidate = score[end - 1] + self.unknown
        if candidate > score[end]:
            score[end], pieces[end] = candidate, pieces[end - 1] + len(word[end - 1].encode())


def token_counts(df: DataFrame, text: str = "text", *, pieces: str = PIECES) -> DataFrame:
    """Adds n_tokens (long) to every row, counted over its whole text; narrow, no shuffle. A column of that name, in any case, gives way.

    Null and empty texts have 0, repeated rows the same number each, and an empty table gives an empty one. Counts of words are remembered per task, up to a fixed number.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(unigram_vocabulary(pieces))

    def make():
        viterbi = Viterbi(vocabulary.value)
        counts = Memo(viterbi.count, 300_000)

        def run(texts):
            out = []
            for t in texts:
                n = 0
                for w in words_of(t or ""):
                    n += counts[w] if len(w) <= LONGEST_KEPT else viterbi.count(w)
                out.append(n)
                counts.trim()
            return [out]

        return run

    return with_columns_from_text(df, text, "n_tokens bigint", make, df.columns)

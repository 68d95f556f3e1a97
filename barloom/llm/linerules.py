"""Quality rules: lines are judged first, failing lines go, then documents that lost too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, beside

SYMBOLS = "[#*$%&|<>]"
WORD = "[^\\x20\\x09-\\x0D]"
NAVIGATION_MARKS = "|»›•"
# Marks that end sentences, by script: Latin, Arabic, Devanagari, Armenian, Burmese, Ethiopic, Khmer, Chinese and Japanese. Fixed values.
SENTENCE = ".!?\\x{2026}\\x{61F}\\x{6D4}\\x{964}\\x{965}\\x{589}\\x{104A}\\x{104B}\\x{1362}\\x{1367}\\x{17D4}\\x{17D5}\\x{203C}\\x{2047}\\x{2048}\\x{2049}\\x{3002}\\x{FF01}\\x{FF0E}\\x{FF1F}\\x{FF61}"
# What may follow them, or end a line like them.
CLOSING = ";:)\\]\"'\\x{61B}\\x{2019}\\x{201D}\\x{BB}\\x{3009}\\x{300B}\\x{300D}\\x{300F}\\x{3011}\\x{FF09}\\x{FF1A}\\x{FF1B}"
TERMINAL = f"[{SENTENCE}{CLOSING}]{WS}*$"
# Scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han. The first four have no marks between sentences either, but for Burmese and Khmer ones above.
SPACELESS = "\\x{E00}-\\x{EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}"
UNMARKED = "\\x{E00}-\\x{EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}"
BOILERPLATE = (
    "\\b(?:[Cc]ookie|[Pp]rivacy [Pp]olicy|[Tt]erms of (?:[Uu]se|[Ss]ervice)|[Aa]ll [Rr]ights [Rr]eserved|[Cc]opyright|[Jj]ava[Ss]cript"
    "|[Ss]ubscribe|[Nn]ewsletter|[Ss]ign (?:in|up)\\b|[Ll]og ?in\\b|[Rr]ead more|[Cc]lick here|[Ll]orem ipsum|[Ss]hare this|[Ff]ollow us|[Aa]dd to cart)"
)


def is_navigation(line: Column, max_marks: int, max_short_words: int) -> Column:
    """Menus and tables: many separator marks, or a few words that no terminal mark ends; four letters of a script without spaces count as a word."""
    bare = line
    for mark in NAVIGATION_MARKS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    marked = F.length(line) - F.length(bare) > max_marks
    longer = line.rlike("^(?:%s*+%s++){%d}" % (WS, WORD, max_short_words + 1)) | line.rlike("(?:[%s][^%s]*+){%d}" % (SPACELESS, SPACELESS, 4 * max_short_words + 1))
    return marked | (~longer & ~line.rlike(TERMINAL))


def keep_line(line: Column, max_marks: int, max_short_words: int, max_unpunctuated: int, max_boilerplate: int) -> Column:
    """A line stays if it has a word and is neither navigation, nor a short line with a boilerplate phrase, nor long without any mark that ends sentences, in a script that has them."""
    unpunctuated = (F.length(line) > max_unpunctuated) & ~line.rlike(f"[{SENTENCE}{UNMARKED}]")
    return line.rlike(WORD) & ~unpunctuated & ~((F.length(line) <= max_boilerplate) & line.rlike(BOILERPLATE)) & ~is_navigation(line, max_marks, max_short_words)


MAX_FAST = 1 << 24


def window_keys(words: Column) -> Column:
    """For each 3-word window, 40 bits of hash above 24 bits of place, sorted: equal windows stand together, their places ascending."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n), F.slice(words, 3, n))
    return F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(F.xxhash64(x), 24).bitwiseOR(i.cast("long"))))


def neighbours(a: Column) -> Column:
    """Pairs of each element with the next, null after the last."""
    return F.arrays_zip(a.alias("a"), F.slice(a, 2, F.greatest(F.size(a), F.lit(1))).alias("b"))


def equal_pairs(keys: Column) -> Column:
    """Neighbours of ``window_keys`` with one hash."""
    return F.filter(neighbours(keys), lambda x: F.shiftright(x["a"].bitwiseXOR(x["b"]), 24) == 0)


def place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(MAX_FAST - 1)).cast("int")


def covered(places: Column) -> Column:
    """Words in windows of three at these ascending places: each adds three, less what the next one shares."""
    return F.aggregate(neighbours(places), F.lit(0).cast("long"), lambda s, x: s + F.least(x["b"] - x["a"], F.lit(3)).cast("long"))


def repeats_by_words(words: Column) -> Column:
    """Places of repeated windows, found by sorting the windows themselves: for hash clashes and texts of over 2^24 words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, n).alias("x"), F.slice(words, 2, n).alias("y"), F.slice(words, 3, n).alias("z"))
    spelled = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    pairs = F.get(F.transform(F.array(spelled), lambda s: F.filter(neighbours(s), lambda x: F.coalesce(x["a"]["w"] == x["b"]["w"], F.lit(False)))), F.lit(0))
    return F.flatten(F.transform(pairs, lambda x: F.array(x["a"]["i"], x["b"]["i"])))


def line_rules(
    df: DataFrame, text: str = "text", *, max_lost: float = 0.5, max_marks: int = 3, max_short_words: int = 3, max_unpunctuated: int = 400, max_boilerplate: int = 200, min_words: int = 50, max_repeat_percent: int = 50
) -> DataFrame:
    """Cleans and judges every row of ``df``; one narrow pass of built-in functions, no shuffle.

    Columns put beside the row's own (a column of the same name, in any case, gives way): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (longs), base_failed, n_lines, n_lines_kept, clean_text (the lines that passed), kept.
    ``kept`` is false if base_failed, or if the removed lines held more than ``max_lost`` of the characters in words.
    A null text counts as an empty one: no words, base_failed, not kept, clean_text ''. Repeated rows get the same verdict each, an empty
    table gives an empty one, and texts are judged whole, however long.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_kept", "clean_text", "kept"]
    limits = (max_marks, max_short_words, max_unpunctuated, max_boilerplate)
    return beside(df, names, lambda rows, at: measured(rows, at(text), names, limits, max_lost, min_words, max_repeat_percent))


def measured(df: DataFrame, text: str, names: list[str], limits: tuple[int, int, int, int], max_lost: float, min_words: int, max_repeat_percent: int) -> DataFrame:
    """The work of ``line_rules`` on rows whose columns have placeholder names; each step's columns are read by the next."""
    own = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = F.array_remove(F.split(t, WS + "+"), "")
    first = df.select(*own, t.alias("__t"), words.alias("__w"), lines.alias("__l"))
    keys = F.when(F.size("__w") < MAX_FAST, window_keys(F.col("__w"))).otherwise(F.array().cast("array<bigint>"))
    kept = F.filter("__l", lambda x: keep_line(x, *limits))
    second = first.select(*own, "__t", "__w", "__l", keys.alias("__s"), kept.alias("__k"))
    third = second.select(*own, "__t", "__w", "__l", "__k", equal_pairs(F.col("__s")).alias("__p"))
    same = lambda x, d: F.get("__w", place(x["a"]) + d) == F.get("__w", place(x["b"]) + d)
    clash = (F.size("__w") >= MAX_FAST) | F.exists("__p", lambda x: ~(same(x, 0) & same(x, 1) & same(x, 2)))
    places = F.when(clash, repeats_by_words(F.col("__w"))).otherwise(F.flatten(F.transform("__p", lambda x: F.array(place(x["a"]), place(x["b"])))))
    fourth = third.select(*own, "__t", "__w", "__l", "__k", F.array_sort(F.array_distinct(places)).alias("__r"))
    chars = lambda w: F.length(F.concat_ws("", w)).cast("long")
    fifth = fourth.select(
        *own,
        F.size("__w").cast("long").alias("n_words"),
        chars(F.col("__w")).alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__r") == 0, F.lit(0).cast("long")).otherwise(covered(F.col("__r"))).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size("__k").cast("long").alias("n_lines_kept"),
        F.concat_ws("\n", "__k").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    clean_chars = F.length(F.regexp_replace("clean_text", WS + "+", ""))
    lost = (F.col("n_lines_kept") < F.col("n_lines")) & (clean_chars < (1 - max_lost) * F.col("word_chars"))
    return fifth.select(*own, *names[:5], failed.alias("base_failed"), "n_lines", "n_lines_kept", "clean_text", (~failed & ~lost).alias("kept"))

"""Corrections of rare spellings to frequent ones, learned from the whole corpus.

A word that another one RATIO times as frequent comes within the allowed edits of is a misspelling; it is mapped to the nearest such
word that isn't one itself. Only ratios count, so the answer is the same for a corpus and for ten copies of it. The candidate search
is an equi-join of distinct words on keys that no pair within the allowed edits lacks (seeking_keys, sought_keys).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.session import staged

RATIO = 4


def letters(word: Column) -> Column:
    return F.concat_ws("", F.sort_array(F.split(word, "")))


def typo_distance(a: Column, b: Column) -> Column:
    """Edits between two words, -1 beyond three; where the letters are the same ones, a swap counts as one edit."""
    return _distance(F.levenshtein(a, b, 4), letters(a) == letters(b))


def _distance(d: Column, same_letters: Column) -> Column:
    return F.when((d >= 2) & same_letters, F.ceil(d / 2).cast("int")).when(d > 3, -1).otherwise(d)


def _without_one(word: Column) -> Column:
    """The word and what is left of it without any one of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array()))


def _marked(mark: str, part: Column) -> Column:
    return F.transform(_without_one(part), lambda x: F.concat(F.lit(mark), x))


def _short_keys(word: Column) -> Column:
    """For two words of up to 9 letters: what is left without one letter, from 7 letters on without two.

    allowed() grants two edits only where one word has 7 letters or more, and a shorter one then lacks at most one letter.
    """
    one = _without_one(word)
    two = F.flatten(F.transform(one, _without_one))
    n = F.length(word)
    return F.when((n < 4) | (n > 9), F.array()).when(n >= 7, two).otherwise(one)


def _anagram(word: Column) -> Column:
    """Swaps count half, so words of the same letters may be four edits apart: they meet by their letters."""
    return F.array(F.concat(F.lit("="), letters(word)))


def sought_keys(word: Column) -> Column:
    """Keys of a word that others look for.

    Pairs of which one has 10 letters or more have three edits at most (but for swaps), so one half of the sought word has
    one of them at most and meets the start (or end) of the other word in what is left without one letter.
    """
    n, half = F.length(word), F.floor(F.length(word) / 2).cast("int")
    long = F.concat(_marked("<", F.substring(word, F.lit(1), half)), _marked(">", F.substring(word, half + 1, n)))
    return F.array_distinct(F.concat(_anagram(word), _short_keys(word), F.when(n >= 7, long).otherwise(F.array())))


def seeking_keys(word: Column) -> Column:
    """Keys of a word that looks for others: each pair within allowed() has one of sought_keys() in common."""
    n = F.length(word)
    least, most = F.when(n < 10, 10).otherwise(n - 3), n + 3  # letters of the sought words
    sizes = lambda half: F.sequence(half(least / 2).cast("int") - 1, F.least(half(most / 2).cast("int") + 1, n))
    starts = F.transform(sizes(F.floor), lambda k: _marked("<", F.substring(word, F.lit(1), k)))
    ends = F.transform(sizes(F.ceil), lambda k: _marked(">", F.substring(word, n - k + 1, k)))
    return F.array_distinct(F.concat(_anagram(word), _short_keys(word), F.when(n >= 7, F.flatten(F.concat(starts, ends))).otherwise(F.array())))


def allowed(a: Column, b: Column) -> Column:
    """Edits that typing errors make in words of these lengths: one from 5 letters, two from 7, three from 10."""
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long >= 10, 3).when(long >= 7, 2).when(long >= 5, 1).otherwise(0)


def close(a: Column, b: Column) -> Column:
    """Whether two words differ by no more than typing errors; false where one is null."""
    near = F.abs(F.length(a) - F.length(b)) <= 3
    return F.coalesce((a == b) | (near & typo_distance(a, b).between(0, allowed(a, b))), F.lit(False))


def corrections(words: DataFrame, scope: list[str], word: str = "word", n: str = "n") -> DataFrame:
    """(scope..., word, correct) for each word that is a misspelling; words with digits and those under 4 letters are left alone.

    words has one row for each word of a scope with its count n; nulls and empty words are ignored.
    """
    words = words.filter(F.length(word) >= 4).filter(~F.col(word).rlike("[0-9]"))
    words = staged(words.select(*scope, word, n, letters(F.col(word)).alias("l")), "words")

    def keyed(df: DataFrame, p: str, keys: Callable[[Column], Column]) -> DataFrame:
        return df.select(*scope, F.col(word).alias(f"{p}w"), F.col(n).alias(f"{p}n"), F.col("l").alias(f"{p}l"), F.explode(keys(F.col(word))).alias("k")).withColumn("k", F.xxhash64(*scope, "k"))

    def near(rare: DataFrame, to: DataFrame) -> DataFrame:
        pairs = keyed(rare, "a", seeking_keys).join(keyed(to, "b", sought_keys), [*scope, "k"])
        pairs = pairs.filter((F.col("bn") >= RATIO * F.col("an")) & (F.abs(F.length("aw") - F.length("bw")) <= 3))
        pairs = pairs.select(*scope, "aw", "bw", "bn", _distance(F.levenshtein("aw", "bw", 4), F.col("al") == F.col("bl")).alias("d"))
        return pairs.filter(F.col("d").between(0, allowed(F.col("aw"), F.col("bw"))))

    common = words.filter(F.col(n) >= RATIO)  # what is rarer has no misspelling
    doubtful = near(common, common).select(*scope, F.col("aw").alias(word)).distinct()
    anchors = staged(common.join(doubtful, [*scope, word], "left_anti").select(words.columns), "anchors")
    found = near(words.join(anchors, [*scope, word], "left_anti").select(words.columns), anchors)
    return found.groupBy(*scope, F.col("aw").alias(word)).agg(F.max_by("bw", F.struct(-F.col("d"), F.col("bn"), F.col("bw"))).alias("correct"))

"""Anagrams, windows over characters and dictionary segmentation, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chars(s: Column) -> Column:
    """Characters of a string; none for the empty string."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def anagram_key(word: Column, case_insensitive: bool = True, letters_only: bool = True) -> Column:
    """Sorted letters. ``letters_only`` without ``case_insensitive`` drops capitals too, as only a-z are letters then."""
    w = F.lower(word) if case_insensitive else word
    w = F.regexp_replace(w, "[^a-z]", "") if letters_only else w
    return F.array_join(F.array_sort(chars(w)), "")


def group_anagrams(words: DataFrame, word: str = "word", case_insensitive: bool = True, letters_only: bool = True, min_group_size: int = 2) -> DataFrame:
    """(key, words, n): words of equal letters, the words sorted; largest groups first. Words without letters are left out
    if only letters count."""
    keyed = words.select(F.col(word).alias("_word"), anagram_key(F.col(word), case_insensitive, letters_only).alias("key"))
    keyed = keyed.where("key <> ''") if letters_only else keyed
    groups = keyed.groupBy("key").agg(F.array_sort(F.collect_list("_word")).alias("words"), F.count("*").alias("n")).where(F.col("n") >= min_group_size)
    return groups.orderBy(F.desc("n"), F.col("words")[0])


def anagram_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.bround(F.coalesce(F.avg("n"), F.lit(0.0)), 2).alias("average"))


def _lefts(s: Column) -> Column:
    """For each position (from 1) the start of the longest run of distinct characters that ends there."""
    c = chars(s)
    step = F.aggregate(
        F.sequence(F.lit(1), F.length(s)),
        F.struct(F.lit(1).alias("left"), F.array().cast("array<int>").alias("all")),
        lambda acc, i: _advance(acc, i, c),
    )
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(step["all"])


def _advance(acc: Column, i: Column, c: Column) -> Column:
    # the place of the same character inside the run so far, from its end
    run = F.reverse(F.slice(c, acc["left"], i - acc["left"]))
    back = F.array_position(run, F.element_at(c, i)).cast("int")
    left = F.when(back > 0, i - back + 1).otherwise(acc["left"]).cast("int")
    return F.struct(left.alias("left"), F.array_append(acc["all"], left).alias("all"))


def _match(s: Column, start: Column, length: Column) -> Column:
    return F.struct((start - 1).cast("int").alias("start"), (start + length - 2).cast("int").alias("end"), length.cast("int").alias("length"), F.substring(s, start, length).alias("content"))


def longest_unique_substring(s: Column) -> Column:
    """struct(start, end inclusive, length, content), from 0; the first of equals; start 0, end -1 for the empty string."""
    lefts = _lefts(s)
    spans = F.transform(lefts, lambda left, i: F.struct((i + 2 - left).cast("int").alias("n"), (-left).alias("m")))
    best = F.array_max(spans)
    return F.when(F.length(s) == 0, _match(s, F.lit(1), F.lit(0))).otherwise(_match(s, -best["m"], best["n"]))


def all_unique_windows(s: Column, min_length: int = 2) -> Column:
    """Maximal runs of distinct characters, in order."""
    lefts = _lefts(s)
    ends = F.transform(lefts, lambda left, i: F.struct(left.alias("left"), (i + 2 - left).cast("int").alias("n"), F.coalesce(F.get(lefts, i + 1) > left, F.lit(True)).alias("last")))
    kept = F.filter(ends, lambda w: w["last"] & (w["n"] >= min_length))
    return F.transform(kept, lambda w: _match(s, w["left"], w["n"]))


def longest_with_k_distinct(s: Column, k: int) -> Column:
    """The first longest run with at most k distinct characters."""
    c = chars(s)

    def step(acc: Column, i: Column) -> Column:
        # drop characters from the left until at most k kinds remain: the run after the last place of the kind that ends first
        run = F.slice(c, acc["left"], i - acc["left"] + 1)
        kinds = F.array_distinct(run)
        lasts = F.transform(kinds, lambda x: F.size(run) - F.array_position(F.reverse(run), x).cast("int"))
        left = F.when(F.size(kinds) > k, acc["left"] + F.array_min(lasts) + 1).otherwise(acc["left"]).cast("int")
        n = (i - left + 1).cast("int")
        better = n > acc["n"]
        return F.struct(left.alias("left"), F.when(better, left).otherwise(acc["at"]).alias("at"), F.when(better, n).otherwise(acc["n"]).alias("n"))

    start = F.struct(F.lit(1).alias("left"), F.lit(1).alias("at"), F.lit(0).alias("n"))
    if k <= 0:
        return _match(s, F.lit(1), F.lit(0))
    best = F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)
    return F.when(F.length(s) == 0, _match(s, F.lit(1), F.lit(0))).otherwise(_match(s, best["at"], best["n"]))


def highlight(s: Column, match: Column, marker: str = "**") -> Column:
    return F.concat(F.substring(s, F.lit(1), match["start"]), F.lit(marker), match["content"], F.lit(marker), F.substring(s, match["end"] + 2, F.length(s)))


def word_break(s: Column, dictionary: Column) -> Column:
    """Whether ``s`` is a sequence of words of the dictionary array; the empty string is."""
    longest = F.coalesce(F.array_max(F.transform(dictionary, F.length)), F.lit(0))
    ok = F.aggregate(
        F.sequence(F.lit(1), F.length(s)),
        F.array(F.lit(True)),
        lambda acc, i: F.array_append(acc, F.exists(F.sequence(F.greatest(F.lit(0), i - longest), i - 1), lambda j: F.element_at(acc, j + 1) & F.array_contains(dictionary, F.substring(s, j + 1, i - j)))),
    )
    return F.when(F.length(s) == 0, F.lit(True)).otherwise(F.element_at(ok, -1))


def segmentable(texts: DataFrame, dictionary: DataFrame, key: str = "id", text: str = "s", word: str = "word") -> DataFrame:
    """(key, breaks): whether each text is a sequence of words of a dictionary table; the empty string is, null is not.

    Stretches of a text of the lengths that the dictionary has are joined with its words, so the dictionary is a table that is
    read once, not an array with every row; what matches are steps from place to place, and a text's own steps, in order of
    their starts, tell which places can be reached. Rows are told apart by ``key``; rows of one key have to have one text.
    """
    words = dictionary.select(F.col(word).alias("w")).where("w is not null and w <> ''").distinct()
    lengths = words.select(F.length("w").alias("n")).distinct()
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("s")).distinct()
    places = rows.select("k", "s", F.explode(F.sequence(F.lit(0), F.length("s") - 1)).alias("at")).where("at >= 0 and at < length(s)")
    pieces = places.join(F.broadcast(lengths), F.col("at") + F.col("n") <= F.length("s")).select("k", "at", F.col("n"), F.substring("s", F.col("at") + 1, F.col("n")).alias("w"))
    steps = pieces.join(words, "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("steps"))
    reached = F.aggregate("steps", F.array(F.lit(0)), lambda seen, x: F.when(F.array_contains(seen, x["at"]) & ~F.array_contains(seen, x["to"]), F.array_append(seen, x["to"])).otherwise(seen))
    joined = rows.join(steps.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left")
    found = F.when(F.length("s") == 0, F.lit(True)).otherwise(F.coalesce(F.array_contains(reached, F.length("s")), F.lit(False)))
    return joined.select(F.col("k").alias(key), found.alias("breaks"))

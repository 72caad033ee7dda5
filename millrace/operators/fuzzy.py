"""Name normalisation, token similarity, spelling and the blocked fuzzy join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut, small

# Words that company names are compared without.
STOP_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "limited", "group", "holdings", "industries", "industies", "the", "and")
# Rows of the keyboard, from which neighbouring keys follow.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def key_neighbours() -> list[str]:
    """Ordered pairs of keys that lie next to each other: in a row, straight above or below, or on the falling diagonal."""
    at = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
    near = {(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1)}
    return [a + b for a, (r, i) in at.items() for b, (q, j) in at.items() if (q - r, j - i) in near]


def tokens(name: Column) -> Column:
    """Sorted distinct words of a name, without punctuation and stop words."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, r"(?U)\s+"), lambda t: (t != "") & ~t.isin(*STOP_WORDS))))


def normalize(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.array_join(F.filter(F.split(plain, r"(?U)\s+"), lambda t: (t != "") & ~t.isin(*STOP_WORDS)), " ")


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or of lengths at most 3 apart and within a quarter of the longer one's length in edits (at least 1)."""
    longer = F.greatest(F.length(a), F.length(b))
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= 3) & (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(longer / 4))))


def token_similarity(ta: Column, tb: Column) -> Column:
    """Greedy matches between two token sets, in sorted order, over the size of their exact union."""
    left = F.aggregate(ta, tb, lambda free, x: _without_first(free, x))
    matches = F.size(tb) - F.size(left)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(matches / F.size(F.array_union(ta, tb)))


def _without_first(free: Column, x: Column) -> Column:
    fits = F.filter(free, lambda y: tokens_match(x, y))
    return F.when(F.size(fits) > 0, F.array_except(free, F.slice(fits, 1, 1))).otherwise(free)


def similarity(a: Column, b: Column) -> Column:
    return token_similarity(tokens(a), tokens(b))


def weighted_distance(a: Column, b: Column) -> Column:
    """Edit distance in which replacing a key by its neighbour costs a half; upper and lower case are one."""
    near = F.array(*map(F.lit, key_neighbours()))
    x, y = (F.filter(F.split(F.lower(c), ""), lambda ch: ch != "") for c in (a, b))
    first = F.transform(F.sequence(F.lit(0), F.size(y)), lambda j: j.cast("double"))

    def row(previous: Column, ch: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            other = F.element_at(y, j)
            cost = F.when(ch == other, 0.0).when(F.array_contains(near, F.concat(ch, other)), 0.5).otherwise(1.0)
            return F.array_append(done, F.least(F.element_at(previous, j + 1) + 1.0, F.element_at(done, j) + 1.0, F.element_at(previous, j) + cost))

        start = F.array(F.element_at(previous, 1) + 1.0)
        return F.when(F.size(y) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(y), F.lit(1))), start, cell))

    return F.element_at(F.aggregate(x, first, row), -1)


#: Words of up to this length are found by what is left of them after deletions, longer ones by pieces.
SHORT = 14


def _deletions(word: Column, reach: int) -> Column:
    """The word and all that is left of it after up to ``reach`` deletions."""
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(reach)), F.array(word), lambda acc, _: F.array_union(acc, F.flatten(F.transform(acc, less)))) if reach else F.array(word)


def near_words(asked: DataFrame, known: DataFrame, reach: int) -> DataFrame:
    """(word, suggestion): candidates, among which are all pairs of asked.word and known.suggestion within ``reach`` edits.

    Words within k edits have a common rest after up to k deletions each; that index is a table of rests, joined by equality.
    Longer words would have too many rests: they are cut into k + 1 pieces, one of which k edits leave whole, at most k places
    off. The index grows with the words, whatever their number of pairs.
    """
    limit = SHORT + reach
    rests = lambda df, c: df.where(F.length(c) <= limit).select(c, F.explode(_deletions(F.col(c), reach)).alias("rest"))
    short = rests(asked, "word").join(rests(known, "suggestion"), "rest").select("word", "suggestion")
    cut_at = lambda n, i: F.floor(n * i / (reach + 1)).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(reach))
    pieces = known.where(F.length("suggestion") > SHORT).select("suggestion", F.length("suggestion").alias("n"), F.explode(numbers).alias("i"))
    pieces = pieces.select("suggestion", "n", "i", F.substring("suggestion", cut_at(F.col("n"), F.col("i")) + 1, cut_at(F.col("n"), F.col("i") + 1) - cut_at(F.col("n"), F.col("i"))).alias("piece"))
    probes = asked.where(F.length("word") > SHORT).select("word", F.explode(F.sequence(F.length("word") - reach, F.length("word") + reach)).alias("n")).where(F.col("n") > SHORT)
    probes = probes.select("word", "n", F.explode(numbers).alias("i")).select("word", "n", "i", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off"))
    start = cut_at(F.col("n"), F.col("i")) + F.col("off")
    probes = probes.where(start >= 0).select("word", "n", "i", F.substring("word", start + 1, cut_at(F.col("n"), F.col("i") + 1) - cut_at(F.col("n"), F.col("i"))).alias("piece"))
    long = probes.join(pieces, ["n", "i", "piece"]).select("word", "suggestion")
    return short.union(long).distinct()


def suggest(queries: DataFrame, dictionary: DataFrame, k: int = 5, max_distance: float = 3.0, weighted: bool = True, reach: int = 3) -> DataFrame:
    """(word, suggestion, distance, place): the k nearest dictionary words for each distinct query.

    dictionary: (word, frequency). Ties go to the more frequent, then to the lesser word; a known word suggests itself alone.
    Candidates come from :func:`near_words` within ``reach`` edits; every edit costs at least 1, or a half if weighted, so
    nothing within ``reach`` or half of it is missed. Only words that have fewer than k suggestions that near, and could have
    some further off, are compared with all words of near length.
    """
    known = dictionary.groupBy("word").agg(F.max("frequency").alias("frequency"))
    asked = queries.select("word").where("word is not null").distinct()
    exact = asked.join(known, "word", "left_semi").select("word", F.col("word").alias("suggestion"), F.lit(0.0).alias("distance"), F.lit(1).alias("place"))
    left = asked.join(known, "word", "left_anti")
    right = known.select(F.col("word").alias("suggestion"), "frequency")
    least = 0.5 if weighted else 1.0
    reach = min(reach, int(max_distance / least))
    sure = min(reach * least, max_distance)  # complete up to this distance
    distance = weighted_distance(F.col("word"), F.col("suggestion")) if weighted else F.levenshtein("word", "suggestion").cast("double")
    fold = F.lower if weighted else lambda c: F.col(c)
    left, right = left.withColumn("_w", fold("word")), right.withColumn("_s", fold("suggestion"))
    close = near_words(left.select(F.col("_w").alias("word")).distinct(), right.select(F.col("_s").alias("suggestion")).distinct(), reach).toDF("_w", "_s")
    scored = left.join(close, "_w").join(right, "_s").select("word", "suggestion", "frequency", distance.alias("distance")).where(F.col("distance") <= max_distance)
    order = Window.partitionBy("word").orderBy("distance", F.desc("frequency"), "suggestion")
    if sure < max_distance:
        scored = cut(scored.where(F.col("distance") <= sure))
        full = scored.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        span = int(max_distance)
        rest = left.join(full, "word", "left_anti").withColumn("_n", F.explode(F.sequence(F.length("word") - span, F.length("word") + span)))
        far = rest.join(right.withColumn("_n", F.length("suggestion")), "_n").select("word", "suggestion", "frequency", distance.alias("distance"))
        scored = scored.unionByName(far.where((F.col("distance") <= max_distance) & (F.col("distance") > sure)))
    return exact.unionByName(scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("word", "suggestion", "distance", "place"))


class SpellChecker:
    """A dictionary to ask again and again: words (word) and, optionally, frequencies (word, frequency). A word that only the
    frequencies have is known too."""

    def __init__(self, words: DataFrame, frequencies: DataFrame | None = None) -> None:
        rows = words.select("word", F.lit(0).cast("long").alias("frequency"))
        if frequencies is not None:
            rows = rows.union(frequencies.select("word", F.col("frequency").cast("long")))
        self.dictionary = rows.groupBy("word").agg(F.max("frequency").alias("frequency"))

    def is_known(self, queries: DataFrame) -> DataFrame:
        """(word, known)."""
        told = self.dictionary.select("word", F.lit(True).alias("_known"))
        return queries.select("word").join(told, "word", "left").select("word", F.coalesce("_known", F.lit(False)).alias("known"))

    def suggest(self, queries: DataFrame, k: int = 5, max_distance: float = 3.0) -> DataFrame:
        return suggest(queries, self.dictionary, k, max_distance)


#: Right rows of a block that meet a left row in one task; larger blocks are dealt over several.
BLOCK = 2048


def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str = "name", right_key: str = "name", left_id: str = "left_id", right_id: str = "right_id", threshold: float = 0.55, block_chars: int = 2, block_rows: int = BLOCK) -> DataFrame:
    """Outer join on similar names: (left_id, left_name, right_id, right_name, score, status).

    Only names whose normal forms, without spaces, start alike are compared. Each left row takes its best right row (ties: least
    right_id) if that reaches the threshold, else stays alone with its best score; right rows that no left row took follow.

    A pair's score is at most the lesser number of words over the greater one, so pairs that this rules out are scored only for
    left rows that found no match, for the score they are left with. Blocks of more than ``block_rows`` right rows are dealt
    over several tasks, to each of which the block's left rows go; the best is found by partial aggregation.
    """
    key = lambda c: F.substring(F.replace(normalize(c), F.lit(" "), F.lit("")), 1, block_chars)
    side = lambda df, i, k, s: df.select(F.col(i).alias(f"{s}_id"), F.col(k).alias(f"{s}_name"), tokens(F.col(k)).alias(f"{s}_t"), key(F.col(k)).alias("block"))
    lefts, rights = cut(side(left, left_id, left_key, "left")), cut(side(right, right_id, right_key, "right"))
    filled = rights.where("block <> ''")
    deals = cut(filled.groupBy("block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("deals")))
    asks = lefts.where("block <> ''").join(small(deals), "block").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    gives = filled.join(small(deals), "block").withColumn("deal", F.pmod(F.xxhash64("right_id", "right_name"), F.col("deals")).cast("int")).drop("deals")
    bound = F.least(F.size("left_t"), F.size("right_t")) / F.greatest(F.size("left_t"), F.size("right_t"))

    def best(asking: DataFrame, which: Column) -> DataFrame:
        pairs = asking.join(gives, ["block", "deal"]).where(which).withColumn("score", token_similarity(F.col("left_t"), F.col("right_t")))
        return pairs.groupBy("left_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "right_id", "right_name")).alias("b"))

    near = cut(best(asks, bound >= threshold))
    open_ = asks.join(near.where(-F.col("b.s") >= threshold).select("left_id"), "left_id", "left_anti")
    top = near.unionByName(best(open_, bound < threshold)).groupBy("left_id").agg(F.min("b").alias("b")).select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.right_name").alias("right_name"), (-F.col("b.s")).alias("score"))
    joined = lefts.select("left_id", "left_name").join(top, "left_id", "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    matched = joined.select("left_id", "left_name", F.when(hit, F.col("right_id")).alias("right_id"), F.when(hit, F.col("right_name")).alias("right_name"), F.coalesce(F.col("score") + 0.0, F.lit(0.0)).alias("score"), F.when(hit, "matched").otherwise("left_only").alias("status"))
    alone = rights.join(matched.where("status = 'matched'").select("right_id"), "right_id", "left_anti")
    alone = alone.select(F.lit(None).cast(lefts.schema["left_id"].dataType).alias("left_id"), F.lit(None).cast("string").alias("left_name"), "right_id", "right_name", F.lit(0.0).alias("score"), F.lit("right_only").alias("status"))
    return matched.unionByName(alone)

"""Grouping of spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The shorter word (the first
in order, if lengths are equal) contributes two disjoint chunks, its halves. One edit lies in one half at most, so the
other half is preserved, and the other word holds it as a positional gram: at the same place, or one further where the
edit before it made that word longer. Words contribute their grams for partners of their own length and of one less.
Chunk and gram meet by an equi-join on the length, the half and the characters, the place being fixed by them, and
the edit distance is verified inside the join, so no candidates are written.

*Hot chunks.* Where many words share a half, comparing them all would grow with the square of the group. In a group of
more than `hot` chunks the rest of the words, which must be near in the same way, is divided again: each chunk goes on
as two, with one or the other half of its rest added, and so do the grams. This is repeated until groups are small or
the rest is a single character, of which there are few.

A word's form is its most frequent near word if that is `ratio` times as frequent. Along a chain of forms the
frequency grows by that ratio each step, so chains are short; their ends are found by doubling steps.

Rules: null texts have no words, a null doc_id counts as the empty string. Ties go to the word first in code-point
order. Repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 100  # chunks of one key that are compared with all its grams


def runs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and run: the maximal runs of letters of whole texts, lower-cased in A-Z, of at least `least` code points."""
    prepare(docs.sparkSession)
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    return found.where(F.char_length("run") >= least).withColumn("run", F.translate("run", UPPER, LOWER))


def without_character(run: Column, at: Column) -> Column:
    """A run less its code point at `at`, from 0."""
    at = at.cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))


def counted(words: DataFrame, least: int, occurrences: int) -> DataFrame:
    """word and n of the words of a column `word` that are long and frequent enough."""
    counts = words.where(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= occurrences)


def _divided(rows: DataFrame) -> DataFrame:
    """Each row as two: with one half of the partner's rest added to the key, and the other half as the new rest.

    `longer` is how much longer than the partner's the word is; the second half lies so much further in it.
    """
    half = F.floor((F.char_length("rest") - F.col("longer")) / 2).cast("int")
    end = half + F.col("longer")
    size = F.char_length("rest")
    first = F.struct(F.concat("key", F.lit("<"), F.substring("rest", F.lit(1), half)).alias("key"), F.substring(F.col("rest"), half + 1, size).alias("rest"))
    second = F.struct(F.concat("key", F.lit(">"), F.substring(F.col("rest"), end + 1, size)).alias("key"), F.substring(F.col("rest"), F.lit(1), end).alias("rest"))
    return rows.select("word", "longer", F.explode(F.array(first, second)).alias("part")).select("word", "longer", "part.key", "part.rest")


def _compared(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """(a, b): the near ones of the words that share a key."""
    joined = chunks.select("key", F.col("word").alias("a")).join(grams.select("key", F.col("word").alias("b"), "longer"), "key")
    return joined.where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): every pair of near words of the distinct column `word` once."""
    length = F.char_length("word")
    chunks = words.select("word", F.lit(0).alias("longer"), length.cast("string").alias("key"), F.col("word").alias("rest"))
    grams = words.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    grams = grams.select("word", "longer", (length - F.col("longer")).cast("string").alias("key"), F.col("word").alias("rest"))
    found = []
    while True:
        chunks, grams = _divided(chunks), _divided(grams)
        large = chunks.where(F.char_length("rest") > 1).groupBy("key").count().where(F.col("count") > hot).select("key")
        large = staged(large, "hot-chunks")
        if large.isEmpty():
            break
        found.append(staged(_compared(chunks.join(large, "key", "left_anti"), grams.join(large, "key", "left_anti")), "near-words"))
        chunks, grams = (staged(side.join(large, "key", "left_semi"), "hot-words") for side in (chunks, grams))
    found.append(_compared(chunks, grams))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms ends. Each round doubles the steps taken."""
    reached, open_ = staged(forms.select("word", F.col("form").alias("root")), "roots"), True
    while open_:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        open_ = not step.where("moved").isEmpty()
        reached = step.drop("moved")
    return reached


def variant_forms(words: DataFrame, ratio: int = 5, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of the distinct words (word, n)."""
    prepare(words.sparkSession)
    words = staged(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = staged(near_pairs(words, hot), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.select(F.col("a").alias("word"), F.col("b").alias("other")).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, F.col("best.other")).alias("form"),
        F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    rows = staged(rows, "formed")
    ends = _roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

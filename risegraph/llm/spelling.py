"""Spelling variants: words one edit apart, grouped under their most frequent form.

Reduced-alphabet generation: letters are hashed to a few symbols, so a word's reduced form has a
one-edit neighbourhood of some 2 * symbols * length strings instead of 2 * 90 * length. Words one
edit apart have reduced forms that are equal or one edit apart, hence every pair is found by
joining the full neighbourhoods of the reduced words with the reduced vocabulary; each pair is then
verified on the original strings. A pair of reduced words is generated from the smaller one only.
The number of symbols grows with the vocabulary, so that few words share a reduced form.

Counts are added up in each task before they move, so a word that a third of all rows hold is one
row of a task. Reduced words travel as 64-bit hashes: a collision is one more pair to verify.

No join is broadcast: Spark takes a neighbourhood for no larger than the words it was made from, by
the size of their packed file, and would send over a hundred times that through the driver.

Defined cases: a null text has no words; a null id hashes as an empty id; repeated rows count
again; other columns are ignored; texts without words and an empty table give an empty result.
Ties of form go to the smallest word in code-point order.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

#: Letters of a run after lower-casing A to Z (U+00D7 and U+00F7 among them).
LETTERS = string.ascii_lowercase + "".join(chr(c) for c in range(0xC0, 0x100))
#: Of the words' hashes, those divisible by this lose a letter.
SLIP = 199
LEAST_CHARS, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
#: Symbols of the reduced alphabet: as many as its letters at most.
SYMBOLS = string.ascii_uppercase


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
               least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    low = F.translate(whole_text(text_col), string.ascii_uppercase, string.ascii_lowercase)
    # a shorter run cannot give a word: only letters are deleted
    runs = F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(own.alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def symbols_for(words: int) -> str:
    """The reduced alphabet for so many words: the seventh root of their number, 4 symbols at least."""
    return SYMBOLS[:min(len(SYMBOLS), max(4, math.ceil(words ** (1 / 7))))]


def reduced(word: str, symbols: str) -> F.Column:
    """Each letter replaced by the symbol that its hash picks."""
    import zlib
    picked = "".join(symbols[zlib.crc32(c.encode()) % len(symbols)] for c in LETTERS)
    return F.translate(F.col(word), LETTERS, picked)


def neighbourhood(red: str, symbols: str) -> F.Column:
    """The string itself and all strings one deletion, replacement or insertion away that are not
    smaller than it."""
    r = F.col(red)
    size = F.length(r)
    letters = F.array(*[F.lit(s) for s in symbols])

    def left(i):
        return F.substring(r, F.lit(1), i - 1)

    def right(i):
        return F.substring(r, i, size)

    places = F.sequence(F.lit(1), size)
    deleted = F.transform(places, lambda i: F.concat(left(i), right(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda s: F.concat(left(i), s, right(i + 1)))))
    inserted = F.flatten(F.transform(F.sequence(F.lit(1), size + 1),
                                     lambda i: F.transform(letters, lambda s: F.concat(left(i), s, right(i)))))
    return F.array_distinct(F.filter(F.concat(deleted, replaced, inserted), lambda x: x >= r))


def shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join of both, neither of which is sent to the driver, whatever size Spark takes it for."""
    return left.join(right.hint("merge"), on, how)


def near_pairs(words: DataFrame, symbols: str) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words exactly one edit apart, once."""
    keyed = words.withColumn("red", reduced("word", symbols))
    forms = keyed.select("red").distinct()
    around = forms.select(F.xxhash64("red").alias("own"), F.explode(neighbourhood("red", symbols)).alias("near"))
    around = around.select("own", F.xxhash64("near").alias("near"))
    met = shuffled(around, forms.select(F.xxhash64("red").alias("near")), "near")
    side = keyed.select(F.xxhash64("red").alias("key"), "word", "n")
    a = side.select(F.col("key").alias("own"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = side.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = shuffled(shuffled(met, a, "own"), b, "near")
    # words of one reduced form meet twice and each meets itself
    pairs = pairs.filter((F.col("own") != F.col("near")) | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on each word's chain of forms, by doubling the steps. A form
    has several times its word's count, so chains are short and have no cycles."""
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = shuffled(steps, on, steps["root"] == F.col("_w"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        moved = written(moved, "spelling-roots")
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: int = LEAST_RATIO,
             least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = written(vocabulary(docs, id_col, text_col, least_chars, least_count), "spelling-words")
    pairs = written(near_pairs(words, symbols_for(words.count())), "spelling-pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n"))
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("top"))
    out = shuffled(words, best, "word", "left")
    enough = -F.col("top.n") >= least_ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(enough, F.col("top.w")).alias("form"),
                             F.when(enough, -F.col("top.n")).alias("form_n")), "spelling-forms")
    roots = followed(out.filter(F.col("form").isNotNull()))
    return shuffled(out, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")

"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and word pairs are hashed into ``BUCKETS``. One pass counts every bucket over all
documents, one over the trusted ones (every row labelled good, but a quarter of
them). A document's score is the mean log-likelihood ratio of its n-grams between the two smoothed
multinomials. The threshold is the ``REJECTED`` quantile of the scores of the quarter of trusted
texts that was held out, so at every size of the table an unseen trusted text passes with the same
probability; a score under it or a failed base rule rejects a document. The same rule holds for
every document; nothing is drawn. Everything is DataFrame functions; what reaches the driver is
``BUCKETS`` numbers and the threshold.

Equal 8-word windows are told by a 64-bit hash within one text.

Defined cases: a null or empty text has no words and fails the base rule, its score is 0; a
null doc_id is carried; repeated rows count again; a null label is not good; without any trusted
text all scores are 0, without held-out ones the base rule alone decides; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import rank_quantiles
from .common import SPACE, WORD, whole_text, written

BUCKETS = 16384
#: A prior count for every bucket.
PRIOR = 1.0
#: Trusted texts whose id's crc32 leaves this rest don't train the weights; they set the threshold.
HELD, FOLDS = 3, 4
#: Share of the held-out trusted texts past the base rule that the threshold rejects.
REJECTED = 0.01
#: Scores are counted in blocks so wide to find the quantile; a few thousand hold them all.
BLOCK = 0.005
WINDOW = 8


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_words", F.array_remove(F.split(whole_text(text_col), SPACE + "+"), ""))


def grams(words: Column) -> Column:
    """The buckets of a text's words and of its pairs of neighbouring words."""
    pairs = F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: _bucket(F.get(words, i - 1), F.get(words, i))))
    return F.concat(F.transform(words, lambda w: _bucket(w)), F.coalesce(pairs, F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held): all ids labelled good."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return good.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD)


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_text, held) of all trusted documents, written."""
    # the ids grow with the labels: no broadcast
    ids = trusted_ids(labels).withColumnRenamed("doc_id", "_id").hint("shuffle_hash")
    return written(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(
        ids, F.col("_key") == F.col("_id")).select("_text", "held"), "quality-trusted")


def bucket_counts(texts: DataFrame) -> list[int]:
    """Each bucket's n-grams over all ``_text``."""
    each = with_words(texts, "_text").select(F.explode(grams(F.col("_words"))).alias("bucket"))
    out = [0] * BUCKETS
    for r in each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def weights(docs: DataFrame, trusted: DataFrame, text_col: str = "text") -> list[float]:
    """Each bucket's log-likelihood ratio; empty without trusted text."""
    from math import log
    good = bucket_counts(trusted.filter("not held"))
    all_good = sum(good)
    if not all_good:
        return []
    raw = bucket_counts(docs.select(F.col(text_col).alias("_text")))
    all_raw = sum(raw)
    base = log(all_raw + PRIOR * BUCKETS) - log(all_good + PRIOR * BUCKETS)
    return [log(g + PRIOR) - log(r + PRIOR) + base for g, r in zip(good, raw)]


def _covered(positions: Column) -> Column:
    """Words under windows at these sorted places."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(positions, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total")), lambda acc: acc["total"])


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _words and the base statistics."""
    text, words = whole_text(text_col), F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    windows = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))).otherwise(
        F.array().cast("array<long>"))
    hashes, ranked = F.col("_hashes"), F.col("_ranked")
    df = with_words(docs, text_col).withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "_lines": lines, "_hashes": windows})
    # only a text with equal windows has them put in order
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_ranked": F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<struct<h:bigint,i:int>>"))
        .otherwise(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}).drop("_lines", "_hashes")
    again = F.filter(ranked, lambda x, k: ((k > 0) & (F.get(ranked, k - 1)["h"] == x["h"]))
                     | ((k + 1 < F.size(ranked)) & (F.get(ranked, k + 1)["h"] == x["h"])))
    return df.withColumn("n_repeat_words", _covered(F.sort_array(F.transform(again, lambda x: x["i"])))).drop("_ranked")


def with_score(docs: DataFrame, text_col: str, table: list[float]) -> DataFrame:
    """All columns of ``docs`` with the base statistics, base_failed and score."""
    df = with_base(docs, text_col)
    words = F.col("_words")
    if table:
        told = F.split(F.lit(" ".join(map(repr, table))), " ").cast("array<double>")  # folded into one constant
        total = F.aggregate(grams(words), F.lit(0.0), lambda acc, b: acc + told[b])
        score = F.when(F.size(words) > 0, total / (2 * F.size(words) - 1)).otherwise(0.0)
    else:
        score = F.lit(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("score", score).drop("_words").withColumn("base_failed", failed)


def threshold(trusted: DataFrame, table: list[float], rejected: float = REJECTED) -> float | None:
    """The ``rejected`` quantile of the held-out trusted texts' scores; None without such texts."""
    held = trusted.filter("held").select("_text")
    # no filter: pushed below the projections, it would compute every array anew for each element
    passed = F.when(~F.col("base_failed"), F.col("score"))
    # written: the quantile reads the counted scores twice
    scores = written(with_score(held, "_text", table).select(passed.alias("score")), "quality-held")
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    found = rank_quantiles(counts, [], "score", "n", [rejected], BLOCK).first()
    return found["q"][0] if found else None


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (as ``_0``, ``_1``, ...) with the base statistics, score and verdict."""
    trusted = trusted_texts(docs, labels, id_col, text_col)
    table = weights(docs, trusted, text_col)
    least = threshold(trusted, table)
    df = with_score(docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]), f"_{docs.columns.index(text_col)}", table)
    good = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    return df.withColumn("kept", ~F.col("base_failed") & good)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, score, kept."""
    return score_documents(docs.select(id_col, text_col), labels, id_col, text_col).select(
        F.col("_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.round("score", 6).alias("score"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with all their columns."""
    # the number keeps the filter above the projections: pushed below them, it would compute
    # every array anew for each element
    scored = score_documents(docs, labels, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    kept = scored.filter("kept and _row >= 0")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

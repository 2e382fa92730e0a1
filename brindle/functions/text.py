"""Words, n-grams and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.files import ranked

#: Words are runs of two or more word characters.
WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _joined(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, n), " "))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of low to high words, joined by spaces; repeats are kept."""
    runs = []
    for n in range(low, high + 1):
        if n == 1:
            runs.append(tokens)
        else:
            starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
            runs.append(_joined(tokens, starts, n))
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def terms(rows: DataFrame, key: str, text: str, low: int = 1, high: int = 2, stop: list[str] | None = None) -> DataFrame:
    """(key, term, tf): how often a term comes in a text. Stop words are left out before words are joined."""
    found = words(F.col(text))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(list(stop)))
    tokens = rows.select(key, found.alias("_words"))
    return tokens.select(key, F.explode(ngrams(F.col("_words"), low, high)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def numbered(found: DataFrame, n: int) -> DataFrame:
    """Terms get a feature: their rank. Few are ranked in one place, many by ranges over all tasks."""
    if n <= 100_000:
        return found.withColumn("feature", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    return ranked(found, "term", "feature").withColumn("feature", F.col("feature").cast("int"))


def _count(bound: float, n: int) -> float:
    """A bound of document frequencies: a whole number of texts, or a share of them."""
    return bound if isinstance(bound, int) and not isinstance(bound, bool) else bound * n


def document_frequencies(tf: DataFrame, n: int, max_df: float = 0.98, max_features: int | None = None, min_df: float = 0.0, smooth: bool = True, use_idf: bool = True) -> DataFrame:
    """(term, df, cf, idf) of the terms in at least min_df and at most max_df of n texts (shares, or numbers if whole).

    With max_features, those of the greatest total count, ties by term. smooth: as if one more text had every term.
    """
    counts = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter((F.col("df") <= _count(max_df, n)) & (F.col("df") >= _count(min_df, n)))
    if max_features:
        counts = counts.orderBy(F.desc("cf"), "term").limit(max_features)
    more = 1.0 if smooth else 0.0
    idf = F.log((more + n) / (more + F.col("df"))) + 1 if use_idf else F.lit(1.0)
    return counts.withColumn("idf", idf)


def weights(tf: DataFrame, vocabulary: DataFrame, key: str, sublinear: bool = False, binary: bool = False, norm: str | None = "l2") -> DataFrame:
    """(key, term, value): tf times idf, at length 1 for each text. Terms outside the vocabulary drop out.

    binary counts each term once, sublinear takes 1 + log(tf); norm: l2, l1 (sum of 1) or None.
    """
    often = F.lit(1.0) if binary else F.col("tf").cast("double")
    often = 1 + F.log(often) if sublinear else often
    raw = tf.join(vocabulary, "term").withColumn("_raw", often * F.col("idf"))
    own = [c for c in vocabulary.columns if c not in ("idf", "df", "cf", "term")]
    if norm is None:
        return raw.select(key, "term", *own, F.col("_raw").alias("value"))
    if norm not in ("l1", "l2"):
        raise ValueError(f"unknown norm {norm!r}")
    by = Window.partitionBy(key)
    size = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(by)) if norm == "l2" else F.sum(F.abs("_raw")).over(by)
    return raw.select(key, "term", *own, (F.col("_raw") / size).alias("value"))

"""Term statistics in long form: vocabulary, TF-IDF, chi-squared, lexicon counts. Wide matrices never arise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import texts as T
from . import vocabulary


def worded(rows: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), keep: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """key, the kept columns, words (of `least` letters, no stop words): a column of its own, so that what is made of it doesn't split the text again."""
    words = T.long_words(text, least)
    return rows.select(key, *keep, (T.content_words(words, stop, least) if stop else words).alias("words"))


def every_term(bigrams: bool):
    return F.concat("words", T.bigrams(F.col("words"))) if bigrams else F.col("words")


def terms(rows: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), bigrams: bool = True, keep: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """key, the kept columns, term, tf: words of `least` letters and, of those that aren't stop words, bigrams. Rows that share key and kept columns count as one."""
    return vocabulary.counted(rows, key, text, stop, bigrams, keep, least).groupBy(key, *keep, "term").agg(F.sum("tf").alias("tf"))


def documents_of(rows: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), bigrams: bool = True, keep: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """The terms of each row once: what document frequencies need, without a shuffle by document."""
    return worded(rows, key, text, stop, keep, least).select(key, *keep, F.explode(F.array_distinct(every_term(bigrams))).alias("term"))


def document_frequency(t: DataFrame, key: str, least: int = 16, n_docs: int | None = None, most_share: float = 1.0) -> DataFrame:
    """term, type, df of terms in at least `least` documents and at most a share of them."""
    return frequent(t.groupBy("term").agg(F.count("*").alias("df")), least, n_docs, most_share)


def frequent(df: DataFrame, least: int = 16, n_docs: int | None = None, most_share: float = 1.0) -> DataFrame:
    """The same from counted terms (term, df)."""
    df = df.where(F.col("df") >= least)
    if n_docs is not None:
        df = df.where(F.col("df") <= most_share * n_docs)
    return df.select("term", F.when(F.instr("term", " ") > 0, "Bigram").otherwise("Unigram").alias("type"), "df")


def capped(t: DataFrame, most: int) -> DataFrame:
    """The `most` terms with the largest sum of tf, ties by term."""
    return t.groupBy("term").agg(F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(most)


def numbered(t: DataFrame) -> tuple[DataFrame, list[str]]:
    """(term, number: its place in order of name; the terms in that order). Terms are sorted by ranges and numbered by range and place, in no single task."""
    spark = t.sparkSession
    ordered = t.select("term").distinct().orderBy("term").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    out = spark.createDataFrame(ordered, "term string, number long").persist()
    return out, [r["term"] for r in out.orderBy("number").collect()]


def idf(train: DataFrame, n_docs: int, least: int = 5) -> DataFrame:
    """Smoothed idf of the training side: term, df, idf. n_docs counts all training documents, empty ones too."""
    return idf_of(train.groupBy("term").agg(F.count("*").alias("df")), n_docs, least)


def idf_of(df: DataFrame, n_docs: int, least: int = 5) -> DataFrame:
    """The same from counted terms (term, df)."""
    return df.where(F.col("df") >= least).withColumn("idf", F.ln((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1)


def tfidf(t: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Sublinear tf times idf, l2-normalised by document; terms that the training side lacks drop out."""
    w = t.join(weights, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    return w.withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).drop("w", "idf", "df")


def chi2(rows: DataFrame, key: str, labels: DataFrame, y: str, value: str = "tf", top: int = 500) -> DataFrame:
    """Chi-squared of summed values by class against each class's share; the `top` terms, ties by term.

    Class shares are over all labelled documents; they are one row, and broadcast.
    """
    share = labels.agg(F.avg(F.col(y).cast("double")).alias("share"))
    obs = rows.join(labels.select(key, y), key).groupBy("term").agg(F.sum(F.col(value) * F.col(y)).alias("pos"), F.sum(value).alias("total"))
    obs = obs.crossJoin(F.broadcast(share)).withColumn("e1", F.col("share") * F.col("total")).withColumn("e0", (1 - F.col("share")) * F.col("total"))
    stat = F.pow(F.col("pos") - F.col("e1"), F.lit(2.0)) / F.col("e1") + F.pow(F.col("total") - F.col("pos") - F.col("e0"), F.lit(2.0)) / F.col("e0")
    out = obs.where("e1 > 0 and e0 > 0").select("term", F.bround(stat, 6).alias("chi2"))
    return out.orderBy(F.desc("chi2"), "term").limit(top)


def lexicon_counts(rows: DataFrame, key: str, text: str, lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """Hits of words (with multiplicity) and adjacent bigrams of a lexicon (token, category, is_distress) in a cleaned text that keeps its stop words.

    n_words, n_distress, distress_density (0 without words), has_distress, and a count for each category. Rows without hits stay.
    """
    worded_ = rows.select(key, T.tokens(text).alias("words")).select(key, F.size("words").alias("n_words"), every_term(True).alias("tokens"))
    every = worded_.select(key, "n_words", F.explode_outer("tokens").alias("token"))
    hits = every.join(F.broadcast(lexicon), "token", "left")  # the lexicon is a fixed, small list
    distress = F.coalesce(F.sum(F.when(F.col("is_distress") == 1, 1)), F.lit(0))
    return hits.groupBy(key, "n_words").agg(
        distress.alias("n_distress"), F.when(F.col("n_words") > 0, distress / F.col("n_words")).otherwise(0.0).alias("distress_density"), (distress > 0).cast("int").alias("has_distress"),
        *[F.count_if(F.col("category") == x).alias(x.lower()) for x in categories],
    )


def slim_lexicon(wide: DataFrame, token: str, flags: list[str]) -> DataFrame:
    """A wide dictionary's tokens (lower case, once) with 0/1 flags; a flag there is the year the token was listed in, negative if it was taken out."""
    marked = [F.max((F.col(f) > 0).cast("int")).alias(f.lower()) for f in flags]
    return wide.where(F.col(token).isNotNull()).groupBy(F.lower(token).alias("token")).agg(*marked)


def consistency(ranked: DataFrame, top: int) -> DataFrame:
    """Terms over folds: in how many among the first `top`, mean rank and mean value there."""
    return ranked.where(F.col("rank") <= top).groupBy("term").agg(F.count("*").alias("n_folds"), F.avg("rank").alias("mean_rank"), F.avg("value").alias("mean_value"))

"""Queries for text features, lexicons and annotation quality."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..functions import texts as T
from ..operators import annotate, corpus, vocabulary
from ..sources import tables
from . import study

R = X.rounded
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS + T.DOMAIN_WORDS) + "]"
FORM = "Borrower added on 01/02/10 > "
LETTERS_SQL = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
TOKENS_SQL = f"list_filter(string_split({LETTERS_SQL}, ' '), lambda x: x <> '')"
CONTENT_SQL = f"list_filter({TOKENS_SQL}, lambda x: length(x) >= 2 AND NOT list_contains({STOPS}, x))"
E_SQL = "e AS (SELECT doc_id AS id, text FROM documents), ey AS (SELECT doc_id AS id, toxic AS y FROM labels SEMI JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)"
G_SQL = f"""{E_SQL}, tk AS (SELECT id, list_filter(regexp_extract_all({LETTERS_SQL}, '[a-zA-Z]{{3,}}'), lambda x: NOT list_contains({STOPS}, x)) AS w FROM e),
ng AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tk UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM tk)) GROUP BY 1, 2),
ug AS (SELECT * FROM ng WHERE instr(term, ' ') = 0)"""


def _letters(spark: SparkSession, d: str) -> DataFrame:
    return study.corpus(spark, d).withColumn("clean", T.letters("text", boilerplate=False))


def _lower(spark: SparkSession, d: str) -> DataFrame:
    """Texts in lower case: their words of letters are those of the cleaned text."""
    return study.corpus(spark, d).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


STOP = T.STOP_WORDS + T.DOMAIN_WORDS


def _terms(spark: SparkSession, d: str, bigrams: bool = True) -> DataFrame:
    return corpus.terms(_lower(spark, d), "id", "text", stop=STOP, bigrams=bigrams)


def _documents_of(spark: SparkSession, d: str, bigrams: bool = True) -> DataFrame:
    return corpus.documents_of(_letters(spark, d), "id", "clean", stop=T.STOP_WORDS + T.DOMAIN_WORDS, bigrams=bigrams)


#: A third of the texts come through the form, which puts a line of its own before them.
FORM_SQL = f"ef AS (SELECT id, CASE WHEN id % 3 = 0 THEN '{FORM}' WHEN id % 3 = 1 THEN ' borrower  ADDED on  11/12/13>' ELSE '' END || coalesce(text, '') AS t FROM e), eg AS (SELECT id, regexp_replace(lower(t), '^\\s*borrower\\s+added\\s+on\\s+\\d{{2}}/\\d{{2}}/\\d{{2}}\\s*>\\s*', '') AS text FROM ef)"


@query(f"WITH {E_SQL}, {FORM_SQL} SELECT id, md5(array_to_string({CONTENT_SQL}, ' ')) AS digest, length(array_to_string({CONTENT_SQL}, ' '))::INT AS n FROM eg")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("id") % 3 == 0, FORM).when(F.col("id") % 3 == 1, " borrower  ADDED on  11/12/13>").otherwise("")
    out = study.corpus(spark, d).select("id", F.concat(form, F.coalesce("text", F.lit(""))).alias("text")).withColumn("c", T.cleaned("text"))
    return out.select("id", F.md5("c").alias("digest"), F.length("c").alias("n"))


#: A form's line with references of several kinds before each page, and what they stand for.
MARKED = "Borrower added on 01/02/10 > &quot;a &amp; b&quot;< BR / >caf&eacute; it&#8217;s&#x21; &amp;lt;br&amp;gt; 1 &lt;br/&gt; 2 &apos;3&apos; added on 01/02/10&gt;"
PLAIN = "Borrower added on 01/02/10 > \"a & b\"< BR / >café it’s! &lt;br&gt; 1 <br/> 2 '3' added on 01/02/10>"


# the pages themselves hold these references only
@query(f"""WITH u AS (SELECT page_id, '{PLAIN.replace("'", "''")}' || replace(replace(replace(replace(replace(coalesce(html, ''), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)(?:borrower\\s+|\\d+\\s+)?added\\s+on\\s+\\d{{2}}/\\d{{2}}/\\d{{2}}\\s*>?', ' ', 'g'), '(?i)<\\s*br\\s*/?\\s*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM u""")
def text_natural(spark: SparkSession, d: str) -> DataFrame:
    p = tables.scan(spark, d, "pages", "page_id", "html")
    return p.select("page_id", F.md5(T.natural(F.concat(F.lit(MARKED), F.coalesce("html", F.lit(""))))).alias("digest"))


@query(f"""WITH {E_SQL}, x AS (SELECT id, text, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS b, {CONTENT_SQL} AS a FROM e)
SELECT id, length(text)::INT AS char_len, len(list_distinct(a))::INT AS uniq_words, CASE WHEN len(a) > 0 THEN round_even(length(array_to_string(a, '')) / len(a)::DOUBLE, 6) ELSE 0 END AS avg_word_len,
greatest(len(b) - len(a), 0)::INT AS removed_words, CASE WHEN len(a) > 0 THEN round_even(len(list_distinct(a)) / len(a)::DOUBLE, 6) ELSE 0 END AS ttr FROM x""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = study.corpus(spark, d).withColumn("c", T.cleaned("text", boilerplate=False))
    return rows.select("id", *[(R(v) if n in ("avg_word_len", "ttr") else v).alias(n) for n, v in T.statistics("text", "c").items()])


@query(f"WITH {G_SQL} SELECT term, CASE WHEN instr(term, ' ') > 0 THEN 'Bigram' ELSE 'Unigram' END AS type, count(*) AS df FROM ng GROUP BY 1, 2 HAVING count(*) >= 16")
def ngram_df_vocab(spark: SparkSession, d: str) -> DataFrame:
    return corpus.frequent(vocabulary.frequencies(_lower(spark, d), "text", STOP), 16)


@query(f"WITH {G_SQL}, n AS (SELECT count(*) AS n FROM e) SELECT term, CASE WHEN instr(term, ' ') > 0 THEN 'Bigram' ELSE 'Unigram' END AS type, count(*) AS df FROM ng, n GROUP BY term, n HAVING count(*) >= 50 AND count(*) <= 0.7::DOUBLE * n")
def ngram_df_capped(spark: SparkSession, d: str) -> DataFrame:
    return corpus.frequent(vocabulary.frequencies(_lower(spark, d), "text", STOP), 50, study.corpus(spark, d).count(), 0.7)


@query(f"WITH {G_SQL} SELECT term, sum(tf)::BIGINT AS total FROM ug GROUP BY 1 ORDER BY total DESC, term LIMIT 200")
def vocab_by_total(spark: SparkSession, d: str) -> DataFrame:
    return corpus.capped(_terms(spark, d, False), 200)


X_SQL = f"""{G_SQL}, nt AS (SELECT count(*) AS n FROM e WHERE id % 4 <> 0), vo AS (SELECT term, ln((1 + n::DOUBLE) / (1 + count(*))) + 1 AS idf FROM ug, nt WHERE id % 4 <> 0 GROUP BY term, n HAVING count(*) >= 5),
wt AS (SELECT id, term, tf, (1 + ln(tf)) * idf AS w FROM ug JOIN vo USING (term)), tx AS (SELECT id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM wt)"""


FITTED = "id % 4 <> 0"


def _weighted(spark: SparkSession, d: str, only: str = "true") -> tuple[DataFrame, pa.Table] | None:
    """The rows of a condition on ids as vocabulary.weighted gives them, and the vocabulary; None where ids repeat or the vocabulary is too large for that."""
    rows = _lower(spark, d)
    if not vocabulary.unique(rows, "id"):
        return None
    train = rows.where(FITTED)
    words = vocabulary.known(corpus.idf_of(vocabulary.frequencies(train, "text", STOP, False), train.count(), 5))
    return None if words is None else (vocabulary.weighted(rows.where(only), "id", "text", words, STOP), words)


def _tfidf(spark: SparkSession, d: str, only: str = "true") -> DataFrame:
    """Fitted on ids that aren't divisible by four, applied to all rows, or to those of a condition on ids."""
    found = _weighted(spark, d, only)
    if found is not None:
        return vocabulary.named(*found, "id")
    t = _terms(spark, d, False)
    n = study.corpus(spark, d).where(FITTED).count()
    return corpus.tfidf(t.where(only), corpus.idf(t.where(FITTED), n, 5), "id")


def _sparse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, indices, values in order of column; term, column) of all documents' TF-IDF."""
    found = _weighted(spark, d)
    if found is None:
        return tables.sparse_rows(_tfidf(spark, d), "id", "term", "tfidf")
    rows, words = found
    return rows.select("id", F.col("columns").alias("indices"), "values"), vocabulary.numbered(words, spark)


@query(f"WITH {X_SQL} SELECT id, term, tf, round_even(tfidf, 6) AS tfidf FROM tx")
def tfidf_long(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).select("id", "term", "tf", R("tfidf").alias("tfidf"))


@query(f"WITH {X_SQL} SELECT count(*) AS n_unseen, count(DISTINCT term) AS n_terms FROM ug WHERE id % 4 = 0 AND term NOT IN (SELECT term FROM vo)")
def tfidf_unseen_terms(spark: SparkSession, d: str) -> DataFrame:
    t = _terms(spark, d, False)
    known = corpus.idf(t.where("id % 4 <> 0"), 1, 5)
    return t.where("id % 4 = 0").join(known, "term", "left_anti").agg(F.count("*").alias("n_unseen"), F.count_distinct("term").alias("n_terms"))


@query(f"""WITH {X_SQL}, tr AS (SELECT id, y FROM ey WHERE id % 4 <> 0), sh AS (SELECT avg(y) AS q FROM tr), ob AS (SELECT term, sum(tfidf * y) AS pos, sum(tfidf) AS total FROM tx JOIN tr USING (id) GROUP BY 1)
SELECT term, round_even((pos - q * total) * (pos - q * total) / (q * total) + (total - pos - (1 - q) * total) * (total - pos - (1 - q) * total) / ((1 - q) * total), 6) AS chi2 FROM ob, sh ORDER BY chi2 DESC, term LIMIT 500""")
def chi2_topk(spark: SparkSession, d: str) -> DataFrame:
    """Terms by chi-squared of their summed TF-IDF on the labelled training side."""
    labels = study.labelled(spark, d).where(FITTED)
    return corpus.chi2(_tfidf(spark, d, FITTED), "id", labels, "y", "tfidf", 500)


@query(f"WITH {E_SQL}, tk AS (SELECT id, list_filter(regexp_extract_all({LETTERS_SQL}, '[a-zA-Z]{{3,}}'), lambda x: NOT list_contains({STOPS}, x)) AS w FROM e), g AS (SELECT DISTINCT id % 3 AS fold, id, unnest(w) AS term FROM tk) SELECT n AS fold, count(DISTINCT term) AS n_terms FROM g, (VALUES (0), (1), (2)) v(n) WHERE fold <= n GROUP BY 1")
def vocabulary_growth(spark: SparkSession, d: str) -> DataFrame:
    t = _documents_of(spark, d, False).select((F.col("id") % 3).cast("int").alias("f"), "term").distinct()
    first = t.groupBy("term").agg(F.min("f").alias("fold")).groupBy("fold").agg(F.count("*").alias("n"))
    return first.select("fold", F.sum("n").over(Window.orderBy("fold")).alias("n_terms"))  # a row for each fold


#: A small lexicon of the test corpus: token, category, is_distress (fixed values).
LEXICON = (("idiot", "SHOCK_EMERGENCY", 1), ("stupid", "DEBT_PRESSURE", 1), ("trash", "LIQUIDITY_SHORTAGE", 1), ("the", "NEUTRAL_BENIGN", 0), ("that it", "HIGH_RISK_REFINANCING", 1), ("of the", "NEUTRAL_BENIGN", 0))
CATEGORIES = ["DEBT_PRESSURE", "LIQUIDITY_SHORTAGE", "SHOCK_EMERGENCY", "HIGH_RISK_REFINANCING", "NEUTRAL_BENIGN"]


@query(f"""WITH {E_SQL}, tk AS (SELECT id, {TOKENS_SQL} AS w FROM e), lx AS (SELECT * FROM (VALUES {', '.join(str(x) for x in LEXICON)}) l(token, category, d)),
al AS (SELECT id, unnest(w) AS token FROM tk UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM tk)), h AS (SELECT id, category, d FROM al JOIN lx USING (token))
SELECT tk.id, len(w)::INT AS n_words, count(*) FILTER (d = 1) AS n_distress, CASE WHEN len(w) > 0 THEN round_even(count(*) FILTER (d = 1) / len(w)::DOUBLE, 6) ELSE 0 END AS distress_density, (count(*) FILTER (d = 1) > 0)::INT AS has_distress,
{', '.join(f"count(*) FILTER (category = '{c}') AS {c.lower()}" for c in CATEGORIES)} FROM tk LEFT JOIN h USING (id) GROUP BY tk.id, w""")
def lexicon_features(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(LEXICON), "token string, category string, is_distress int")
    out = corpus.lexicon_counts(_letters(spark, d), "id", "clean", lexicon, CATEGORIES)
    return out.withColumn("distress_density", R("distress_density"))


# --- annotators: the given quality label, and a rule on the text's length ---------------------------

J_SQL = "j AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS human, CASE WHEN n_chars >= 900 THEN 'good' WHEN n_chars >= 300 THEN 'fair' ELSE 'bad' END AS rule FROM labels JOIN documents USING (doc_id))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.scan(spark, d, "labels", "doc_id", "quality").join(tables.scan(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("human"), F.when(F.col("n_chars") >= 900, "good").when(F.col("n_chars") >= 300, "fair").otherwise("bad").alias("rule"))


@query(f"WITH {J_SQL}, t AS (SELECT count(*) AS n, avg((human = rule)::INT) AS po FROM j), c AS (SELECT sum(a.n * b.n) AS x FROM (SELECT human AS k, count(*) AS n FROM j GROUP BY 1) a JOIN (SELECT rule AS k, count(*) AS n FROM j GROUP BY 1) b USING (k)) SELECT n, round_even(po, 6) AS agreement, round_even((po - x / (n * n)::DOUBLE) / (1 - x / (n * n)::DOUBLE), 6) AS kappa FROM t, c")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.kappa(_pairs(spark, d), "human", "rule")
    return out.select("n", R("agreement").alias("agreement"), R("kappa").alias("kappa"))


@query(f"WITH {J_SQL} SELECT human AS label, count(*) FILTER (rule = 'good') AS as_good, count(*) FILTER (rule = 'fair') AS as_fair, count(*) FILTER (rule = 'bad') AS as_bad FROM j GROUP BY 1")
def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    return annotate.confusion(_pairs(spark, d), "human", "rule", ["good", "fair", "bad"])


@query(f"""WITH {J_SQL}, x AS (SELECT human AS label, count(*) AS support, count(*) FILTER (human = rule) AS tp FROM j GROUP BY 1), y AS (SELECT rule AS label, count(*) AS said FROM j GROUP BY 1),
z AS (SELECT label, support, tp / said::DOUBLE AS p, tp / support::DOUBLE AS r FROM x JOIN y USING (label)) SELECT label, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(2 * p * r / (p + r), 6) AS f1, support FROM z""")
def prf_by_class(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.per_class(_pairs(spark, d), "human", "rule")
    return out.withColumns({c: R(c) for c in ("precision", "recall", "f1")})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return annotate.unmatched(tables.scan(spark, d, "documents", "doc_id"), tables.scan(spark, d, "labels", "doc_id"), "doc_id")


@query("SELECT item_id, 'term' || item_id AS token, CASE WHEN item_id % 2 = 0 THEN 'DEBT_PRESSURE' ELSE 'NEUTRAL_BENIGN' END AS category, ((item_id % 2 = 0) OR item_id % 3 = 0)::INT AS is_distress FROM benchmark")
def annotation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an annotator, made from item numbers: fences, a header, a short line, an unknown category, flags that are no numbers."""
    b = tables.scan(spark, d, "benchmark", "item_id")
    even = F.col("item_id") % 2 == 0
    flag = F.when(F.col("item_id") % 3 == 0, "1").when(even, "yes").otherwise("0")
    line = F.concat(F.lit("term"), F.col("item_id"), F.lit(","), F.when(even, "debt_pressure").otherwise("NEUTRAL_BENIGN"), F.lit(","), flag, F.lit(',"because, well"'))
    answers = b.select("item_id", F.concat(F.lit("```csv\ntoken,category,is_distress,rationale\n"), line, F.lit("\nshort\nx,NO_SUCH,1,y\n```")).alias("answer"))
    return tables.annotation_rows(answers, "answer", CATEGORIES, "NEUTRAL_BENIGN").select("item_id", "token", "category", "is_distress")

"""Queries for sources behind calls, checked joins, small functions, full groupings and threshold policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import texts as T
from ..operators import annotate, balance, checks, corpus, fairness, models, rankstats, runner
from ..sources import feeds, tables
from . import study, textual
from .statistics import erf_sql
from .study import A_SQL, F_SQL, L_SQL, P_SQL, PL_SQL, S_SQL

R = X.rounded
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- sources and sinks ----------------------------------------------------------------------------

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _customer_csv(spark: SparkSession, d: str) -> str:
    path = f"{tables.scratch(spark)}/customer"
    tables.scan(spark, d, "customer").write.csv(path, header=True)
    return path


@query("SELECT c_nationkey, count(*) AS n, round_even(sum(c_acctbal), 4) AS balance FROM customer WHERE c_nationkey IN (1, 3, 7, 12) GROUP BY 1")
def csv_filter_append(spark: SparkSession, d: str) -> DataFrame:
    """A typed CSV scan of two columns, filtered part by part into one table."""
    rows = tables.scan_csv(spark, _customer_csv(spark, d), CUSTOMER, ["c_nationkey", "c_acctbal"])
    out = tables.append_filtered(rows, f"{tables.scratch(spark)}/some", F.col("c_nationkey").isin(1, 3), F.col("c_nationkey").isin(7, 12))
    return out.groupBy("c_nationkey").agg(F.count("*").alias("n"), R(F.sum("c_acctbal"), 4).alias("balance"))


@query("SELECT count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round_even(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5000)")
def head_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.head(spark, d, "orders", 5000, "o_orderkey")
    return rows.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), R(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("rate"))


@query("SELECT 1::BIGINT AS n_files, (SELECT count(*) + 1 FROM customer) AS n_lines, (SELECT sum(octet_length(encode(c_name)) + length(c_nationkey::VARCHAR) + 2) + length('name,nation') + 1 FROM customer)::BIGINT AS n_bytes")
def text_file_profile(spark: SparkSession, d: str) -> DataFrame:
    path = f"{tables.scratch(spark)}/names"
    tables.scan(spark, d, "customer", "c_name", "c_nationkey").toDF("name", "nation").coalesce(1).write.csv(path, header=True)
    return tables.text_profile(spark, path)


@query(f"WITH {A_SQL} SELECT area, CASE WHEN n >= 0 THEN n END AS loans, CASE WHEN mean_balance >= 0 THEN mean_balance END AS mean_balance, CASE WHEN mean_amount >= 0 THEN mean_amount END AS mean_amount, share_urgent, share_building FROM a")
def fetch_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A wide source that answers two variables at a time, and is busy at first."""
    wide, asked = study.areas(spark, d), set()

    def fetch(names: list[str]) -> DataFrame:
        if tuple(names) not in asked:
            asked.add(tuple(names))
            raise feeds.Busy
        return wide.select("area", *names)

    names, waited = ["n", "mean_balance", "mean_amount", "share_urgent", "share_building"], []
    parts = [feeds.patiently(fetch, part, wait=waited.append) for part in feeds.chunks(names, 2)]
    assert waited == [feeds.FIRST_WAIT] * 3
    return tables.merged_chunks(parts, "area").withColumnRenamed("n", "loans")


@query("SELECT 'term' || p_partkey AS token, CASE WHEN p_partkey % 3 = 0 THEN 'DEBT_PRESSURE' ELSE 'NEUTRAL_BENIGN' END AS category, (p_partkey % 3 = 0)::INT AS is_distress FROM part")
def annotator_batches(spark: SparkSession, d: str) -> DataFrame:
    """Terms asked fifty at a time of a made-up annotator that is busy on its first call."""
    terms = tables.scan(spark, d, "part", "p_partkey").select(F.concat(F.lit("term"), "p_partkey").alias("term"))
    calls = []

    def ask(some: list[str]) -> str:
        calls.append(len(some))
        if len(calls) == 1:
            raise feeds.Busy
        if len(some) > feeds.TERMS:
            raise ValueError("too many terms")
        return "```csv\n" + "\n".join(f'{t},{"debt_pressure" if int(t[4:]) % 3 == 0 else "neutral_benign"},,"said so, once"' for t in some) + "\n```"

    return feeds.annotated(terms, "term", ask, textual.CATEGORIES, "NEUTRAL_BENIGN", wait=lambda s: None).select("token", "category", "is_distress")


SUMMARY_SQL = "SELECT c_mktsegment AS k, count(*) AS n, round_even(avg(c_acctbal), 4) AS m FROM customer GROUP BY 1"


@query(f"WITH x AS ({SUMMARY_SQL}) SELECT k AS row, 'size' AS measure, 'count' AS statistic, n::DOUBLE AS value FROM x UNION ALL SELECT k, 'balance', 'mean', m FROM x UNION ALL SELECT k, 'balance', 'twice', m * 2 FROM x")
def wide_summary_long(spark: SparkSession, d: str) -> DataFrame:
    """A report's table with two header lines, read into long form."""
    by = tables.scan(spark, d, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(F.count("*").alias("n"), R(F.avg("c_acctbal"), 4).alias("m"))
    lines = by.select(F.lit(2).alias("place"), F.concat_ws(",", "c_mktsegment", "n", "m", F.col("m") * 2).alias("line"))
    heads = spark.createDataFrame([(0, ",size,balance,"), (1, ",count,mean,twice")], "place int, line string")
    return tables.wide_summary(heads.unionByName(lines), "line", "place")


@query(f"WITH {textual.X_SQL} SELECT id, term, round_even(tfidf, 6) AS tfidf FROM tx")
def sparse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF rows written as sparse rows and a vocabulary, and read back."""
    folder = tables.scratch(spark)
    rows, words = textual._sparse(spark, d)
    rows.write.parquet(f"{folder}/rows")
    words.write.parquet(f"{folder}/vocabulary")
    return tables.long_rows(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/vocabulary"), "id", "term", "tfidf").withColumn("tfidf", R("tfidf"))


@query("SELECT n_name AS nation, c.n, c.segments, 'append' AS part FROM (SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1) c JOIN nation ON c_nationkey = n_nationkey")
def audit_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows added as JSON lines in two parts, flat rows as CSV in two parts, both read back and joined."""
    c, folder = tables.scan(spark, d, "customer", "c_nationkey", "c_mktsegment"), tables.scratch(spark)
    rows = c.groupBy(F.col("c_nationkey").alias("key")).agg(F.struct(F.count("*").alias("n"), F.collect_set("c_mktsegment").alias("segments")).alias("audit"))
    names = tables.scan(spark, d, "nation", "n_nationkey", "n_name").toDF("key", "nation")
    for part in (0, 1):
        tables.append_audit(rows.where(F.col("key") % 2 == part), f"{folder}/audit")
        tables.append_csv(names.where(F.col("key") % 2 == part), f"{folder}/names")
    back = spark.read.schema("key int, audit struct<n: long, segments: array<string>>").json(f"{folder}/audit")
    flat = tables.scan_csv(spark, f"{folder}/names", "key int, nation string")
    return back.join(flat, "key").select("nation", "audit.n", F.size("audit.segments").cast("long").alias("segments"), F.lit("append").alias("part"))


@query("SELECT lower(p_name) AS token, max((p_size - 25 > 0)::INT) AS positive, max((p_partkey % 5 > 0)::INT) AS negative, max((p_retailprice - 1000 > 0)::INT) AS uncertainty FROM part GROUP BY 1")
def lexicon_slim(spark: SparkSession, d: str) -> DataFrame:
    p = tables.scan(spark, d, "part", "p_name", "p_size", "p_partkey", "p_retailprice")
    wide = p.select(F.upper("p_name").alias("Word"), (F.col("p_size") - 25).alias("Positive"), (F.col("p_partkey") % 5).alias("Negative"), (F.col("p_retailprice") - 1000).alias("Uncertainty"))
    return corpus.slim_lexicon(wide, "Word", ["Positive", "Negative", "Uncertainty"])


@query(f"WITH {A_SQL} SELECT 0 AS place, 'loans' AS stage, (SELECT count(*) FROM s) AS n_rows UNION ALL SELECT 1, 'areas', (SELECT count(*) FROM a) UNION ALL SELECT 2, 'large', (SELECT count(*) FROM a WHERE n > 100)")
def staged_run(spark: SparkSession, d: str) -> DataFrame:
    """Three stages, run, and run again: what is there is taken up."""
    stages = [
        ("loans", lambda s, _, made: study.loans(s, d)),
        ("areas", lambda s, _, made: made["loans"].groupBy("area").agg(F.count("*").alias("n"))),
        ("large", lambda s, settings, made: made["areas"].where(F.col("n") > settings.limit)),
    ]
    folder, settings = tables.scratch(spark), runner.Settings.parsed(["limit=100", "suffix=_x"])
    runner.run(spark, stages[:2], settings, folder)
    log = runner.run(spark, stages, settings, folder)
    return log.where(F.col("taken_up") == (F.col("place") < 2)).select("place", "stage", "n_rows")


# --- rows and small functions ---------------------------------------------------------------------


@query("SELECT count(*) AS n_before, count(*) FILTER (NOT coalesce(o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O'), false)) AS n_removed, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O')) AS n_after FROM orders")
def filter_removed(spark: SparkSession, d: str) -> DataFrame:
    o = tables.scan(spark, d, "orders", "o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))
    return checks.removed(o, status.isin("F", "O"))[1]


@query(f"WITH {S_SQL} SELECT count(*) AS n, sum(flag)::BIGINT AS n_one FROM (SELECT id % 4 AS flag, CASE WHEN id % 3 <> 0 THEN segment END AS segment, CASE WHEN balance > 0 THEN balance END AS balance FROM s) WHERE flag IN (0, 1) AND segment IS NOT NULL AND balance IS NOT NULL")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels in 0 and 1 only, and no nulls among the named columns."""
    rows = study.loans(spark, d).select((F.col("id") % 4).alias("flag"), F.when(F.col("id") % 3 != 0, F.col("segment")).alias("segment"), F.when(F.col("balance") > 0, F.col("balance")).alias("balance"))
    return rows.where(F.col("flag").isin(0, 1)).na.drop(subset=["segment", "balance"]).agg(F.count("*").alias("n"), F.sum("flag").alias("n_one"))


@query(f"WITH {S_SQL} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN (id % 200)::INT END, 999) AS months_since, CASE WHEN balance < 0 THEN 0 ELSE balance END AS balance, segment FROM s")
def sentinel_and_order(spark: SparkSession, d: str) -> DataFrame:
    """Never-happened as 999, a lower bound, and the columns that stay, in their order."""
    rows = study.loans(spark, d).withColumn("months_since", F.when(F.col("id") % 3 == 0, (F.col("id") % 200).cast("int"))).withColumn("__helper", F.lit(1))
    rows = checks.sentinel(rows, ["months_since", "never_there"]).withColumn("balance", X.clipped("balance", low=0.0))
    rows = checks.without(rows, "AMOUNT", "area", "issue_d", "month", "nation", "priority", "is_default", "unknown")
    return checks.reordered(rows, checks.column_union(["months_since", "id"], ["id", "balance"]))


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN o_orderkey % 5 = 0 THEN 'soon' END AS t, o_orderkey % 3 AS k, o_orderdate::DATE AS day FROM orders)
SELECT k AS kind, count(t) AS n_given, count(CASE WHEN k < 2 THEN day END) AS n_parsed, count(t) - count(CASE WHEN k < 2 THEN day END) AS n_failed, strftime(min(CASE WHEN k < 2 THEN day END), '%Y-%m-%d') AS first_day FROM x GROUP BY 1""")
def parse_dates_mixed(spark: SparkSession, d: str) -> DataFrame:
    o, k = tables.scan(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 5 == 0, "soon")
    rows = o.select(k.alias("kind"), text.alias("t")).withColumn("day", X.parsed_day("t"))
    return rows.groupBy("kind").agg(F.count("t").alias("n_given"), F.count("day").alias("n_parsed"), (F.count("t") - F.count("day")).alias("n_failed"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"))


@query("""SELECT c_custkey AS id, lower(c_mktsegment) || ' x' AS plain, CASE c_custkey % 4 WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN c_custkey + 0.5::DOUBLE END AS number,
CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 10 ELSE c_custkey % 5 END::INT AS years, trim(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || ' ' || c_mktsegment) AS joined,
CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS place FROM customer""")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    """Strings made untidy, and made tidy again."""
    c, key = tables.scan(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    untidy = F.concat(F.lit("  "), "c_mktsegment", F.lit(" x  "))
    number = F.when(key % 4 == 0, F.concat(F.lit(" "), key.cast("string"))).when(key % 4 == 1, F.concat(key.cast("string"), F.lit(".5"))).when(key % 4 == 2, "n/a")
    years = F.when(key % 5 == 0, "< 1 year").when(key % 5 == 1, "n/a").when(key % 5 == 2, "10+ years").otherwise(F.concat((key % 5).cast("string"), F.lit(" years")))
    name = F.when(key % 2 == 0, F.col("c_name"))
    rows = c.select(key.alias("id"), untidy.alias("u"), number.alias("n"), years.alias("y"), name.alias("a"), "c_mktsegment")
    return rows.select("id", X.plain("u").alias("plain"), X.numeric("n").alias("number"), X.years_employed("y").alias("years"), T.joined("a", "c_mktsegment").alias("joined"), X.looked_up("c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}).alias("place"))


@query("SELECT c_nationkey AS nation, sum(CASE WHEN c_nationkey % 3 <> 0 THEN c_acctbal::DECIMAL(18, 2) END)::DOUBLE AS total FROM customer GROUP BY 1")
def sum_min_count(spark: SparkSession, d: str) -> DataFrame:
    """Grouped sums that stay null where every value is."""
    c = tables.scan(spark, d, "customer", "c_nationkey", "c_acctbal")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum(F.when(F.col("c_nationkey") % 3 != 0, F.col("c_acctbal").cast("decimal(18,2)"))).cast("double").alias("total"))


#: Word forms and their lemmas, a sample of a given table (fixed values).
LEMMAS = {"thes": "the", "ands": "and", "ions": "ion", "ers": "er", "idiots": "idiot"}
_LEMMA_SQL = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEMMAS.items()) + " ELSE x END"


@query(f"SELECT doc_id AS id, md5(array_to_string(list_transform({textual.TOKENS_SQL}, lambda x: {_LEMMA_SQL}), ' ')) AS digest FROM documents")
def text_lemmas(spark: SparkSession, d: str) -> DataFrame:
    words = study.corpus(spark, d).select("id", T.tokens(T.letters("text", boilerplate=False)).alias("words"))
    return words.select("id", F.md5(F.array_join(T.lemmatised(F.col("words"), LEMMAS), " ")).alias("digest"))


@query("SELECT p_partkey AS partkey FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 100")
def subsample_md5(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows without replacement: those with the smallest hashes of seed and key."""
    p = tables.scan(spark, d, "part", "p_partkey")
    return p.orderBy(F.md5(F.concat(F.lit("42:"), F.col("p_partkey").cast("string"))), "p_partkey").limit(100).select(F.col("p_partkey").alias("partkey"))


@query("""WITH g AS (SELECT vec_id // 4 AS seq, vec_id % 4 AS place, vec_id, embedding FROM embeddings), x AS (SELECT seq, place, (vec_id % 3 <> 0)::INT AS m, i, embedding[i] AS v FROM g, range(1, 9) r(i))
SELECT seq, i::INT AS dim, round_even(CASE WHEN sum(m) > 0 THEN sum(v::DOUBLE * m) / sum(m) ELSE 0 END, 5) AS mean, sum(m)::INT AS n_tokens FROM x GROUP BY 1, 2""")
def masked_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the tokens that a mask names; tokens are given vectors, four to a text, the first eight dimensions shown."""
    e = tables.scan(spark, d, "embeddings", "vec_id", "embedding")
    rows = e.groupBy(F.expr("vec_id div 4").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    rows = rows.select("seq", F.col("all.embedding").alias("vectors"), F.transform("all.vec_id", lambda v: (v % 3 != 0).cast("int")).alias("mask"))
    out = rows.select("seq", feeds.masked_mean("vectors", "mask").alias("mean"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"))
    return out.select("seq", "n_tokens", F.posexplode(F.slice("mean", 1, 8)).alias("dim", "mean")).select("seq", (F.col("dim") + 1).alias("dim"), R("mean", 5).alias("mean"), "n_tokens")


@query(f"""WITH {textual.J_SQL}, x AS (SELECT count(*) AS n, avg(((human = 'good') = (rule = 'good'))::INT) AS agreement, count(*) FILTER (human = 'good' AND rule = 'good') AS tp, count(*) FILTER (rule = 'good') AS p, count(*) FILTER (human = 'good') AS t FROM j)
SELECT n, round_even(agreement, 6) AS agreement, round_even(tp / p::DOUBLE, 6) AS precision, round_even(tp / t::DOUBLE, 6) AS recall, round_even(2 * tp / (p + t)::DOUBLE, 6) AS f1 FROM x""")
def binary_view(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.binary(textual._pairs(spark, d), "human", "rule", ["good"])
    return out.withColumns({c: R(c) for c in ("agreement", "precision", "recall", "f1")})


# --- joins that must hold -------------------------------------------------------------------------


@query(f"WITH {A_SQL} SELECT area, n, mean_balance, share_urgent FROM a")
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    a = study.areas(spark, d)
    both = checks.one_to_one(a.select("area", "n"), a.select("area", "mean_balance"), "area")
    return checks.left_one_to_one(both, a.select("area", "share_urgent"), "area", "share_urgent")


@query("SELECT o_orderkey AS id, o_totalprice AS price, coalesce(c_acctbal, 0) AS balance, coalesce(c_mktsegment, '') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey WHERE o_orderkey < 2000")
def lookup_and_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Keys that must be known, and keys whose missing rows are filled."""
    o = tables.scan(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    wanted = o.where("o_orderkey < 2000").select("o_orderkey")
    found = checks.lookup(wanted, o, "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    c = tables.scan(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment").where("c_custkey % 3 <> 0")
    out = checks.reindexed(found, c, "c_custkey", {"c_acctbal": 0.0, "c_mktsegment": ""})
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


@query("SELECT count(*) AS n, round_even(sum(c.c_acctbal), 4) AS balance_customer, round_even(sum(p.p_retailprice), 4) AS price_part, round_even(sum(s.s_acctbal), 4) AS balance_supplier FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.scan(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").join(tables.scan(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    fact = lines.select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    dims = {"customer": ("c_custkey", "c_acctbal"), "part": ("p_partkey", "p_retailprice"), "supplier": ("s_suppkey", "s_acctbal")}
    out = checks.star(fact, {name: (tables.scan(spark, d, name, key, value), key) for name, (key, value) in dims.items()})
    total = lambda c, name: R(F.sum(c), 4).alias(name)
    return out.agg(F.count("*").alias("n"), total("c_acctbal_customer", "balance_customer"), total("p_retailprice_part", "price_part"), total("s_acctbal_supplier", "balance_supplier"))


@query(f"""WITH {P_SQL}, x AS (SELECT model, arm, avg(y_prob) AS mean_p FROM p GROUP BY 1, 2), y AS (SELECT model, arm, avg(y_true) AS rate FROM p WHERE fold > 2 GROUP BY 1, 2) SELECT model, arm, round_even(mean_p, 6) AS mean_p, round_even(rate, 6) AS rate FROM x JOIN y USING (model, arm)""")
def merge_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Two summaries of the same configurations, side by side."""
    p, keys = study.predictions(spark, d), ["model", "arm"]
    x, y = p.groupBy(*keys).agg(R(F.avg("y_prob")).alias("mean_p")), p.where("fold > 2").groupBy(*keys).agg(R(F.avg("y_true")).alias("rate"))
    return x.join(y, keys)


# --- groupings in full ----------------------------------------------------------------------------

WORSE, BETTER = ["share_machinery", "share_urgent", "share_low", "share_household"], ["mean_balance", "mean_amount", "mean_nation"]
_terms_sql = " + ".join([study.rank_sql(c) for c in WORSE] + [f"1 - {study.rank_sql(c)}" for c in BETTER])
A7_SQL = f"""{S_SQL},
a7 AS (
  SELECT area, round_even(avg(balance), 4) AS mean_balance, round_even(avg(amount), 4) AS mean_amount, round_even(avg(nation), 6) AS mean_nation,
         {', '.join(f"round_even(avg(({test})::INT), 6) AS {name}" for name, test in (('share_building', "segment = 'BUILDING'"), ('share_machinery', "segment = 'MACHINERY'"), ('share_household', "segment = 'HOUSEHOLD'"), ('share_furniture', "segment = 'FURNITURE'"), ('share_urgent', "priority LIKE '1%'"), ('share_low', "priority LIKE '5%'")))}
  FROM s GROUP BY area)"""
SIX = {f"share_{x}": f"{x}_group" for x in ("building", "machinery", "household", "furniture", "urgent", "low")}


def wide_areas(spark: SparkSession, d: str) -> DataFrame:
    share = lambda flag: X.rounded(F.avg(flag.cast("int")))
    tests = {f"share_{x}": F.col("segment") == x.upper() for x in ("building", "machinery", "household", "furniture")} | {"share_urgent": F.col("priority").startswith("1"), "share_low": F.col("priority").startswith("5")}
    return study.loans(spark, d).groupBy("area").agg(
        X.rounded(F.avg("balance"), 4).alias("mean_balance"), X.rounded(F.avg("amount"), 4).alias("mean_amount"), X.rounded(F.avg("nation")).alias("mean_nation"), *[share(t).alias(c) for c, t in tests.items()],
    )


def grouped_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas with the index of seven inputs, its tertiles and those of six shares."""
    out = balance.index(wide_areas(spark, d), WORSE, BETTER, "disadvantage").withColumn("disadvantage", X.rounded("disadvantage", 9))
    return balance.tertiles(out, {"disadvantage": "index_group"} | SIX)


G7_SQL = f"{A7_SQL}, ai7 AS (SELECT *, round_even(({_terms_sql}) / 7, 9) AS disadvantage FROM a7), ag AS (SELECT *, {', '.join(f'{study.tertile_sql(c, chr(97) + chr(105) + chr(55))} AS {g}' for c, g in ({'disadvantage': 'index_group'} | SIX).items())} FROM ai7)"


@query(f"WITH {G7_SQL} SELECT area, round_even(disadvantage, 6) AS disadvantage, index_group FROM ag")
def index_of_seven(spark: SparkSession, d: str) -> DataFrame:
    return grouped_areas(spark, d).select("area", R("disadvantage").alias("disadvantage"), "index_group")


@query(f"WITH {G7_SQL} SELECT area, {', '.join(SIX.values())} FROM ag")
def six_groupings(spark: SparkSession, d: str) -> DataFrame:
    return grouped_areas(spark, d).select("area", *SIX.values())


@query(f"WITH {A_SQL} SELECT area, round_even(((share_machinery - avg(share_machinery) OVER ()) / stddev_samp(share_machinery) OVER () - (mean_balance - avg(mean_balance) OVER ()) / stddev_samp(mean_balance) OVER ()) / 2, 6) AS z_index FROM a")
def z_score_sample(spark: SparkSession, d: str) -> DataFrame:
    return balance.z_index(study.areas(spark, d), ["share_machinery"], ["mean_balance"], sample=True).select("area", R("z_index").alias("z_index"))


@query()
def pc1_index(spark: SparkSession, d: str) -> DataFrame:
    """The first component's index beside the index of ranks, and their correlation's sign."""
    rows = grouped_areas(spark, d)
    return balance.pc1_index(rows, WORSE + BETTER, "disadvantage").select("area", R("pc1_index").alias("pc1_index"), R("disadvantage").alias("disadvantage"))


ALL_GROUPINGS = ["index_group", *SIX.values()]
GRID = [0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.8]
G7P_SQL = f"{P_SQL}, {G7_SQL.removeprefix(S_SQL + ',').strip()}"


@query(f"""WITH {G7P_SQL}, u AS (SELECT model, arm, fold, y_true, y_prob, grouping, level FROM p JOIN (UNPIVOT (SELECT area, {', '.join(ALL_GROUPINGS)} FROM ag) ON {', '.join(ALL_GROUPINGS)} INTO NAME grouping VALUE level) USING (area)),
gr AS (SELECT model, arm, grouping, level, fold, t.threshold, sum(y_true) AS np, count(*) - sum(y_true) AS nn, count(*) FILTER (y_prob >= t.threshold AND y_true = 1) AS tp, count(*) FILTER (y_prob >= t.threshold AND y_true = 0) AS fp
  FROM u, (VALUES {', '.join(f'({t}::DOUBLE)' for t in GRID)}) t(threshold) WHERE level IN ('Low', 'High') GROUP BY ALL),
gg AS (SELECT l.model, l.arm, l.grouping, l.fold, l.threshold, least(l.np, h.np, l.nn, h.nn) < 30 AS small, h.tp / h.np::DOUBLE - l.tp / l.np::DOUBLE AS tg, h.fp / h.nn::DOUBLE - l.fp / l.nn::DOUBLE AS fg FROM gr l JOIN gr h USING (model, arm, grouping, fold, threshold) WHERE l.level = 'Low' AND h.level = 'High')
SELECT model, arm, grouping, fold, threshold, small::INT AS small_cell, CASE WHEN NOT small THEN round_even(tg, 6) END AS tpr_gap, CASE WHEN NOT small THEN round_even(fg, 6) END AS fpr_gap, CASE WHEN NOT small THEN round_even(greatest(abs(tg), abs(fg)), 6) END AS eo_diff FROM gg""")
def fairness_full_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every arm, model, fold, seven groupings, eight thresholds: rows are counted by area and decision first, so groupings multiply counts, not rows."""
    labels = grouped_areas(spark, d).select("area", *ALL_GROUPINGS)
    keys = ["model", "arm", "fold"]
    out = fairness.grid(study.predictions(spark, d), ALL_GROUPINGS, keys, GRID, by="area", labels=labels)
    return out.select(*keys, "grouping", "threshold", "small_cell", *[R(c).alias(c) for c in ("tpr_gap", "fpr_gap", "eo_diff")])


def _directed_sql(treated: str, control: str, tag: str) -> str:
    return f"""st_{tag} AS (SELECT *, (index_group = '{treated}')::INT AS t FROM al WHERE index_group IN ('Low', 'High')),
ks_{tag} AS (SELECT * FROM (SELECT *, sum(t) OVER (PARTITION BY machinery_group) AS ts, sum(1 - t) OVER (PARTITION BY machinery_group) AS cs FROM st_{tag}) WHERE ts > 0 AND cs > 0),
w_{tag} AS (SELECT area, index_group, CASE WHEN t = 1 THEN 1::DOUBLE ELSE (ts / (sum(t) OVER ())::DOUBLE) / (cs / (sum(1 - t) OVER ())::DOUBLE) END AS weight FROM ks_{tag})"""


@query(f"""WITH {PL_SQL}, {_directed_sql('High', 'Low', 'high')}, {_directed_sql('Low', 'High', 'low')},
w AS (SELECT 'High' AS treated, * FROM w_high UNION ALL SELECT 'Low', * FROM w_low),
x AS (SELECT treated, model, arm, w.index_group AS g, sum((y_prob >= 0.5::DOUBLE)::INT * weight) / sum(weight) AS fpr, avg((y_prob >= 0.5::DOUBLE)::INT) AS plain, sum(weight) * sum(weight) / sum(weight * weight) AS ne FROM p JOIN w USING (area) WHERE y_true = 0 GROUP BY 1, 2, 3, 4),
y AS (SELECT l.treated, l.model, l.arm, l.fpr AS low, h.fpr AS high, h.plain - l.plain AS plain_gap, l.ne AS nl, h.ne AS nh, (l.fpr * l.ne + h.fpr * h.ne) / (l.ne + h.ne) AS q FROM x l JOIN x h USING (treated, model, arm) WHERE l.g = 'Low' AND h.g = 'High'),
z AS (SELECT *, (low - high) / sqrt(q * (1 - q) * (1 / nl + 1 / nh)) AS z FROM y)
SELECT treated, model, arm, round_even(high - low, 6) AS weighted_gap, round_even(plain_gap, 6) AS plain_gap, round_even(z, 5) AS z, round_even({erf_sql('z')}, 5) AS p_value FROM z""")
def cem_directions(spark: SparkSession, d: str) -> DataFrame:
    """False-positive gaps High - Low with and without weights, either side treated."""
    labels, p = study.labelled_areas(spark, d), study.predictions(spark, d)
    parts = []
    for treated, control in (("High", "Low"), ("Low", "High")):
        w = balance.matched_weights(labels, "index_group", treated, control, "machinery_group").select("area", "index_group", "weight")
        parts.append(w.withColumn("treated", F.lit(treated)))
    rows = p.join(parts[0].unionByName(parts[1]), "area").withColumn("one", F.lit(1.0))
    keys = ["treated", "model", "arm"]
    plain = balance.weighted_fpr(rows, keys, "index_group", "one").select(*keys, R("gap_high_minus_low").alias("plain_gap"))
    out = balance.weighted_fpr(rows, keys, "index_group", "weight").join(plain, keys)
    return out.select(*keys, R("gap_high_minus_low").alias("weighted_gap"), "plain_gap", R("z", 5).alias("z"), R("p_value", 5).alias("p_value"))


@query()
def paired_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of each other arm on four gaps (High - Low), paired by fold."""
    folds = fairness.by_fold(study.labelled_predictions(spark, d), list(study.GROUPINGS), ["model", "arm"])
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_gap").alias("gap")) for m in ("tpr", "fpr", "ppr", "auc")])
    long = folds.select("grouping", "model", "arm", "fold", F.inline(parts))
    base = long.where(F.col("arm") == study.ARMS[0]).select("grouping", "model", "fold", "metric", F.col("gap").alias("base"))
    pairs = long.where(F.col("arm") != study.ARMS[0]).join(base, ["grouping", "model", "fold", "metric"]).withColumn("delta", F.col("gap") - F.col("base"))
    return models.paired_tests(pairs, ["grouping", "model", "arm", "metric"], "delta")


@query(f"""WITH {F_SQL}, q AS (SELECT s.id, f.fold, (CASE WHEN (s.id % 10) < 8 THEN 'test' ELSE 'val' END) AS part, s.is_default AS y, ((s.id * 7919) % 1000 + 50 * s.is_default) / 1100::DOUBLE AS p FROM s JOIN f ON s.month > f.train_cutoff AND s.month <= f.test_end),
v AS (SELECT p AS t, sum(y) AS pos, count(*) AS n FROM q WHERE part = 'val' GROUP BY 1),
c AS (SELECT t, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, sum(pos) OVER () AS n1, sum(n) OVER () - sum(pos) OVER () AS n0 FROM v WINDOW w AS (ORDER BY t DESC)),
b AS (SELECT t FROM c ORDER BY tp * n0 - fp * n1 DESC, t DESC LIMIT 1),
th AS (SELECT 'legacy_fixed' AS policy, unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS threshold UNION ALL SELECT 'validation_youden', t FROM b UNION ALL SELECT 'explicit', 0.55::DOUBLE)
SELECT policy, round_even(threshold, 9) AS threshold, count(*) AS n, count(*) FILTER (p >= threshold) AS n_hit FROM th, q WHERE part = 'test' GROUP BY 1, 2""")
def threshold_policies(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on the test part under each policy; Youden's threshold comes from the validation part alone."""
    rows = study.predictions(spark, d).where((F.col("arm") == study.ARMS[0]) & (F.col("model") == study.MODELS[0])).withColumn("part", F.when(F.col("id") % 10 < 8, "test").otherwise("val"))
    val, test = rows.where("part = 'val'"), rows.where("part = 'test'")
    named = [(p, t) for p in rankstats.POLICIES for t in rankstats.thresholds(p, val, explicit=0.55)]
    cells = test.crossJoin(F.broadcast(spark.createDataFrame(named, "policy string, threshold double")))  # a handful of thresholds
    return cells.groupBy("policy", R("threshold", 9).alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col("y_prob") >= F.col("threshold")).alias("n_hit"))

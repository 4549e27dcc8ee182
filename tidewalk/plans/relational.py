"""Queries for scans, features, folds, fitted statistics, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import fit, folds, ranks
from ..sources import tables
from . import study
from .study import A_SQL, F_SQL, L_SQL, S_SQL

R = X.rounded
day = lambda c: F.date_format(c, "yyyy-MM-dd")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- scans and profiles ---------------------------------------------------------------------------


@query("SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS n_large, round_even(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1")
def eda_fill_rate_by_year(spark: SparkSession, d: str) -> DataFrame:
    o = tables.scan(spark, d, "orders", "o_orderdate", "o_totalprice", "o_orderstatus")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"), R(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("rate"))


@query(f"""WITH {S_SQL}, x AS (SELECT CASE WHEN balance >= 0 THEN balance END AS balance, CASE WHEN is_default = 1 THEN segment END AS segment, nation FROM s)
SELECT 'balance' AS "column", round_even(avg((balance IS NULL)::INT), 6) AS null_fraction, count(DISTINCT balance) AS n_distinct FROM x
UNION ALL SELECT 'segment', round_even(avg((segment IS NULL)::INT), 6), count(DISTINCT segment) FROM x UNION ALL SELECT 'nation', round_even(avg((nation IS NULL)::INT), 6), count(DISTINCT nation) FROM x""")
def eda_null_fraction(spark: SparkSession, d: str) -> DataFrame:
    rows = study.loans(spark, d).withColumn("balance", X.not_negative("balance")).withColumn("segment", F.when(F.col("is_default") == 1, F.col("segment")))
    return fit.null_fractions(rows, ["balance", "segment", "nation"], distinct=True).withColumn("null_fraction", R("null_fraction"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1 ORDER BY n DESC, segment LIMIT 3")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    by = tables.scan(spark, d, "customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    by = by.withColumn("share", R(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1)))))  # a row for each value
    return by.orderBy(F.desc("n"), "segment").limit(3)


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM orders))::INT AS n_columns FROM orders")
def file_profile(spark: SparkSession, d: str) -> DataFrame:
    return tables.profile(tables.scan(spark, d, "orders"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS sum_k, round_even(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def event_json_agg(spark: SparkSession, d: str) -> DataFrame:
    e = tables.scan(spark, d, "events", "event_type", "value", "props").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), R(F.avg("value")).alias("mean_value"))


@query("SELECT key, count(*) AS n, max(length(value))::INT AS longest FROM (SELECT 'nation' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'name', c_name FROM customer) GROUP BY 1")
def manifest_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = tables.scan(spark, d, "customer", "c_name", "c_mktsegment")
    lines = c.select(F.explode(F.array(F.concat_ws(": ", F.lit("nation"), "c_mktsegment"), F.concat(F.lit("- name : "), "c_name"), F.lit("no pair"))).alias("line"))
    return tables.manifest_pairs(lines, "line").groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("longest"))


# --- row-wise features ----------------------------------------------------------------------------


@query(f"""WITH {S_SQL} SELECT id, strftime(month, '%Y-%m') AS issue_ym, is_default, substr(priority, 1, 1)::INT AS grade_ord, (segment = 'BUILDING')::INT AS is_building, round_even((amount + balance) / 2, 6) AS midpoint, area
FROM s WHERE segment IS DISTINCT FROM 'MACHINERY' AND year(issue_d) BETWEEN 1996 AND 2000""")
def raw_features(spark: SparkSession, d: str) -> DataFrame:
    rows = study.loans(spark, d).where(X.differs("segment", "MACHINERY") & F.col("issue_d").between("1996-01-01", "2000-12-31"))
    grade = X.ordinal("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return rows.select("id", X.month_label("issue_d").alias("issue_ym"), "is_default", grade.alias("grade_ord"), X.equals_flag("segment", "BUILDING").alias("is_building"), R((F.col("amount") + F.col("balance")) / 2).alias("midpoint"), "area")


@query(f"WITH {S_SQL}, m AS (SELECT min(year(month) * 12 + month(month)) AS m0 FROM s) SELECT id, strftime(month, '%Y-%m-%d') AS month_start, (year(month) * 12 + month(month) - m0)::INT AS month_idx FROM s, m")
def month_index(spark: SparkSession, d: str) -> DataFrame:
    rows = study.loans(spark, d)
    first = rows.agg(F.min(X.months_of("month")).alias("m0"))  # one row
    return rows.crossJoin(F.broadcast(first)).select("id", day("month").alias("month_start"), (X.months_of("month") - F.col("m0")).alias("month_idx"))


@query("""SELECT o_orderkey AS id, strftime(try_strptime(strftime(o_orderdate, '%b-%Y'), '%b-%Y'), '%Y-%m-%d') AS parsed,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE regexp_extract(o_orderpriority, '([0-9])', 1)::INT END AS level, nullif(regexp_extract('no digits', '([0-9]+)', 1), '') AS none FROM orders""")
def time_features(spark: SparkSession, d: str) -> DataFrame:
    o = tables.scan(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), day(X.parsed_month(F.date_format("o_orderdate", "MMM-yyyy"))).alias("parsed"), X.first_group(priority, "([0-9])").cast("int").alias("level"), X.first_group(F.lit("no digits"), "([0-9]+)").alias("none"))


@query(f"WITH {S_SQL} SELECT id, CASE WHEN balance > 0 THEN round_even(amount / balance, 6) END AS funded_ratio, CASE WHEN balance >= 0 THEN balance END AS balance FROM s")
def funded_ratio_guard(spark: SparkSession, d: str) -> DataFrame:
    return study.loans(spark, d).select("id", R(X.ratio("amount", "balance")).alias("funded_ratio"), X.not_negative("balance").alias("balance"))


@query(f"""WITH {S_SQL} SELECT id, CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS place, length(area)::INT AS width, substr(area, 1, 2) AS prefix, (segment IS NOT NULL AND trim(segment) <> '')::INT AS has_segment FROM s""")
def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    return study.loans(spark, d).select("id", X.ordinal("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("place"), F.length("area").alias("width"), F.substring("area", 1, 2).alias("prefix"), X.has_text("segment").alias("has_segment"))


@query(f"""WITH {S_SQL}, e AS (SELECT min(issue_d) AS e, area FROM s GROUP BY area), x AS (SELECT id, (year(issue_d) * 12 + month(issue_d)) - (year(e) * 12 + month(e)) - 2 AS m FROM s JOIN e USING (area))
SELECT id, CASE WHEN m >= 0 THEN m END::INT AS history FROM x""")
def credit_history_months(spark: SparkSession, d: str) -> DataFrame:
    rows = study.loans(spark, d)
    first = rows.groupBy("area").agg(F.add_months(F.min("issue_d"), 2).alias("earliest"))
    return rows.join(first, "area").select("id", X.months_between("issue_d", "earliest").alias("history"))


@query(f"WITH {S_SQL} SELECT id, round_even(ln(q / (1 - q)), 6) AS logit, (q >= 0.5::DOUBLE)::INT AS hit FROM (SELECT id, least(greatest((id % 11) / 10::DOUBLE, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM s)")
def logit_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = study.loans(spark, d).withColumn("q", (F.col("id") % 11) / F.lit(10.0))
    return rows.select("id", R(X.logit("q")).alias("logit"), (F.col("q") >= 0.5).cast("int").alias("hit"))


# --- folds ----------------------------------------------------------------------------------------


@query(f"WITH {F_SQL} SELECT fold, strftime(train_cutoff, '%Y-%m') AS train_cutoff, strftime(test_end, '%Y-%m') AS test_end, n_train, n_test, n_test_events FROM f")
def folds_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    f = study.fold_table(spark, d)
    return f.select("fold", X.month_label("train_cutoff").alias("train_cutoff"), X.month_label("test_end").alias("test_end"), "n_train", "n_test", "n_test_events")


@query(f"WITH {F_SQL} SELECT fold, CASE WHEN month <= train_cutoff THEN 'train' ELSE 'test' END AS side, count(*) AS n, sum(is_default)::BIGINT AS n_default FROM s JOIN f ON month <= test_end GROUP BY 1, 2")
def fold_membership_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.membership(study.loans(spark, d), study.fold_table(spark, d), "month")
    return rows.groupBy("fold", "side").agg(F.count("*").alias("n"), F.sum("is_default").alias("n_default"))


@query(f"""WITH {F_SQL}, x AS (SELECT fold, n_train, n_test, count(*) FILTER (month <= train_cutoff) AS a, count(*) FILTER (month > train_cutoff) AS b FROM s JOIN f ON month <= test_end GROUP BY ALL),
t AS (SELECT id FROM s JOIN f ON month > train_cutoff AND month <= test_end GROUP BY id HAVING count(*) > 1)
SELECT count(*) AS n_folds, count(*) FILTER (a <> n_train OR b <> n_test) AS wrong_sizes, (SELECT count(*) FROM f WHERE test_end <= train_cutoff) AS wrong_order, (SELECT count(*) FROM t) AS rows_in_several_tests FROM x""")
def fold_integrity(spark: SparkSession, d: str) -> DataFrame:
    return folds.integrity(study.loans(spark, d), study.fold_table(spark, d), "month", "id")


@query(f"""WITH {F_SQL}, x AS (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY issue_d, id) AS r, count(*) OVER (PARTITION BY fold) AS n FROM s JOIN f ON month <= train_cutoff)
SELECT fold, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'sub' ELSE 'val' END AS part, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM x GROUP BY 1, 2""")
def inner_split(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.membership(study.loans(spark, d), study.fold_table(spark, d), "month").where("side = 'train'")
    return folds.inner_split(rows, "fold", ["issue_d", "id"]).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {S_SQL} SELECT strftime(month, '%Y-%m') AS month, count(*) AS n FROM s WHERE month IN (SELECT DISTINCT month FROM s ORDER BY month LIMIT 8) GROUP BY 1")
def initial_window(spark: SparkSession, d: str) -> DataFrame:
    return folds.first_periods(study.loans(spark, d), "month", 8).groupBy(X.month_label("month").alias("month")).agg(F.count("*").alias("n"))


# --- fitted on the training side -------------------------------------------------------------------

T_SQL = f"{F_SQL}, t AS (SELECT s.*, amount * 2 + (id % 3) AS twin, CASE WHEN id % 5 = 0 THEN balance END AS sparse FROM s WHERE month <= (SELECT max(train_cutoff) FROM f WHERE fold = 3))"


def _train(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training rows of fold 3, and all rows."""
    rows = study.loans(spark, d).withColumn("twin", F.col("amount") * 2 + F.col("id") % 3).withColumn("sparse", F.when(F.col("id") % 5 == 0, F.col("balance")))
    cut = study.fold_table(spark, d).where("fold = 3").agg(F.max("train_cutoff").alias("cut"))  # one row
    marked = rows.crossJoin(F.broadcast(cut))
    return marked.where("month <= cut").drop("cut"), rows


@query(f"WITH {T_SQL} SELECT 'sparse' AS \"column\", round_even(avg((sparse IS NULL)::INT), 6) AS null_fraction, avg((sparse IS NULL)::INT) > 0.7 AS dropped FROM t UNION ALL SELECT 'amount', round_even(avg((amount IS NULL)::INT), 6), avg((amount IS NULL)::INT) > 0.7 FROM t")
def missing_filter(spark: SparkSession, d: str) -> DataFrame:
    out = fit.null_fractions(_train(spark, d)[0], ["sparse", "amount"])
    return out.select("column", R("null_fraction").alias("null_fraction"), (F.col("null_fraction") > 0.7).alias("dropped"))


@query(f"WITH {T_SQL} SELECT 'amount' AS a, 'balance' AS b, round_even(corr(amount, balance), 6) AS r FROM t UNION ALL SELECT 'amount', 'twin', round_even(corr(amount, twin), 6) FROM t UNION ALL SELECT 'balance', 'twin', round_even(corr(balance, twin), 6) FROM t")
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fit.correlations(_train(spark, d)[0], ["amount", "balance", "twin"]).withColumn("r", R("r"))


_COLUMNS = ("amount", "balance", "twin", "sparse")
_PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, avg(({a} IS NULL)::INT) AS na, avg(({b} IS NULL)::INT) AS nb FROM t" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :])


@query(f'WITH {T_SQL}, pr AS ({_PAIRS_SQL}) SELECT DISTINCT CASE WHEN na > nb THEN a WHEN nb > na THEN b ELSE greatest(a, b) END AS "column" FROM pr WHERE abs(r) > 0.95::DOUBLE')
def corr_drop_list(spark: SparkSession, d: str) -> DataFrame:
    # twin follows amount and has the later name; sparse equals balance where it is known, and has more nulls
    return fit.correlated_columns(_train(spark, d)[0], list(_COLUMNS))


@query(f"""WITH {T_SQL} SELECT 'amount' AS "column", round_even(quantile_cont(amount, 0.995::DOUBLE), 4) AS cap, true AS applied FROM t UNION ALL SELECT 'balance', round_even(quantile_cont(balance, 0.995::DOUBLE), 4), min(balance) >= 0 FROM t""")
def clip_caps(spark: SparkSession, d: str) -> DataFrame:
    return fit.clip_report(_train(spark, d)[0], ["amount", "balance"]).withColumn("cap", R("cap", 4))


@query(f"WITH {T_SQL}, c AS (SELECT quantile_cont(amount, 0.995::DOUBLE) AS cap FROM t) SELECT id, round_even(ln(1 + CASE WHEN id % 9 <> 0 THEN least(amount, cap) END), 6) AS amount_log FROM s, c")
def clip_log1p(spark: SparkSession, d: str) -> DataFrame:
    train, rows = _train(spark, d)
    caps = fit.caps(train, ["amount"]).withColumnRenamed("amount", "cap")
    known = F.when(F.col("id") % 9 != 0, F.col("amount"))
    return rows.crossJoin(F.broadcast(caps)).select("id", R(F.log1p(X.clipped(known, high=F.col("cap")))).alias("amount_log"))


@query(f"""WITH {T_SQL} SELECT id, (segment = 'BUILDING')::INT AS segment_BUILDING, (segment = 'FURNITURE')::INT AS segment_FURNITURE, (segment = 'HOUSEHOLD')::INT AS segment_HOUSEHOLD FROM s""")
def onehot_train(spark: SparkSession, d: str) -> DataFrame:
    train, rows = _train(spark, d)
    # MACHINERY is kept out of training, so later rows of it are unknown: all zeros
    known = [r["segment"] for r in train.where("segment <> 'MACHINERY'").select("segment").distinct().collect()]
    return fit.one_hot(rows, "segment", known).select("id", *[f"segment_{v}" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD")])


@query(f"WITH {T_SQL}, m AS (SELECT avg(coalesce(sparse, 0)) AS m, stddev_pop(coalesce(sparse, 0)) AS sd FROM t) SELECT id, round_even((coalesce(CASE WHEN id % 5 = 0 THEN balance END, 0) - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM s, m")
def standardize_train(spark: SparkSession, d: str) -> DataFrame:
    train, rows = _train(spark, d)
    filled = F.coalesce("sparse", F.lit(0.0))
    stats = train.agg(F.avg(filled).alias("m"), F.stddev_pop(filled).alias("sd"))
    return rows.crossJoin(F.broadcast(stats)).select("id", R((filled - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))


@query(f"WITH {A_SQL}, x AS (SELECT area, CASE WHEN n % 3 <> 0 THEN mean_balance END AS b FROM a) SELECT area, round_even(coalesce(b, (SELECT quantile_cont(b, 0.5::DOUBLE) FROM x)), 6) AS b FROM x")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = study.areas(spark, d).select("area", F.when(F.col("n") % 3 != 0, F.col("mean_balance")).alias("b"))
    return fit.median_filled(rows, ["b"]).withColumn("b", R("b"))


@query(f"""WITH {S_SQL} SELECT count(*) AS n, count(*) - count(DISTINCT id) AS n_repeated, 0::BIGINT AS n_null, count(*) FILTER (amount / 100000 > 1 OR amount < 0) AS n_outside FROM s""")
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    return fit.quality_checks(study.loans(spark, d).withColumn("share", F.col("amount") / 100000), "id", ["id", "segment"], ["share"])


@query(f"WITH {S_SQL} SELECT segment AS value, count(*) AS n FROM s WHERE segment NOT IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def unexpected_values(spark: SparkSession, d: str) -> DataFrame:
    return fit.unexpected(study.loans(spark, d), "segment", ["BUILDING", "FURNITURE"])


@query()
def mi_topk(spark: SparkSession, d: str) -> DataFrame:
    return fit.binned_information(study.loans(spark, d), ["amount", "balance", "nation"], "is_default", top=2)


def psi_sql(n: str) -> str:
    x = f"({n} + 10)::DOUBLE"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * pow({x}, 2)) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)) - {' - '.join(f'1 / ({n} + {i})::DOUBLE' for i in range(10))})"


#: Every row with the distances to three rows of its class on either side, and by running counts how many rows lie nearer than the third.
MI_SQL = f"""{S_SQL}, l AS (SELECT y, c, v FROM (SELECT is_default AS y, unnest([{{'c': 'amount', 'v': amount}}, {{'c': 'balance', 'v': balance}}, {{'c': 'nation', 'v': nation::DOUBLE}}], recursive := true) FROM s)),
cl AS (SELECT c, y, count(*) AS ny FROM l GROUP BY ALL HAVING ny > 1), k AS (SELECT l.*, ny FROM l JOIN cl USING (c, y)),
d AS (SELECT c, y, v, ny, list_sort(list_filter([v - lag(v, 1) OVER w, v - lag(v, 2) OVER w, v - lag(v, 3) OVER w, lead(v, 1) OVER w - v, lead(v, 2) OVER w - v, lead(v, 3) OVER w - v], lambda x: x IS NOT NULL))[least(3, ny - 1)] AS r FROM k WINDOW w AS (PARTITION BY c, y ORDER BY v)),
cum AS (SELECT c, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY c ORDER BY v) AS upto FROM k GROUP BY c, v), own AS (SELECT c, y, v, count(*) AS n FROM k GROUP BY ALL),
e AS (SELECT d.*, own.n AS n_own, cum.n AS n_here, v + r AS hi, v - r AS lo FROM d JOIN own USING (c, y, v) JOIN cum USING (c, v)),
h AS (SELECT e.*, coalesce(cum.upto, 0) AS below FROM e ASOF LEFT JOIN cum ON e.c = cum.c AND e.hi > cum.v), g AS (SELECT h.*, coalesce(cum.upto, 0) AS under FROM h ASOF LEFT JOIN cum ON h.c = cum.c AND h.lo >= cum.v),
m AS (SELECT c, ny, CASE WHEN r = 0 THEN n_own ELSE least(3, ny - 1) END AS used, CASE WHEN r = 0 THEN n_here ELSE (below - under)::BIGINT END AS nearer FROM g)"""


@query(f"""WITH {MI_SQL} SELECT c AS "column", round_even(greatest(0, {psi_sql('count(*)')} + avg({psi_sql('used')} - {psi_sql('ny')} - {psi_sql('nearer')})), 6) AS information FROM m GROUP BY c""")
def mi_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of the numbers of all loans with their outcome, by three nearest neighbours."""
    return ranks.neighbour_information(study.loans(spark, d), ["amount", "balance", "nation"], "is_default").withColumn("information", R("information"))


# --- joins, sets, reshaping -----------------------------------------------------------------------


@query(f"""WITH {L_SQL}, k AS (SELECT * FROM al WHERE n % 4 <> 0) SELECT count(*) AS n, count(k.area) AS n_matched, round_even(count(k.area) / count(*)::DOUBLE, 6) AS coverage, count(DISTINCT CASE WHEN k.area IS NULL THEN s.area END) AS areas_missing FROM s LEFT JOIN k USING (area)""")
def label_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    labels = study.labelled_areas(spark, d).where("n % 4 <> 0").select("area", "index_group")
    rows = study.loans(spark, d).join(labels, "area", "left")
    hit = F.col("index_group").isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_matched"), R(F.avg(hit.cast("double"))).alias("coverage"), F.count_distinct(F.when(~hit, F.col("area"))).alias("areas_missing"))


@query(f"WITH {A_SQL} SELECT DISTINCT area FROM s WHERE area NOT IN (SELECT area FROM a WHERE n % 4 <> 0)")
def anti_join_unmatched(spark: SparkSession, d: str) -> DataFrame:
    known = study.areas(spark, d).where("n % 4 <> 0")
    return study.loans(spark, d).join(known, "area", "left_anti").select("area").distinct()


@query(f"WITH {A_SQL} SELECT coalesce(x.area, y.area) AS area, x.n AS n, CASE WHEN y.mean_balance >= 0 THEN y.mean_balance END AS mean_balance FROM (SELECT * FROM a WHERE n % 3 <> 0) x FULL JOIN (SELECT * FROM a WHERE n % 5 <> 0) y ON x.area = y.area")
def outer_merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    a = study.areas(spark, d)
    return tables.merged_chunks([a.where("n % 3 <> 0").select("area", "n"), a.where("n % 5 <> 0").select("area", "mean_balance")], "area")


@query("SELECT nationkey, bool_or(c) AS has_customer, bool_or(s) AS has_supplier FROM (SELECT c_nationkey AS nationkey, true AS c, false AS s FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, false, true FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    c = tables.scan(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    s = tables.scan(spark, d, "supplier", "s_nationkey", "s_acctbal").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    yes, no = F.lit(True), F.lit(False)
    parts = [c.subtract(s).select("nationkey", yes.alias("has_customer"), no.alias("has_supplier")), s.subtract(c).select("nationkey", no.alias("has_customer"), yes.alias("has_supplier")), c.intersect(s).select("nationkey", yes.alias("has_customer"), yes.alias("has_supplier"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_custkey AS custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = tables.scan(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("r", F.row_number().over(w)).where("r = 1")
    return o.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("first_order"))


@query("SELECT p_brand AS brand, p_partkey AS partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 5")
def stratified_sample_md5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.md5(F.concat(F.lit("42:"), F.col("p_partkey").cast("string"))), "p_partkey")
    p = tables.scan(spark, d, "part", "p_partkey", "p_brand").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"))


@query("SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_quantity, sum(l_quantity) FILTER (l_linestatus = 'F') AS filled_quantity FROM lineitem GROUP BY 1")
def pivot_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.scan(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    out = rows.groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return out.select("flag", F.col("O").alias("open_quantity"), F.col("F").alias("filled_quantity"))


@query(f"""WITH {S_SQL} SELECT area, round_even(sum(CASE WHEN amount > 0 AND balance > 0 THEN balance * amount END) / sum(CASE WHEN amount > 0 AND balance > 0 THEN amount END), 6) AS balance FROM s GROUP BY 1""")
def zip_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import balance as B

    return B.weighted_means(study.loans(spark, d), "area", "amount", ["balance"]).withColumn("balance", R("balance"))


@query(f"""WITH {A_SQL} SELECT area, CASE WHEN n - 150 > 0 THEN round_even(mean_balance / (n - 150), 6) END AS ratio, CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN coalesce(CASE WHEN n % 2 = 0 THEN n END, 0) + coalesce(CASE WHEN n % 3 = 0 THEN n END, 0) END::DOUBLE AS total FROM a""")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    two, three = F.when(F.col("n") % 2 == 0, F.col("n")), F.when(F.col("n") % 3 == 0, F.col("n"))
    return study.areas(spark, d).select("area", R(X.ratio("mean_balance", F.col("n") - 150)).alias("ratio"), X.row_sum(two, three).alias("total"))


@query("SELECT 'acctbal' AS name, count(*) AS n, round_even(avg(c_acctbal), 6) AS mean, round_even(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS low, round_even(quantile_cont(c_acctbal, 0.5::DOUBLE), 6) AS mid, max(c_acctbal) AS high FROM customer")
def describe_column(spark: SparkSession, d: str) -> DataFrame:
    c = tables.scan(spark, d, "customer", "c_acctbal")
    return c.agg(F.lit("acctbal").alias("name"), F.count("*").alias("n"), R(F.avg("c_acctbal")).alias("mean"), R(F.stddev_samp("c_acctbal")).alias("sd"), F.min("c_acctbal").alias("low"), R(F.percentile("c_acctbal", 0.5)).alias("mid"), F.max("c_acctbal").alias("high"))


@query(f"""WITH {S_SQL}, x AS (SELECT segment, priority, count(*) AS n FROM s GROUP BY 1, 2) SELECT segment, priority AS mode, n FROM x QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, priority) = 1""")
def mode_params(spark: SparkSession, d: str) -> DataFrame:
    by = study.loans(spark, d).groupBy("segment", "priority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("segment").orderBy(F.desc("n"), "priority")
    return by.withColumn("r", F.row_number().over(w)).where("r = 1").select("segment", F.col("priority").alias("mode"), "n")

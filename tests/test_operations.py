"""Sources behind calls, joins that must hold, settings and stages, small functions: rules that SQL on the tables doesn't show."""

import os
import time

import numpy as np
import pytest
from compare import sql_rows
from pyspark.sql import functions as F

from tidewalk.functions import exprs as X
from tidewalk.functions import texts as T
from tidewalk.operators import checks, rankstats, runner
from tidewalk.plans import catalogue, operations
from tidewalk.sources import feeds, tables

TABLES = "/root/testdata/sf0.01"


def test_joins_raise_where_a_rule_is_broken(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    twice = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string")
    less = twice.where("b = 'p'")
    with pytest.raises(checks.Violation):
        checks.one_to_one(a, twice, "k")
    with pytest.raises(checks.Violation):
        checks.left_one_to_one(a, less, "k", "b")
    with pytest.raises(checks.Violation):
        checks.lookup(a.select("k"), less, "k")
    with pytest.raises(checks.Violation):
        checks.domain(a, "a", ["x"])
    assert checks.domain(a, "a", ["x", "y"]).count() == checks.lookup(a.select("k"), twice.where("b <> 'q'"), "k").count() == 2
    assert checks.one_to_one(a, twice.where("b <> 'q'"), "k").count() == 2
    got = {r["k"]: r["b"] for r in checks.reindexed(a.select("k"), less, "k", {"b": "-"}).collect()}
    assert got == {1: "p", 2: "-"}


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, None, 2, 3)], "id int, m int, __h int, Extra int")
    assert checks.sentinel(df, ["m", "none"]).first()["m"] == 999
    assert checks.without(df, "EXTRA", "unknown").columns == ["id", "m", "__h"]
    assert checks.reordered(df, ["m"]).columns == ["m", "id", "Extra"]
    assert checks.column_union(["b", "a"], ["c", "a"]) == ["a", "b", "c"]
    assert tables.resolve(df, "EXTRA") == "Extra"
    with pytest.raises(KeyError):
        tables.resolve(df, "nothing")


def test_waiting_for_a_busy_source():
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 4:
            raise feeds.Busy
        return x

    assert feeds.patiently(call, 7, wait=waits.append) == 7 and waits == [1.0, 2.0, 4.0]
    with pytest.raises(feeds.Busy):
        feeds.patiently(lambda: (_ for _ in ()).throw(feeds.Busy()), attempts=7, wait=waits.append)
    assert waits[3:] == [1.0, 2.0, 4.0, 8.0, 16.0, 30.0]
    with pytest.raises(KeyError):  # no second attempt
        feeds.patiently({}.__getitem__, 1, wait=lambda s: pytest.fail("waited"))
    assert [len(c) for c in feeds.chunks(list(range(95)))] == [40, 40, 15]


def test_fetched_joins_chunks_and_renames(spark):
    wide = spark.createDataFrame([("a", 1, -2.0, 3.0), ("b", 4, 5.0, None)], "k string, x int, y double, z double")
    out = feeds.fetched(spark, lambda names: wide.select("k", *names), ["x", "y", "z"], "k", {"x": "first"}, size=2)
    assert sorted(map(tuple, out.collect())) == [("a", 1, None, 3.0), ("b", 4, 5.0, None)] and out.columns == ["k", "first", "y", "z"]


def encoder():
    """Token vectors (length, 1), (5, 3), then zeros; the mask names the first token, and many more of a long text."""

    def encode(some):
        assert all(some)  # empty texts stay away
        return [[[float(len(t)), 1.0], [5.0, 3.0]] + [[2.0, 0.0]] * (300 if len(t) > 50 else 0) for t in some], [[1, 0] + [1] * (300 if len(t) > 50 else 0) for t in some]

    return encode


def test_embedded_texts(spark):
    encode = encoder()
    rows = spark.createDataFrame([(i, "x" * (i % 3)) for i in range(7)] + [(7, None), (8, "y" * 60)], "id int, text string")
    got = {r["id"]: (r["first"], r["mean"], r["n_tokens"], r["has_text"]) for r in feeds.embedded(rows, "id", "text", encode, 2, size=2).collect()}
    assert got[1] == ([1.0, 1.0], [1.0, 1.0], 1, True) and got[0] == got[3] == got[7] == ([0.0, 0.0], [0.0, 0.0], 0, False) and len(got) == 9
    assert got[8][2] == 255 and got[8][1] == pytest.approx([(60 + 2 * 254) / 255, 1 / 255])  # 256 tokens, one of which the mask leaves out
    assert feeds.embedded(rows.where("text = ''"), "id", "text", encode, 2).count() == 3


def test_embeddings_go_on_where_they_stopped(spark, tmp_path):
    rows, path, calls = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(60)], "id int, text string"), str(tmp_path / "e"), str(tmp_path / "calls")

    encode = encoder()

    def stops(some):
        if any(len(t) == 4 for t in some) and not __import__("os").path.exists(calls):
            raise RuntimeError("stopped")
        return encode(some)

    with pytest.raises(Exception, match="stopped"):
        feeds.embedded_parts(rows.where("id % 5 < 4 or id = 59"), "id", "text", stops, 2, path, parts=6, size=1)
    from tidewalk.sources import connectors

    done = connectors.marks(spark, path)
    assert 0 < len(done) < 6
    open(calls, "w").close()
    whole = feeds.embedded_parts(rows.where("id % 5 < 4 or id = 59"), "id", "text", stops, 2, path, parts=6, size=1)
    assert whole.count() == whole.select("id").distinct().count() == 49 and connectors.marks(spark, path) == {str(i) for i in range(6)}
    with pytest.raises(ValueError, match="key"):
        feeds.embedded_parts(rows.unionAll(rows), "id", "text", encode, 2, str(tmp_path / "other"))


def test_references_are_resolved_as_python_does(spark):
    import html

    texts = ["&eacute;&#8217;&apos;&amp;lt;", "&notin; &notit; &am &amp no", "&#x41;&#0;&#xD800;", "plain", "", "&lt;br&gt;", "a &nbsp; b < BR / > c<br>d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["u"] for r in df.select(T.unescaped("t").alias("u")).collect()] == [html.unescape(t) for t in texts]
    assert [r["n"] for r in df.select(T.natural("t").alias("n")).collect()][-2:] == ["", "a b c d"]


def test_lemmas_by_rules(spark):
    verbs, nouns = ["be", "pay", "carry", "make", "stop", "bus", "lend", "go"], ["loan", "debt", "bus", "city", "knife", "box", "woman", "pay", "make"]
    said = {"paying": "pay", "carries": "carry", "making": "make", "makes": "make", "loans": "loan", "cities": "city", "boxes": "box", "women": "woman", "went": "go", "unknowns": "unknowns", "busses": "busses", "bus": "bus", "debt": "debt", "lended": "lend", "s": "s"}
    df = spark.createDataFrame([(list(said),)], "w array<string>")
    got = df.select(T.lemmas_by_rules(F.col("w"), verbs, nouns, ({"went": "go"}, {})).alias("l")).first()["l"]
    assert dict(zip(said, got, strict=True)) == said
    assert df.select(T.lemmas_by_rules(F.col("w"), [], []).alias("l")).first()["l"] == list(said)


def test_command_line_goes_on(spark, tmp_path):
    from tidewalk import __main__ as command

    where = ["tables=/root/testdata/sf0.001", f"out={tmp_path}", "arms=structured"]
    first = command.main([*where, "folds=1,2"])
    assert command.main([*where, "folds=1,2"]) == first
    assert command.main(where) > first
    with pytest.raises(SystemExit):
        command.main(["arms=structured"])


def test_settings():
    s = runner.Settings.parsed(["folds=1,2", "restart", "limit=5", "models=Forest,Logistic", "suffix=_a", "parallel=2"])
    assert (s.folds, s.restart, s.limit, s.models, s.suffix, s.parallel) == ((1, 2), True, 5, ("Forest", "Logistic"), "_a", 2)
    with pytest.raises(ValueError):
        runner.Settings.parsed(["fold=1"])


def test_a_stopped_run_is_taken_up(spark, tmp_path):
    seen = []

    def stage(name, fails=False):
        def made(s, settings, before):
            seen.append(name)
            if fails:
                raise RuntimeError(name)
            return s.range(len(before) + 1)

        return made

    with pytest.raises(RuntimeError):
        runner.run(spark, [("one", stage("one")), ("two", stage("two", True))], runner.Settings(), str(tmp_path))
    log = runner.run(spark, [("one", stage("one")), ("two", stage("two"))], runner.Settings(), str(tmp_path)).orderBy("place").collect()
    assert seen == ["one", "two", "two"] and [(r["n_rows"], r["taken_up"]) for r in log] == [(1, True), (2, False)]
    runner.run(spark, [("one", stage("one"))], runner.Settings(restart=True), str(tmp_path))
    assert seen[-1] == "one"


def test_files(spark, tmp_path):
    for i, name in enumerate(("b.txt", "a.txt")):
        (tmp_path / name).write_text("x\ny\n" * (i + 1))
        os.utime(tmp_path / name, (time.time() + 100 * i,) * 2)
    assert tables.newest(spark, f"{tmp_path}/*.txt").endswith("a.txt")
    with pytest.raises(FileNotFoundError):
        tables.newest(spark, f"{tmp_path}/*.csv")
    assert tuple(tables.text_profile(spark, f"{tmp_path}/*.txt").first()) == (2, 12, 6)
    (tmp_path / "t.csv").write_text("k,v\n1,NaN\n2,2.5\n")
    assert [r["v"] for r in tables.scan_csv(spark, str(tmp_path / "t.csv"), "k int, v double", ["v"]).collect()] == [None, 2.5]
    assert tables.markdown(spark.createDataFrame([(1, 0.25, None)], "a int, b double, c string")) == "| a | b | c |\n|-|-|-|\n| 1 | 0.25 |  |"


def test_wide_headers(spark):
    lines = spark.createDataFrame([(0, ",auc,,n"), (1, ",mean,std,"), (2, "lr,0.5,0.1,7"), (3, "rf,0.6,,8")], "i int, line string")
    got = {(r["row"], r["measure"], r["statistic"]): r["value"] for r in tables.wide_summary(lines, "line", "i").collect()}
    assert got == {("lr", "auc", "mean"): 0.5, ("lr", "auc", "std"): 0.1, ("lr", "n", ""): 7.0, ("rf", "auc", "mean"): 0.6, ("rf", "auc", "std"): None, ("rf", "n", ""): 8.0}


def test_untidy_values(spark):
    df = spark.createDataFrame([("  Ab ", " 7 ", "10+ years", "31-12-2010"), ("", "x", "n/a", "2010-13-01"), (None, None, None, None)], "s string, n string, y string, d string")
    out = df.select(X.plain("s").alias("s"), X.numeric("n").alias("n"), X.years_employed("y").alias("y"), X.parsed_day("d").alias("d")).collect()
    assert [r["s"] for r in out] == ["ab", "", None] and [r["n"] for r in out] == [7.0, None, None] and [r["y"] for r in out] == [10, None, None]
    assert str(out[0]["d"]) == "2010-12-31" and out[1]["d"] is None


def test_policies_need_what_they_use(spark):
    for policy in ("validation_youden", "explicit", "other"):
        with pytest.raises(ValueError):
            rankstats.thresholds(policy)
    assert rankstats.thresholds("legacy_fixed") == [0.5, 0.6, 0.7]


def test_first_component_follows_the_index(spark):
    rows = catalogue.QUERIES["pc1_index"](spark, TABLES).toPandas()
    assert np.corrcoef(rows["pc1_index"], rows["disadvantage"])[0, 1] > 0
    columns, got = sql_rows(f"WITH {operations.A7_SQL} SELECT area, {', '.join(operations.WORSE + operations.BETTER)} FROM a7", TABLES)
    names = sorted(operations.WORSE + operations.BETTER)
    table = {r[columns.index("area")]: [r[columns.index(c)] for c in names] for r in got}
    x = np.array([table[a] for a in rows["area"]])
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = u[:, 0] * s[0]
    assert np.abs(np.abs(rows["pc1_index"].to_numpy()) - np.abs(want)).max() < 1e-5


def test_paired_effects_equal_the_pairs(spark):
    rows = catalogue.QUERIES["paired_effects"](spark, TABLES).collect()
    assert len({(r["arm"], r["metric"]) for r in rows}) == 4 * (len({r["arm"] for r in rows}))
    assert all(r["n_folds"] >= 3 and r["ci_lo"] <= r["mean_delta"] <= r["ci_hi"] for r in rows if r["ci_lo"] is not None)

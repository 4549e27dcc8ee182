"""What keeps queries small on large tables: words counted where texts are, draws by table, fits in as many tasks as cores."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewalk.operators import corpus, models, rankstats, vocabulary

TEXTS = [(1, "Red fox, red FOX; the dog"), (2, None), (3, ""), (4, "ab"), (5, "fox"), (6, "fox"), (7, "dog the fox dogé9dog"), (8, "x" * 50 + " fox")]


def _brute(text: str | None, stop: tuple[str, ...], bigrams: bool) -> Counter:
    words = [w for w in re.findall("[a-zA-Z]{3,}", text or "") if w not in stop]
    return Counter(words + ([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] if bigrams else []))


def test_words_are_counted_in_slices_without_a_shuffle_of_texts(spark, monkeypatch):
    rows = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    for bigrams in (False, True):
        want = {(i, w, n) for i, t in TEXTS for w, n in _brute(t, ("the",), bigrams).items()}
        assert {tuple(r) for r in vocabulary.counted(rows, "id", "text", ("the",), bigrams).collect()} == want
        df = Counter(w for _, w, _ in want)
        assert {r["term"]: r["df"] for r in vocabulary.frequencies(rows, "text", ("the",), bigrams).collect()} == dict(df)
    plan = vocabulary.counted(rows, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # slices of one text each give the same
    monkeypatch.setattr(vocabulary, "AT_ONCE", 1)
    got = [tuple(r) for r in vocabulary.counted(rows, "id", "text", ("the",)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_weights_by_a_broadcast_vocabulary_equal_the_joined_ones(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    t = corpus.terms(rows, "id", "text", bigrams=False)
    idf = corpus.idf(t, 8, 1)
    joined = {(r["id"], r["term"]): (r["tf"], round(r["tfidf"], 9)) for r in corpus.tfidf(t, idf, "id").collect()}
    words = vocabulary.known(idf)
    found = vocabulary.weighted(rows, "id", "text", words)
    assert {(r["id"], r["term"]): (r["tf"], round(r["tfidf"], 9)) for r in vocabulary.named(found, words, "id").collect()} == joined
    for r in vocabulary.with_terms(found, words).collect():
        assert r["terms"] == sorted(r["terms"]) and {(r["id"], x) for x in r["terms"]} == {k for k in joined if k[0] == r["id"]}


def test_repeated_ids_count_as_one(spark):
    rows = spark.createDataFrame([(1, "fox dog"), (1, "fox")], "id long, text string")
    assert not vocabulary.unique(rows, "id")
    assert {tuple(r) for r in corpus.terms(rows, "id", "text", bigrams=False).collect()} == {(1, "fox", 2), (1, "dog", 1)}


def test_draws_by_table_equal_the_search():
    steps = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120)])
    x = np.random.default_rng(5).integers(0, 2**64, 200_000, dtype=np.uint64)
    edges = (steps * 2.0**53).astype(np.uint64) << np.uint64(11)
    x = np.concatenate([x, edges, edges - np.uint64(1 << 11), edges + np.uint64(1 << 11), [np.uint64(0), np.uint64(2**64 - 1)]])
    want = np.searchsorted(steps, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
    assert (rankstats.drawn(x, steps, rankstats.cells(steps)) == want).all()


def test_fits_take_as_many_tasks_as_cores(spark, monkeypatch):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x")).repartition(60, "id")
    seen, kind = [], models.estimator

    def spied(*args, **kwargs):
        made = kind(*args, **kwargs)
        fit = made.fit
        made.fit = lambda ready: (seen.append(ready.rdd.getNumPartitions()), fit(ready))[1]
        return made

    monkeypatch.setattr(models, "estimator", spied)
    models.fit_score(rows, rows, "Logistic", ["x"], "y")
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism


def test_parts_of_values_are_found_in_steps(spark):
    """More edges than a step, repeated ones too, give each value the part that a plain count gives; keys' values are not dealt by key."""
    import numpy as np

    from tidewalk.operators import quantiles

    rng = np.random.default_rng(3)
    edges = {0: sorted(rng.integers(0, 500, 1000).tolist()), 1: list(range(64)), 2: [7] * 130, 3: []}
    found = quantiles.stepped(spark.createDataFrame([(k, [float(e) for e in v]) for k, v in edges.items()], "k int, e array<double>"), "e")
    rows = spark.createDataFrame([(k, v / 2) for k in edges for v in range(-4, 1010, 3)], "k int, __v double")
    for most in (quantiles.MOST_EDGES, 0):
        old, quantiles.MOST_EDGES = quantiles.MOST_EDGES, most
        try:
            joined = quantiles.with_edges(rows, found, ["k"], 1000)
        finally:
            quantiles.MOST_EDGES = old
        got = quantiles.parted(joined, "__v", "e", "part").collect()
        assert len(got) == rows.count() and all(r["part"] == sum(e <= r["__v"] for e in edges[r["k"]]) for r in got)
        assert ("BroadcastHashJoin" if most else "__salt") in joined._jdf.queryExecution().executedPlan().toString()

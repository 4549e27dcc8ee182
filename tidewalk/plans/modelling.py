"""Queries that fit models; they have no SQL, so tests hold them against invariants."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import arms, blocks, boosting, corpus, decomposition, fairness, fit, forests, models, rankstats, runner, vocabulary, walks
from ..sources import connectors, tables
from . import study, textual

R = X.rounded
QUERIES, ORACLES = {}, {}
NEVER = {"id", "is_default", "nation_flag"}
PREPARE = {"never": NEVER, "logged": ["amount", "balance"], "encoded": ["segment", "priority"]}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _features(spark: SparkSession, d: str) -> DataFrame:
    return study.loans(spark, d).withColumn("balance", X.not_negative("balance")).drop("area", "issue_d")


#: Trees of importance_by_model's models; the operators take any number.
TREES = 20
DAY = "unix_date"


def walk_blocks(rows: DataFrame, period: str, y: str, never: set[str], encoded: list[str], doc: str = "", texts: arms.Texts | None = None) -> tuple[blocks.Blocks, list[str]]:
    """A study's rows as blocks, and its terms in order of their numbers. With texts, rows name their document in the column doc."""
    spark = rows.sparkSession
    tables.shipped(spark)
    numeric = fit.numeric_candidates(rows, never | {doc})
    # a row for each value of an encoded column
    seen = {c: rows.groupBy(F.coalesce(c, F.lit("Missing")).alias("v")).agg(F.min(F.unix_date(period)).alias("day")).orderBy("v").collect() for c in encoded}
    base = rows.select(
        "id", F.unix_date(period).alias("time"), F.col(y).cast("double").alias("y"), blocks.array_of(numeric).alias("x"), F.array(*[F.coalesce(c, F.lit("Missing")) for c in encoded]).cast("array<string>").alias("codes"),
        *([F.col(doc).alias("doc")] if doc else []),
    )
    none = F.array().cast("array<double>")
    lexicon, width, names = (), 0, []
    if texts is None:
        base = base.withColumns({"has_text": F.lit(0.0), "lexicon": none, "vector": none, "term": F.array().cast("array<int>"), "weight": none})
    else:
        lexicon = tuple(c for c in texts.lexicon.columns if c != "doc")
        width = len(texts.vectors.select("embedding").first()["embedding"])
        # terms of fewer rows stand in no fold's vocabulary
        uses = base.where("doc is not null").groupBy("doc").agg(F.count("*").alias("uses"))
        enough = texts.terms.join(uses, "doc").groupBy("term").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= walks.LEAST_ROWS)
        numbered, names = corpus.numbered(enough)
        cells = texts.terms.join(numbered, "term").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("number", (1 + F.ln("tf")).alias("w")))).alias("cells"))
        about = texts.lexicon.select("doc", blocks.array_of(list(lexicon)).alias("lexicon")).join(texts.vectors.select("doc", F.col("embedding").cast("array<double>").alias("vector")), "doc", "full")
        about = about.join(cells.select("doc", F.col("cells.number").cast("array<int>").alias("term"), F.col("cells.w").alias("weight")), "doc", "full")
        base = base.join(about, "doc", "left").withColumn("has_text", F.col("doc").isNotNull().cast("double")).drop("doc")
        empty = {"lexicon": none, "vector": none, "term": F.array().cast("array<int>"), "weight": none}
        base = base.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)) if c in ("lexicon", "vector") else F.coalesce(c, empty[c]) for c in empty})
    layout = blocks.Layout(tuple(numeric), {c: {r["v"]: r["day"] for r in found} for c, found in seen.items()}, lexicon, width, len(names), base.schema["id"].dataType.simpleString())
    path = f"{tables.scratch(spark)}/blocks"
    blocks.written(base, layout, path)
    return blocks.Blocks(spark, path, layout), names


def learned_folds(rows: DataFrame, table: DataFrame, period: str, held: blocks.Blocks, logged: list[str], texts: bool = False, components: int = arms.COMPONENTS) -> list[walks.Fold]:
    folds = [{"fold": r["fold"], "cutoff": r["cutoff"], "end": r["end"]} for r in table.select("fold", F.unix_date("train_cutoff").alias("cutoff"), F.unix_date("test_end").alias("end")).collect()]
    return walks.learned(held, folds, walks.fold_caps(held, folds, [c for c in logged if c in held.layout.numeric]), logged, texts, components)


def _walked(spark: SparkSession, d: str) -> tuple[blocks.Blocks, list[walks.Fold]]:
    rows, table = _features(spark, d).persist(), study.fold_table(spark, d).persist()
    held, _ = walk_blocks(rows, "month", "is_default", NEVER, PREPARE["encoded"])
    folds = learned_folds(rows, table, "month", held, PREPARE["logged"])
    rows.unpersist()
    table.unpersist()
    return held, folds


def _auc(p: DataFrame) -> DataFrame:
    return rankstats.auc(p, ["fold", "model"]).withColumn("auc", R("auc"))


@query
def lr_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """AUC of the logistic model on each fold's test rows."""
    held, folds = _walked(spark, d)
    fits = walks.logistic(held, folds, ("structured",))
    held.done()
    return _auc(walks.scored(held, folds, fits))


@query
def gbt_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """AUC of 300 boosted trees on each fold's test rows."""
    held, folds = _walked(spark, d)
    fits = boosting.fitted(held, folds, ("structured",))
    held.done()
    return _auc(boosting.scored(held, folds, fits))


@query
def rf_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """AUC of a random forest of 500 trees, grown to the end, on each fold's test rows."""
    held, folds = _walked(spark, d)
    s = forests.Settings()
    scores, large = forests.scored(held, folds, s)
    learned = {f.fold: walks.prepared(f, held.layout) for f in folds if f.fold in large}
    held.done()
    parts = [scores] if scores is not None else []
    if large or not parts:  # no task takes these folds' cells
        own = study.fold_table(spark, d).where(F.col("fold").isin(large))
        parts.append(models.walk_forward(_features(spark, d), own, "month", "is_default", "Forest", PREPARE, trees=s.trees, learned=learned, max_depth=30, leaf=s.leaf))
    return _auc(reduce(DataFrame.unionByName, parts))


@query
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of the logistic grid on every tuning fold's inner validation part, averaged."""
    mean, _ = models.tuned(models.written(_features(spark, d)), study.fold_table(spark, d), "month", "id", "is_default", "Logistic", PREPARE)
    return mean.select("model", "place", "params", R("mean_auc").alias("mean_auc"), "n_folds", "best")


@query
def tuned_refit(spark: SparkSession, d: str) -> DataFrame:
    """AUC of the tuned logistic model, fitted anew on the whole training side of the last fold."""
    rows, table = models.written(_features(spark, d)), study.fold_table(spark, d)
    _, best = models.tuned(rows, table, "month", "id", "is_default", "Logistic", PREPARE)
    last = table.orderBy(F.desc("fold")).first().asDict()
    p = models.refitted(rows, last, "month", "is_default", "Logistic", PREPARE, best)
    return rankstats.auc(p, ["fold", "model"]).withColumn("auc", R("auc")).withColumn("c", F.lit(float(best["c"])))


# --- the study with texts: arms by fold, and what reads their predictions -----------------------------

#: Arms and models of the registered study; folds whose predictions are written together.
STUDY_ARMS = tuple(arms.ARMS)
WAVE = 12
_written: dict[tuple, str] = {}


def with_texts(spark: SparkSession, d: str) -> tuple[DataFrame, arms.Texts]:
    """Loans with a document each (three quarters have one), and what belongs to documents."""
    n = max(study.corpus(spark, d).count(), 1)
    rows = _features(spark, d).withColumn("doc", F.when(F.col("id") % 4 != 0, F.col("id") % n))
    terms = textual._terms(spark, d, False).withColumnRenamed("id", "doc")
    lexicon = textual.lexicon_features(spark, d).withColumnRenamed("id", "doc")
    e = tables.scan(spark, d, "embeddings", "vec_id", "embedding")
    return rows, arms.Texts(terms, lexicon, e.withColumnRenamed("vec_id", "doc"), components=10)


def run_study(spark: SparkSession, d: str, path: str, settings: runner.Settings) -> DataFrame:
    """Predictions of the settings' folds, arms and models as a table at path: id, fold, model, arm, y_true, y_prob, area.

    Folds are fitted and written WAVE by WAVE, each complete or not there, so that a run that stops is taken up where it was; restart begins anew.
    """
    table = study.fold_table(spark, d).persist()
    if settings.restart:
        tables.removed(spark, path)
    done = {int(m) for m in connectors.marks(spark, path)}
    left = [r["fold"] for r in table.select("fold").orderBy("fold").collect() if r["fold"] not in done and (not settings.folds or r["fold"] in settings.folds)]
    if left:
        rows, texts = with_texts(spark, d)
        rows = rows.persist()
        held, _ = walk_blocks(rows, "month", "is_default", NEVER, PREPARE["encoded"], "doc", texts)
        area = study.loans(spark, d).select("id", "area").persist()
        for at in range(0, len(left), settings.parallel):
            own = table.where(F.col("fold").isin(left[at : at + settings.parallel]))
            folds = learned_folds(rows, own, "month", held, PREPARE["logged"], True, texts.components)
            for f in folds:
                for arm in settings.arms:
                    fit.banned(f.names(held.layout, arm), {"is_default", "id", "area", "y_true"}, ("label", "fairness"))
            parts = []
            if "Logistic" in settings.models:
                parts.append(walks.scored(held, folds, walks.logistic(held, folds, settings.arms)))
            if "Boosted" in settings.models:
                parts.append(boosting.scored(held, folds, boosting.fitted(held, folds, settings.arms, boosting.Settings(trees=settings.trees, seed=settings.seed))))
            scores = reduce(DataFrame.unionByName, parts).withColumn("y_prob", F.bround("y_prob", 6))
            own = sorted(f.fold for f in folds)
            connectors.append(scores.join(area, "id").select(*PREDICTED), path, f"folds {own}", tuple(own))
        held.done()
        area.unpersist()
        rows.unpersist()
    table.unpersist()
    return predicted(spark, path)


#: Columns of a study's predictions.
PREDICTED = {"id": "long", "fold": "int", "model": "string", "arm": "string", "y_true": "int", "y_prob": "double", "area": "string"}


def predicted(spark: SparkSession, path: str) -> DataFrame:
    return connectors.read(spark, path, ", ".join(f"{c} {t}" for c, t in PREDICTED.items()))


def study_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The registered study's predictions: all folds, all arms, the logistic model; made once for each session and folder and shared by the queries below."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        path = f"{tables.scratch(spark)}/predictions"
        run_study(spark, d, path, runner.Settings(arms=STUDY_ARMS, models=("Logistic",), parallel=WAVE))
        _written[key] = path
    return predicted(spark, _written[key])


#: Arms whose importances are shown.
SHOWN_ARMS = ("structured", "lexicon", "tfidf_chi2", "embed_pca")
_importances: dict[tuple, str] = {}


def fold_importances(spark: SparkSession, d: str) -> DataFrame:
    """fold, arm, feature, kind, value (size of the coefficient on scaled features), share, rank: every fold, made once for each session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _importances:
        rows, texts = with_texts(spark, d)
        rows, table = rows.persist(), study.fold_table(spark, d).persist()
        held, terms = walk_blocks(rows, "month", "is_default", NEVER, PREPARE["encoded"], "doc", texts)
        folds = learned_folds(rows, table, "month", held, PREPARE["logged"], True, texts.components)
        fits = walks.logistic(held, folds, SHOWN_ARMS)
        found = walks.importances(held.layout, folds, {k: np.abs(b[1:]) for k, b in fits.items()}, terms)
        held.done()
        rows.unpersist()
        table.unpersist()
        path = f"{tables.scratch(spark)}/importances"
        # some hundred features for each fold and arm
        spark.createDataFrame(found, "fold int, arm string, feature string, kind string, value double, share double, rank int").write.parquet(path)
        _importances[key] = path
    return spark.read.parquet(_importances[key])


@query
def importance_mass(spark: SparkSession, d: str) -> DataFrame:
    """Share of each kind of features in all importance, by fold and arm."""
    return fold_importances(spark, d).groupBy("fold", "arm", "kind").agg(F.count("*").alias("n_features"), R(F.sum("share")).alias("mass"), F.min("rank").alias("best_rank"))


@query
def term_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand among a fold's first twenty by the model's coefficients, over all folds."""
    terms = fold_importances(spark, d).where("kind = 'tfidf_chi2'").withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy("rank")))
    out = corpus.consistency(terms.select("fold", F.expr("substring(feature, 12)").alias("term"), "rank", "value"), 20)
    return out.withColumns({"mean_rank": R("mean_rank"), "mean_value": R("mean_value")})


@query
def arm_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUC, average precision, Brier score and Gini of each fold and arm, from models' predictions."""
    p, keys = study_predictions(spark, d), ["fold", "model", "arm"]
    out = rankstats.brier_gini(p, keys).join(rankstats.average_precision(p, keys), keys)
    return out.select(*keys, "n", R("auc").alias("auc"), R("ap").alias("ap"), R("brier").alias("brier"), R("gini").alias("gini"))


@query
def arm_delong(spark: SparkSession, d: str) -> DataFrame:
    """DeLong tests of the text arms against the structured one on models' predictions, corrected over folds; unpaired rows raise."""
    out = rankstats.delong(study_predictions(spark, d), ["fold", "model"], "arm", "structured", strict=True)
    out = rankstats.benjamini_hochberg(out, ["model", "arm"], "p_value", ["fold"])
    return out.select("fold", "model", "arm", *[R(c).alias(c) for c in ("auc_a", "auc_b", "delta_auc", "z", "p_value", "q_value")])


@query
def arm_fairness(spark: SparkSession, d: str) -> DataFrame:
    """Gaps High - Low of models' predictions by fold, with tests."""
    labels = study.labelled_areas(spark, d).select("area", *study.GROUPINGS)
    out = fairness.by_fold(study_predictions(spark, d).join(labels, "area"), list(study.GROUPINGS), ["model", "arm"])
    return out.select("grouping", "model", "arm", "fold", *[R(f"{r}_{c}").alias(f"{r}_{c}") for r in fairness.RATES for c in ("gap", "p", "q")])


@query
def arm_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Expected calibration error of models' predictions by fold, arm and level of the index."""
    labels = study.labelled_areas(spark, d).select("area", F.col("index_group").alias("level"))
    curve = fairness.calibration(study_predictions(spark, d).join(labels, "area"), ["fold", "arm"], "level")
    return fairness.calibration_error(curve, ["fold", "arm", "level"]).withColumn("ece", R("ece"))


@query
def preprocessing_audit(spark: SparkSession, d: str) -> DataFrame:
    """What every fold's preprocessing has learned: all folds from a few passes over blocks."""
    held, folds = _walked(spark, d)
    found = []
    for f in sorted(folds, key=lambda f: f.fold):
        p = walks.prepared(f, held.layout)
        fit.banned(p.features(), {"is_default", "id"}, ("label",))
        found.append((f.fold, p.numeric, p.missing, p.correlated, {k: float(v) for k, v in p.caps.items()}, p.categories))
    held.done()
    return spark.createDataFrame(found, "fold int, numeric array<string>, missing array<string>, correlated array<string>, caps map<string,double>, categories map<string,array<string>>")


@query
def pca_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.scan(spark, d, "embeddings")
    out, shares = models.reduced(rows.where("vec_id % 5 <> 0"), rows, "embedding", 10)
    return out.select("vec_id", F.size("reduced").alias("dims"), F.lit(round(sum(shares), 6)).alias("explained"))


@query
def pca_randomised(spark: SparkSession, d: str) -> DataFrame:
    """Ten components of every embedding by the randomised decomposition, fitted on four fifths of them, and the share of variance they explain."""
    rows = tables.scan(spark, d, "embeddings", "vec_id", "embedding")
    found = decomposition.randomised(rows.where("vec_id % 5 <> 0"), "embedding", 10)
    return rows.select("vec_id", models.projected("embedding", found.directions, found.means).alias("reduced"), F.lit(round(sum(found.shares), 6)).alias("explained"))


@query
def importance_by_model(spark: SparkSession, d: str) -> DataFrame:
    fold = study.fold_table(spark, d).orderBy("fold").first()
    train = models.written(_features(spark, d).where(F.col("month") <= F.lit(fold["train_cutoff"])))
    p = fit.prepare(train, **PREPARE)
    ready = p.apply(train)
    parts = [models.importances(models.fit_score(ready, ready, m, p.features(), "is_default", trees=TREES)[0], p.features()).assign(model=m) for m in ("Logistic", "Boosted", "Forest")]
    import pandas as pd

    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


@query
def resume_append(spark: SparkSession, d: str) -> DataFrame:
    """Folds 1 and 2 are written, fold 2 again, then all that are missing; the table holds each once."""
    rows = study.predictions(spark, d)
    path = f"{tables.scratch(spark)}/folds"
    for some in ([1, 2], [2]):
        tables.append_fold(rows.where(F.col("fold").isin(some)), path)
    done = tables.done_folds(spark, path)
    left = [r["fold"] for r in study.fold_table(spark, d).select("fold").orderBy("fold").collect() if r["fold"] not in done]
    out = tables.append_fold(rows.where(F.col("fold").isin(left)), path)
    return out.groupBy("fold", "model", "arm").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


ORACLES["resume_append"] = f"WITH {study.P_SQL} SELECT fold, model, arm, count(*) AS n, count(DISTINCT id) AS n_ids FROM p GROUP BY ALL"


@query
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sparse rows, as maps from term to weight, with their length."""
    found = textual._weighted(spark, d)
    if found is None:
        rows = textual._tfidf(spark, d)
        return rows.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", R("tfidf").alias("w"))))).alias("weights"), R(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    rows = vocabulary.with_terms(*found)
    norm = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    return rows.select("id", F.map_from_arrays("terms", F.transform("values", lambda v: R(v))).alias("weights"), R(norm).alias("norm"))


@query
def tfidf_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Terms that chi-squared ranks high in each of three parts of the corpus."""
    from pyspark.sql.window import Window

    labels = study.labelled(spark, d)
    t = textual._terms(spark, d, False)
    parts = [corpus.chi2(t.where(F.col("id") % 3 != k), "id", labels.where(F.col("id") % 3 != k), "y", "tf", 30).withColumn("fold", F.lit(k)) for k in range(3)]
    rows = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("chi2"), "term"))).withColumnRenamed("chi2", "value")
    return corpus.consistency(rows, 20).withColumns({"mean_rank": R("mean_rank"), "mean_value": R("mean_value")})

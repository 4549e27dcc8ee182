"""Time-ordered scoring studies on Spark: folds, features, rank statistics, fairness, reweighting."""

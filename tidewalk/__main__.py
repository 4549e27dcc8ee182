"""python -m tidewalk tables=FOLDER out=FOLDER [setting=value ...]: runs the study, or goes on with one that was stopped.

Settings are those of `runner.Settings`: folds=1,2 arms=structured,tfidf_chi2 models=Logistic,Boosted trees=300 parallel=12 restart suffix=_name.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import runner
from .plans import modelling


def main(words: list[str]) -> int:
    """Rows of predictions that stand at the end."""
    places = {k: v for k, _, v in (w.partition("=") for w in words) if k in ("tables", "out")}
    if set(places) != {"tables", "out"}:
        raise SystemExit(__doc__)
    settings = runner.Settings.parsed([w for w in words if w.partition("=")[0] not in places])
    spark = SparkSession.builder.getOrCreate()
    rows = modelling.run_study(spark, places["tables"], f"{places['out']}/predictions{settings.suffix}", settings)
    for r in rows.groupBy("model", "arm").agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("rows")).orderBy("model", "arm").collect():
        print(f"{r['model']} {r['arm']}: {r['folds']} folds, {r['rows']} rows")
    return rows.count()


if __name__ == "__main__":
    main(sys.argv[1:])

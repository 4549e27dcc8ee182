"""Tables in and out: pruned scans, typed CSV, appends by fold with markers, audit lines, small text formats."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType
from pyspark.sql.window import Window

from ..functions import exprs as X


def scan(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def head(spark: SparkSession, folder: str, name: str, n: int, *order: str) -> DataFrame:
    """The first n rows of a table; by the given columns, else any n."""
    rows = scan(spark, folder, name)
    return (rows.orderBy(*order) if order else rows).limit(n)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the cluster names, a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.gettempdir()
    return f"{named}/tidewalk-{uuid.uuid4().hex}"


def shipped(spark: SparkSession) -> None:
    """Gives the package's modules to the executors, once for each session, so that they need no installation there."""
    context, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_tidewalk_modules", False):
        return
    folder = tempfile.mkdtemp(prefix="tidewalk-")  # the driver's file server reads it as long as the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{top.name}-library", "zip", top.parent, top.name))
    context._tidewalk_modules = True


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table stands there, its writer's mark included."""
    fs, hadoop = _files(spark, f"{path}/_SUCCESS")
    return bool(fs.exists(hadoop))


def removed(spark: SparkSession, path: str) -> None:
    """Takes a table away, if it is there."""
    fs, hadoop = _files(spark, path)
    fs.delete(hadoop, True)


def newest(spark: SparkSession, pattern: str) -> str:
    """Of the files or folders that match, the one that was changed last; of equal times the last by name."""
    fs, hadoop = _files(spark, pattern)
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(hadoop) or []]
    if not found:
        raise FileNotFoundError(pattern)
    return max(found)[1]


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Iterable[str] = ()) -> DataFrame:
    """CSV with a given schema (no inference), NaN taken out."""
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return without_nan(df.select(*columns) if columns else df)


def without_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({n: X.nan_to_null(n) for n in floats})


def resolve(df: DataFrame, name: str) -> str:
    """The column of that name in whatever case."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if not found:
        raise KeyError(f"{name} is not among {df.columns}")
    return found[0]


def append_fold(df: DataFrame, path: str, fold: str = "fold") -> DataFrame:
    """Writes the folds of df; a fold that is written again replaces itself only, so a stopped run can be taken up."""
    write_parts(df, path, fold)
    return df.sparkSession.read.parquet(path)


def write_parts(df: DataFrame, path: str, *parts: str) -> None:
    """Writes partitions; those that df has replace what stood there, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def done_folds(spark: SparkSession, path: str, fold: str = "fold") -> list[int]:
    """Folds that are complete: partitions of the table."""
    fs, hadoop = _files(spark, path)
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory()]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{fold}="))


def append_filtered(rows: DataFrame, path: str, *chunks) -> DataFrame:
    """Rows of each condition in turn, added to one table."""
    for condition in chunks:
        rows.where(condition).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Nested audit rows as JSON lines."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a folder of CSV files, each with its header."""
    df.write.mode("append").csv(path, header=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """'key: value' lines of a text file."""
    lines = spark.read.text(path)
    return manifest_pairs(lines, "value")


def manifest_pairs(lines: DataFrame, column: str) -> DataFrame:
    pattern = r"^\s*[-*]?\s*([^:]+?)\s*:\s*(.*?)\s*$"
    pairs = lines.select(F.regexp_extract(column, pattern, 1).alias("key"), F.regexp_extract(column, pattern, 2).alias("value"))
    return pairs.where("key <> ''")


def annotation_rows(answers: DataFrame, column: str, categories: list[str], neutral: str) -> DataFrame:
    """Answers of an annotator (CSV lines, maybe in code fences): token, category, is_distress, rationale.

    Lines with fewer than two fields or an unknown category are left out; a flag that isn't 0 or 1 follows from the category.
    """
    lines = answers.select("*", F.posexplode(F.split(F.regexp_replace(F.col(column), r"(?m)^```.*$", ""), r"\r?\n")).alias("line", "row"))
    fields = F.from_csv("row", "token string, category string, flag string, rationale string", {"mode": "PERMISSIVE"})
    rows = lines.where(F.trim("row") != "").withColumn("f", fields)
    category = F.upper(F.trim("f.category"))
    flag = F.coalesce(F.expr("try_cast(trim(f.flag) as int)"), (category != neutral).cast("int"))
    out = rows.select(*[c for c in answers.columns if c != column], "line", F.trim("f.token").alias("token"), category.alias("category"), flag.alias("is_distress"), F.trim("f.rationale").alias("rationale"))
    return out.where(F.col("token").isNotNull() & F.col("category").isin(categories) & (F.lower("token") != "token"))


def merged_chunks(chunks: list[DataFrame], key: str) -> DataFrame:
    """Chunks of columns of one wide source, joined on their key; negative numbers are missing values."""
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.join(chunk, key, "outer")
    return out.withColumns({c: X.not_negative(c) for c, t in out.dtypes if c != key and t in ("int", "bigint", "double", "float")})


def profile(df: DataFrame) -> DataFrame:
    """Rows and columns of a table."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def text_profile(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and lines of text files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return lines.groupBy("file", "size").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.sum("n").alias("n_lines"))


def sparse_rows(long: DataFrame, key: str, term: str, value: str) -> tuple[DataFrame, DataFrame]:
    """A long matrix as (rows: key, indices, values in order of column; vocabulary: term, column), both ready to be written."""
    vocabulary = long.select(term).distinct().withColumn("column", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(term)) - 1)  # a row for each term
    cells = long.join(vocabulary, term).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("column", F.col(value).cast("double").alias("value")))).alias("cells"))
    return cells.select(key, F.col("cells.column").alias("indices"), F.col("cells.value").alias("values")), vocabulary


def long_rows(sparse: DataFrame, vocabulary: DataFrame, key: str, term: str, value: str) -> DataFrame:
    """The long matrix back from its sparse rows."""
    cells = sparse.select(key, F.explode(F.arrays_zip("indices", "values")).alias("cell")).select(key, F.col("cell.indices").alias("column"), F.col("cell.values").alias(value))
    return cells.join(vocabulary, "column").select(key, term, value)


def wide_summary(lines: DataFrame, line: str, place: str) -> DataFrame:
    """A summary with two header lines (measure, statistic) and one line for each row, in long form: row, measure, statistic, value.

    `place` orders the lines; an empty measure goes on with the one to its left.
    """
    fields = lines.select(F.col(place).alias("place"), F.split(line, ",", -1).alias("f"))
    heads = [fields.where(F.col("place") == i).select(F.col("f").alias(name)) for i, name in ((0, "measures"), (1, "statistics"))]
    carried = lambda a, m: F.concat(a, F.array(F.when(m != "", m).otherwise(F.element_at(a, -1))))
    top = heads[0].select(F.aggregate(F.slice("measures", 2, F.size("measures")), F.array(F.lit("")), carried).alias("measures"))  # one row each
    rows = fields.where("place > 1").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(heads[1]))
    cells = rows.select(F.col("f")[0].alias("row"), F.posexplode("f").alias("at", "text"), "measures", "statistics").where("at > 0")
    return cells.select("row", F.get("measures", F.col("at")).alias("measure"), F.get("statistics", F.col("at")).alias("statistic"), F.expr("try_cast(text AS double)").alias("value"))


def markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows of a result as a table for a report."""
    rows = df.limit(most).collect()
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(map(shown, r)) + " |" for r in rows]])

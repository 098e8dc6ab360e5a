"""File sources of campaign data.

* ``scan_campaign_files``: all campaigns below a folder, each a file or a
  folder of part files, as one DataFrame; the path part the caller names
  becomes ``activity_id``, so all campaigns go through one job (grouped by
  activity) instead of a loop.
* ``read_csv_split``: CSV with an explicit schema (no inference pass), NaN-like
  text and empty strings read as NULL, lines that don't fit set apart.
* ``first_available``: the first of several sources that exists.
* ``validate_panel``: treatments, outcomes and ids checked in one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from causeway.operators.joins import keep


def scan_campaign_files(spark: SparkSession, folder: str, token: str = "", fmt: str = "parquet",
                        schema: StructType | None = None, part: int = -1, **options) -> DataFrame:
    """``part``: which path part names the campaign, -1 the file (without its
    extension), -2 the folder it is in.  Only campaigns whose name contains
    ``token`` are listed."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    if part == -1:
        df = reader.option("pathGlobFilter", f"*{token}*").load(folder)
    else:
        df = reader.load(f"{folder.rstrip('/')}/{'*/' * (-part - 2)}*{token}*")
    named = F.element_at(F.split(F.col("_metadata.file_path"), "/"), part)
    name = F.url_decode(F.regexp_replace(named, r"(?<=.)\.[^.]*$", "") if part == -1 else named)
    return df.withColumn("activity_id", name)


_LINE = "_line"


def read_campaign_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The good rows of a CSV; see :func:`read_csv_split` for the others."""
    return read_csv_split(spark, path, schema)[0]


def read_csv_split(spark: SparkSession, path: str, schema: StructType,
                   header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV.  A line that doesn't fit the
    schema — a value of the wrong type, too few or too many fields — is no row:
    rejects hold it as (file, line).  Both come from one kept parse."""
    wide = StructType([*schema.fields, StructField(_LINE, StringType())])
    parsed = keep(spark.read.option("header", header).option("nullValue", "").option("nanValue", "NaN")
                  .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).option("enforceSchema", True)
                  .schema(wide).csv(path).withColumn("_file", F.col("_metadata.file_path")))
    good = parsed.where(F.col(_LINE).isNull()).select(*schema.fieldNames())
    rejects = parsed.where(F.col(_LINE).isNotNull()).select(
        F.url_decode(F.element_at(F.split("_file", "/"), -1)).alias("file"), F.col(_LINE).alias("line"))
    return good, rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected lines per file, with the first of them in order."""
    return rejects.groupBy("file").agg(F.count(F.lit(1)).alias("n_rejected"), F.min("line").alias("example"))


def first_available(spark: SparkSession, sources: Sequence[tuple[str, str]], schema: StructType) -> DataFrame:
    """The first source that exists: ("csv", path), ("parquet", path) or
    ("table", name); an error names all of them if none does."""
    for kind, where in sources:
        if kind == "table":
            if spark.catalog.tableExists(where):
                return spark.table(where).select(*schema.fieldNames())
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(where)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return read_campaign_csv(spark, where, schema) if kind == "csv" else spark.read.parquet(where).select(*schema.fieldNames())
    raise FileNotFoundError("none of these is there: " + ", ".join(f"{k} {w}" for k, w in sources))


def panel_faults(df: DataFrame, t: str = "t", y: str = "y", id_col: str = "id") -> DataFrame:
    """One row of counts: n, treatments that are NULL or not 0 / 1, outcomes that
    are NULL or not finite, NULL ids, repeated ids."""
    tc, yc = F.col(t).cast("double"), F.col(y).cast("double")
    per_id = df.select(F.col(id_col).alias("_i"), tc.alias("_t"), yc.alias("_y")).groupBy("_i").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_t").isNull(), 1)).alias("_tn"),
        F.count(F.when(~F.col("_t").isin(0.0, 1.0), 1)).alias("_tb"), F.count(F.when(F.col("_y").isNull(), 1)).alias("_yn"),
        F.count(F.when(F.isnan("_y") | (F.abs("_y") == float("inf")), 1)).alias("_yb"))
    null_id = F.col("_i").isNull()
    return per_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (
        ("n", F.col("_n")), ("t_null", F.col("_tn")), ("t_invalid", F.col("_tb")), ("y_null", F.col("_yn")),
        ("y_not_finite", F.col("_yb")), ("id_null", F.when(null_id, F.col("_n"))),
        ("id_repeated", F.when(~null_id, F.col("_n") - 1)))])


def validate_panel(df: DataFrame, t: str = "t", y: str = "y", id_col: str = "id") -> DataFrame:
    """``df`` itself if its treatments are 0 or 1, its ids given and unique and
    its outcomes finite or missing; else an error with the counts."""
    row = panel_faults(df, t, y, id_col).first().asDict()
    bad = {k: v for k, v in row.items() if v and k not in ("n", "y_null")}
    if bad:
        raise ValueError(f"not a panel: {bad} of {row['n']} rows")
    return df


def recode(df: DataFrame, log1p_cols: tuple[str, ...] = (), t: str = "t", y: str = "y",
           id_col: str | None = None) -> DataFrame:
    """Campaign recoding: log1p of amount columns (negative → NULL, NaN →
    NULL), T as INT, Y as DOUBLE, a mandatory id."""
    out = df
    for c in log1p_cols:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(~F.isnan(x) & (x > -1), F.log1p(x)))
    out = out.withColumn("t", F.col(t).cast("int")).withColumn("y", F.col(y).cast("double"))
    if id_col is not None:
        out = out.withColumn("id", F.col(id_col))
    if "id" not in out.columns:
        raise ValueError("an id column is required: rows have no position in Spark")
    return out


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without any NULL in ``cols`` (all columns by default)."""
    return df.dropna(subset=cols)

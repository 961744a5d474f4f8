"""JSON dumps of patches: one file a time step and patch, ``dofs_t{t}_p{p}.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "metadata map<string,string>, points array<array<double>>, connectivity array<array<int>>, point_data map<string,array<double>>"


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """timestep, patch, points, connectivity, point_data of every file."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    name = F.input_file_name()
    return raw.select(
        F.regexp_extract(name, r"dofs_t(\d+)_p(\d+)", 1).cast("int").alias("timestep"),
        F.regexp_extract(name, r"dofs_t(\d+)_p(\d+)", 2).cast("int").alias("patch"),
        "points",
        "connectivity",
        "point_data",
    )


#: Patches of a block, whose counts are summed first.
BLOCK = 4096


def merged(dumps: DataFrame) -> DataFrame:
    """The patches of a step as one mesh: connectivity shifted by the points of the patches before.

    Only counts meet in windows: those of a block's patches, and those of a step's blocks; the arrays stay where
    they are but for the join on (timestep, patch), which are distinct.  Points' numbers are long.  Spark takes an
    array for one element, so the join carries a hint against broadcast of the dumps.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = dumps.withColumn("__n", F.greatest(F.coalesce(F.size("points"), F.lit(0)), F.lit(0)).cast("long"))
    counts = rows.groupBy("timestep", "patch", F.floor(F.col("patch") / BLOCK).alias("__b")).agg(F.sum("__n").alias("__n"))
    blocks = counts.groupBy("timestep", "__b").agg(F.sum("__n").alias("__n"))
    starts = blocks.select("timestep", "__b", F.coalesce(F.sum("__n").over(before("timestep").orderBy("__b")), F.lit(0)).alias("__o"))
    inside = F.coalesce(F.sum("__n").over(before("timestep", "__b").orderBy("patch")), F.lit(0))
    shifts = counts.withColumn("__i", inside).join(starts, ["timestep", "__b"]).select("timestep", "patch", (F.col("__o") + F.col("__i")).alias("__s"))
    return dumps.hint("merge").join(shifts, ["timestep", "patch"]).select(
        "timestep",
        "patch",
        "points",
        F.transform("connectivity", lambda cell: F.transform(cell, lambda k: k + F.col("__s"))).alias("connectivity"),
        "point_data",
    )


def point_table(dumps: DataFrame) -> DataFrame:
    """timestep, name, value: one row a point and array, to scan for anomalies."""
    arrays = dumps.select("timestep", F.explode("point_data").alias("name", "values"))
    return arrays.select("timestep", "name", F.explode("values").alias("value"))

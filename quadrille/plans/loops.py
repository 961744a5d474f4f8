"""Driver loops over DataFrames: time stepping with refinement, and numbering of sorted rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Geometry
from ..functions.morton import MortonCodec
from ..functions.physics import Equation
from ..operators import fvm, intergrid, measures, tree
from ..operators.layout import PatchLayout
from ..sources.tables import shared_dir


def row_numbers(frame: DataFrame) -> DataFrame:
    """``frame`` sorted by patch_id with ``place`` from 1, without one task that sees all rows.

    Rows are range-partitioned; a partition's numbers start after the counts of those before it.
    """
    dealt = tree.sort_by_key(frame).withColumn("__p", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__p").count()  # one row a partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("patch_id"))
    return dealt.join(starts, "__p").select(*frame.columns, (own + F.col("__start")).cast("long").alias("place"))


def run_uniform(
    cells: DataFrame,
    equation: Equation,
    spacing: Sequence[float],
    extent: int,
    t_end: float,
    cfl: float = 0.3,
    dt: float | None = None,
    every: int = 4,
    by: Sequence[str] = (),
) -> DataFrame:
    """Steps a periodic uniform grid (or those told apart by ``by``, together) to ``t_end``; without ``dt`` each step takes the CFL limit.

    Lineage is cut every few steps; a fixed dt needs no action in between.
    """
    state, time, n = cells, 0.0, 0
    while time < t_end * (1 - 1e-12):
        h = dt or fvm.cfl_limit(state, equation, [F.lit(s) for s in spacing], cfl).first().dt
        h = min(h, t_end - time)
        state = fvm.uniform_step(state, equation, float(h), spacing, extent, by)
        time, n = time + h, n + 1
        if n % every == 0 or dt is None:
            state = state.checkpoint()
    return state


@dataclass
class Report:
    """What a refined run did."""

    steps: int = 0
    cell_updates: int = 0
    regrids: int = 0
    unchanged: int = 0
    patches: list[int] = field(default_factory=list)


def run_refined(
    cells: DataFrame,
    leaves: DataFrame,
    equation: Equation,
    geometry: Geometry,
    codec: MortonCodec,
    layout: PatchLayout,
    t_end: float,
    criterion: Callable[[DataFrame], DataFrame],
    cfl: float = 0.3,
    regrid_every: int = 5,
    min_level: int = 1,
    output: Callable[[int, float, DataFrame], None] | None = None,
    output_every: int = 20,
) -> tuple[DataFrame, DataFrame, Report]:
    """Advances an adaptive grid; ``criterion`` maps cells to (patch_id, status).

    Neighbours are derived again only when the leaf set has changed.
    """
    report, time = Report(), 0.0
    fields = list(equation.fields)
    nbr = tree.neighbors(leaves, codec).checkpoint()
    spacing = [geometry.cell_size(F.col("level"), a) for a in (0, 1)]
    wanted = {"dt": fvm.cfl_measure(equation, spacing, cfl), "n": F.count(F.lit(1))}
    cells, seen = measures.written(cells, wanted)
    while time < t_end * (1 - 1e-12):
        dt, n = min(seen["dt"], t_end - time), seen["n"]
        step = fvm.refined_step(cells, leaves, equation, float(dt), geometry, codec, layout, nbr)
        cells, seen = measures.written(step, wanted)
        time, report.steps, report.cell_updates = time + dt, report.steps + 1, report.cell_updates + n
        if report.steps % regrid_every == 0:
            report.regrids += 1
            refined, families = tree.plan_regrid(leaves, criterion(cells).checkpoint(), codec, min_level)
            if tree.is_noop(refined, families):
                report.unchanged += 1
            else:
                cells, seen = measures.written(intergrid.regrid_cells(cells, refined, families, codec, layout.sizes[0], fields), wanted)
                leaves = tree.regrid_keys(leaves, refined, families, codec).checkpoint()
                nbr = tree.neighbors(leaves, codec).checkpoint()
            report.patches.append(leaves.count())
        if output and report.steps % output_every == 0:
            output(report.steps, time, cells)
    return cells, leaves, report


def drained(spark, stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of each key of a streaming aggregate over what there is now, as a table.

    Update mode: a micro-batch writes the groups that it changed, under its number (so a repeated one
    overwrites itself), and state behind the watermark is dropped.
    """
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    none = spark.createDataFrame([], stream.schema).withColumn("__batch", F.lit(0).cast("long"))
    none.write.parquet(f"{place}/result/none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/result/{number:09d}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{place}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{place}/result/*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("last")).select(*keys, *(f"last.{c}" for c in rest))

"""Measures taken in the pass that writes: time-step limits, counts of flags and of unsound values."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from .tree import COARSEN, REFINE, STABLE


def written(frame: DataFrame, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """The frame written to the shared folder and read again, and the measures (aggregates) of its rows: one job's pass.

    They are taken by the tasks that write, so a repeated task counts once.  Of a table without rows they are what the
    aggregates give for none.
    """
    spark = frame.sparkSession
    folder = f"{shared_dir(spark)}/measured-{uuid.uuid4().hex}"
    seen = Observation(f"measured_{uuid.uuid4().hex}")
    frame.observe(seen, *(m.alias(n) for n, m in measures.items())).write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder), seen.get


def unsound(columns: Sequence[str], limit: float = 1e10) -> dict[str, Column]:
    """n_nan, n_inf and n_large over all of some columns."""
    total = lambda test: sum((F.count_if(test(F.col(c).cast("double"))) for c in columns), F.lit(0))
    infinite = lambda v: F.abs(v) == F.lit(float("inf"))
    return {
        "n_nan": total(F.isnan),
        "n_inf": total(infinite),
        "n_large": total(lambda v: ~F.isnan(v) & ~infinite(v) & (F.abs(v) > limit)),
    }


def flag_counts(status: str = "status") -> dict[str, Column]:
    """How many patches want what."""
    return {f"n_{s}": F.count_if(F.col(status) == s) for s in (REFINE, COARSEN, STABLE)}

"""Own operators on arrays of patches beside the built-in ones, and measures of the pass that writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.morton import MortonCodec
from quadrille.operators import halo, intergrid, measures, tree
from quadrille.operators import patch_arrays as P
from quadrille.operators.layout import PatchLayout
from quadrille.operators.tree import INDICES
from quadrille.sources import tables as S


def copies():
    """The built-in operators on arrays; made here so that tasks get the class itself."""

    class Copies:
        def interpolation(self, coarse, corner):
            out = P.quadrant(coarse, corner)
            for a in range(1, coarse.ndim):
                out = out.repeat(2, axis=a)
            return out

        def restriction(self, fine):
            return P.LimitedLinear().restriction(fine)

    return Copies()


def _cells(spark, rank, n, level=1):
    """Cells of a uniform tree with values that follow no line."""
    codec, names = MortonCodec(rank, 4), INDICES[-rank:]
    cells = tree.uniform(spark, codec, level)
    for m in names:
        cells = cells.withColumn(m, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = (F.pmod(F.xxhash64("patch_id", *names), F.lit(1000)) / 8).alias("u")
    return codec, PatchLayout((n,) * rank, 1), cells.select("patch_id", "level", *names, value)


def _by_key(frame):
    return {r.patch_id: np.array(r.u) for r in frame.collect()}


@pytest.mark.parametrize(("rank", "n"), [(2, 4), (2, 8), (3, 4)])
def test_beside_the_built_in(spark, rank, n):
    codec, layout, cells = _cells(spark, rank, n)
    patches = halo.patch_rows(cells, layout, ["u"]).persist()
    for got, want in (
        (P.prolong_patches(patches, codec, layout, ["u"], copies()), intergrid.prolong(cells, codec, n, ["u"])),
        (P.restrict_patches(patches, codec, layout, ["u"], copies()), intergrid.restrict(cells, codec, n, ["u"])),
    ):
        expected = _by_key(halo.patch_rows(want, layout, ["u"]))
        found = _by_key(got)
        assert found.keys() == expected.keys()
        assert all(np.allclose(found[k], expected[k], atol=1e-12) for k in found)


@pytest.mark.parametrize(("rank", "n"), [(2, 8), (3, 4)])
def test_limited_lines_conserve(spark, rank, n):
    """Restriction undoes the interpolation; no value leaves the range of its patch."""
    codec, layout, cells = _cells(spark, rank, n)
    patches = halo.patch_rows(cells, layout, ["u"]).persist()
    fine = P.prolong_patches(patches, codec, layout, ["u"]).persist()
    before, back = _by_key(patches), _by_key(P.restrict_patches(fine, codec, layout, ["u"]))
    assert all(np.allclose(before[k], back[k], atol=1e-10) for k in before) and before.keys() == back.keys()
    ranges = {r.p: (r.a, r.b) for r in fine.select(codec.parent(F.col("patch_id")).alias("p"), F.explode("u").alias("v")).groupBy("p").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    assert all(before[k].min() - 1e-9 <= a and b <= before[k].max() + 1e-9 for k, (a, b) in ranges.items())


def test_a_line_stays_a_line():
    """Inside the patch a linear field is met at the centres of fine cells; its border is level."""
    j, i = np.mgrid[:8, :8] + 0.5
    coarse = (3 * i - 2 * j)[None]
    fine = P.LimitedLinear().interpolation(coarse, (1, 0))[0]
    y, x = np.mgrid[:8, :8]
    want = 3 * (x / 2 + 0.25) - 2 * (4 + y / 2 + 0.25)
    assert np.allclose(fine[:6, 2:], want[:6, 2:]) and not np.allclose(fine[:6, :2], want[:6, :2])


def test_refusals_and_empty_tables(spark):
    codec, layout, cells = _cells(spark, 2, 4)
    patches = halo.patch_rows(cells, layout, ["u"]).persist()
    none = patches.limit(0)
    assert P.prolong_patches(none, codec, layout, ["u"]).count() == P.restrict_patches(none, codec, layout, ["u"]).count() == 0
    one = patches.orderBy("patch_id").limit(3)
    with pytest.raises(Exception, match="each child of a family once"):
        P.restrict_patches(one, codec, layout, ["u"]).collect()
    short = patches.withColumn("u", F.slice("u", 1, 15))
    with pytest.raises(Exception, match="values in every patch"):
        P.prolong_patches(short, codec, layout, ["u"]).collect()
    with pytest.raises(Exception, match="values in every patch"):
        P.flags_of_arrays(patches.withColumn("u", F.lit(None).cast("array<double>")), layout, "u", P.largest_jump).collect()


def test_plans(spark):
    """The table function and the criterion add no exchange, the aggregate one."""
    codec, layout, _ = _cells(spark, 2, 4)
    rows = spark.range(8).select("id", F.array_repeat(F.lit(1.0), 16).alias("u")).withColumnRenamed("id", "patch_id")
    exchanges = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(P.prolong_patches(rows, codec, layout, ["u"])) == 0
    assert exchanges(P.flags_of_arrays(rows, layout, "u", lambda v: P.largest_jump(v).astype(str))) == 0
    assert exchanges(P.restrict_patches(rows, codec, layout, ["u"])) == 1


def test_criterion_beside_an_expression(spark):
    codec, layout, cells = _cells(spark, 2, 4)
    patches = halo.patch_rows(cells, layout, ["u"])
    flags = P.flags_of_arrays(patches, layout, "u", lambda v: np.where(v.reshape(len(v), -1).max(1) > 110, tree.REFINE, tree.STABLE))
    peak = F.when(F.array_max("u") > 110, tree.REFINE).otherwise(tree.STABLE)
    want = intergrid.flags_by(patches, peak)
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, want.collect()))


def test_measures_of_the_writing_pass(spark):
    """The same numbers as an aggregate each, by one job."""
    S.shared_dir(spark)
    v = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("id") * 1e8)
    status = F.when(F.col("id") % 3 == 0, tree.REFINE).otherwise(tree.STABLE)
    frame = spark.range(1000).select("id", v.alias("v"), status.alias("status"))
    wanted = {"n": F.count(F.lit(1)), "top": F.max("id"), **measures.unsound(["v"]), **measures.flag_counts()}
    spark.sparkContext.setJobGroup("measures", "")
    again, seen = measures.written(frame, wanted)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("measures")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 1 and again.dtypes == frame.dtypes and again.count() == 1000
    want = intergrid.anomalies(frame, ["v"]).first()
    assert {k: seen[k] for k in ("n_nan", "n_inf", "n_large")} == {k: want[k] for k in ("n_nan", "n_inf", "n_large")}
    assert (seen["n"], seen["top"], seen["n_refine"], seen["n_coarsen"], seen["n_stable"]) == (1000, 999, 334, 0, 666)
    empty, none = measures.written(frame.limit(0), wanted)
    assert empty.count() == 0 and none["n"] == 0 and none["top"] is None

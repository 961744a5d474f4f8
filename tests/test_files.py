"""Files, settings and streams."""

import json

from pyspark.sql import functions as F

from quadrille.functions.morton import MortonCodec
from quadrille.operators import intergrid, tree
from quadrille.sinks import vtk
from quadrille.sources import config, dofs_json
from quadrille.sources import tables as S
from quadrille.streaming import points as P

CODEC = MortonCodec(2, 3)


def test_collection_and_steps(tmp_path):
    assert len(set(vtk.lagrange_quad_order(3))) == 16 and vtk.lagrange_quad_order(2)[:4] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    (tmp_path / "n_00012.vtk").write_text("")
    assert vtk.list_steps(str(tmp_path)) == [(12, "n_00012.vtk")]
    vtk.write_collection(str(tmp_path / "all.pvd"), [(0.5, "n_00012.vtk"), (0.5, "b"), (1.0, "c")])
    text = (tmp_path / "all.pvd").read_text()
    assert 'timestep="0.5" group="" part="1" file="b"' in text and 'timestep="1.0" group="" part="0" file="c"' in text


def test_json_dumps(spark, tmp_path):
    for t in (0, 1):
        for p in (0, 1, 2):
            dump = {"metadata": {"k": "v"}, "points": [[0, 0], [1, 0], [1, 1]], "connectivity": [[0, 1, 2]], "point_data": {"rho": [1.0, 2e11, 3.0]}}
            (tmp_path / f"dofs_t{t}_p{p}.json").write_text(json.dumps(dump))
    dumps = dofs_json.read_dumps(spark, str(tmp_path))
    rows = {(r.timestep, r.patch): r.connectivity for r in dofs_json.merged(dumps).collect()}
    assert rows[1, 2] == [[6, 7, 8]] and rows[0, 0] == [[0, 1, 2]] and len(rows) == 6
    plan = dofs_json.merged(dumps)._jdf.queryExecution().optimizedPlan().toString()
    assert all("points" not in line.split("windowspec")[0] for line in plan.split("\n") if "Window [" in line)
    found = intergrid.anomalies(dofs_json.point_table(dumps), ["value"]).first()
    assert (found.n, found.n_large, found.n_nan) == (18, 6, 0)


def test_settings():
    got = config.parse("order: 3  # nodes\nequation: 'euler'\n  cfl: 0.25\nother: 1\n")
    assert (got.order, got.equation, got.cfl, got.depth) == (3, "euler", 0.25, 7)


def test_streams(spark, sf_dir, tmp_path):
    stream = P.to_points(P.read_events(spark, f"{sf_dir}/event[s].parquet"))
    counts = P.windowed_counts(stream, S.CODEC, 3, "1 day")
    P.drain(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < closed <= S.read(spark, sf_dir, "events").count()

    def flags(leaves, batch):
        return S.point_flags(leaves, batch.select("x", "y"), S.PASSES[0], batch.count())

    leaves = P.refine_from(stream, tree.uniform(spark, S.CODEC, S.START_LEVEL), S.CODEC, flags, str(tmp_path / "refine"), S.MIN_LEVEL)
    assert tree.same_topology(leaves, S.leaf_set(spark, sf_dir, 1))


def test_llm_is_apart():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "quadrille"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+[.\w]*llm", path.read_text()), path


def test_offsets_across_blocks(spark):
    """Counts of 10,000 patches with gaps, and patches without points, against a plain running sum."""
    n = 10000
    dumps = spark.range(n).select(
        F.lit(3).alias("timestep"),
        (F.col("id") * 3).cast("int").alias("patch"),
        F.array_repeat(F.array(F.lit(0.0)), (F.col("id") % 5).cast("int")).alias("points"),
        F.array(F.array(F.lit(0))).alias("connectivity"),
        F.create_map(F.lit("a"), F.array(F.lit(1.0))).alias("point_data"),
    )
    got = {r.patch: r.connectivity[0][0] for r in dofs_json.merged(dumps).collect()}
    total = 0
    for k in range(n):
        assert got[3 * k] == total
        total += k % 5

"""Meshes as a data source: what is written is read, and what failed is not there."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from quadrille.functions import basis
from quadrille.sinks import meshes, vtk

BOX = ["x0", "y0", "dx", "dy"]


def _grid(spark, n=100, parts=4):
    x, y = F.col("id") % 10, F.floor(F.col("id") / 10)
    size = [F.lit(0.5).alias("dx"), F.lit(0.25).alias("dy")]
    return spark.range(0, n, 1, parts).select("id", (x * 0.5).alias("x0"), (y * 0.25).alias("y0"), *size, (F.col("id") / 8).alias("u"))


def _files(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".vtk")) if os.path.isdir(folder) else []


def _rows(frame):
    return sorted((r.id, r.type, r.x0, r.y0, r.z0, r.x1, r.y1, r.z1, r.u) for r in frame.collect())


def test_quads_round_trip(spark, tmp_path):
    folder = str(tmp_path / "a")
    meshes.write(_grid(spark), folder, near=["id"], cells_per_file=10)
    want = [(k, 9, k % 10 * 0.5, k // 10 * 0.25, 0.0, k % 10 * 0.5 + 0.5, k // 10 * 0.25 + 0.25, 0.0, k / 8) for k in range(100)]
    assert _rows(meshes.read(spark, folder)) == want
    assert len(_files(folder)) >= 10
    assert dict(meshes.read(spark, folder).dtypes)["id"] == "bigint"
    text = (tmp_path / "a" / "mesh.pvd").read_text()
    assert all(f in text for f in _files(folder))


def test_bytes_of_a_file(spark, tmp_path):
    meshes.write(_grid(spark, 2, 1), str(tmp_path), cells_per_file=5)
    data = (tmp_path / _files(tmp_path)[0]).read_bytes()
    assert data.startswith(b"# vtk DataFile Version 3.0\ncells\nBINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS 8 double\n")
    at = data.index(b"double\n") + 7
    assert struct.unpack(">12d", data[at : at + 96]) == (0, 0, 0, 0.5, 0, 0, 0.5, 0.25, 0, 0, 0.25, 0)
    at = data.index(b"CELLS 2 10\n") + 11
    assert struct.unpack(">10i", data[at : at + 40]) == (4, 0, 1, 2, 3, 4, 4, 5, 6, 7)
    at = data.index(b"SCALARS u double 1\nLOOKUP_TABLE default\n") + 40
    assert struct.unpack(">2d", data[at : at + 16]) == (0.0, 0.125)


def test_voxels(spark, tmp_path):
    cells = spark.range(8).select("id", *(F.shiftright("id", d).bitwiseAND(1).cast("double").alias(f"{a}0") for d, a in enumerate("xyz")), *(F.lit(1.0).alias(f"d{a}") for a in "xyz"))
    meshes.write(cells, str(tmp_path))
    found = {r.id: (r.type, r.x0, r.y0, r.z0, r.x1, r.y1, r.z1) for r in meshes.read(spark, str(tmp_path)).collect()}
    assert found == {k: (11, k & 1, k >> 1 & 1, k >> 2, (k & 1) + 1, (k >> 1 & 1) + 1, (k >> 2) + 1) for k in range(8)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_nodes_are_sampled(spark, tmp_path, order):
    """A polynomial of the basis' degree is met at every point of the lattice."""
    f = lambda x, y: 1 + x ** (order - 1) + 2 * y ** (order - 1)
    values = [F.lit(float(f(x, y))) for y, x in basis.tensor_points(order, 2)]
    cells = spark.range(3).select("id", F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"), F.array(*values).alias("u"))
    meshes.write(cells, str(tmp_path))
    for r in meshes.read(spark, str(tmp_path)).collect():
        lattice = vtk.lagrange_quad_order(order)
        assert r.type == 70 and r.u == pytest.approx([f(i / order, j / order) for i, j in lattice])
        assert (r.x0, r.x1) == (r.id, r.id + 1)


def test_failed_task_leaves_nothing(spark, tmp_path):
    """A job whose last task fails, after others have written, leaves no file of its own and no row."""
    folder = str(tmp_path / "a")
    meshes.write(_grid(spark, 20), folder)
    before = _files(folder)
    bad = _grid(spark).withColumn("x0", F.when(F.col("id") < 99, F.col("x0")))
    with pytest.raises(Exception, match="null or NaN"):
        meshes.write(bad, folder, cells_per_file=10)
    assert _files(folder) == before and meshes.read(spark, folder).count() == 20


def test_commit_takes_away_repeated_tasks(spark, tmp_path):
    """Files of the job that no task reports (a lost executor's) go; those of other jobs stay."""
    schema = _grid(spark).schema
    writer = meshes.MeshWriter(str(tmp_path), schema, False, {})
    batches = _grid(spark, 10, 1).toArrow().to_batches()
    lost, done = writer.write(iter(batches)), writer.write(iter(batches))
    other = meshes.MeshWriter(str(tmp_path), schema, False, {}).write(iter(batches))
    assert len(_files(tmp_path)) == 3
    writer.commit([None, done])
    assert _files(tmp_path) == sorted([done.files[0][0], other.files[0][0]]) and lost.files[0][0] not in _files(tmp_path)
    assert meshes.read(spark, str(tmp_path)).count() == 10


def test_append_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "a")
    meshes.write(_grid(spark, 30), folder)
    meshes.write(_grid(spark, 12), folder, timestep=1.5)
    assert meshes.read(spark, folder).count() == 42 and 'timestep="1.5"' in (tmp_path / "a" / "mesh.pvd").read_text()
    meshes.write(_grid(spark, 7, 1), folder, mode="overwrite")
    assert meshes.read(spark, folder).count() == 7 and len(_files(folder)) == 1


def test_a_box_opens_its_files_only(spark, tmp_path):
    folder = str(tmp_path / "a")
    meshes.write(_grid(spark), folder, near=["id"], cells_per_file=10)
    found = meshes.read(spark, folder, (1.1, 0.3, 1.4, 0.4))
    assert [r.id for r in found.collect()] == [12]
    reader = meshes.MeshReader(folder, found.schema, "1.1,0.3,1.4,0.4")
    every = meshes.MeshReader(folder, found.schema, None)
    assert len(reader.partitions()) <= 2 and len(every.partitions()) >= 10


def test_edge_cases(spark, tmp_path):
    meshes.write(_grid(spark, 3).limit(0), str(tmp_path / "empty"))
    assert meshes.read(spark, str(tmp_path / "empty")).count() == 0
    nulls = _grid(spark, 3, 1).withColumn("u", F.when(F.col("id") != 1, F.col("u")))
    meshes.write(nulls, str(tmp_path / "nulls"))
    assert meshes.read(spark, str(tmp_path / "nulls")).filter(F.isnan("u")).first().id == 1
    with pytest.raises(Exception, match="whole number is null"):
        meshes.write(nulls.withColumn("id", F.lit(None).cast("long")), str(tmp_path / "whole"))
    with pytest.raises(Exception, match="order x order"):
        meshes.write(nulls.withColumn("u", F.array(F.lit(1.0), F.lit(2.0))), str(tmp_path / "nodal"))
    with pytest.raises(Exception, match="needs the columns"):
        meshes.write(nulls.drop("dx"), str(tmp_path / "columns"))
    meshes.write(_grid(spark, 2, 1), str(tmp_path / "text"), ascii="true")
    text = (tmp_path / "text" / _files(tmp_path / "text")[0]).read_text()
    assert "ASCII" in text and "CELLS 2 10\n4 0 1 2 3\n4 4 5 6 7\n" in text and "0.5 0.25 0.0\n" in text
    with pytest.raises(Exception, match="text are not read"):
        meshes.read(spark, str(tmp_path / "text")).count()


def test_files_of_other_programs(spark, tmp_path):
    """Cells of two kinds, floats, and no list."""
    points = [(0, 0), (1, 0), (1, 1), (0, 1), (2, 0)]
    data = b"# vtk DataFile Version 3.0\nother\nBINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS 5 float\n"
    data += b"".join(struct.pack(">3f", x, y, 0) for x, y in points)
    data += b"\nCELLS 2 9\n" + struct.pack(">9i", 4, 0, 1, 2, 3, 3, 1, 4, 2) + b"\nCELL_TYPES 2\n" + struct.pack(">2i", 9, 5)
    data += b"\nCELL_DATA 2\nSCALARS is_halo int 1\nLOOKUP_TABLE default\n" + struct.pack(">2i", 0, 1)
    (tmp_path / "other.vtk").write_bytes(data)
    rows = meshes.read(spark, str(tmp_path)).orderBy("cell").collect()
    assert [(r.type, r.x0, r.x1, r.y1, r.is_halo) for r in rows] == [(9, 0, 1, 1, 0), (5, 1, 2, 1, 1)]

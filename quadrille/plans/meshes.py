"""Queries over meshes written by tasks and read back, beside their SQL; trees stand side by side along x."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from ..functions.geometry import Geometry
from ..operators import tree
from ..sinks import meshes, vtk
from ..sources import dofs_json
from ..sources import tables as S
from . import octree
from . import sql as Q

C2, C3 = S.CODEC, S.CODEC3
#: Lower, then upper corner of the box that ``mesh_box`` asks for; its borders meet no cell's.
BOX = (0.3001, 0.2001, 0.6001, 0.7001)
#: Of the files; corners, numbers of corners and keys of cells in order of space are much alike.
PACKED = "zstd"


def _folder(spark) -> str:
    return f"{S.shared_dir(spark)}/mesh-{uuid.uuid4().hex}"


def leaf_boxes(spark, sf: str) -> DataFrame:
    """Cells of the quadtrees of the events with their boxes, each tree a unit square.

    Patches are put in order of key, a row each; their cells follow from the arrays in order of j and i.
    """
    leaves = S.leaf_set(spark, sf)
    cells = S.cells_of(tree.sort_by_key(S.leaf_patches(spark, sf, leaves)), C2, S.PATCH)
    boxes = vtk.with_own_boxes(cells, C2, Geometry((1.0, 1.0), (S.PATCH,) * 2, C2.depth))
    return boxes.withColumn("x0", F.col("x0") + C2.tree(F.col("patch_id")))


def _corners(axes: str, unit: int) -> str:
    at = {a: f"{'g + ' if a == 'x' else ''}{{}} / {unit}" for a in axes}
    return ", ".join(
        f"({at[a].format(f'(c{a} + {s} * w)')})::DOUBLE AS {a}{s}" for s in (0, 1) for a in axes
    )


_LATTICE = ", ".join(f"({k}, {i / 2!r}::DOUBLE, {j / 2!r}::DOUBLE)" for k, (i, j) in enumerate(vtk.lagrange_quad_order(2)))
_DUMPS = f"""{Q.GRID},
point AS MATERIALIZED (SELECT g, (y // 8) * 8 + x // 8 AS patch, x, y, row_number() OVER (PARTITION BY g ORDER BY (y // 8) * 8 + x // 8, y, x) - 1 AS n FROM grid WHERE u > 0)"""


def register(query, checkpoints) -> None:
    """Adds the queries by the decorator of ``plans.queries``."""

    def r6(c: str):
        return F.round(c, 6) + F.lit(0.0)

    @query(f"WITH RECURSIVE {Q.LEAF_CELLS} SELECT 9 AS type, patch_id, j::BIGINT AS j, i::BIGINT AS i, {_corners('xy', 2048)}, {Q.r('u')} AS u FROM cells")
    def mesh_cells(spark, sf):
        """Quads of the quadtrees' cells, from the files that tasks wrote."""
        checkpoints(spark)
        folder = _folder(spark)
        meshes.write(leaf_boxes(spark, sf).select("patch_id", "j", "i", "x0", "y0", "dx", "dy", "u"), folder, share_corners=True, compression=PACKED)
        return meshes.read(spark, folder).select("type", "patch_id", "j", "i", "x0", "y0", "x1", "y1", r6("u").alias("u"))

    @query(
        f"WITH RECURSIVE {Q.LEAF_CELLS} SELECT patch_id, j::BIGINT AS j, i::BIGINT AS i, {Q.r('u')} AS u FROM cells "
        f"WHERE cx <= {BOX[2]} * 2048 AND cx + w >= {BOX[0]} * 2048 AND cy <= {BOX[3]} * 2048 AND cy + w >= {BOX[1]} * 2048 AND g = 0"
    )
    def mesh_box(spark, sf):
        """Cells of a mesh that meet a box: files elsewhere are not opened."""
        checkpoints(spark)
        folder = _folder(spark)
        boxes = leaf_boxes(spark, sf).select("patch_id", "j", "i", "x0", "y0", "dx", "dy", "u")
        meshes.write(boxes, folder, cells_per_file=4096, share_corners=True, compression=PACKED)
        return meshes.read(spark, folder, BOX).select("patch_id", "j", "i", r6("u").alias("u"))

    @query(f"{octree.CELLS_SQL} SELECT 11 AS type, patch_id, k::BIGINT AS k, j::BIGINT AS j, i::BIGINT AS i, {_corners('xyz', 128)}, {Q.r('u')} AS u FROM cells")
    def mesh_voxels(spark, sf):
        """Voxels of the octrees' cells, from the files that tasks wrote."""
        checkpoints(spark)
        leaves = S.octree(spark, sf)[0]
        cells = S.cells_of(tree.sort_by_key(S.octree_patches(spark, sf, leaves)), C3, S.PATCH3)
        boxes = vtk.with_own_boxes(cells, C3, Geometry((1.0, 1.0, 1.0), (S.PATCH3,) * 3, C3.depth))
        boxes = boxes.withColumn("x0", F.col("x0") + C3.tree(F.col("patch_id")))
        folder = _folder(spark)
        box = [f"{p}{a}" if p else f"{a}0" for p in ("", "d") for a in tree.AXES]
        meshes.write(boxes.select("patch_id", *tree.INDICES, *box, "u"), folder, share_corners=True, compression=PACKED)
        return meshes.read(spark, folder).select("type", "patch_id", *tree.INDICES, *meshes.BOUNDS, r6("u").alias("u"))

    @query(
        f"WITH {Q.GRID}, lattice(n, px, py) AS (VALUES {_LATTICE}) SELECT g, x, y, 70 AS type, n::INTEGER AS n, {Q.r('u * (1 + 0.2 * px + 0.1 * py)')} AS v FROM grid, lattice"
    )
    def mesh_nodes(spark, sf):
        """Nodal values of two by two Gauss points as Lagrange quads of nine points, in file order."""
        checkpoints(spark)
        values = [F.col("u") * F.lit(float(1 + 0.2 * px + 0.1 * py)) for py, px in basis.tensor_points(2, 2)]
        edge = F.lit(1 / S.EXTENT)
        cells = S.grid(spark, sf).select(
            "g", "x", "y", (F.col("g") + F.col("x") * edge).alias("x0"), (F.col("y") * edge).alias("y0"), edge.alias("dx"), edge.alias("dy"), F.array(*values).alias("v")
        )
        folder = _folder(spark)
        meshes.write(cells, folder, near=["g", "y", "x"], compression=PACKED)
        found = meshes.read(spark, folder).select("g", "x", "y", "type", F.posexplode("v").alias("n", "v"))
        return found.select("g", "x", "y", "type", "n", r6("v").alias("v"))

    @query(f"WITH {_DUMPS} SELECT g AS timestep, patch, n AS point, x::DOUBLE AS x, y::DOUBLE AS y FROM point")
    def dump_offsets(spark, sf):
        """Points of dumps, a patch of eight by eight places each, numbered through their step: the grids' places that hold something."""
        patch = F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8)
        held = S.grid(spark, sf).filter("u > 0").groupBy(F.col("g").alias("timestep"), patch.alias("patch"))
        points = F.array_sort(F.collect_list(F.struct("y", "x")))
        dumps = held.agg(points.alias("p")).select(
            "timestep",
            "patch",
            F.transform("p", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))).alias("points"),
            F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.array(k)).alias("connectivity"),
            F.create_map(F.lit("none"), F.array(F.lit(0.0))).alias("point_data"),
        )
        pairs = F.explode(F.arrays_zip("points", F.flatten("connectivity").alias("numbers"))).alias("r")
        rows = dofs_json.merged(dumps).select("timestep", "patch", pairs)
        return rows.select("timestep", "patch", F.col("r.numbers").alias("point"), F.col("r.points")[0].alias("x"), F.col("r.points")[1].alias("y"))

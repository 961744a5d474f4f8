"""Queries that look up stored patches by place, box and key, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup
from ..sources import tables as S
from . import sql as Q
from . import stored

#: A box of the first tree, low and high corner (x, y) on the finest grid of 128 places a side.
LOW, HIGH = (21, 40), (77, 71)

_ORDERS = "orders_at AS (SELECT o_orderkey AS o, o_orderkey // 4096 AS g, o_custkey % 128 AS x, o_orderkey % 128 AS y FROM orders)"


def register(query, checkpoints) -> None:
    """Adds the queries by the decorator of ``plans.queries``."""

    def patches(spark, sf):
        checkpoints(spark)
        leaves = S.leaf_set(spark, sf)
        return stored.stored(spark, S.CODEC, leaves, S.leaf_patches(spark, sf, leaves))

    @query(
        f"""WITH RECURSIVE {Q.LEAF_CELLS}, {_ORDERS},
around AS MATERIALIZED (SELECT o, g, x, y, s, x - x % s AS lx, y - y % s AS ly FROM orders_at, (SELECT 1::BIGINT << range AS s FROM range(8))),
held AS MATERIALIZED (SELECT a.o, l.patch_id, l.level, (a.x - l.x) * 8 // l.s AS i, (a.y - l.y) * 8 // l.s AS j
  FROM around a JOIN leaf3 l ON l.g = a.g AND l.s = a.s AND l.x = a.lx AND l.y = a.ly)
SELECT h.o, h.patch_id, h.level, {Q.r('c.u')} AS u FROM held h JOIN cells c ON c.patch_id = h.patch_id AND c.j = h.j AND c.i = h.i"""
    )
    def place_lookup(spark, sf):
        """The patch that holds each order's place, and the value of its cell there."""
        orders = S.read(spark, sf, "orders").select(
            F.col("o_orderkey").alias("o"), S.group("o_orderkey").alias("g"), (F.col("o_custkey") % 128).alias("x"), (F.col("o_orderkey") % 128).alias("y")
        )
        found = lookup.by_places(patches(spark, sf), "patches", orders, F.col("g"))
        codec, key = S.CODEC, F.col("patch_id")
        level = codec.level(key)
        i, j = (F.floor((F.col(a) - c) * S.PATCH / codec.side(level)) for a, c in zip("xy", codec.coords(key), strict=True))
        value = F.get("u", (j * S.PATCH + i).cast("int"))
        return found.select("o", "patch_id", level.alias("level"), (F.round(value, 6) + F.lit(0.0)).alias("u"))

    @query(
        f"""WITH RECURSIVE {Q.LEAF_CELLS}
SELECT patch_id, count(*) AS n, {Q.r('sum(u)')} AS total FROM cells WHERE patch_id IN (SELECT patch_id FROM leaf3
  WHERE g = 0 AND x < {HIGH[0]} AND x + s > {LOW[0]} AND y < {HIGH[1]} AND y + s > {LOW[1]}) GROUP BY patch_id"""
    )
    def box_lookup(spark, sf):
        """Patches of the first tree that meet a box, with the sum of their cells."""
        found = lookup.by_box(patches(spark, sf), "patches", LOW, HIGH)
        total = F.aggregate("u", F.lit(0.0), lambda a, v: a + v)
        return found.select("patch_id", F.size("u").cast("long").alias("n"), (F.round(total, 6) + F.lit(0.0)).alias("total"))

    @query(
        f"""WITH RECURSIVE {Q.LEAF_CELLS}, corner AS (SELECT g, 32 AS x, 64 AS y FROM (SELECT DISTINCT g FROM leaf3 WHERE g IN (0, 1, 3)))
SELECT l.patch_id, c.j::INTEGER AS j, c.i::INTEGER AS i, {Q.r('c.u')} AS u FROM corner k JOIN leaf3 l ON l.g = k.g AND l.x = k.x AND l.y = k.y JOIN cells c ON c.patch_id = l.patch_id"""
    )
    def key_lookup(spark, sf):
        """Cells of the patches whose corner is at (32, 64) in the trees 0, 1 and 3, whatever their level."""
        codec = S.CODEC
        keys = [codec.key((32, 64), level, g) for g in (0, 1, 3) for level in range(2, codec.depth + 1)]
        found = lookup.by_keys(patches(spark, sf), "patches", keys).select("patch_id", F.posexplode("u").alias("k", "v"))
        return found.select(
            "patch_id", F.floor(F.col("k") / S.PATCH).cast("int").alias("j"), (F.col("k") % S.PATCH).cast("int").alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("u")
        )

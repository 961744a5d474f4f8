"""Leaves, neighbours and patches stored by key range.

A store keeps tables partitioned by zone, the range of keys under one cell of a coarse level, and
bucketed: leaves and patches by patch_id, links (neighbours across faces) by n_id.  A halo exchange
then joins links with patches bucket by bucket, without an exchange of either.  A pass of refinement
reads the zones at and beside what changes and rewrites those alone; the neighbour table follows by
its delta.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.morton import LEVEL_BITS, MortonCodec
from ..sources.tables import shared_dir
from . import tree

#: The key that a table is bucketed by.
KEYS = {"leaves": "patch_id", "links": "n_id", "patches": "patch_id"}


@dataclass(frozen=True)
class Change:
    """What a pass read and wrote: zones with changed leaves, those with changed links, and rows read of both tables."""

    leaf_zones: int
    link_zones: int
    leaves_read: int
    links_read: int


class Store:
    """Tables of one leaf set in a folder of the shared folder; ``zone_level`` is at most the coarsest leaf's level.

    ``buckets`` is how many tasks a join of two tables has, so it should grow with them.  Zones are the unit
    of rewriting, so there should be many more than a pass changes, and each should hold some MB: below 0, a
    level's zones hold several whole trees (of rank 2, four at -1, sixteen at -2).
    """

    def __init__(self, spark: SparkSession, codec: MortonCodec, zone_level: int, buckets: int = 4):
        self.spark, self.codec, self.zone_level, self.buckets = spark, codec, zone_level, buckets
        self.name = f"quadrille_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.name}"

    def zone(self, key: Column) -> Column:
        """The number of a key's zone: its tree and the code of its ancestor."""
        return F.shiftright(key, self._zone_bits)

    def zone_of(self, key: int) -> int:
        """``zone`` of a plain number."""
        return key >> self._zone_bits

    @property
    def _zone_bits(self) -> int:
        return LEVEL_BITS + self.codec.rank * (self.codec.depth - self.zone_level)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _dealt(self, frame: DataFrame, table: str) -> DataFrame:
        """By bucket, so that each task writes one file a zone."""
        zoned = frame.withColumn("zone", self.zone(F.col("patch_id")))
        return zoned.repartition(self.buckets, KEYS[table])

    def save(self, table: str, frame: DataFrame, row_group_bytes: int | None = None) -> DataFrame:
        """Writes a whole table; ``frame`` has no column ``zone``.  Patches' files also carry a Bloom filter of their keys."""
        writer = self._dealt(frame, table).write.partitionBy("zone").bucketBy(self.buckets, KEYS[table]).sortBy(KEYS[table])
        if table == "patches":
            writer.options(**{"parquet.bloom.filter.enabled#patch_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
        if row_group_bytes:
            writer.option("parquet.block.size", str(row_group_bytes))
        writer.option("path", f"{self.folder}/{table}").saveAsTable(f"{self.name}_{table}")
        return self.read(table)

    def replace(self, table: str, frame: DataFrame) -> None:
        """Rewrites the zones that ``frame`` has rows of, and no other."""
        mode, conf = "spark.sql.sources.partitionOverwriteMode", self.spark.conf
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            columns = self.read(table).columns
            self._dealt(frame, table).select(*columns).write.insertInto(f"{self.name}_{table}", overwrite=True)
        finally:
            conf.set(mode, before)
        self.spark.catalog.refreshTable(f"{self.name}_{table}")

    def create(self, leaves: DataFrame) -> None:
        """Stores a leaf set and its neighbours."""
        own = self.save("leaves", leaves.select("patch_id"))
        self.save("links", tree.neighbors(own, self.codec))

    def drop(self) -> None:
        """Removes the tables and their files; frames read from them are of no use afterwards."""
        for table in KEYS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def leaves(self) -> DataFrame:
        return tree.with_coords(self.read("leaves"), self.codec)

    def links(self) -> DataFrame:
        return self.read("links").select("patch_id", "dir", "relation", "n_id")

    def _staged(self, frame: DataFrame, name: str) -> DataFrame:
        """A written table: what a pass reads is replaced, so its results are worked out before."""
        path = f"{self.folder}/staged-{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _zones(self, keys: DataFrame, column: str = "patch_id") -> set[int]:
        """Zone numbers, as many as the tables have partitions at most."""
        return {r.zone for r in keys.select(self.zone(F.col(column)).alias("zone")).distinct().collect()}

    def advance(self, refined: DataFrame, families: DataFrame) -> Change:
        """One pass: ``refined`` leaves and ``families`` (as of ``tree.plan_regrid``) change the stored tables."""
        gone, born = (self._staged(x, n) for x, n in zip(tree.changes(refined, families, self.codec), ("gone", "born"), strict=True))
        own = self._zones(gone)
        if not own:
            return Change(0, 0, 0, 0)
        # What is born touches only what the leaves before it touched.
        beside = self.read("links").filter(F.col("zone").isin(sorted(own))).join(gone, "patch_id", "left_semi")
        touched = own | self._zones(beside, "n_id")
        seen = {t: Observation(f"{t}_{uuid.uuid4().hex}") for t in ("leaves", "links")}
        part = {t: self.read(t).filter(F.col("zone").isin(sorted(touched))).observe(o, F.count(F.lit(1)).alias("n")) for t, o in seen.items()}
        leaves = self._staged(part["leaves"].select("patch_id").join(gone, "patch_id", "left_anti").unionByName(born), "leaves")
        fresh = self._staged(tree.neighbors(leaves, self.codec, born), "fresh")
        links = self._staged(tree.updated_neighbors(part["links"], leaves, gone, born, self.codec, fresh), "links")
        self.replace("links", links)
        self.replace("leaves", leaves.filter(self.zone(F.col("patch_id")).isin(sorted(own))))
        return Change(len(own), len(touched), *(seen[t].get["n"] for t in ("leaves", "links")))

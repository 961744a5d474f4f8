"""Near-duplicate groups by circulant MinHash, banding, exact Jaccard checks and components.

A document's set is its distinct word shingles.  Two permutations of the 32-bit numbers give all
signature coordinates: the first places a shingle, coordinate k takes the second at that place
shifted by k around the circle.  Both are arithmetic, so no universe fills up however long a text
is.  One byte of each coordinate is kept; a band is some consecutive bytes.

Every pair that shares a band is a candidate and none is dropped on its signature.  A sketch of how
many shingles fall into each of 256 parts of the hash space bounds the intersection of two sets from
above, so what it rules out cannot be similar; what it does not is compared on full sets.

1. Documents with equal sets become one class.
2. In each bucket all classes are checked against the smallest, which is linear and joins most of a
   large group of near copies.  Links that pass give components.
3. Buckets that still hold several components: members of different components are looked at, by the
   sketch alone.  Buckets of many members are first parted by their members' rarest shingles (sets
   that are similar share one of the rarest ones, so no pair is lost), and what is still large is
   cut into blocks.  Each group hands on a forest of possible pairs, never all pairs.
4. Members that forests connect meet in one group, or in blocks of it, with their texts; full sets
   decide, and links that are confirmed are handed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

ROWS, BANDS = 6, 40
#: Parts of the hash space that a sketch counts; a count of 255 stands for 255 or more.
PARTS = 256
#: Members of one head that are checked together.
PAIRS_PER_SALT = 1_000
#: Members and shingles of one block of a group; larger groups are cut into blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 800, 4_000_000
BLOCK_BYTES = 4 << 20
#: Shingles whose coordinates are worked out at once: they stay in the processor's cache.
CHUNK = 1 << 13
_SEED = 20240229

#: Everything but ``[\x20\x09-\x0D]`` belongs to words.
CLASSES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], np.uint8)

_NULL_ID = -(1 << 63)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``size`` words.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    t = common.hash_tokens([x.lower() for x in texts], CLASSES)
    n, words = len(t.hashes), np.diff(t.offsets)
    step = np.uint64(0x2545F4914F6CDD1D)
    acc = np.zeros(n, np.uint64)
    short: dict[int, np.ndarray] = {}
    for j in range(size):
        acc = common.mix64(acc[: max(0, n - j)] * step + t.hashes[j:])
        short[j + 1] = acc
    out = []
    for a, m in zip(t.offsets.tolist(), words.tolist(), strict=False):
        if m == 0:
            out.append(np.zeros(0, np.uint64))
        elif m < size:
            out.append(common.mix64(short[m][a : a + 1] + np.uint64(m)))
        else:
            out.append(np.unique(acc[a : a + m - size + 1]))
    return out


class CirculantMinHash:
    """Signatures of ``k`` coordinates from two permutations of 32-bit numbers, the second shifted."""

    def __init__(self, k: int, seed: int = _SEED):
        self.k = k
        rng = np.random.default_rng(seed)
        odd = rng.integers(1 << 31, size=3) * 2 + 1
        self.first, self.factor, self.last = (np.uint32(x) for x in odd)

    def place(self, shingles: np.ndarray) -> np.ndarray:
        """The first permutation, of the upper half of a hash."""
        x = (shingles >> np.uint64(32)).astype(np.uint32) * self.first
        return x ^ (x >> np.uint32(16))

    def second(self, at: np.ndarray) -> np.ndarray:
        """The second permutation."""
        x = at * self.factor
        x ^= x >> np.uint32(15)
        x *= self.last
        x ^= x >> np.uint32(13)
        return x

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; all of a set's shingles are read. Empty sets get the largest value."""
        out = np.full((len(sets), self.k), np.iinfo(np.uint32).max, np.uint32)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        # A shift by k before the second permutation's factor is a shift by k * factor after it.
        places = self.place(np.concatenate([sets[i] for i in full])) * self.factor
        shifts = (np.arange(self.k, dtype=np.uint64) * np.uint64(self.factor)).astype(np.uint32)
        ends = np.cumsum(sizes[full])
        x, y = np.empty(CHUNK, np.uint32), np.empty(CHUNK, np.uint32)
        for a in range(0, len(places), CHUNK):
            b = min(a + CHUNK, len(places))
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1
            starts = np.maximum(np.concatenate([[0], ends[i : j - 1]]) if i == 0 else ends[i - 1 : j - 1], a) - a
            own, u, v = places[a:b], x[: b - a], y[: b - a]
            least = np.empty((self.k, j - i), np.uint32)
            for k, shift in enumerate(shifts):
                np.add(own, shift, out=u)
                np.right_shift(u, np.uint32(15), out=v)
                np.bitwise_xor(u, v, out=u)
                np.multiply(u, self.last, out=u)
                np.right_shift(u, np.uint32(13), out=v)
                np.bitwise_xor(u, v, out=u)
                np.minimum.reduceat(u, starts, out=least[k])
            out[full[i:j]] = np.minimum(out[full[i:j]], least.T)
        return out


def low_bytes(signatures: np.ndarray) -> np.ndarray:
    """The lowest byte of each coordinate."""
    return (signatures & np.uint32(0xFF)).astype(np.uint8)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set: how many of its shingles fall into each part, 255 at most."""
    out = np.zeros((len(sets), PARTS), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.minimum(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255)
    return out


def possible(sketch: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of other sets can be similar to one of ``n`` shingles, by an upper bound of what they share."""
    more = (np.maximum(others, sketch) - others).sum(axis=1, dtype=np.int64)
    less = (np.maximum(others, sketch) - sketch).sum(axis=1, dtype=np.int64)
    both = np.minimum(n - more, sizes - less)
    return 100 * both >= percent * (n + sizes - both)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| of sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _describe(size: int, coordinates: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = CirculantMinHash(coordinates)
        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            for a, b in common.blocks(texts, BLOCK_BYTES):
                sets = shingle_sets(texts[a:b], size)
                bodies = np.hstack([low_bytes(minhash.signatures(sets)), sketches(sets)])
                h1 = np.array([common.mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([np.bitwise_xor.reduce(s * s) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array([x.tobytes() for x in bodies], pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "body"],
                )

    return work


def _explode_shingles(size: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per shingle of each text; ``whole`` tells several texts of one member apart."""
        for batch in batches:
            for member, text in zip(batch.column("member").to_pylist(), common.texts_of(batch.column("text")), strict=True):
                own = shingle_sets([text], size)[0].view(np.int64)
                whole = int(own.sum())
                for i in range(0, len(own), 1 << 17):
                    part = own[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), x, np.int64)) if x is not part else pa.array(part) for x in (member, whole, part, len(own))],
                        names=["member", "whole", "shingle", "n"],
                    )

    return work


def _blocked(members: DataFrame, ws: common.Workspace) -> DataFrame:
    """Rows of (key, member, n, ...) with ``left`` and ``right`` blocks: any two members of a group meet in
    one block or pair of blocks at least, and a block has about BLOCK_MEMBERS members at most."""
    share = F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)
    sizes = members.groupBy("key").agg(F.ceil(share).cast("int").alias("cut")).filter("cut > 1")
    cut = members.join(ws.written(sizes, "large-groups"), "key", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    own = F.pmod(F.xxhash64("member"), F.col("cut")).cast("int")
    return (
        cut.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .withColumn("left", F.least("own", "other"))
        .withColumn("right", F.greatest("own", "other"))
        .drop("cut", "own", "other")
    )


_GROUP = ["key", "left", "right"]


class _Union:
    """Which of some numbered things are joined."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def top(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = i = self.of[self.of[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """False where they are joined already."""
        i, j = self.top(i), self.top(j)
        self.of[max(i, j)] = min(i, j)
        return i != j


def _across(n: np.ndarray, component: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of members of different components that can be similar."""
    order = np.argsort(n, kind="stable")
    sizes, parts, kinds = n[order], sketch[order], component[order]
    for i in range(len(order)):
        stop = np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
        j = np.flatnonzero(kinds[i + 1 : stop] != kinds[i]) + i + 1
        if len(j):
            for k in j[possible(parts[i], sizes[i], parts[j], sizes[j], percent)].tolist():
                yield int(order[i]), int(order[k])


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _forests(percent: int, first: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A forest of the possible pairs across components of each group."""
        for group in common.grouped(batches, _GROUP):
            component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
            if component.max() == 0:
                continue
            member, n = group["member"].to_numpy(), group["n"].to_numpy()
            sketch = np.frombuffer(b"".join(group["body"].to_pylist()), np.uint8).reshape(len(member), -1)[:, first:]
            union, found = _Union(len(member)), []
            for i, j in _across(n, component, sketch, percent):
                if union.join(i, j):
                    found.append((int(member[i]), int(member[j])))
            if found:
                yield _rows(found, ["u", "v"])

    return work


def _links(size: int, percent: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Confirmed links between members of a group that are in different components."""
        for group in common.grouped(batches, _GROUP):
            component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
            if component.max() == 0:
                continue
            member = group["member"].to_numpy()
            sets = shingle_sets(common.texts_of(group["text"]), size)
            n = np.array([len(s) for s in sets])
            union, found = _Union(int(component.max()) + 1), []
            for i, j in _across(n, component, sketches(sets), percent):
                a, b = union.top(int(component[i])), union.top(int(component[j]))
                if a != b and similar(sets[i], sets[j], percent):
                    union.join(a, b)
                    found.append((int(member[i]), int(member[j])))
            if found:
                yield _rows(found, ["u", "v"])

    return work


def _with_head(read, alike):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, the head's own before those that it is compared with."""
        group, own = None, []
        for batch in batches:
            heads, salts, members = (batch.column(c).to_pylist() for c in ("head", "salt", "member"))
            found = []
            for i, value in enumerate(read(batch)):
                if (heads[i], salts[i]) != group:
                    group, own = (heads[i], salts[i]), []
                if members[i] is None:
                    own.append(value)
                elif any(alike(value, o) for o in own):
                    found.append((heads[i], members[i]))
            yield _rows(found, ["head", "member"])

    return work


def _by_head(pairs: DataFrame, table: DataFrame, work, ws: common.Workspace) -> DataFrame:
    """Pairs (head, member) that ``work`` finds alike, with the columns of ``table`` (doc_id, ...).

    The head's row goes once to every thousand of its members or so, whatever their number.
    """
    counts = ws.written(
        pairs.groupBy("head").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts")), "heads"
    )
    salted = pairs.join(counts.hint("merge"), "head").select(
        F.col("member").alias("doc_id"), "head", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member"
    )
    heads = counts.select(
        F.col("head").alias("doc_id"),
        "head",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("member"),
    )
    found = salted.unionByName(heads).join(table.hint("merge"), "doc_id").drop("doc_id")
    dealt = found.repartition("head", "salt").sortWithinPartitions("head", "salt", F.asc_nulls_first("member"))
    return common.map_batches(dealt, work, "head long, member long")


def _read_sketches(first: int):
    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for n, body in zip(batch.column("n").to_pylist(), batch.column("body").to_pylist(), strict=True):
            yield n, np.frombuffer(body, np.uint8)[first:]

    return read


def _read_sets(size: int):
    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = common.texts_of(batch.column("text"))
        for a, b in common.blocks(texts, BLOCK_BYTES):
            yield from shingle_sets(texts[a:b], size)

    return read


def _possible_pair(percent: int):
    return lambda x, y: bool(possible(x[1], x[0], y[1][None, :], np.array([y[0]]), percent)[0])


def _parted(members: DataFrame, texts: DataFrame, size: int, percent: int, ws: common.Workspace) -> DataFrame:
    """(key, member): groups by rare shingles, in one of which any two similar sets meet.

    In an order of shingles (rarest among these members first) two sets of which ``percent`` agree
    share one of the first n - ceil(n * percent / 100) + 1 of either set.
    """
    own = texts.join(members.select(F.col("member").alias("doc_id")).hint("merge"), "doc_id")
    rows = ws.written(
        common.map_batches(own.select(F.col("doc_id").alias("member"), "text"), _explode_shingles(size), "member long, whole long, shingle long, n long"),
        "shingles",
    )
    often = ws.written(rows.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1"), "shingle-counts")
    # Shingles of one member alone link nothing, but count among the first ones.
    rare = rows.join(often.hint("merge"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("member", "whole").orderBy("often", "shingle"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rare.withColumn("place", place).filter((F.col("place") <= first) & (F.col("often") > 1)).select(
        F.col("shingle").alias("key"), "member"
    )


def _mixed(rows: DataFrame, ws: common.Workspace) -> DataFrame:
    """Of (key, member, component) the groups that hold several components; with the group's ``size``."""
    keys = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"))
    return rows.join(ws.written(keys.filter("x < y").select("key", "size"), "mixed-groups").hint("merge"), "key")


def near_groups(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_members: int = BLOCK_MEMBERS,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links.  Null texts and texts without words
    have no shingles and no links.  Rows of one doc_id are one document; a null doc_id counts as one
    document, smaller than all, whose component_id is null.  An empty table gives no rows.

    Groups of more than ``block_members`` are parted by rare shingles.  Joins of tables that grow with
    the corpus ask for merge joins: their plan is the same at any size.  At most 64 bands.
    """
    base = common.id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    with common.Workspace(docs.sparkSession, "near-dedup") as ws:
        return ws.result(_groups(base, shingle, percent, rows, bands, block_members, ws))


def _groups(base: DataFrame, shingle: int, percent: int, rows: int, bands: int, many: int, ws: common.Workspace) -> DataFrame:
    first = rows * bands  # where the sketch begins in a body
    schema = "doc_id long, n long, h1 long, h2 long, body binary"
    sets = ws.written(common.map_batches(base, _describe(shingle, first), schema), "shingle-sets")
    full = sets.filter("n > 0")
    classes = ws.written(
        full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("body").alias("body")), "set-classes"
    )
    # Each document with the smallest document of the same set.
    members = ws.written(
        full.select("doc_id", "n", "h1", "h2")
        .join(classes.select("n", "h1", "h2", F.col("doc_id").alias("rep")).hint("merge"), ["n", "h1", "h2"])
        .select("doc_id", "rep")
        .distinct(),
        "set-members",
    )
    # Documents of several rows with different sets hold those classes together.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).filter("v < w").select("doc_id", "v")
    ties = members.join(several, "doc_id").select(F.col("rep").alias("u"), "v")

    # A bucket's key holds the band in its lowest six bits.
    def key(i: int) -> Column:
        own = F.xxhash64(F.substring("body", i * rows + 1, rows))
        return F.shiftleft(F.shiftright(own, 6), 6).bitwiseOR(F.lit(i).cast("long"))

    keyed = classes.select(F.col("doc_id").alias("member"), F.explode(F.array(*(key(i) for i in range(bands)))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("member").alias("head"), F.max("member").alias("y")).filter("head < y").drop("y")
    shared = ws.written(keyed.join(ws.written(buckets, "buckets").hint("merge"), "key"), "shared-buckets")
    star = ws.written(shared.filter("member <> head").select("head", "member").distinct(), "stars")
    bodies = classes.select("doc_id", "n", "body")
    able = _by_head(star, bodies, _with_head(_read_sketches(first), _possible_pair(percent)), ws)
    able = ws.written(able, "possible-stars")
    wanted = able.select(F.explode(F.array("head", "member")).alias("doc_id")).distinct()
    texts = ws.written(base.join(wanted.hint("merge"), "doc_id"), "star-texts")
    alike = _by_head(able, texts, _with_head(_read_sets(shingle), lambda a, b: similar(a, b, percent)), ws)
    links = ws.written(alike.distinct().select(F.col("member").alias("u"), F.col("head").alias("v")).unionByName(ties), "links")
    found = connected_components(links, ws)

    # Buckets that still hold members of several components.
    labels = found.select(F.col("node").alias("member"), "component").hint("merge")
    component = F.coalesce("component", "member").alias("component")
    labelled = shared.join(labels, "member", "left").select("key", "member", component)
    mixed = ws.written(_mixed(labelled, ws), "mixed")
    large = ws.written(mixed.filter(F.col("size") > many).select("member").distinct(), "members-of-large-buckets")
    small = mixed.filter(F.col("size") <= many).drop("size")
    if not large.isEmpty():
        parts = _parted(large, base, shingle, percent, ws).join(labels, "member", "left").select("key", "member", component)
        small = small.unionByName(_mixed(ws.written(parts, "parts"), ws).drop("size"))
    placed = small.join(bodies.withColumnRenamed("doc_id", "member").hint("merge"), "member")
    dealt = _blocked(ws.written(placed, "placed"), ws).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    forest = ws.written(common.map_batches(dealt, _forests(percent, first), "u long, v long").distinct(), "forest")
    if not forest.isEmpty():
        trees = connected_components(forest, ws)
        ids = forest.select(F.explode(F.array("u", "v")).alias("member")).distinct()
        open_ = (
            ids.join(trees.select(F.col("node").alias("member"), F.col("component").alias("key")).hint("merge"), "member", "left")
            .join(labels, "member", "left")
            .join(classes.select(F.col("doc_id").alias("member"), "n").hint("merge"), "member")
            .select("member", F.coalesce("key", "member").alias("key"), component, "n")
        )
        own = base.withColumnRenamed("doc_id", "member").hint("merge")
        dealt = _blocked(ws.written(open_, "open"), ws).join(own, "member").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        more = ws.written(common.map_batches(dealt, _links(shingle, percent), "u long, v long"), "more-links")
        if not more.isEmpty():
            found = connected_components(links.unionByName(more), ws)

    of = members.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(
        found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left"
    )
    of = of.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    null = lambda c: F.nullif(c, F.lit(_NULL_ID))
    return (
        sets.select("doc_id", "n")
        .join(of.hint("merge"), "doc_id", "left")
        .select(
            null(F.col("doc_id")).alias("doc_id"),
            F.col("n").alias("n_shingles"),
            null(F.coalesce("component_id", "doc_id")).alias("component_id"),
            (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
        )
    )


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; same columns.

    Texts without words, null ones too, all stay.  All rows of a doc_id that stays do; null doc_ids
    are one document.  Other columns may have any names.  An empty table gives an empty one.
    """
    placed, (id_name,) = common.by_place(docs, options.get("id_col", "doc_id"))
    kept = near_groups(docs, shingle, percent, **options).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return common.as_before(placed.join(kept, F.col(id_name).cast("long").eqNullSafe(F.col("kept_id")), "left_semi"), docs)

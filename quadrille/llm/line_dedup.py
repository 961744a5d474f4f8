"""Line dedup with DataFrame functions only.

Lines become 128-bit hashes of their normalised form in one slim table; documents are counted per
hash with partial aggregates (a line in a third of all rows sends one row a task), hashes over the
threshold are joined back to the lines' places, and each document is put together again by the places
that stay.  All of it is linear in a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
_NULL_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return common.lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _hashes(lines: Column, min_chars: int) -> Column:
    """Place and hash (128 bits: two with different seeds) of each line that is long enough to count."""
    hashed = F.transform(
        F.transform(lines, line_key),
        lambda k, i: F.when(
            F.length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))
        ),
    )
    return F.filter(hashed, lambda h: h.isNotNull())


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 10,
    min_docs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text (lines that stay, joined), n_lines, n_dropped for every row.

    Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose
    all their lines but those of the smallest doc_id that holds them.  Null or empty text is one
    empty line and becomes the empty text.  Rows with one doc_id count as one document; a null
    doc_id counts as one document, the smallest.  An empty table gives no rows.
    """
    base = common.id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Rows of one doc_id are told apart by their text.
    base = base.select("doc_id", F.xxhash64("text").alias("row"), "text")
    keys = common.written(
        base.select("doc_id", "row", _hashes(F.split("text", "\n"), min_chars).alias("keys")).filter(F.size("keys") > 0), "line-keys"
    )
    pairs = keys.select("doc_id", "row", F.explode("keys").alias("key")).select("doc_id", "row", "key.*")
    # Two documents at least: smallest and largest id differ, one aggregate without a distinct.
    many = F.min("doc_id") < F.max("doc_id") if min_docs == 2 else F.count_distinct("doc_id") >= min_docs
    # A table of its own, so that both sides of the join below are plain exchanges, which adaptive
    # execution splits where one line fills a partition.
    common_keys = common.written(
        pairs.groupBy("a", "b").agg(F.min("doc_id").alias("keeper"), many.alias("many")).filter("many").drop("many"),
        "common-lines",
    )
    dropped = (
        pairs.join(common_keys, ["a", "b"])
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "row")
        .agg(F.collect_list("pos").alias("drop"))
    )
    # Places that stay, in order: whole numbers go through a hash set, so this is linear in the lines.
    lines = F.split("text", "\n")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    stay = F.when(F.col("drop").isNotNull(), F.array_except(places, "drop"))
    return (
        base.join(dropped, ["doc_id", "row"], "left")
        .select("doc_id", "text", lines.alias("lines"), stay.alias("stay"))
        .select(
            F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"),
            F.when(F.col("stay").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
            .alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("stay").isNull(), 0).otherwise(F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        )
    )

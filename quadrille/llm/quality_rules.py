"""Quality rules with DataFrame functions only: counted rules, then a log-likelihood ratio.

Texts become hashed unigrams and bigrams of words and runs of punctuation.  Two multinomials over
the buckets are estimated, one from trusted documents and one from the whole corpus, and a document
is kept if the mean log ratio of its n-grams, an exact sum of integers, reaches a threshold.  Both
passes read the texts once; what is shuffled is a row a bucket and task, then a row a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets of n-grams; the weights are broadcast, so this bounds their size.
BUCKETS = 1 << 16
#: Documents of the trusted multinomial at most, those with the smallest crc32 of doc_id.
TRUSTED_ROWS = 20_000
#: Trusted n-grams spread evenly over each bucket, in both multinomials: shrinks rare buckets to 0.
PRIOR = 5
#: Least mean log ratio (nats an n-gram) of a kept document.
THRESHOLD = -0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Log ratios are whole numbers of this part of a nat, so that sums do not depend on their order.
UNIT = 1_000_000
#: Bits of a number that are a window's place in its text; the rest are of its hash.
PLACE_BITS = 24

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
LETTERS = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
MARKS = r"\p{Punct}+"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ngrams(text: Column) -> tuple[Column, Column]:
    """crc32 of a text's tokens, and of the column that this is put in (``crc``) the buckets.

    Tokens are the runs of letters and digits in order, then the runs of punctuation in order.
    """
    crc = F.transform(F.concat(_all(text, LETTERS), _all(text, MARKS)), lambda t: F.crc32(t.cast("binary")))
    own = F.transform("crc", lambda c: F.pmod(c, F.lit(BUCKETS)))
    pairs = F.transform(
        F.slice("crc", 2, F.greatest(F.size("crc") - 1, F.lit(0))),
        lambda c, i: F.pmod(F.get("crc", i) * 31 + c, F.lit(BUCKETS)),
    )
    return crc, F.concat(own, pairs)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id of at most ``most`` documents labelled as good and not as toxic."""
    placed, (key, quality, toxic) = common.by_place(labels, "doc_id", "quality", "toxic")
    good = placed.filter((F.col(quality) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0) & F.col(key).isNotNull())
    ids = good.select(F.col(key).cast("long").alias("doc_id")).distinct()
    return ids.orderBy(common.fold_column(F.col("doc_id"), 1 << 32), "doc_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """bucket, weight: whole millionths of the log of trusted share over corpus share.

    Shares are mixed with an even one by the same part, ``PRIOR`` trusted n-grams a bucket: buckets
    that trusted documents hardly reach weigh about 0, frequent ones their plain ratio.  Every
    document counts in the corpus; a doc_id with several rows is trusted in each.
    """
    crc, buckets = ngrams(F.coalesce("text", F.lit("")))
    chosen = F.broadcast(trusted_ids(labels, trusted_rows).withColumn("trusted", F.lit(1)))  # trusted_rows at most
    counts = (
        common.id_and_text(docs)
        .join(chosen, "doc_id", "left")
        .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), crc.alias("crc"))
        .select("trusted", F.explode(buckets).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("corpus"), F.sum("trusted").alias("trusted"))
    )
    whole = Window.partitionBy()  # BUCKETS rows at most
    n, t = F.sum("corpus").over(whole), F.sum("trusted").over(whole)
    prior = F.lit(PRIOR) / F.greatest(t, F.lit(1))
    share = F.when(t > 0, F.col("trusted") / F.greatest(t, F.lit(1))).otherwise(F.col("corpus") / n)
    ratio = F.ln((share + prior) / (F.col("corpus") / n + prior))
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def _repeated(frame: DataFrame) -> DataFrame:
    """``frame`` with ``n_repeat_words`` instead of ``words``: words in windows of three found twice or more.

    A step puts each array in a column, so that none is worked out twice.  Windows are sorted as
    numbers of a hash and a place; where neighbours with one hash have different words, or places
    need more bits, the windows themselves are sorted.
    """
    rest = [c for c in frame.columns if c != "words"]
    inner = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    hashes = F.transform(inner, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    keyed = F.transform("hashes", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    short = F.size("words") < 1 << PLACE_BITS
    distinct = F.size(F.array_distinct("hashes"))

    def place(x):
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def pair(x, y):
        same = F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
        return F.when(same, F.struct(place(x).alias("a"), place(y).alias("b")))

    def equal(p):
        a, b, c = (F.get("words", p["a"] + k) == F.get("words", p["b"] + k) for k in range(3))
        return a & b & c

    pairs = F.filter(F.zip_with("sorted", F.slice("sorted", 2, 1 << 30), pair), lambda p: p.isNotNull())
    windows = F.transform(
        inner, lambda w, i: F.struct(F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i"))
    )
    found = (
        frame.withColumn("hashes", hashes)
        .withColumn("sorted", F.when((distinct < F.size("hashes")) & short, F.sort_array(keyed)))
        .select(*rest, "words", pairs.alias("pairs"))
        .withColumn("plain", F.when(~F.forall("pairs", equal) | ~short, F.sort_array(windows)))
        .drop("words")
    )
    again = F.transform(
        "plain",
        lambda x, j: F.when((x["w"] == F.get("plain", j + 1)["w"]) | (x["w"] == F.get("plain", j - 1)["w"]), x["i"]),
    )
    either = F.array_union("pairs.a", "pairs.b")
    places = F.when(F.col("plain").isNotNull(), F.filter(again, lambda i: i.isNotNull())).otherwise(either)
    at = found.select(*rest, F.sort_array(places).alias("at"))
    # Each window has three words; those up to the next window's start are its own.
    steps = F.zip_with("at", F.slice("at", 2, 1 << 30), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)
    return at.select(*rest, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def _measured(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, the counted rules, and ``crc`` of tokens, a row for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = common.id_and_text(docs).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        _all(text, WORD).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        ngrams(text)[0].alias("crc"),
    )
    return _repeated(
        base.select(
            "row",
            "doc_id",
            "words",
            F.size("words").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "crc",
        )
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    trusted_rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, score, kept.

    ``score`` is the mean log ratio (0 without n-grams, and everywhere without trusted documents).
    Null and empty texts have no words, so they fail the counted rules.  Every row, repeated ones and
    those of a null doc_id too, has its own result; other columns may have any names; an empty table
    gives no rows.  A row's arrays of words and n-grams are held at once, about 200 bytes a word.
    """
    weights = F.broadcast(log_ratios(docs, labels, trusted_rows))  # BUCKETS rows at most
    facts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    buckets = ngrams(F.lit(""))[1]
    grams = _measured(docs).select(
        "row", *facts, F.explode_outer(buckets).alias("bucket")
    )
    scored = (
        grams.join(weights, "bucket", "left")
        .groupBy("row", *facts)
        .agg(F.count("bucket").alias("n_grams"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    )
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / UNIT).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.select(*facts, failed.alias("base_failed"), "n_grams", score.alias("score")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )

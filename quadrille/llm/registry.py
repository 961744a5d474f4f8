"""The queries of this subpackage over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
            FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
h AS (SELECT p.doc_id, p.i, p.n, b.item_id FROM p JOIN b ON p.n = b.n AND p.win = b.win),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.line, l.pos, s.k IS NOT NULL AND l.doc_id <> s.keeper AS dropped
  FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(read(spark, sf_dir, "documents"), shingle=3, percent=85)


# Only pairs that share a shingle are compared; the recursion follows links to smaller ids.
OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^ \t\n\x0b\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
        WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id WHERE reach.r < l.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.r) AS component_id, min(r.r) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_pack import read_tokens, write_tokens

    manifest = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, with_ids=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(read(spark, sf_dir, "documents")).drop("index_file")


OP10_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(k) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS k FROM documents) WINDOW g AS (PARTITION BY k)
"""


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_mining import mine

    return mine(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, g, count(*) AS f
      FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m))
      GROUP BY lang, m, g HAVING count(*) >= 100),
cand AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, m, g, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
         FROM (SELECT lang, m, g, a, w, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.g, c.a, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score,
                  row_number() OVER (PARTITION BY c.lang, c.g ORDER BY (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f), k) AS first
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.x JOIN f r ON r.lang = c.lang AND r.g = c.y
           JOIN total t ON t.lang = c.lang),
inside AS (SELECT lang, g, max(a) AS f
           FROM (SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS g
                 FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i
                       FROM (SELECT lang, a, m, w, unnest(range(2, m)) AS k FROM cand))) GROUP BY lang, g)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT s.lang, s.g, a, l, r, n, score::BIGINT AS score,
             row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank
      FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g
      WHERE first = 1 AND (i.f IS NULL OR 100 * i.f < 100 * a))
WHERE rank <= 2000
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


# crc32 of a string's bytes, by the table of its reflected polynomial.
_CRC = """CRC AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    code = "(strpos('0123456789ABCDEF', h[2 * i + {}]) - 1)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2),
        lambda i: {code.format(1)} * 16 + {code.format(2)})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))""".replace(
        "h[", f"hex(encode({text}))["
    ).replace("len(h)", f"len(hex(encode({text})))")


OP12_SQL = rf"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL),
trusted AS (SELECT doc_id FROM good, CRC ORDER BY {_crc("doc_id::VARCHAR")}, doc_id LIMIT 20000),
tokens AS (SELECT row, regexp_extract_all(text, '[[:alnum:]\x{{80}}-\x{{10FFFF}}]+') || regexp_extract_all(text, '[[:punct:]]+') AS w FROM d),
placed AS (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM tokens),
code AS (SELECT x, {_crc("x")} AS c FROM (SELECT DISTINCT x FROM placed), CRC),
seq AS (SELECT row, c, lead(c) OVER (PARTITION BY row ORDER BY i) AS b FROM placed JOIN code USING (x)),
grams AS (SELECT row, c % 65536 AS bucket FROM seq UNION ALL SELECT row, (31 * c + b) % 65536 FROM seq WHERE b IS NOT NULL),
per AS (SELECT row, bucket, count(*) AS n FROM grams GROUP BY row, bucket),
counts AS (SELECT bucket, sum(per.n) AS corpus, coalesce(sum(per.n) FILTER (trusted.doc_id IS NOT NULL), 0) AS good
           FROM per JOIN d USING (row) LEFT JOIN trusted ON trusted.doc_id = d.doc_id GROUP BY bucket),
shares AS (SELECT bucket, corpus / sum(corpus) OVER () AS p, 5 / greatest(sum(good) OVER (), 1) AS prior,
                  CASE WHEN sum(good) OVER () > 0 THEN good / greatest(sum(good) OVER (), 1) ELSE corpus / sum(corpus) OVER () END AS q FROM counts),
weights AS (SELECT bucket, round(ln((q + prior) / (p + prior)) * 1000000)::BIGINT AS weight FROM shares),
scores AS (SELECT row, sum(n)::BIGINT AS n, sum(n * weight)::BIGINT AS total FROM per JOIN weights USING (bucket) GROUP BY row),
words AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM d),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n
       FROM (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM words))),
again AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest([i, i + 1, i + 2]) FROM windows WHERE n > 1) GROUP BY row),
lines AS (SELECT row, count(*) - count(DISTINCT line) AS n
          FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
facts AS (SELECT row, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM words)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words AS base_failed, coalesce(scores.n, 0) AS n_grams,
       CASE WHEN coalesce(scores.n, 0) > 0 THEN scores.total / scores.n / 1000000 ELSE 0.0::DOUBLE END AS score,
       NOT (n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words)
       AND CASE WHEN coalesce(scores.n, 0) > 0 THEN scores.total / scores.n / 1000000 ELSE 0.0::DOUBLE END >= -0.2 AS kept
FROM d JOIN facts USING (row) LEFT JOIN lines USING (row) LEFT JOIN again USING (row) LEFT JOIN scores USING (row)
"""


def op13_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .run_detection import detect_runs, planted, summary

    return summary(detect_runs(read(spark, sf_dir, "documents"), planted))


# Equal words of a text at most a quarter of it apart; stretches of such places are runs.
OP13_SQL = rf"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, {_crc("doc_id::VARCHAR")} AS h,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, CRC),
shape AS (SELECT row, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
placed AS (SELECT row, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END] AS x
           FROM (SELECT row, w, n, a, parts, unnest(range(n)) AS i FROM shape)),
same AS (SELECT p.row, p.i, r.i - p.i AS q FROM placed p JOIN placed r ON p.row = r.row AND p.x = r.x AND r.i > p.i AND 4 * (r.i - p.i) <= p.n),
stretches AS (SELECT row, q, min(i) AS s, count(*) + q AS len
              FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS z FROM same) GROUP BY row, q, z
              HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (
           SELECT 1 FROM stretches y WHERE y.row = x.row AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
dropped AS (SELECT DISTINCT row, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT p.row, string_agg(x, ' ' ORDER BY p.i) AS text FROM placed p LEFT JOIN dropped o ON o.row = p.row AND o.i = p.i
         WHERE o.row IS NULL GROUP BY p.row),
lists AS (SELECT row, count(*) AS n, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS list FROM runs GROUP BY row),
best AS (SELECT row, s, len, q FROM (SELECT *, row_number() OVER (
           PARTITION BY row ORDER BY len // q DESC, (len % q) / q DESC, s, q) AS k FROM runs) WHERE k = 1)
SELECT doc_id, coalesce(lists.n, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period,
       1000 * best.len // best.q AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN lists USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := globals().get(name.split("_")[0].upper() + "_SQL"))}

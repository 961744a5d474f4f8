"""Byte-level BPE by DuckDB queries inside each task.

Encoding: the distinct matches of the vocabulary's pattern in a block become token-position rows,
one a byte.  A recursive query joins adjacent tokens with the merge table and contracts each word's
leftmost pair of minimum rank until no pair is left.  Long words are first cut where no merge of the
vocabulary can reach across, and a round does as many of their leftmost contractions as give no pair
of a lower rank on the way, which is what one at a time would do whatever the vocabulary.  Decoding joins ids with the vocabulary and
aggregates the bytes in order.  Spark hands out the blocks; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .segments import BoundedCache, PieceCache

#: Words of so many bytes or fewer take one contraction a round, and are not cut.
SHORT_BYTES = 64
#: Rows of token positions in one recursive query.
QUERY_BYTES = 1 << 18
#: Rounds of one recursive query over long words; their state is then taken up by the next query, which
#: holds the words that are not done.  Fewer where a word has many rows, as a query holds all its rounds.
LONG_ROUNDS, LONG_ROWS = 16, 1 << 20
BLOCK_BYTES = 2 << 20
DATABASE_MEMORY = "256MB"
#: Encodings that a worker keeps; less than token output does, as the database takes memory too.
CACHE_PIECES, CACHE_WORDS = 400_000, 200_000
#: Ids of one decoding query; a longer text takes several.
DECODE_IDS = 1 << 19

# One sort of all rows a round: neighbours of another word give no pair.
_SHORT = """
WITH RECURSIVE step(word, pos, tok, it) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  (WITH pairs AS (
    SELECT word, pos, tok, it,
           CASE WHEN lead(word) OVER w = word THEN tok * 4294967296 + lead(tok) OVER w END AS pair,
           CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS before
    FROM step WINDOW w AS (ORDER BY word * 65536 + pos)),
   best AS (
    SELECT p.word, min((m.rank << 32) | p.pos) AS least FROM pairs p JOIN merges m ON m.pair = p.pair GROUP BY p.word)
   SELECT p.word, p.pos, CASE WHEN p.pos = (b.least & 4294967295) THEN (b.least >> 32) ELSE p.tok END, p.it + 1
   FROM pairs p JOIN best b ON p.word = b.word WHERE p.before IS DISTINCT FROM (b.least & 4294967295)))
SELECT s.word, s.pos, s.tok
FROM step s JOIN (SELECT word, max(it) AS it FROM step GROUP BY word) l ON s.word = l.word AND s.it = l.it
ORDER BY s.word, s.pos
"""

# Long words take several contractions a round: the leftmost pairs of the minimum rank, from the left
# without overlap, up to the first one that makes a pair of a lower rank with a token beside it.  The
# token before it may itself be new; the one after it is still the old one.  ``place`` numbers tokens;
# ``run`` is how far into equal neighbours a pair is.
_LONG = """
WITH RECURSIVE step(word, pos, tok, it) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  (WITH pairs AS (
    SELECT word, pos, tok, it, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos, lag(tok) OVER w AS before,
           lead(tok, 2) OVER w AS after, row_number() OVER w AS place
    FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)),
   ranked AS (
    SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY p.word) AS least
    FROM pairs p LEFT JOIN merges m ON m.pair = p.tok * 4294967296 + p.nxt),
   hits AS (
    SELECT word, pos, npos, least, place, before, after,
           place - row_number() OVER (PARTITION BY word ORDER BY place) AS island
    FROM ranked WHERE rank = least),
   chosen AS (
    SELECT *, CASE WHEN lag(place) OVER (PARTITION BY word ORDER BY place) = place - 2 THEN least ELSE before END AS left_tok
    FROM (SELECT *, place - min(place) OVER (PARTITION BY word, island) AS run FROM hits) WHERE run % 2 = 0),
   taken AS (
    SELECT word, pos, npos, least FROM (
      SELECT c.word, c.pos, c.npos, c.least,
             coalesce(sum(CASE WHEN l.rank < c.least OR r.rank < c.least THEN 1 ELSE 0 END)
                      OVER (PARTITION BY c.word ORDER BY c.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower
      FROM chosen c
      LEFT JOIN merges l ON l.pair = c.left_tok * 4294967296 + c.least
      LEFT JOIN merges r ON r.pair = c.least * 4294967296 + c.after) WHERE lower = 0)
   SELECT s.word, s.pos, coalesce(t.least, s.tok)::BIGINT, s.it + 1
   FROM step s SEMI JOIN taken a ON s.word = a.word
   LEFT JOIN taken t ON s.word = t.word AND s.pos = t.pos
   WHERE s.it < {rounds}
     AND NOT EXISTS (FROM taken g WHERE g.word = s.word AND g.npos = s.pos)))
SELECT word, pos, tok, latest FROM (SELECT *, max(it) OVER (PARTITION BY word) AS latest FROM step)
WHERE it = latest ORDER BY word, pos
"""

_DECODE = """
SELECT doc, list(bytes ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _offsets(values: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1]


class Codec:
    """Encoder and decoder of one rank table in an own in-memory database."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, short_bytes: int = SHORT_BYTES):
        self.ranks, self.pattern, self.short_bytes = ranks, regex.compile(pattern), short_bytes
        self.letters = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" in pattern
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Nothing spills to a folder of the machine: a query beyond the limit fails.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DATABASE_MEMORY, "temp_directory": ""})
        pairs = [
            (a, b, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None
        ]
        left, right, rank = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)) if pairs else (pa.array([], pa.int64()),) * 3
        self._table("merges", {"l": left, "r": right, "rank": rank}, "l * 4294967296 + r AS pair, rank")
        self._table(
            "vocabulary",
            {"tok": pa.array(list(ranks.values()), pa.int64()), "hex": pa.array([t.hex() for t in ranks], pa.string())},
            "tok, unhex(hex) AS bytes",
        )
        #: Of tokens that a merge makes, the places where it can join their parts; all beginnings of tokens.
        self.joins: dict[bytes, list[int]] = {}
        for token in ranks:
            own = [i for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            if own:
                self.joins[token] = own
        self.beginnings = {token[:i] for token in self.joins for i in range(1, len(token) + 1)}
        self.words = BoundedCache(CACHE_WORDS)
        self.cache = PieceCache(self._encode_pieces, self._encode_after_blank, cut_tails=self.letters, most=CACHE_PIECES)

    def _table(self, name: str, columns: dict[str, pa.Array], select: str) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT {select} FROM given")
        self.db.unregister("given")

    def _run(self, query: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _start(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words], np.int64)
        tokens = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        if len(tokens) and tokens.min() < 0:
            raise ValueError("the vocabulary lacks some single bytes")
        first = np.cumsum(lengths) - lengths
        return pa.table(
            {
                "word": np.repeat(np.arange(len(words)), lengths),
                "pos": np.arange(len(tokens)) - np.repeat(first, lengths),
                "tok": tokens,
            }
        )

    def _long(self, state: pa.Table) -> pa.Table:
        """Queries of a bounded number of rounds until no word changes any more."""
        done = []
        while state.num_rows:
            rounds = max(1, min(LONG_ROUNDS, LONG_ROWS // state.num_rows))
            found = self._run(_LONG.format(rounds=rounds), "start", state)
            open_ = pc.equal(found["latest"], rounds)
            state = found.filter(open_).select(["word", "pos", "tok"])
            done.append(found.filter(pc.invert(open_)).select(["word", "pos", "tok"]))
        return pa.concat_tables(done).sort_by([("word", "ascending"), ("pos", "ascending")])

    def cut(self, word: bytes) -> list[bytes]:
        """Parts of a word between which no merge is possible, whatever has been merged within them.

        A merge across a place joins a token that ends there and one that begins there.
        """
        reached = bytearray(len(word) + 1)
        beginnings, joins = self.beginnings, self.joins
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                token = word[i:j]
                if token not in beginnings:
                    break
                for k in joins.get(token, ()):
                    reached[i + k] = 1
        places = [0, *(i for i in range(1, len(word)) if not reached[i]), len(word)]
        return [word[a:b] for a, b in zip(places, places[1:], strict=False)]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some words by the query that suits their length."""
        out = [b""] * len(words)
        short = [i for i in range(len(words)) if len(words[i]) <= self.short_bytes]
        long = [i for i in range(len(words)) if len(words[i]) > self.short_bytes]
        for chosen, run in ((short, lambda s: self._run(_SHORT, "start", s)), (long, self._long)):
            own = [words[i] for i in chosen]
            for a, b in common.blocks(own, QUERY_BYTES):
                found = run(self._start(own[a:b]))
                tokens = found["tok"].to_numpy().astype("<u4").tobytes()
                cut = (4 * np.searchsorted(found["word"].to_numpy(), np.arange(b - a + 1))).tolist()
                for k in range(a, b):
                    out[chosen[k]] = tokens[cut[k - a] : cut[k - a + 1]]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (a match of the pattern) as little-endian unsigned 32-bit integers."""
        parts = [[w] if len(w) <= self.short_bytes else self.cut(w) for w in words]
        distinct = list({p: None for own in parts for p in own})
        ids = dict(zip(distinct, self._contract(distinct), strict=True))
        return [b"".join(map(ids.__getitem__, own)) for own in parts]

    def _encode_after_blank(self, pieces: list[str]) -> list[bytes]:
        """Pieces that follow a blank; one of letters is a single match with its blank."""
        alone = [p for p in pieces if p.isalpha()] if self.letters else []
        ids = dict(zip(alone, self.encode_words([b" " + p.encode() for p in alone]), strict=True))
        others = [p for p in pieces if p not in ids]
        ids.update(zip(others, self._encode_pieces([" " + p for p in others]), strict=True))
        return [ids[p] for p in pieces]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        ids = self.words
        matches = [self.pattern.findall(p) for p in pieces]
        words = list({m: None for own in matches for m in own})
        found, new = ids.lookup(words)
        fresh = dict(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        ids.update(fresh)
        value = {w: v or fresh[w] for w, v in zip(words, found, strict=True)}
        return [b"".join(map(value.__getitem__, own)) for own in matches]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The same for a column; null counts as empty."""
        return self.cache.encode_array(texts)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(lengths) - lengths
        tokens = np.frombuffer(b"".join(ids), "<u4")
        doc, pos = np.repeat(np.arange(len(ids)), lengths), np.arange(len(tokens)) - np.repeat(first, lengths)
        parts: list[list[bytes]] = [[] for _ in ids]
        for a in range(0, len(tokens), DECODE_IDS):
            own = slice(a, a + DECODE_IDS)
            found = self._run(_DECODE, "ids", pa.table({"doc": doc[own], "pos": pos[own], "tok": tokens[own]}))
            lists = found["bytes"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            values = lists.flatten()
            # The bytes of a list's values stand side by side in one buffer.
            ends = _offsets(values)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            data = values.buffers()[2]
            for i, p, q in zip(found["doc"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                parts[i].append(data[p:q].to_pybytes())
        return [b"".join(p) for p in parts]


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast (ranks, pattern), built once."""
    codecs = common.kept(__name__)
    if shared.id not in codecs:
        codecs.clear()
        codecs[shared.id] = Codec(*shared.value)
    return codecs[shared.id]


class _Shared:
    """A broadcast with a key under which workers keep what they make of it."""

    def __init__(self, spark, value):
        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


def share(spark, ranks: dict[bytes, int], pattern: str) -> _Shared:
    """Broadcasts a vocabulary; its size is that of the rank file."""
    return _Shared(spark, (ranks, pattern))


def encode(docs: DataFrame, vocabulary: _Shared, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit) as its last column, in place of the text.

    Null text is encoded as the empty one, which has no ids.  Every row has its row, repeated ones too.
    A column of ``docs`` that is called ids is an error; other names never clash.  An empty table gives
    an empty one.
    """
    placed, (text,) = common.by_place(docs, text_col)
    keep = [(c, n) for c, n in zip(placed.columns, docs.columns, strict=True) if c != text]
    if any(n.lower() == "ids" for _, n in keep):
        raise ValueError("documents have a column ids already")
    names = [c for c, _ in keep]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            ids = codec.encode_array(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    schema = common.with_columns(placed.select(*names), "ids binary")
    found = common.map_batches(placed.withColumn(text, F.col(text).cast("string")), work, schema)
    return found.toDF(*(n for _, n in keep), "ids")


def decode(encoded: DataFrame, vocabulary: _Shared) -> DataFrame:
    """``encoded`` with the column ``decoded`` (an error if there is one): the bytes of its ``ids``.

    Null ids decode to no bytes; ids that the vocabulary lacks decode to none.  Every row has its row.
    """
    if any(n.lower() == "decoded" for n in encoded.columns):
        raise ValueError("there is a column decoded already")
    placed, (name,) = common.by_place(encoded, "ids")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            ids = [x or b"" for x in batch.column(name).to_pylist()]
            for a, b in common.blocks(ids, 2 * BLOCK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(codec.decode(ids[a:b]), pa.binary())],
                    names=[*batch.schema.names, "decoded"],
                )

    found = common.map_batches(placed, work, common.with_columns(placed, "decoded binary"))
    return found.toDF(*encoded.columns, "decoded")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too.

    Null text counts as empty: no tokens.  Other columns of ``docs`` may have any names.  An empty
    table gives no rows.  A text is never cut inside a match, so a match has to fit in memory.

    Encodes and decodes in one stage, so that a task has one worker and ids stay in it.
    """
    vocabulary = share(docs.sparkSession, read_ranks(rank_path), pattern)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            ids = codec.encode_array(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_batches(common.id_and_text(docs), work, schema)

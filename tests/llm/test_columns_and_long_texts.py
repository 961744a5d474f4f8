"""Extra columns of any name, long texts, and values (not only ids) of the table of edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import bpe, common, decontamination, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, near_dedup, quality, token_pack

from .helpers import EDGE, alnum_words, blank_words, edge_docs, lower
from .test_edges import FILTERS, PER_ROW, RANKS, _benchmark

#: Names that operators use themselves or used once, and names that differ from ours in case alone.
CLASHES = (
    "words spans items path part fold key span ids n kept_id head member component lang_pred score left right place rows c c_0 x1 "
    "__dc_spans __dc_words __dc_items __xd_key __xd_sha __xd_count __xd_range __li_lang __li_score __nd_id __qc_score "
    "quality item text_sha256 hash start stop uid main base tail rare"
).split()


def _clashing(spark):
    docs = edge_docs(spark).select("doc_id", "text", "lang")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)), F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c,d")).alias("odd name, 1"))


@pytest.mark.parametrize("name", FILTERS)
def test_filters_carry_columns_of_any_name(spark, name):
    docs, plain = _clashing(spark), edge_docs(spark)
    got = FILTERS[name](spark, docs)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    assert all(tuple(r)[3 : 3 + len(CLASHES)] == tuple(range(len(CLASHES))) for r in rows)
    want = FILTERS[name](spark, plain).collect()
    # Of rows that repeat both id and text any one may stay.
    assert Counter((r.doc_id, r["text"]) for r in rows) == Counter((r.doc_id, r["text"]) for r in want)


@pytest.mark.parametrize("name", ["decontamination", "license", "language", "lm", "pack", "exact", "line_dedup", "quality", "bpe"])
def test_rows_whatever_the_columns(spark, name):
    got, want = PER_ROW[name](spark, _clashing(spark)), PER_ROW[name](spark, edge_docs(spark))
    drop = [c for c in ("index_file",) if c in got.columns]
    assert sorted(map(str, got.drop(*drop).collect())) == sorted(map(str, want.drop(*drop).collect()))


@pytest.mark.parametrize("name", FILTERS)
def test_text_column_of_another_case(spark, name):
    docs = edge_docs(spark).withColumnRenamed("text", "Text")
    got = FILTERS[name](spark, docs)
    assert got.columns == docs.columns and got.count() == FILTERS[name](spark, edge_docs(spark)).count()


def test_columns_that_cannot_be_told_apart(spark):
    docs = edge_docs(spark).select("doc_id", F.col("text").alias("TEXT"), F.col("text").alias("Text"))
    with pytest.raises(ValueError):
        language_id.keep_identified(docs)
    both = edge_docs(spark).select("doc_id", "text", F.lit(None).cast("string").alias("TEXT"))
    assert exact_dedup.deduplicate(both).columns == both.columns
    with pytest.raises(ValueError):
        bpe.encode(edge_docs(spark).withColumn("ids", F.lit(1)), None)


def test_values_of_edge_cases(spark):
    docs = edge_docs(spark)
    by_text = lambda rows, *names: Counter((r.doc_id, *(r[n] for n in names)) for r in rows)
    texts = [(i, t or "") for i, t, _ in EDGE]
    found = decontamination.contamination(docs, _benchmark(spark)).collect()
    assert by_text(found, "n_words") == Counter((i, len(alnum_words(t))) for i, t in texts)
    assert {r.doc_id for r in found if r.contaminated} - {None} == {1, 2, 9, 10, 13}
    lines = line_dedup.dedup_lines(docs).collect()
    assert by_text(lines, "n_lines") == Counter((i, t.count("\n") + 1) for i, t in texts)
    assert {r.doc_id for r in lines if r.n_dropped} == {2, 13}  # the keeper of a line is the smallest id
    assert by_text(license_scan.scan_licenses(docs).collect(), "n_words", "base_labels") == Counter(
        (i, len(alnum_words(t)), "mit" if "MIT" in t else "") for i, t in texts
    )
    told = language_id.identify(docs).collect()
    assert {r.doc_id for r in told if r.lang_pred == "und"} - {None} == {3, 4, 5, 6}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in told)
    scored = lm_scoring.score_documents(docs).collect()
    assert by_text(scored, "n_tokens", "held_out") == Counter(
        (i, len(blank_words(t)) + 1, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in texts
    )
    groups = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    assert (groups[2].component_id, groups[7].n_shingles, groups[3].kept, groups[5].n_shingles) == (1, 6, True, 0)
    assert groups[None].component_id is None and groups[9].component_id is None and groups[10].component_id is None
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = token_pack.read_tokens(token_pack.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert by_text(packed, "n_tokens") == Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert by_text(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect(), "n_tokens", "decoded_sha256") == Counter(
        (i, len(own.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts
    )
    sizes = Counter(lower(t) for _, t in texts)
    assert by_text(exact_dedup.exact_groups(docs).collect(), "group_size", "text_sha256") == Counter(
        (i, sizes[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in texts
    )


def _long_text(n):
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefghijklmnop éß", k=rng.randrange(1, 9))) for _ in range(3000)]
    return " ".join(rng.choices(words, k=n)) + " " + "z" * 5000 + "!?" * 3000


def test_parts_of_long_texts_add_up(monkeypatch):
    """Small bounds give what large ones give."""
    texts = [_long_text(3000).encode(), b"", b"Ab  ab ab .. x", _long_text(20).encode()]
    calls = {
        "tokens": lambda: [common.hash_tokens(texts, quality.CLASSES).hashes.tolist()],
        "words": lambda: [common.word_numbers(t, lambda w: len(w), most).tolist() for t in texts for most in [MOST[0]]],
        "features": lambda: [np.concatenate([b for b, _ in quality.features(texts)]).tolist()],
        "vectors": lambda: [(a.tolist(), np.round(b, 5).tolist()) for a, b in quality.vectors(texts)],
        "shingles": lambda: [s.tolist() for s in near_dedup.shingle_sets(texts, 3)],
        "parts": lambda: [b"".join(common.blank_parts(t, MOST[0])) for t in texts],
        "languages": lambda: np.round(_bucket_counts([t.decode() for t in texts], MOST[0]), 9).tolist(),
    }
    MOST = [1 << 30]
    want = {k: f() for k, f in calls.items()}
    monkeypatch.setattr(common, "HASH_BYTES", 37)
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    monkeypatch.setattr(quality, "BLOCK_TOKENS", 7)
    MOST[0] = 29
    assert {k: f() for k, f in calls.items()} == want


def _bucket_counts(texts, most):
    out = np.zeros((len(texts), (1 << language_id.BUCKET_BITS) + 1))
    for pieces in language_id._blocks(texts, most):
        for bucket, offsets in language_id._grams(pieces):
            for (i, _, _), a, b in zip(pieces, offsets, offsets[1:], strict=False):
                np.add.at(out[i], bucket[a:b], 1)
    return out[:, :-1].sum(axis=1), out[:, :-1].argmax(axis=1), out[:, :-1].max(axis=1)


def test_one_long_text_through_every_operator(spark):
    text = _long_text(400_000)
    docs = spark.createDataFrame([(1, text, "en"), (2, "short one", "en"), (3, text, "en")], "doc_id long, text string, lang string")
    for name, run in PER_ROW.items():
        assert sorted(r.doc_id for r in run(spark, docs).collect()) == [1, 2, 3], name
    scored = {r.doc_id: r for r in lm_scoring.score_documents(docs, order=2).collect()}
    assert scored[1].n_tokens == len(blank_words(text)) + 1 and scored[1].n_known == scored[1].n_tokens


def test_lm_documents_of_several_rows(spark, monkeypatch):
    from .helpers import frame, random_texts

    docs = frame(spark, random_texts(40, 5))
    want = {r.doc_id: r for r in lm_scoring.score_documents(docs, order=3, min_share=2.0).collect()}
    monkeypatch.setattr(lm_scoring, "ROW_ENTRIES", 3)
    monkeypatch.setattr(lm_scoring, "FREQUENT_SHARE", 2.0)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 11)
    texts = [lower(r["text"]).encode() for r in docs.collect()]
    head = lm_scoring.Head(lm_scoring.Table(np.zeros(0, np.uint64), np.zeros(0)), np.zeros(1), 3)
    work = lm_scoring._score(type("B", (), {"value": head}), type("B", (), {"value": {}}))
    import pyarrow as pa

    rows = [r for b in work([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], names=["doc_id", "text"])]) for r in b.to_pylist()]
    assert sum(r["main"] for r in rows) == len(texts) and len(rows) > len(texts)
    words, grams = Counter(), Counter()
    for r in rows:
        assert max(len(r["rare"]), len(r["tail"])) <= 3
        words.update({(r["uid"], w): n for w, n in zip(r["rare"], r["times"], strict=True)})
        for g in r["tail"]:
            grams[r["uid"]] += g["n"]
    assert words == Counter({(i, w): n for i, t in enumerate(texts) for w, n in Counter([*t.decode().split(), " "]).items()})
    assert grams == Counter({i: len(t) + 1 for i, t in enumerate(texts)}) and len(want) == len(texts)

"""Every operator over a table of edge cases and over an empty one."""

import public_tokenizers
import pytest

from quadrille.llm import bpe, decontamination, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, near_dedup, quality, token_pack

from .helpers import EDGE, edge_docs, empty_docs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _benchmark(spark):
    rows = [(1, "cat sat on the mat and looked at the dog"), (2, None), (3, ""), (None, "one two"), (1, "one TWO")]
    return spark.createDataFrame(rows, "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0), (7, 1), (8, 0)], "doc_id long, quality int")


PER_ROW = {
    "decontamination": lambda s, d: decontamination.contamination(d, _benchmark(s)),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "quality": lambda s, d: quality.classify(d, _labels(s)),
    "license": lambda s, d: license_scan.scan_licenses(d),
    "language": lambda s, d: language_id.identify(d),
    "lm": lambda s, d: lm_scoring.score_documents(d),
    "near": lambda s, d: near_dedup.near_groups(d),
    "pack": lambda s, d: token_pack.read_tokens(token_pack.write_tokens(d, public_tokenizers.path("byte_bpe_50k.json"))),
    "bpe": lambda s, d: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "exact": lambda s, d: exact_dedup.exact_groups(d),
}
FILTERS = {
    "decontaminate": lambda s, d: decontamination.decontaminate(d, _benchmark(s)),
    "remove_spans": lambda s, d: decontamination.remove_spans(d, _benchmark(s)),
    "keep_identified": lambda s, d: language_id.keep_identified(d),
    "exact": lambda s, d: exact_dedup.deduplicate(d),
    "near": lambda s, d: near_dedup.deduplicate(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_rows(spark, name):
    rows = PER_ROW[name](spark, edge_docs(spark)).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((e[0] for e in EDGE), key=key)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty(spark, name):
    assert PER_ROW[name](spark, empty_docs(spark)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters(spark, name):
    docs = edge_docs(spark)
    out = FILTERS[name](spark, docs)
    assert out.columns == docs.columns
    assert 0 < out.count() <= len(EDGE)
    assert FILTERS[name](spark, empty_docs(spark)).count() == 0


def test_empty_benchmark(spark):
    found = decontamination.contamination(edge_docs(spark), _benchmark(spark).limit(0))
    assert found.filter("contaminated").count() == 0


def test_what_filters_keep(spark):
    ids = lambda d: sorted(r.doc_id for r in d.collect() if r.doc_id is not None)
    docs = edge_docs(spark)
    assert ids(exact_dedup.deduplicate(docs)) == [-5, 2, 4, 5, 6, 7, 8, 10, 11, 12, 13]
    assert ids(language_id.keep_identified(docs)) == [-5, 1, 2, 7, 7, 8, 9, 10, 11, 12, 13]
    gone = ids(decontamination.decontaminate(docs, _benchmark(spark)))
    assert not {1, 2, 9, 10, 13} & set(gone) and {7, 8, 11} <= set(gone)

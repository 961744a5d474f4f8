"""The pipeline against a plain version built from the operators' own brute-force rules."""

import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken

import corpus_pipeline
from quadrille.llm import bpe
from quadrille.llm.common import read

from .helpers import alnum_words, blank_words, lower

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in read(spark, DATA, "documents").collect()}
    items = [r.text for r in read(spark, DATA, "benchmark").collect()]
    docs = {i: t for i, t in docs.items() if t and regex.search(r"\p{L}", t)}
    last = {}
    for i, t in sorted(docs.items()):
        last[lower(t)] = i
    docs = {i: docs[i] for i in last.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := blank_words(t)) else set() for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(docs)
    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = {i: docs[i] for i in docs if find(i) == i}
    windows = set()
    for text in items:
        w = alnum_words(text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    docs = {i: t for i, t in docs.items() if not windows & {tuple(w[k : k + 10]) for w in [alnum_words(t)] for k in range(len(w) - 9)}}
    ranks = bpe.read_ranks(corpus_pipeline.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == sorted(docs)
    for i, t in docs.items():
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = read(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns

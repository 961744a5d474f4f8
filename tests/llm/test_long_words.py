"""Byte-level BPE of long words, against single contractions and against the library."""

import os
import random

import numpy as np
import public_tokenizers
import tiktoken

from quadrille.llm import bpe


def _single(word, ranks):
    """The leftmost pair of minimum rank, one at a time."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_vocabulary_at_every_length():
    """Vocabularies not made by merges: what a merge makes may rank below what is merged."""
    rng = random.Random(7)
    for round_ in range(40):
        tokens = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(rng.randrange(3, 40))}
        order = [bytes([b]) for b in range(256)] + sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN, short_bytes=rng.choice([0, 5, 64]))
        words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 120))) for _ in range(15)] + [b"a" * 70, b"ab" * 40]
        for word, ids in zip(words, codec.encode_words(words), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == _single(word, ranks), (round_, word)


def test_words_of_many_letters():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, codec = random.Random(8), bpe.Codec(ranks, public_tokenizers.PATTERN)
    letters = lambda some, n: "".join(rng.choices(some, k=n))
    texts = [letters("abcdefghijklmnopqrstuvwxyz", 400_000), "a" * 300_000, letters("etaoin", 50_000), letters("éèßñ中文ば", 20_000)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert not os.path.exists(".tmp")

"""The trained operators against plain versions of their features, updates and posteriors."""

import math
from collections import Counter, defaultdict

import numpy as np

from quadrille.llm import language_id, quality

from .helpers import random_texts

TEXTS = [*random_texts(40, 31), "", "Hello, world!! Hello, world!!", "ÄÖ é... \x00 A", "a a a b b"]


def _tokens(text: bytes) -> list[bytes]:
    out, kind = [], 0
    for b in text:
        k = 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2 if 33 <= b <= 126 else 0
        if k and k == kind:
            out[-1] += bytes([b])
        elif k:
            out.append(bytes([b]))
        kind = k
    return out


def _feature_names(text: bytes) -> list[tuple]:
    """Names of the features: the word, its shape, and it with the word before."""
    tokens, out = _tokens(text), []
    words = ["same" if i and tokens[i] == tokens[i - 1] else t for i, t in enumerate(tokens)]
    for i, t in enumerate(tokens):
        kind = 1 if t[0] >= 128 or chr(t[0]).isalnum() else 2
        capital = all(65 <= b <= 90 or b >= 128 for b in t)
        out += [("word", words[i]), ("shape", kind, capital, min(len(t), 20)), ("pair", words[i - 1], words[i]) if i else ("first", words[i])]
    return out


def test_features_are_words_shapes_and_pairs():
    """Equal names always have equal buckets, others hardly ever do."""
    bucket, names = {}, defaultdict(set)
    got = [np.zeros(0, np.int32)] * len(TEXTS)
    for buckets, of in quality.features([t.encode() for t in TEXTS]):
        for i in np.unique(of):
            got[i] = np.concatenate([got[i], buckets[of == i].ravel()])
    for text, own in zip(TEXTS, got, strict=True):
        named = _feature_names(text.encode())
        assert len(named) == len(own)
        for name, b in zip(named, own.tolist(), strict=True):
            assert bucket.setdefault(name, b) == b
            names[b].add(name)
    assert sum(len(n) > 1 for n in names.values()) <= 0.03 * len(names)


def test_vectors_are_shares_of_features():
    for text, (at, x) in zip(TEXTS, quality.vectors([t.encode() for t in TEXTS]), strict=True):
        assert at[-1] == 1 << quality.BUCKET_BITS and x[-1] == 1
        n = len(_feature_names(text.encode()))
        assert math.isclose(x[:-1].sum(), 10 if n else 0, rel_tol=1e-5) and (np.diff(at) > 0).all()


def test_ftrl_steps():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        at = np.append(np.unique(rng.integers(0, 40, 6)), 1 << quality.BUCKET_BITS)
        rows.append((at.astype(np.int32), rng.random(len(at)).astype(np.float32), int(rng.integers(2))))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for at, x, y in rows:
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(w, x, strict=True))))
            for i, own, v in zip(at, w, x, strict=True):
                g = (p - y) * float(v)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * own
                n[i] += g * g
    got = quality.ftrl(rows, epochs=3)
    want = {i: weight(i) for i in z}
    assert all(math.isclose(got[i], w, rel_tol=1e-4, abs_tol=1e-6) for i, w in want.items())
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())


def test_quality_scores(spark):
    """The query's model is one run over all labelled rows in order of a hash; its scores are plain dot products."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int")
    model = quality.train(docs, labels)
    for row in quality.classify(docs, labels).collect():
        at, x = quality.vectors([TEXTS[row.doc_id].encode()])[0]
        dot = sum(float(model.weights[i]) * float(v) for i, v in zip(at[:-1], x[:-1], strict=True)) + model.bias
        assert math.isclose(row.score, 1 / (1 + math.exp(-dot)), rel_tol=1e-4)
        assert row.predicted == (row.score >= 0.3)


def _buckets(text: str) -> list[int]:
    out = []
    for n in language_id.NGRAMS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF) >> (32 - language_id.BUCKET_BITS))
    return out


def test_language_posteriors(spark):
    """Any number of languages in any number of matrices gives the posterior of multinomial naive Bayes."""
    texts = [t for t in TEXTS if t] * 2
    rows = [(i, t, f"l{i % 7}") for i, t in enumerate(texts)] + [(900, "lonely ß", "rare"), (901, "", "empty"), (902, None, "none"), (903, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, docs = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(_buckets(text.lower()))
            docs[lang] += 1
    size = 1 << language_id.BUCKET_BITS
    asked = ["w1 w22 Hello", "ß lonely", "", "12 34", None, "world!! é"]
    for matrix_languages in (64, 2):
        model = language_id.train(labelled, matrix_languages=matrix_languages)
        assert len(model.paths) > 1 or matrix_languages == 64
        best, sure, evidence = language_id.score(asked, [language_id.common.loaded("test", p, 99) for p in model.paths])
        for text, name, p, e in zip(asked, best, sure, evidence, strict=True):
            if not text or not any(c.isalpha() for c in text):
                assert (name, p, e) == ("und", 0.0, -math.inf)
                continue
            own = Counter(_buckets(text.lower()))
            logs = {}
            for lang, n in docs.items():
                total = sum(counts[lang].values()) + language_id.SMOOTHING * size
                logs[lang] = math.log(n / sum(docs.values())) + sum(k * math.log((counts[lang][b] + language_id.SMOOTHING) / total) for b, k in own.items())
            top = max(logs.values())
            plain = max(v - math.log(docs[lang] / sum(docs.values())) for lang, v in logs.items())
            assert math.isclose(e, plain / sum(own.values()) + math.log(size), rel_tol=1e-6)
            assert name == min(k for k, v in logs.items() if math.isclose(v, top, abs_tol=1e-9))
            assert math.isclose(p, 1 / sum(math.exp(v - top) for v in logs.values()), rel_tol=1e-6)

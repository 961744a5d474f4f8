"""Phrase mining, quality rules and run detection against brute force, and on edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quadrille.llm import phrase_mining, quality_rules, run_detection

from .helpers import EDGE, SCHEMA, edge_docs, empty_docs, frame, lower


def _phrases(rows, least, top, percent=100, longest=5):
    """The contract of phrase mining, in plain loops over (lang, text)."""
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in total:
        cand = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1}
        scored = []
        for p, a in cand.items():
            inside = any(
                len(o) > len(p) and 100 * b >= percent * a and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))
                for o, b in cand.items()
            )
            if not inside:
                score, _, l, r = min(
                    (1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                    for k in range(1, len(p))
                )
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def _mined(docs, **options):
    found = phrase_mining.mine(docs, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_of_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "dd", "e\x00f", "g" * 30]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",x"]) for _ in range(rng.randrange(80)))
        rows.append((rng.choice(["en", "de", None]), rng.choice([text, rows[-1][1] if rows else text])))
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for options in ({"least": 3, "top": 40}, {"least": 2, "top": 9, "percent": 80}):
        assert _mined(docs, **options) == _phrases(rows, **options)


def test_phrases_in_long_runs_and_edges(spark):
    """Pieces of one word over and over have no trigger or one a word; chunks still own each word once."""
    rows = [("en", "x " * 3000), ("en", "x y " * 700 + ". x"), ("en", None), (None, "")]
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert _mined(docs, least=2, top=50) == _phrases(rows, 2, 50)
    assert _mined(edge_docs(spark), least=2, top=50) == _phrases([(g, t) for _, t, g in EDGE], 2, 50)
    assert _mined(empty_docs(spark)) == []


def test_chunks_own_every_word_once():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefghij") for _ in range(5000)).encode()
    chunks, owned, of = phrase_mining.chunks([text, b"", b"q, r s"])
    words = [c.split(" ") for c in chunks.to_pylist()]
    assert owned.sum() == 5003 and max(owned) <= phrase_mining.LONGEST and set(of.tolist()) == {0, 2}
    assert [w for c, n, i in zip(words, owned, of, strict=True) if i == 0 for w in c[:n]] == text.decode().split()
    assert all(len(c) <= n + 4 for c, n in zip(words, owned, strict=True)) and len(words) > 100


def _rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def _buckets(text):
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "") + re.findall(r"[!-/:-@\[-`{-~]+", text or "")
    c = [zlib.crc32(t.encode()) for t in tokens]
    return [x % 65536 for x in c] + [(31 * x + y) % 65536 for x, y in zip(c, c[1:], strict=False)]


def _judged(rows, good, threshold=quality_rules.THRESHOLD):
    corpus, trusted = collections.Counter(), collections.Counter()
    for key, text, _ in rows:
        corpus.update(_buckets(text))
        if key in good:
            trusted.update(_buckets(text))
    n, t = corpus.total(), trusted.total()
    prior = 5 / max(t, 1)
    weight = {
        b: round(1e6 * math.log(((trusted[b] / max(t, 1) if t else corpus[b] / n) + prior) / (corpus[b] / n + prior))) for b in corpus
    }
    out = []
    for key, text, _ in rows:
        base, own = _rules(text), _buckets(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        score = sum(weight[b] for b in own) / len(own) / 1e6 if own else 0.0
        out.append((key, *base, failed, len(own), score, not failed and score >= threshold))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    rows = [*EDGE]
    for i in range(40):
        words = [rng.choice(["the", "cat", "é!", "sat,", "on", "#*", "a|b", "Mat"]) + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(150))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", " "]) for w in words)
        rows.append((100 + i, text if i % 5 else text + "\n" + text, "en"))
    good = {r[0] for r in rows if r[0] and r[0] % 3 == 1}
    docs = spark.createDataFrame([(i, t, g, "s", 0, 7, "k", 9, "w", "i") for i, t, g in rows], SCHEMA).repartition(3)
    marks = [(k, 1, 0) for k in good] + [(k, 1, None) for k in good] + [(k + 1, 0, 0) for k in good] + [(102, 1, 1), (None, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for marked, ids in ((labels, good), (labels.limit(0), set())):
        got = _sorted(tuple(r) for r in quality_rules.judge(docs, marked).collect())
        want = _sorted(_judged(rows, ids))
        assert [r[:8] + r[9:] for r in got] == [r[:8] + r[9:] for r in want]
        assert np.allclose([r[8] for r in got], [r[8] for r in want], atol=2e-6)
    assert quality_rules.judge(empty_docs(spark), labels).collect() == []


def test_rules_where_hashes_of_windows_agree(spark, monkeypatch):
    """With three bits left for hashes many windows collide; they are told apart by their words."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(200))) for _ in range(30)]
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 61)
    got = {r.doc_id: r.n_repeat_words for r in quality_rules._measured(frame(spark, texts)).select("doc_id", "n_repeat_words").collect()}
    assert got == {i: _rules(t)[4] for i, t in enumerate(texts)}


def test_trusted_documents_are_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] * 2, "doc_id long, quality int, toxic int")
    ids = [r.doc_id for r in quality_rules.trusted_ids(labels, 7).collect()]
    assert ids == sorted(range(100), key=lambda i: zlib.crc32(str(i).encode()))[:7]


def test_long_text_of_rules(spark):
    text = "word and other things here, " * 200_000 + "end"  # 5.6 MB
    row = quality_rules._measured(frame(spark, [text])).drop("crc").first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines) == (1_000_001, 1_000_000, 0)


def _runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(w):
    gone = {i for s, n, q in _runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _periodic(rng):
    k, w = rng.randrange(1, 6), []
    n = rng.randrange(250)
    while len(w) < n:
        part = [f"w{rng.randrange(k + 1)}" for _ in range(rng.randrange(1, 30))]
        w += (part * rng.randrange(1, 9))[: rng.randrange(1, 200)]
    return w


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    lists = [_periodic(rng) for _ in range(150)]
    lists += [lists[i] + lists[i + 1] for i in range(10)] + [["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, []]
    rows = run_detection.detect_runs(frame(spark, ["  ".join(w) for w in lists])).collect()
    assert len(rows) == len(lists)
    for row in rows:
        w = lists[row.doc_id]
        assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (len(w), _runs(w), _collapsed(w))


def test_summary_with_planted_runs(spark):
    rng = random.Random(9)
    lists = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(120))] for _ in range(120)]
    docs = frame(spark, [" ".join(w) for w in lists])
    for row in run_detection.summary(run_detection.detect_runs(docs, run_detection.planted)).collect():
        w, h = lists[row.doc_id], zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = _runs(w)
        best = max(runs, key=lambda r: (r[1] // r[2], r[1] % r[2] / r[2], -r[0], -r[2]), default=None)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4))
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == want
        assert row.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(_collapsed(w).encode()).hexdigest()


def test_runs_of_edges_and_a_long_text(spark):
    got = run_detection.detect_runs(edge_docs(spark), run_detection.planted).collect()
    assert len(got) == len(EDGE) and run_detection.detect_runs(empty_docs(spark)).collect() == []
    words = [f"w{i % 1000}" for i in range(400_000)] + ["z"]
    row = run_detection.detect_runs(frame(spark, [" ".join(words)])).first()
    assert [tuple(r) for r in row.runs] == [(0, 400_000, 1000)] and len(row.collapsed.split()) == 1001


def test_nonterminals_are_looked_at_once():
    """Copies in one block share their grammar: boundaries do not grow with the number of copies."""
    rng = random.Random(1)
    one = [rng.randrange(500) for _ in range(400)]
    ids = np.array(one * 64)
    grammar = run_detection.repair(ids, np.repeat(np.arange(64), 400))
    assert len(grammar.left) + len(grammar.symbols) < 2 * len(one)
    assert grammar.length.max() == 400

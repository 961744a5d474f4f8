"""Operators against plain Python versions on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quadrille.llm import bpe, common, components, decontamination, exact_dedup, license_scan, line_dedup, lm_scoring, near_dedup, token_pack

from .helpers import EDGE, alnum_words, blank_words, edge_docs, frame, lower, random_texts

TEXTS = [*random_texts(120, 1), None, "", " \n", "w1\nw2 W3é \n  long enough line here\n"]


def _hits(text, items, window):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = alnum_words(body)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("phrase_bytes", [1 << 20, 60])
def test_decontamination(spark, phrase_bytes):
    items = list(enumerate(random_texts(12, 5, words=9), 100)) + [(7, "w1"), (7, "w2 w4"), (8, "never there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.search(frame(spark, TEXTS), "text", bench, 3, phrase_bytes=phrase_bytes).collect()
    for row in found:
        n, hit, own = _hits(row.text, items, 3)
        assert (row.words, sum(s.stop - s.start for s in row.spans), row["items"]) == (n, hit, own)


def test_cut_words():
    assert decontamination.cut_words(b"A b, c! d", [(1, 3)]) == b"A ! d"


def test_line_dedup(spark):
    lines = ["a shared line of text", "  A SHARED line of text\t", "short", "short", "own line number {}", ""]
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(lines).format(i) for _ in range(rng.randrange(1, 8))) for i in range(40)] + [None, ""]
    where = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    for min_docs in (2, 5):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts), min_docs=min_docs).collect()}
        for i, t in enumerate(texts):
            own = (t or "").split("\n")
            kept = [x for x in own if not (len(k := key(x)) >= 10 and len(where[k]) >= min_docs and min(where[k]) != i)]
            assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(own), len(own) - len(kept), "\n".join(kept))


def test_license_base(spark):
    scanner = license_scan.Scanner()
    rng = random.Random(4)
    pieces = ["under the MIT license", "Apache License, Version 2", "CC BY-NC", "the", "license", "apache", "foo", "under", "by"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)]
    for text, found in zip(texts, scanner.scan([t.encode() for t in texts]), strict=True):
        words = alnum_words(text)
        places = [
            (i, label)
            for phrase, label in license_scan.BASE_PHRASES
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        assert found.n_base == len(places) and found.base == tuple(sorted({p[1] for p in places}))
        assert (found.first, found.last) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_matching_statistics():
    rng = random.Random(8)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))]
        automaton = license_scan.SuffixAutomaton()
        for i, s in enumerate(strings):
            automaton.add(s, i)
        parts = {tuple(s[i:j]): None for s in strings for i in range(len(s)) for j in range(i, len(s) + 1)}
        text = [rng.randrange(4) for _ in range(30)]
        for i, (state, n) in enumerate(automaton.walk(text), 1):
            assert n == max(k for k in range(i + 1) if tuple(text[i - k : i]) in parts)
            if n:
                best = tuple(text[i - n : i])
                places = {k: [j + n - 1 for j in range(len(s)) if tuple(s[j : j + n]) == best] for k, s in enumerate(strings)}
                assert automaton.ends[state] == {k: ends for k, ends in places.items() if ends}


def test_license_templates():
    notice = dict(license_scan.TEMPLATES)["bsd"]
    found = license_scan.Scanner().scan([f"Intro words. {notice}, yes".encode(), b"redistribution and use"])
    assert [s[0] for s in found[0].spans] == ["bsd"] and not found[1].spans


def _ppm(text, counts, order):
    """PPM with escape method C and exclusion over nested dictionaries of counts."""
    data, out = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(data)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            live = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(live.values()) + len(live)
            if data[i] in live:
                out += math.log10(live[data[i]] / total)
                break
            if live and sum(live.values()):
                out += math.log10(len(live) / total)
            excluded |= set(seen)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def test_lm(spark):
    texts = [*random_texts(60, 9), None, "", "Zz éß"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, order=2).collect()}
    learn = [lower(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    words, counts = Counter(), defaultdict(Counter)
    for t in learn:
        words.update([*blank_words(t), " "])
        data = b"\xff\xff" + t.encode() + b"\xff"
        for i in range(2, len(data)):
            for k in range(3):
                counts[data[i - k : i]][data[i]] += 1
    total, distinct = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*blank_words(t), " "]
        row = got[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(w in words for w in tokens), total)
        assert math.isclose(row.base_score, sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens), abs_tol=1e-9)
        assert math.isclose(row.score, _ppm(lower(t).encode(), counts, 2), abs_tol=1e-6)


def test_lm_is_a_distribution():
    keys = np.concatenate([lm_scoring._coded(c, 2)[0] for c in lm_scoring._chunks([b"abracadabra", b"abba"], 2, 5)])
    grams = [np.unique(keys & np.uint64(lm_scoring._mask(k)), return_counts=True) for k in range(3)]
    pruned = [(k[c > 1], c[c > 1]) for k, c in grams]
    for trie in (lm_scoring.build_trie(grams), lm_scoring.build_trie(pruned)):
        for context in (b"ab", b"ra", b"zz", b"\xff\xff"):
            every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
            assert math.isclose(np.exp(lm_scoring.log_probabilities(every, trie)).sum(), 1)


def test_adaptive_code_length():
    assert lm_scoring.adaptive_code_length(b"ab" * 200) < 200 < lm_scoring.adaptive_code_length(bytes(range(64)) * 2)


def _sets(texts, size):
    out = []
    for t in texts:
        w = blank_words(t)
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80), (2, 60)])
def test_near(spark, size, percent):
    texts = [*random_texts(150, 11, words=60), None, "", "a", "A", "a b"]
    sets = _sets(texts, size)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = {r.doc_id: r for r in near_dedup.near_groups(frame(spark, texts), size, percent).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


def test_near_chain_without_common_leader(spark):
    """Every link of a chain counts although its ends are unlike."""
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base[:i] + ["x"] * i + base[2 * i :]) for i in range(0, 12)]
    sets = _sets(texts, 1)
    got = near_dedup.near_groups(frame(spark, texts), 1, 85).collect()
    linked = all(100 * len(a & b) >= 85 * len(a | b) for a, b in zip(sets, sets[1:], strict=False))
    assert linked and {r.component_id for r in got} == {0}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long"), common.Workspace(spark, "test")).collect()}
    parent = {i: i for e in edges for i in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(got.get(i, i) == find(i) for i in parent)


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*TEXTS, "a  b", "tab\t x", "<|endoftext|> y"]
    docs = frame(spark, texts, first=-3)
    manifest = token_pack.write_tokens(docs, path, str(tmp_path / "out"), range_bytes=500, file_ids=300)
    assert manifest.count() > 2
    got = sorted(token_pack.read_tokens(manifest).collect())
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, (text, row) in enumerate(zip(texts, got, strict=True)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (i - 3, start, len(ids))
        assert bytes(row.ids) == ids.tobytes() and row.ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype(np.uint32)
    assert (token_pack.unpack(token_pack.pack(ids, bits), len(ids), bits) == ids).all()
    with open(tmp_path / "f", "wb") as out:
        writer = token_pack.TokenFileWriter(out, bits, block_ids=100)
        for i in range(0, len(ids), 997):
            writer.add(i or None, ids[i : i + 997].astype("<u4").tobytes())
        writer.close()
    with open(tmp_path / "f", "rb") as file:
        read = token_pack.TokenFile(file, (tmp_path / "f").stat().st_size)
        assert (read.ids(0, len(ids)) == ids).all() and (read.ids(333, 4444) == ids[333:4444]).all()
        assert (read.document(3) == ids[3 * 997 : 4 * 997]).all()


def test_bpe(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, some = random.Random(1), list("aab  bc\n\té \x1c\x85 ÄÖ1²½,.'sst!中文🙂")
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["a" * 1000, "abcab" * 200, "".join(rng.choice("abcdef") for _ in range(2000)), " " * 300, "é" * 333, *TEXTS]
    vocabulary = bpe.share(spark, ranks, public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(frame(spark, texts), vocabulary), vocabulary).collect()
    for row in rows:
        text = texts[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


@pytest.mark.parametrize("key_bits", [64, 3, 1])
def test_exact(spark, tmp_path, key_bits):
    texts = [*TEXTS, *TEXTS[:30], *(t and t.upper() for t in TEXTS[:50])]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    folder = str(tmp_path / "index")
    options = {"key_bits": key_bits, "bucket_entries": 4, "range_bytes": 1000, "index_dir": folder}
    for row in exact_dedup.exact_groups(frame(spark, texts), **options).collect():
        own = groups[lower(texts[row.doc_id])]
        sha = hashlib.sha256(lower(texts[row.doc_id]).encode()).hexdigest()
        assert (row.keep_id, row.group_size, row.kept, row.text_sha256) == (max(own), len(own), row.doc_id == max(own), sha)
    for row in exact_dedup.exact_groups(frame(spark, texts), **options).collect():
        text = lower(texts[row.doc_id]).encode()
        entry = exact_dedup.RangeFile(row.index_file).find(exact_dedup._keyed(text, key_bits), text)
        assert (entry.count, entry.best[1]) == (len(groups[text.decode()]), max(groups[text.decode()]))


def test_extendible_directory_doubles():
    index = exact_dedup.ExtendibleIndex(capacity=2, key_bits=8)
    for k in range(64):
        index.add(exact_dedup.Entry(k, b"%d" % k, (True, k, 0), 1))
    for k in (1, 1, 1):
        index.add(exact_dedup.Entry(k, b"other%d" % len(list(index.entries())), (True, k, 0), 1))
    assert index.depth >= 5 and all(index.find(k, b"%d" % k) for k in range(64))
    assert all(len(b.entries) <= 2 or len({e.key for e in b.entries}) == 1 for b in index.buckets())


def test_repeated_rows_count(spark):
    rows = exact_dedup.exact_groups(edge_docs(spark)).filter("doc_id = 7").collect()
    assert [(r.group_size, r.kept) for r in rows] == [(2, True)] * 2
    empty = sum(not t for _, t, _ in EDGE)
    assert {r.group_size for r in exact_dedup.exact_groups(edge_docs(spark)).filter("doc_id = 3").collect()} == {empty}


def test_hash_tokens():
    texts = [b"Ab c", b"", b" c  Ab", b"\x00 c"]
    t = common.hash_tokens(texts, near_dedup.CLASSES)
    own = [t.hashes[a:b].tolist() for a, b in zip(t.offsets, t.offsets[1:], strict=False)]
    assert [len(x) for x in own] == [2, 0, 2, 2] and own[0] == own[2][::-1] and own[3][1] == own[0][1]

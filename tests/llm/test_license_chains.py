"""Chains of license matches against all chains there are, on templates that repeat phrases."""

import random

from quadrille.llm import license_scan


def _maximal_matches(words, template, least):
    """(start, length) of the longest matches with any of the templates' places that end at each word."""
    out = []
    for end in range(1, len(words) + 1):
        n = max(k for k in range(end + 1) if any(template[j : j + k] == words[end - k : end] for j in range(len(template) - k + 1)))
        if n >= least:
            out.append((end - n, n))
    return [(at, n) for at, n in out if (at, n + 1) not in out]


def _best_cover(words, template, least, gap):
    """Most words of the template that any chain covers, by trying all of them."""
    matches = [
        (at, at + n, j, j + n)
        for at, n in _maximal_matches(words, template, least)
        for j in range(len(template) - n + 1)
        if template[j : j + n] == words[at : at + n]
    ]

    def after(last, covered):
        best = len(covered)
        for m in matches:
            if all(a < b for a, b in zip(last, m, strict=True)) and m[0] - last[1] <= gap:
                best = max(best, after(m, covered | set(range(m[2], m[3]))))
        return best

    return max((after(m, set(range(m[2], m[3]))) for m in matches), default=0)


def _scanner(templates, **options):
    return license_scan.Scanner(templates=templates, phrases=(("never stands here", "x"),), keys={}, rivals={}, **options)


def test_chains_cover_what_any_chain_can():
    rng = random.Random(11)
    labelled = 0
    for _ in range(250):
        phrase = rng.choices("abcd", k=3)
        template = [*phrase, *rng.choices("efg", k=rng.randrange(4)), *phrase, *rng.choices("abcdefg", k=rng.randrange(1, 5))]
        least, gap, cover = rng.choice([2, 3]), rng.choice([0, 1, 3]), rng.choice([0.5, 0.7, 1.0])
        words = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(len(template))
            words += [*template[a : a + rng.randrange(2, 7)], *rng.choices("abxy", k=rng.randrange(3))]
        found = _scanner([("t", " ".join(template))], min_match=least, min_cover=cover, max_gap=gap).scan([" ".join(words).encode()])[0]
        best = _best_cover(words, template, least, gap)
        assert bool(found.spans) == (best > 0 and best >= cover * len(template)), (template, words, least, gap, cover, best, found)
        if found.spans:
            assert abs(max(s[3] for s in found.spans) - best / len(template)) < 1e-9
            labelled += 1
    assert labelled > 40


def test_a_repeated_phrase_continues_where_it_covers_most():
    template = "aa bb cc xx yy zz aa bb cc pp qq rr ss"
    found = _scanner([("t", template)]).scan([b"xx yy zz W aa bb cc W pp qq rr ss"])[0]
    assert [(s[0], s[1], s[2]) for s in found.spans] == [("t", 0, 12)] and abs(found.spans[0][3] - 10 / 13) < 1e-9


def test_whole_texts():
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        if len(words) > 60:
            changed = " ".join(w for k, w in enumerate(words) if k % 40 != 17)
            assert label in {s[0] for s in license_scan.Scanner().scan([changed.encode()])[0].spans}

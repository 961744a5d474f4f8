"""That no bound of an operator costs a part of its job."""

import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import common, decontamination, language_id, license_scan, line_dedup, lm_scoring

from .helpers import EDGE, edge_docs, frame, lower, random_texts
from .test_brute_force import _ppm


@pytest.mark.parametrize("order,min_share", [(4, 0.002), (3, 2.0), (1, 2.0), (2, 1e-9)])
def test_lm_knows_what_the_head_does_not_hold(spark, order, min_share):
    texts = [*random_texts(60, 9), None, "", "Zz éß", "seldom seen 中文", "Seldom seen 中文 🙂"]
    docs = frame(spark, texts)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, order=order, min_share=min_share).collect()}
    counts = defaultdict(Counter)
    for i, t in enumerate(texts):
        data = b"\xff" * order + lower(t).encode() + b"\xff"
        for at in range(order, len(data)) if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            for k in range(order + 1):
                counts[data[at - k : at]][data[at]] += 1
    for i, t in enumerate(texts):
        assert math.isclose(got[i], _ppm(lower(t).encode(), counts, order), abs_tol=1e-6)


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_lm_tail_in_parts(most):
    texts = [t.encode() for t in random_texts(40, 3)]
    coded = lambda own, most: np.concatenate([lm_scoring._coded(c, 4)[0] for c in lm_scoring._chunks(own, 4, most)])
    keys, counts = np.unique(coded(texts, 1 << 20), return_counts=True)
    assert (np.unique(coded(texts, 7), return_counts=True)[1] == counts).all()
    grams = [lm_scoring._merge(keys & np.uint64(lm_scoring._mask(k)), counts) for k in range(5)]
    trie = lm_scoring.build_trie(grams)
    asked = np.unique(coded([b"w1 w22 w3 zz", b"W6\xc3\xa9 w7 w1"], 1 << 20))
    rows = [(-1, k, n) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)] + [(k % 3, k, 2) for k in asked.tolist()]
    rows.sort(key=lambda r: (r[1] >> 8 & 0xFFFF, r[0]))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 7], strict=True)], names=["uid", "gram", "n"])
        for i in range(0, len(rows), 7)
    ]
    got = Counter()
    for batch in lm_scoring._score_tail(SimpleNamespace(value=trie.levels[:2]), 4, most)(batches):
        got.update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
    logs = 2 * lm_scoring.log_probabilities(asked, trie) / math.log(10)
    for uid in range(3):
        assert math.isclose(got[uid], logs[asked % np.uint64(3) == uid].sum(), abs_tol=1e-9)


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
CC = "This work is licensed under a Creative Commons {} International License"


@pytest.mark.parametrize(
    "text,label",
    [
        *((text, label) for label, text in license_scan.TEMPLATES),
        (GPL.format(2), "gpl-2"),
        (GPL.format(3), "gpl-3"),
        (GPL.format("2.1").replace("program", "library").replace("GNU", "GNU Lesser"), "lgpl"),
        (CC.format("Attribution 4.0"), "cc-by"),
        (CC.format("Attribution-ShareAlike 4.0"), "cc-by-sa"),
        (CC.format("Attribution-NonCommercial 4.0"), "cc-by-nc"),
        (CC.format("Attribution-NoDerivatives 4.0"), "cc-by-nd"),
        (CC.format("Attribution-NonCommercial-ShareAlike 4.0"), "cc-by-nc-sa"),
        (CC.format("Attribution-NonCommercial-NoDerivatives 4.0"), "cc-by-nc-nd"),
        (CC.format("Attribution-NonCommercial-ShareAlike 3.0").replace("International", "Unported"), "cc-by-nc-sa"),
        (CC.format("Attribution-Non-Commercial 4.0"), None),
        (GPL.format(3).replace("GNU", "GNU Affero"), None),
    ],
)
def test_license_notices_get_their_own_label(text, label):
    for around in ("{}", "Some words of a page. {}, and what follows it."):
        found = license_scan.Scanner().scan([around.format(text).encode()])[0]
        assert {s[0] for s in found.spans} == ({label} if label else set())


def test_license_of_two_notices():
    text = f"{GPL.format(2)} one two three four five six seven eight nine {CC.format('Attribution-NonCommercial 4.0')}"
    assert [s[0] for s in license_scan.Scanner().scan([text.encode()])[0].spans] == ["gpl-2", "cc-by-nc"]


def test_unlabelled_documents_stay(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t, _ in EDGE if any(c.isalpha() for c in t or ""))


def test_short_items_cost_no_long_documents(spark):
    item = " ".join(f"i{k}" for k in range(12))
    bench = spark.createDataFrame([(1, "yes"), (2, "Ann Lee"), (3, item)], "item_id long, text string")
    long = " ".join(f"t{k}" for k in range(30))
    texts = [f"{long} yes", f"Ann Lee {long} yes", "Ann Lee", "yes no", f"{long} {item[3:]} {long}", f"{long} {item[:20]}", None, ""]
    kept = decontamination.decontaminate(frame(spark, texts), bench).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 5, 6, 7]


def test_line_dedup_of_very_many_lines(spark):
    """Two documents of half a million lines each, most of them shared, in linear time."""
    import time

    n = 500_000
    long = [f"line number {i} of a long log" for i in range(n)]
    texts = ["\n".join(long), "\n".join([*long[: n - 1000], "short", *(f"own line number {i}" for i in range(1000))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.time()
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert (rows[0].n_lines, rows[0].n_dropped, rows[0].text == texts[0]) == (n, 0, True)
    assert (rows[1].n_lines, rows[1].n_dropped) == (n + 1, n - 1000)
    assert rows[1].text == "\n".join(["short", *(f"own line number {i}" for i in range(1000))])


def test_draws_of_very_large_totals(spark):
    """A share of 5,000 of 10^10 rows is not 0: of 2^31 hashes about a thousand pass, here shown on its bound."""
    keys = spark.range(2_000_000)
    for total, low, high in ((10**7, 800, 1200), (10**8, 60, 140)):
        assert low < keys.filter(common.drawn(F.col("id"), 5000, total)).count() < high
    # The hash that is smallest of these keys is drawn even among 10^10 rows if it is below the share.
    least = keys.select(F.min(F.xxhash64("id")).alias("h")).first().h
    share = (least + 2**63) / 2**64
    wanted = 5000
    assert keys.filter(common.drawn(F.col("id"), wanted, int(wanted / share * 0.99))).count() == 1
    assert keys.filter(common.drawn(F.col("id"), wanted, int(wanted / share * 1.01))).count() == 0
    assert keys.limit(100).filter(common.drawn(F.col("id"), wanted, 4999)).count() == 100

"""Ranked search against plain Python."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.fixtures import AWKWARD, documents, prose
from tilewater.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, k=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, w in held:
            m = 50 + 50 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in ts & set(w))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def check(spark, docs, items, k=50, clashing=False):
    df = documents(spark, docs, clashing).repartition(5)
    got = [tuple(r) for r in ranked.search(df, spark.createDataFrame(items, ITEMS), k).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute([d[:2] for d in docs], items, k), key=key)


def corpus(n=160):
    r = random.Random(3)
    docs = [(i, prose(i, r.randint(1, 90), 60)) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [(2000, "Common " * 500), (None, docs[3][1]), (3, docs[3][1])]
    return docs + [a[:2] for a in AWKWARD]


def test_against_plain_python_with_ties_nulls_and_repeats(spark):
    items = [(i, prose(500 + i, 3 + 8 * i, 80)) for i in range(9)]
    items += [(20, None), (21, ""), (22, "?!"), (23, "nowhere"), (24, "COMMON common"), (0, "漢字 É"), (None, prose(4, 20)), (3, items[3][1])]
    check(spark, corpus(), items, clashing=True)
    check(spark, corpus(40), items, k=3)


def test_every_block_of_items_counts(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 12)
    check(spark, corpus(30), [(i, prose(500 + i, 3 + 3 * i, 80)) for i in range(9)], k=4)


def test_no_documents_or_no_items(spark):
    some, none = spark.createDataFrame([(1, "a b")], ITEMS), spark.createDataFrame([], ITEMS)
    assert ranked.search(documents(spark, [(1, None), (2, " ")]), some).count() == 0
    assert ranked.search(documents(spark, [(1, "a")]), none).count() == 0
    assert ranked.search(documents(spark, []), some).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_are_left_once_their_bound_lies_below_the_worst_kept():
    r = np.random.default_rng(1)
    present = r.random((12, 5000)) < np.linspace(0.02, 0.9, 12)[:, None]
    gains = np.where(present, r.integers(900, 1001, present.shape) * np.linspace(3000, 10, 12).astype(int)[:, None], 0)
    best = ranked.Best(50)
    scored = ranked.evaluate(best, gains, present, np.arange(5000))
    total = gains.sum(axis=0)
    order = np.lexsort((np.arange(5000), -total))[:50]
    assert (best.ids == order).all() and (best.scores == total[order]).all() and scored < 2500


def test_equal_scores_prefer_small_ids_even_in_later_masks():
    present = np.array([[True, False, True, False], [False, True, False, True]])
    gains = present * 100
    best = ranked.Best(2)
    ranked.evaluate(best, gains, present, np.array([9, 1, 8, 2]))
    assert best.ids.tolist() == [1, 2]


def test_ids_of_text(spark):
    out = ranked.search(documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "b")], ITEMS).withColumn("item_id", F.lit("x")))
    assert [tuple(r) for r in out.collect()][0][:3] == ("x", 1, 1)

"""Quality rules: counts against plain Python, sketches and limits."""

import random
import re

from tests.llm.fixtures import AWKWARD, LONG, documents, prose
from tilewater.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    w, t = WORD.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for i, x in enumerate(runs):
        seen.setdefault(x, []).append(i)
    twice = {p + j for places in seen.values() if len(places) > 1 for p in places for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


TEXTS = [
    "a b c a b c", "a a a a a", "a a a", "x a b c y a b c z a b c", "one\ntwo\none\n \n \none ", "a\tb\x0bc\x0cd\re\nf", "# * $ %&|<> ##", "  nbsp stays",
    "a\n\n\nb\na\r\na\r\n", prose(3, 300, 6), LONG, prose(1, 40_000, 50), " ".join(["lorem ipsum dolor"] * 500), "😀 😀 😀 😀", None, "",
]


def test_counts_against_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, a[1]) for i, a in enumerate(AWKWARD)]
    out = rules.digest(documents(spark, rows, clashing=True)).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in out} == {i: brute(t) for i, t in rows} and len(out) == len(rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_buckets_hold_and_are_narrow(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    values = [0, 1, 63, 64, 127, 128, 129, 2**40, 2**62] + [r.randrange(2 ** r.randint(1, 60)) for _ in range(500)]
    for v, b in spark.createDataFrame([(v,) for v in values], "v long").select("v", rules.bucket(F.col("v"))).collect():
        assert b <= v and (v - b) * rules.STEPS <= v and (v >= 128 or b == v)


def test_sketches_merge_and_give_quartiles(spark):
    r = random.Random(2)
    rows = [(str(i % 3), str(i % 7), int(r.lognormvariate(6, 2))) for i in range(5000)]
    fine = rules.sketches(spark.createDataFrame(rows, "lang string, source string, x long").repartition(9), ["lang", "source"], ["x"])
    whole = rules.quartiles(rules.merged(fine, ()), ()).first()
    values = sorted(x for *_, x in rows)
    for q, got in ((1, whole.q1), (3, whole.q3)):
        true = values[-(-q * len(values) // 4) - 1]
        assert got <= true <= got * (1 + 1 / rules.STEPS) + 1
    assert whole.n == 5000


def test_limits_follow_their_group_and_fall_back(spark):
    usual = [(i, prose(i, 120), "en", "big") for i in range(250)]
    marked = [(1000 + i, " ".join(w + "#" for w in prose(i, 120).split()), "en", "code") for i in range(250)]
    few = [(2000 + i, prose(i, 120), "en", "small") for i in range(10)] + [(2100, prose(7, 120), "xx", None)]
    odd = [(3000, marked[0][1], "en", "big"), (3001, marked[1][1], "xx", None), (3002, prose(1, 120) + " " + "w" * 4000, "en", "small")]
    out = {r.doc_id: r for r in rules.judged(documents(spark, usual + marked + few + odd), "doc_id").collect()}
    assert all(out[r[0]].kept for r in usual + marked + few)
    assert out[3000].reasons == ["symbol_share"] and not out[3000].kept  # a third of symbols is normal in one source only
    assert out[3001].kept  # judged by all: half of them hold symbols
    assert out[3002].reasons == ["word_length"]


def test_same_verdicts_however_rows_are_dealt(spark):
    rows = [(i, prose(i, 60 + i % 50, 30 + i % 90), "ab"[i % 2], "xyz"[i % 3]) for i in range(400)]
    a, b = (sorted(map(tuple, rules.digest(documents(spark, rows).repartition(n)).collect())) for n in (1, 13))
    assert a == b

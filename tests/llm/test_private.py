import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, documents
from tilewater.llm import private
from tilewater.llm.common import table

SF = "/root/testdata/sf0.01"


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


def base(text):
    """The contract, said once more with another engine's expressions."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (r, listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in private.KINDS[:4]]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    check(private.digest(docs).collect(), {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


TRICKY = [
    "a.b@c.d%e@f.g.h x@y x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.001 9.9.9.99999999999", "é😀 +1 (234) 567-8901. +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111111 4111111111111111 41111111111111112", "@@@ a@b. .@x.y -@-.-",
    "card 4465758382889437 4465758382889437 ok", "pay to IBAN GB82 WEST 1234 5698 7654 32 now; GB82WEST12345698765433 is wrong",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 24be64439e3e49cf46b2d7c90f3602a3d0b907ff', "call (523) 555-1055 or 523 555 1055",
    "7" * 5000 + "@" + "a" * 5000, "1-" * 20000 + "1", "+" + "9 " * 5000 + "9",
]


def test_tricky_and_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + i, t) for i, (_, t, *_) in enumerate(AWKWARD)]
    out = private.digest(documents(spark, rows, clashing=True)).collect()
    check(out, dict(rows))
    spans = {r.doc_id: r.spans for r in out}
    assert spans[5] == "card:5:21,card:22:38"
    assert spans[6] == "iban:12:39"
    assert spans[7] == "secret:9:49"
    assert spans[8] == "phone:5:19,phone:23:35"
    assert private.digest(documents(spark, [])).count() == 0


def test_mask_rewrites_text_and_keeps_columns(spark):
    rows = [(1, "é mail a@b.cd now"), (2, None), (3, "clean"), (4, "+1 (234) 567-8901")]
    df = documents(spark, rows, clashing=True)
    out = {r.doc_id: r for r in private.mask(df).collect()}
    assert private.mask(df).columns == df.columns
    assert out[1].text == "é mail [EMAIL] now" and out[1].n_chars == 18
    assert out[2].text is None and out[3].text == "clean" and out[4].text == "[PHONE]"
    assert private.mask(df).where(F.col("row") == "clash").count() == 4


def test_context_on_both_sides_and_past_earlier_matches(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3"
    rows = [
        (0, "Call 555-123-4567 or 555-123-4568; 555-123-4569 (mobile)"), (1, "call (523) 555-1055 or 523 555 1055"), (2, f"{key} is the password"),
        (3, "555-123-4567 " + "x" * 41 + " call " + "x" * 41 + " 555-123-4568"), (4, "DE89370400440532013000 BIC COBADEFFXXX"),
        (5, "GB82WEST12345698765432 2024-01-01"), (6, "IT12 GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947"), (7, "DE89370400440532013001 BIC"),
        (8, "😀é 555-123-4567 é😀 phone"), (9, f"Key: {key} x " + "y" * 30 + " no"), (10, ""), (11, None),
    ]
    out = {r.doc_id: r.spans for r in private.digest(documents(spark, rows, clashing=True)).collect()}
    assert out == {
        0: "phone:5:17,phone:21:33,phone:35:47", 1: "phone:5:19,phone:23:35", 2: "secret:0:32", 3: "", 4: "iban:0:22", 5: "iban:0:22",
        6: "iban:5:32,iban:33:51", 7: "", 8: "phone:3:15", 9: "", 10: "", 11: ""}
    masked = {r.doc_id: r.text for r in private.mask(documents(spark, rows)).collect()}
    assert masked[0] == "Call [PHONE] or [PHONE]; [PHONE] (mobile)" and masked[4] == "[IBAN] BIC COBADEFFXXX"


def test_very_many_matches_in_one_text(spark):
    """100,000 addresses and numbers in one text take seconds, places and mask as in plain Python."""
    import time

    words, at, want = [], 0, []
    for i in range(50_000):
        for kind, text in (("email", f"a{i}@b.io"), ("ip", f"10.{i % 256}.{i // 256 % 256}.7")):
            want.append((at, kind, at + len(text)))
            words.append(text)
            at += len(text) + 1
    text = " ".join(words)
    df = documents(spark, [(1, text), (2, "x@y.org " * 3)])
    began = time.time()
    out = {r.doc_id: r for r in private.digest(df).collect()}
    took = time.time() - began
    assert (out[1].n_email, out[1].n_ip) == (50_000, 50_000)
    assert out[1].spans == ",".join(f"{k}:{a}:{b}" for a, k, b in want)
    masked = {r.doc_id: r.text for r in private.mask(df).collect()}
    assert masked[1] == " ".join(["[EMAIL] [IP]"] * 50_000) and masked[2] == "[EMAIL] " * 3
    assert took < 60


def test_mask_of_long_texts_by_pieces(spark):
    """Spans before, across and behind the cuts, code points beyond the basic plane."""
    import random

    r = random.Random(4)
    rows = []
    for i in range(12):
        parts = []
        for _ in range(r.randint(1, 60)):
            parts.append("\U0001F600 word " * r.randint(0, 300))
            parts.append(f"m{r.randint(0, 9)}@host{r.randint(0, 99)}.org ")
        rows.append((i, "".join(parts)))
    rows.append((90, "y " * (private.PIECE * private.CUT) + "a@b.org"))
    import re

    for row in private.mask(documents(spark, rows)).collect():
        assert row.text == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", dict(rows)[row.doc_id])


def test_added_spans_apart_from_base_ones(spark):
    """Overlaps found in two passes are those found by looking at all pairs."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(9)
    span = lambda kind: (a := r.randint(0, 300), 2, a + r.randint(1, 12), kind, 0.8, "t")
    rows = [(i, [span("card") for _ in range(r.randint(0, 20))], [span("card") for _ in range(r.randint(0, 40))]) for i in range(40)]
    rows.append((99, [span("card") for _ in range(300)], [span("card") for _ in range(700)]))
    df = spark.createDataFrame(rows, f"id int, base {private._SPAN}, more {private._SPAN}")
    for got in df.select("id", private._apart(F.col("base"), F.col("more")).alias("free")).collect():
        base, more = next(x[1:] for x in rows if x[0] == got.id)
        want = [m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        assert sorted(map(tuple, got.free)) == sorted(want)

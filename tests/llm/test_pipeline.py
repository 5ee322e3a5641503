"""Stages of the pipeline against plain Python, each on its own input; rows without ids or with shared ids."""

import re
from itertools import combinations

import corpus_pipeline as pipeline
from tests.llm.fixtures import AWKWARD, ITEM, documents
from tilewater.llm import benchmark, licenses, mixing
from tilewater.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def kept_of_groups(rows):
    sets = {}
    for r in rows:
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]

    told = stored(stages["language_id"](spark, docs, small))
    assert told.columns == COLUMNS
    left = {r.doc_id for r in told.collect()}
    assert not left & {1, 2, 3, 4} and len(left) > 0.8 * docs.count()

    unique = stored(stages["near_dedup"](spark, told, small))
    assert unique.columns == COLUMNS and {r.doc_id for r in unique.collect()} == kept_of_groups(told.collect())

    clean = stored(stages["decontamination"](spark, unique, small))
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    sought = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in sought for n in {len(s) for s in sought} for i in range(len(w) - n + 1))

    assert clean.columns == COLUMNS
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect() if not hit(r.text)}

    masked = stored(stages["personal_data"](spark, clean, small))
    assert masked.columns == COLUMNS and masked.count() == clean.count()

    mixed = stages["mixing"](spark, masked, small).collect()
    sizes = {}
    for r in masked.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, goal in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert abs(sum(r.n_words for r in mixed if r.source == source) - goal) <= 0.05 * goal + 1


def test_decontamination_of_shared_and_absent_ids(spark):
    bench = spark.createDataFrame([(7, ITEM), (None, ITEM), (8, None)], "item_id long, text string")
    rows = [(None, ITEM, None, None), (None, "clean", None, None), (5, ITEM, None, None), (5, "other text", None, None), (5, ITEM, None, None), *AWKWARD]
    df = documents(spark, rows, clashing=True)
    out = [(r.doc_id, r.n_words, r.n_hit) for r in benchmark.decontaminate(df, bench).collect()]
    assert len(out) == len(rows) and out.count((5, 30, 30)) == 2 and (None, 30, 30) in out and (5, 2, 0) in out and (None, 1, 0) in out
    clean = benchmark.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - 3


def test_license_scan_keeps_rows(spark):
    rows = [(None, "MIT license", None, None), (5, "mit LICENSE mit license", None, None), (5, "", None, None), *AWKWARD]
    out = [(r.doc_id, r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.digest(documents(spark, rows, clashing=True)).collect()]
    assert len(out) == len(rows) and (None, 1, 0, 0, "mit") in out and (5, 2, 0, 2, "mit") in out and (5, 0, None, None, "") in out


def test_language_stage_keeps_mixed_and_drops_foreign_texts(spark):
    from tests.llm.fixtures import prose

    rows = [(i, prose(i, 60), "x", "a") for i in range(20)] + [
        (100, "Это совсем другой язык и другие буквы", None, "a"), (101, "Это язык " + prose(1, 40), None, "a"), (102, "12 34 !!", "x", "a"), (103, None, "x", "a")]
    kept = {r.doc_id for r in pipeline.language_id(spark, documents(spark, rows), "").collect()}
    assert kept == {*range(20), 101}


def test_language_stage_keeps_large_alphabets_and_drops_unlearnt_languages(spark):
    import random

    def tongue(letters, lengths, seed):
        pool = ["".join(random.Random(seed * 10_000 + i).choices(letters, k=lengths[i % len(lengths)])) for i in range(400)]
        return lambda i, n: " ".join(random.Random(seed * 10_000 + 1000 + i).choices(pool, k=n))

    one, two = tongue("abcdefghijklmnoprstu", (3, 4, 5, 6, 7, 8), 1), tongue("abcdefghijklmnoprstu", (3, 4, 5, 6, 7, 8), 2)
    large, thai = tongue([chr(0x4E00 + 5 * i) for i in range(1200)], (1, 2, 2, 3), 3), tongue([chr(0x0E01 + i) for i in range(40)], (3, 5), 4)
    rows = [(i, one(i, 60), "x", "a") for i in range(40)] + [(100 + i, large(i, 150), "z", "a") for i in range(40)]
    rows += [(200 + i, large(500 + i, 100), None, "a") for i in range(10)] + [(300 + i, one(500 + i, 50), None, "a") for i in range(10)]
    rows += [(400 + i, two(i, 60), None, "a") for i in range(10)] + [(500 + i, thai(i, 60), None, "a") for i in range(10)]
    out = {r.doc_id: r.lang for r in pipeline.language_id(spark, documents(spark, rows), "").collect()}
    assert out == {r[0]: r[2] or ("z" if r[0] < 300 else "x") for r in rows if r[0] < 400}

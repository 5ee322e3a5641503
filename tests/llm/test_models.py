"""Language ID, quality, mixing, fingerprints and block products against plain Python and held-out rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, corpus, documents, edit, prose
from tilewater.llm import imatch, language, mixing, near, quality, suffixes, tokens, urls
from tilewater.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.digest(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 150 < len(held) < 350
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_greedy_parsing_counts_longest_matches():
    sample = {"x": ["abracadabra"], "y": ["the cat sat"]}
    model = language.build(sample)
    table_ = language.symbol_table(model.letters)

    def brute(text, said):
        s, t = language.symbols(text, table_).tolist(), language.symbols(said + " ", table_).tolist()
        inside = lambda p: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
        n = i = 0
        while i < len(s):
            j = i + 1
            while j < len(s) and inside(s[i : j + 1]):
                j += 1
            n, i = n + 1, j
        return n

    for text in ("cadabra the cat", "zzz", "sat on", "abra abra"):
        s = language.symbols(text, table_)
        block = np.full((1, language.BLOCK), language.PAD, np.uint8)
        block[0, : len(s)] = s
        assert language.phrases(block, model)[:, 0].tolist() == [brute(text, sample["x"][0]), brute(text, sample["y"][0])]


def test_language_of_awkward_rows(spark):
    rows = [(i, t, "xy"[i % 2], None) for i, (_, t, *_) in enumerate(AWKWARD)]
    out = {r.doc_id: r for r in language.digest(documents(spark, rows, clashing=True)).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and out[4].lang_pred in ("x", "y")
    unlabelled = language.digest(documents(spark, [(1, "no labels here")])).collect()
    assert unlabelled[0].lang_pred == "und" and unlabelled[0].score == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.digest(docs, labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = [r.score for r in rows if truth[r.doc_id]], [r.score for r in rows if not truth[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_score_is_a_dot_product(spark):
    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["two words", None, "", "two words and $$$ more $$$ words", "é " * 300]
    one_by_one = [quality.score_texts([t], w)[0] for t in texts]
    assert np.allclose(quality.score_texts(texts, w), one_by_one)
    assert one_by_one[1] == one_by_one[2] == pytest.approx(1 / (1 + np.exp(-w[-1])))
    assert quality.fit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int")).sum() == 0


def test_targets_stop_at_their_limit():
    assert mixing.targets([10, 10, 10]) == pytest.approx([18.75, 7.5, 3.75])
    got = mixing.targets([1, 100, 100, 0])
    assert got[0] == 3 and got[3] == 0 and sum(got) == pytest.approx(201) and got[1] / got[2] == pytest.approx(2)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one(size):
    v = np.arange(size)
    out = mixing.permuted(v, np.full(size, size), np.full(size, 5))
    assert sorted(out) == list(range(size))
    assert (mixing.permuted(out, np.full(size, size), np.full(size, 5), back=True) == v).all()
    if size > 16:
        assert (out != v).any() and (mixing.permuted(v, np.full(size, size), np.full(size, 6)) != out).any()


def test_draws_use_up_every_slot():
    drawn = mixing.draw([100, 0, 7, 993], shard_slots=64)
    for k, n in enumerate([100, 0, 7, 993]):
        mine = sorted((f, c) for _, s, f, c, _ in drawn if s == k)
        assert sum(c for _, c in mine) == n and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_draws_of_a_task_are_those_of_all(spark):
    slots = [300, 0, 7, 4000, 1, 2693]
    whole = mixing.draw(slots, shard_slots=64)
    assert [r for a in range(0, 110, 10) for r in mixing.draw(slots, 64, low=a, high=a + 10)] == whole
    assert sorted(tuple(r) for r in mixing.drawn(spark, slots, 64).collect()) == sorted(whole)
    filled = {}
    for shard, _, _, count, place in whole:
        assert place == filled.get(shard, 0)
        filled[shard] = place + count
    assert [filled[i] for i in range(len(filled))] == [64] * 109 + [25]
    huge = mixing.draw([40_000_000_000, 3, 25_000_000_000], low=9_000_000, high=9_000_002)
    assert {r[0] for r in huge} == {9_000_000, 9_000_001} and sum(r[3] for r in huge) == 2 * mixing.SHARD_SLOTS
    share = [sum(c for s, k, _, c, _ in whole if k == 3 and s < 55), sum(c for s, k, _, c, _ in whole if k == 3 and s >= 55)]
    assert min(share) > 1800  # both halves hold about half of a source


@pytest.mark.parametrize("size", [1, 2, 255, 256, 257, 700, 5000])
def test_slots_hold_the_target_to_the_word(size):
    for words in {0, 1, size // 3, size - 1, size, size + 1, 2 * size + size // 2, 3 * size}:
        blocks, slots, last = mixing.quota(size, words, 4)
        s = np.arange(slots)
        block = mixing.permuted(s % blocks, np.full(slots, blocks), np.full(slots, 4 + mixing.BLOCK_KEY))
        length = np.where(block == blocks - 1, size - (blocks - 1) * mixing.BLOCK, mixing.BLOCK)
        if slots:
            assert 0 < last <= length[-1]
            length[-1] = last
        assert length.sum() == words
    assert mixing.quota(0, 0.0, 1) == (0, 0, 0)


def test_mixture_and_its_digest_agree(spark):
    docs = documents(spark, [(i, prose(i, 5 + 40 * (i % 9)), None, "abcd"[i % 4]) for i in range(120)] + [(500, None, None, None), (501, "one", None, None)])
    rows = mixing.digest(docs).collect()
    again = sorted(mixing.digest(docs.repartition(5)).collect())
    assert sorted(rows) == again and len(rows) == 122
    source, by = {r.doc_id: r.source for r in docs.collect()}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((source[r.doc_id], r.target), []).append(r.taken)
    assert len(by) == 5 and all(abs(t - sum(got)) <= 0.5 for (_, t), got in by.items())
    blocks = mixing.mixture(docs).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in rows)
    assert all(len(b.text.split(" ")) == b.n_words <= mixing.BLOCK for b in blocks)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(b.text in " ".join(texts[i] for i in b.doc_ids) or len(b.doc_ids) == 1 for b in blocks)


def test_fingerprints_against_the_next_document(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    rows = imatch.digest(docs).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        own, after = texts[r.doc_id], ids[(ids.index(r.doc_id) + 1) % len(ids)]
        q = len(own) // 4
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - q] + texts[after][:q]).encode()).hexdigest()
        assert (r.near_next == 1) == (r.fingerprint == prints[after]) and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


def test_fingerprints_of_awkward_rows(spark):
    rows = imatch.digest(documents(spark, AWKWARD, clashing=True)).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    alone = imatch.digest(documents(spark, [(1, "single text of one table")])).collect()[0]
    assert alone.near_next == 1


def _shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_block_products_find_the_links_between_components(spark):
    base = prose(1, 150)
    texts = {i: edit(base, *range(i % 7, 150, 23 + i % 5)) for i in range(60)}
    label = {i: i % 3 for i in texts}
    rows = spark.createDataFrame([(0, 0, 60, 40, i, label[i], label[i] > 0, t) for i, t in texts.items()],
                                 "tree int, path long, m long, s long, node long, label long, stray boolean, text string")
    got = {(r.a, r.b) for r in near.between_blocks(rows, 3, 85, 100).collect()}
    sets = {i: _shingles(t, 3) for i, t in texts.items()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert all(linked(a, b) and label[a] != label[b] for a, b in got)
    for a in (i for i in texts if label[i]):
        for other in {label[b] for b in texts if label[b] != label[a] and linked(a, b)}:
            assert any(x == a and label[b] == other for x, b in got)


def test_near_classes_of_awkward_rows(spark):
    rows = [*AWKWARD, (None, "a row without an id but with some words", None, None), (20, "a row without an id but with some words", None, None)]
    out = near.classes(documents(spark, rows, clashing=True)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[6] + by[7]} == {6} and not by[7][0].kept
    assert {r.component_id for r in by[None]} == {20} and all(r.n_shingles == 0 for i in (1, 2, 3) for r in by[i])
    df = documents(spark, rows, clashing=True)
    kept = near.unique(df)
    assert kept.columns == df.columns and kept.where("doc_id in (6, 7)").count() == 1


@pytest.mark.parametrize("hot", [2048, 1])
def test_suffixes_with_and_without_hot_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = [r for r in corpus() if r[0] < 45]
    got = {r.doc_id: r for r in suffixes.deduplicate(documents(spark, rows, clashing=True).repartition(3), with_text=True).collect()}
    first, texts = {}, {r[0]: (r[1] or "").encode() for r in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(texts[i][p : p + 50], i)
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i].n_removed == gone.sum() and got[i].n_spans == np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)


def test_suffixes_of_awkward_rows(spark):
    out = suffixes.digest(documents(spark, [*AWKWARD, (None, "x" * 80, None, None), (1000, "x" * 80, None, None)])).collect()
    assert len(out) == len(AWKWARD) + 2 and all(r.n_removed == 0 for r in out if r.doc_id is None or r.doc_id == 1000)


def test_normal_forms(spark):
    rows = [("https://www.A.org:443/x/index.html?utm_source=q&ref=1#f", "a.org/x"), ("http://a.org/x/", "a.org/x"), ("http://a.org/?b=1&ref=2", "a.org?b=1"),
            (None, None), ("mailto:x", None)]
    got = spark.createDataFrame(rows, "url string, want string").select("want", urls.normal(F.col("url")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_links_of_all_forms(spark):
    can, ref = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    page = "https://s.net/a/b/c?x=1"
    named = {
        "page.html": "s.net/a/b/page", "../x": "s.net/a/x", "./y?q=2#f": "s.net/a/b/y?q=2", "?id=1": "s.net/a/b/c?id=1", "../../../z": "s.net/z",
        "/login?next=https://x.org/": "s.net/login?next=https://x.org/", "r?to=http://x.org/": "s.net/a/b/r?to=http://x.org/", "//t.net/u/../v": "t.net/v",
        "http://T.net/w/./": "t.net/w", "mailto:a@b.cd": None, "#top": None, "..": "s.net/a", "/p": "s.net/p",
    }
    forms = list(named)
    rows = [(i, page, (can if i % 2 else ref) % k) for i, k in enumerate(forms)] + [
        (90, "https://two.net/", can % "/one" + ref % "/three" + can % "/two" + ref % "https://four.net/"), (91, "https://bare.net", can % "x"), (92, "none", can % "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = lambda i: {r.b for r in urls.links(df.where(F.col("page_id") == i)).collect()}
    got = df.where("page_id < 90").select("page_id", urls.normal(urls.absolute(
        F.regexp_extract("html", '(?:href="|url=)([^">]+)', 1), F.col("url"))).alias("b")).collect()
    assert {forms[r.page_id]: r.b for r in got} == named
    assert one(90) == {"two.net/one", "two.net/two", "two.net/three", "four.net"} and one(91) == {"bare.net/x"} and one(92) == set()
    blocked = spark.createDataFrame([(1, "https://m.net/d/p", can % "../q"), (2, "https://m.net/q", can % "http://shop.com/de/1"),
                                     (3, "http://shop.com/de/1", None)], df.schema)
    assert {r.verdict for r in urls.judge(blocked).collect()} == {"block"}


def test_shared_ids_lose_no_clean_text(spark):
    from pyspark.sql import functions as F

    a, b = prose(61, 120), prose(62, 120)
    df = documents(spark, [(1, a), (5, b), (5, a), (6, b), (7, prose(63, 80)), (None, b), (7, ""), (None, prose(64, 70))])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near.unique(df).collect())
    assert kept == sorted([(False, 1, a), (False, 5, b), (False, 7, prose(63, 80)), (False, 7, ""), (True, 0, prose(64, 70))])
    found = {(r.doc_id, r.n_shingles > 0): r.component_id for r in near.classes(df).collect() if r.doc_id is not None}
    assert found[1, True] == found[5, True] == found[6, True] == 1 and found[7, True] == found[7, False] == 7
    assert near.classes(df).where(F.col("kept")).count() == 3 + 1  # 1, both rows of 7, the lone row without an id


def test_copies_of_one_text_link_to_it_although_they_are_apart(spark):
    """A large node: copies of a text with edits of their own, each like the text, hardly two like each other."""
    words = prose(70, 400, 4000).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 70):
        mine = list(words)
        for k in range(16):
            mine[(i * 37 + k * 25) % 400] = f"own{i}x{k}"
        rows.append((i, " ".join(mine)))
    out = near.classes(documents(spark, rows), 3, 75, 100).collect()
    assert {r.component_id for r in out} == {0}


@pytest.mark.parametrize("num, at_least", [(80, 0.99), (85, 0.99)])
def test_recall_of_pairs_at_the_threshold(spark, num, at_least):
    """Pairs as near to the threshold as edits make them, among common words that keep nodes large."""
    rows, pairs = [], []
    for i in range(150):
        words = ("the same words open every text here " * 3 + prose(2000 + i, 150, 5000)).split()
        other, k = list(words), 30
        size = lambda a, b: (len(a & b), len(a | b))
        grams = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        while k < len(words):
            nxt = list(other)
            nxt[k] = f"edit{i}"
            both, either = size(grams(words), grams(nxt))
            if 100 * both < num * either:
                break
            other, k = nxt, k + 9
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1))
    found = {r.doc_id: r.component_id for r in near.classes(documents(spark, rows), 5, num, 100).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= at_least * len(pairs)
    assert near.tree_count(80, 100) == 14 and near.tree_count(85, 100) == 10


def test_portions_hold_all_rows_and_few_bytes():
    import pyarrow as pa

    texts = ["a" * 900, None, "é" * 40, "", "b" * 5000, "c", "d" * 300, None] * 50
    batch = pa.RecordBatch.from_pylist([{"i": i, "row": {"text": t}} for i, t in enumerate(texts)]).slice(3)
    got = [(p.column("i").to_pylist(), t.to_pylist()) for p, t in tokens.portions(batch, batch.column("row").field("text"), 1000)]
    assert [i for p, _ in got for i in p] == list(range(3, len(texts)))
    assert [t for _, p in got for t in p] == texts[3:]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 1000 for _, p in got)


def test_a_text_goes_to_python_once_in_language_id(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"the river runs to the sea and the town {i}", "en", "web", 40) for i in range(40)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    df = corpus_pipeline.language_id(spark, docs, "")
    stage = [x for x in df._jdf.queryExecution().analyzed().toString().split("\n") if "MapInArrow" in x][0]
    assert "__text" not in stage and "text" not in stage.split("[", 1)[1].split("]")[0]
    assert df.count() == 40


def test_rounds_of_components_are_of_few_tasks(spark):
    from tilewater.llm.components import connected

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(200, 300)] + [(2, 1), (1, 2), (3, 3), (None, 4), (50, 7)]
        spark.sparkContext.setJobGroup("components", "")
        found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
        status = spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in found} == {i: 100 for i in range(100, 131)} | {i: 7 for i in (7, 50, *range(200, 300))} | {1: 1, 2: 1}
    assert len(found) == 31 + 102 + 2
    assert sum(s.numCompletedTasks for s in stages if s) < 2000

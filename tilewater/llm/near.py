"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles; equal sets are one entry. In each of TREES independent trees, entries branch by their
minwise token under the next hash function of the tree; a node with at most NODE entries is compared exhaustively, a larger one
compares every entry with a pivot and branches on. The pivot is the entry whose sketch agrees most with the sketch that the node's
entries vote for, byte by byte: among edited copies of one text that is the text itself or the copy nearest to it, in every tree the same.
Sketches of minwise bytes drop pairs that are far below the threshold; what is left is confirmed on full sets. Entries that are linked
already, directly or through others, are not compared again, so large groups cost a pair an entry, not a pair of each two.

Recall: two entries of similarity s share a node of depth d in one tree with s**d. The number of trees is the least with which a pair at the
threshold that branches to the deepest level is missed with at most 1 - RECALL: 14 trees at 0.8, 10 at 0.85; a pair that meets in
nodes of depth 1 is missed with 2e-10 and 6e-9. An entry that stays unlinked in a deepest node is compared with all others there.

Defined results: sets of null, empty and wordless texts are empty and linked with nothing; fewer words than a shingle has are one shingle;
each distinct set is an entry of its own, also where rows share an id; component_id counts rows that share an id as one document, which joins
their components, while `unique` keeps a row of each; rows without an id are linked, but have no component_id unless a row with one is
reached; rows are kept one to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.llm import tokens
from tilewater.llm.common import keyed, stored
from tilewater.llm.components import connected

DEPTH, NODE, SKETCH, STRIPE, RECALL = 4, 24, 64, 512, 0.999
#: bytes of text that a task takes in hand at a time
PORTION = 1 << 19
#: bytes of the sketch that the entries of a large node vote on
VOTES = 16
#: nodes of rows without an id, and of further texts of an id, lie from here on
UNNAMED = 1 << 62


def tree_count(num: int, den: int) -> int:
    """Trees that find a pair at the threshold, were it to branch to the deepest level, with RECALL."""
    shared = (num / den) ** DEPTH
    return 1 if shared >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - shared))


def seeds(count: int) -> np.ndarray:
    return tokens.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets(run: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text."""
    words, first, *_ = tokens.word_hashes(run, tokens.BLANKS)
    return [tokens.shingles(words[a:b], size) for a, b in zip(first[:-1], first[1:], strict=True)]


def minwise(found: list[np.ndarray], functions: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over each set (none may be empty): sets x functions."""
    values = np.concatenate(found)
    first = np.concatenate([[0], np.cumsum([len(s) for s in found])[:-1]])
    out = np.empty((len(found), len(functions)), np.uint64)
    for i, seed in enumerate(functions):
        h = (values ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(32))) * seed
        out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), first)
    return out


def profiles(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """doc_id, text_hash, n, s1, s2 (name of the set), branch (32-bit tokens by tree and level), sketch (bytes) of every row."""
    split = trees * DEPTH
    functions = seeds(split + SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in tokens.portions(batch, batch.column("text"), PORTION):
                found = sets([(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()], size)
                n = np.array([len(s) for s in found], np.int64)
                names = np.zeros((len(found), 2), np.int64)
                low = np.zeros((len(found), len(functions)), np.uint64)
                some = np.flatnonzero(n)
                for k in some:
                    ends = np.array([len(found[k])])
                    names[k, 0] = tokens.range_hashes(found[k], ends * 0, ends).view(np.int64)[0]
                    names[k, 1] = tokens.range_hashes(tokens.mix(found[k] + np.uint64(1)), ends * 0, ends).view(np.int64)[0]
                if len(some):
                    low[some] = minwise([found[k] for k in some], functions)
                token = (low[:, :split] >> np.uint64(16)).astype(np.uint32).view(np.int32)
                branch = pa.FixedSizeListArray.from_arrays(pa.array(token.ravel()), split).cast(pa.list_(pa.int32()))
                sketch = pa.FixedSizeListArray.from_arrays(pa.array((low[:, split:] >> np.uint64(8)).astype(np.uint8).ravel().view(np.int8)), SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n), pa.array(names[:, 0]), pa.array(names[:, 1]), branch,
                     sketch.cast(pa.list_(pa.int8()))], names=["doc_id", "text_hash", "n", "s1", "s2", "branch", "sketch"])

    return keyed(docs).mapInArrow(
        run, "doc_id long, text_hash long, n long, s1 long, s2 long, branch array<int>, sketch array<tinyint>")


def plausible(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose sketches agree nearly as often as it says (5 deviations)."""
    least = int(SKETCH * num / den - 5 * (SKETCH * num / den * (1 - num / den)) ** 0.5)
    side = lambda s: heads.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    return both.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (same >= least)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * intersection >= num * union, on full sets; texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: str | None) -> np.ndarray:
            if node not in known:
                if len(known) > 200:
                    known.clear()
                known[node] = sets([(text or "").encode("utf-8", "surrogatepass")], size)[0]
            return known[node]

        for whole in batches:
            for batch, _ in tokens.portions(whole, whole.column("ta"), PORTION):
                keep = []
                for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")], strict=True):
                    x, y = of(a, ta), of(b, tb)
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(den * common >= num * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """`rows` with the component so far of a column: itself if it has no link."""
    known = labels.select(F.col("node").alias(column), F.col("root").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def centred(large: DataFrame) -> DataFrame:
    """Members of large nodes (tree, path, node, vote: bytes) with the pivot: who agrees most with what the members vote for."""
    votes = large.groupBy("tree", "path").agg(*[F.mode(F.get("vote", F.lit(i)), deterministic=True).alias(f"v{i}") for i in range(VOTES)])
    agree = sum((F.when(F.get("vote", F.lit(i)) == F.col(f"v{i}"), 1).otherwise(0) for i in range(VOTES)), F.lit(0))
    rank = F.struct(agree, F.xxhash64("node"))
    pivots = large.join(votes, ["tree", "path"]).groupBy("tree", "path").agg(F.max_by("node", rank).alias("pivot"))
    return large.join(pivots, ["tree", "path"])


def grow(heads: DataFrame, trees: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes of all trees: members (node, tree, path, members, pivot) of the small ones, and of the large ones by level."""
    rows = heads.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.get("branch", t * DEPTH))).alias("tree", "token"))
    rows = rows.select("node", "tree", F.col("token").cast("long").alias("path"))
    small, large = [], []
    for level in range(DEPTH):
        pick = F.min_by("node", F.xxhash64("node", "tree", F.lit(level)))
        nodes = rows.groupBy("tree", "path").agg(F.count("*").alias("members"), pick.alias("pivot")).where("members > 1")
        rows = stored(rows.join(nodes, ["tree", "path"]))
        small.append(rows.where(F.col("members") <= NODE))
        big = rows.where(F.col("members") > NODE).drop("pivot")
        if big.isEmpty():
            break
        token = F.get("branch", F.col("tree") * DEPTH + level + 1) if level < DEPTH - 1 else F.lit(0)
        known = heads.select("node", "branch", F.slice("sketch", 1, VOTES).alias("vote"))
        big = stored(big.join(known, "node").select("node", "tree", "path", "members", "vote", token.alias("token")))
        large.append(stored(centred(big).select("node", "tree", "path", "members", "pivot")))
        rows = big.select("node", "tree", F.xxhash64("path", "token").alias("path"))
    return small, large


def links(docs: DataFrame, heads: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node, root: components of heads (node, doc_id, text_hash, n, branch, sketch), by links that connect what is connected."""
    small, large = grow(heads, tree_count(num, den))
    texts = lambda pairs: stored(_texts(docs, heads.join(
        pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node")))
    stars = stored(plausible(_ordered(_union(small + large), "node", "pivot"), heads, num, den))
    labels = stored(connected(confirmed(stars, texts(stars), size, num, den)))
    # small nodes: every pair that is not connected yet; deepest large ones: what is apart from its pivot against all others
    own = _labelled(_union(small).select("node", "tree", "path"), labels, "node", "label")
    several = own.groupBy("tree", "path").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("tree", "path")
    own = own.join(several, ["tree", "path"])
    other = own.select("tree", "path", F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = own.join(other, ["tree", "path"]).where("node < b and label <> lb").select(F.col("node").alias("a"), "b")
    rest = stored(plausible(_ordered(pairs, "a", "b").join(stars, ["a", "b"], "left_anti"), heads, num, den))
    more = [confirmed(rest, texts(rest), size, num, den)] if not rest.isEmpty() else []
    if len(large) == DEPTH:
        deep = _labelled(_labelled(large[-1].select("node", "tree", "path", "pivot"), labels, "node", "label"), labels, "pivot", "lp")
        deep = stored(deep.withColumn("stray", F.col("label") != F.col("lp")))
        strays = deep.groupBy("tree", "path").agg(F.count("*").alias("m"), F.count_if("stray").alias("s")).where("s > 0")
        deep = stored(deep.join(strays, ["tree", "path"]))
        if not deep.isEmpty():
            held = stored(_texts(docs, heads.join(deep.select("node").distinct(), "node")))
            more.append(between_blocks(deep.join(held, "node"), size, num, den))
    if not more:
        return labels
    # later links join the components that the stars left
    ends = _labelled(_labelled(stored(_union(more)), labels, "a", "ra"), labels, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    joined = stored(connected(ends))
    return _composed(labels, joined)


def _composed(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """node, root: components `labels` whose roots `joined` connects further."""
    on = _labelled(labels.withColumnRenamed("root", "mid"), joined, "mid", "root").select("node", "root")
    alone = joined.join(labels.select("node"), "node", "left_anti").select("node", "root")
    return on.unionByName(alone)


def between_blocks(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """a, b: links of strays with members of other components in the deepest nodes, one for each stray, block and component.

    rows: tree, path, m and s (members and strays of the node), node, label, stray, text. Strays and members are dealt to blocks of about
    STRIPE; each pair of blocks is one task's product of two incidence matrices, exact on full sets.
    """
    count = lambda n: F.ceil(F.col(n) / STRIPE).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), count(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    keep = ["tree", "path", "node", "label", "text"]
    left = rows.where("stray").select(*keep, F.lit(True).alias("left"), own("s", 1).alias("i"), every("m").alias("j"))
    right = rows.select(*keep, F.lit(False).alias("left"), own("m", 2).alias("j"), every("s").alias("i"))

    def run(table: pa.Table) -> pa.Table:
        found = sets([(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()], size)
        n = np.array([len(x) for x in found])
        node, label = np.array(table["node"].to_pylist(), np.int64), np.array(table["label"].to_pylist(), np.int64)
        side = np.array(table["left"].to_pylist(), bool)
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        _, token = np.unique(np.concatenate(found), return_inverse=True)
        owner = np.repeat(np.arange(len(found)), n)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        common = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, int(token[-1]) + 1, 4096):
            i, j = np.searchsorted(token, (low, low + 4096))
            hit = np.zeros((len(found), 4096), np.float32)
            hit[owner[i:j], token[i:j] - low] = 1
            common += hit[x] @ hit[y].T
        linked = (den * common >= num * (n[x][:, None] + n[y][None, :] - common)) & (label[x][:, None] != label[y][None, :])
        a, b = np.nonzero(linked)
        _, first = np.unique(np.column_stack([a, label[y][b]]), axis=0, return_index=True)
        return pa.table({"a": node[x][a[first]], "b": node[y][b[first]]})

    return left.unionByName(right).groupBy("tree", "path", "i", "j").applyInArrow(run, "a long, b long")


def _texts(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """node, text of heads."""
    named = heads.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return keyed(docs).join(named, same).groupBy("node").agg(F.first("text").alias("text"))


def _numbered(found: DataFrame, docs: DataFrame) -> DataFrame:
    """`found` with `node`: the doc_id for the first text of an id, a number from UNNAMED on for further ones and for rows without an id."""
    ids = keyed(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("l"), F.max("text_hash").alias("h"))
    several = stored(ids.where("l <> h").select("doc_id", "l"))
    other = F.xxhash64("doc_id", "text_hash").bitwiseAND(UNNAMED - 1).bitwiseOR(F.lit(UNNAMED))
    first = F.col("doc_id").isNotNull() & (F.col("l").isNull() | (F.col("l") == F.col("text_hash")))
    return found.join(several, "doc_id", "left").withColumn("node", F.when(first, F.col("doc_id")).otherwise(other)).drop("l")


def groups(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n, node, root of every row: equal sets share a root, and so do sets that links connect."""
    found = stored(_numbered(profiles(docs, size, tree_count(num, den)), docs))
    name = ["s1", "s2", "n"]
    firsts = stored(found.where("n > 0").groupBy(*name).agg(F.min("node").alias("head")))
    heads = found.join(firsts.select(F.col("head").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    heads = stored(heads.select("node", "doc_id", "text_hash", "n", "branch", "sketch"))
    roots = links(docs, heads, size, num, den)
    own = found.select("doc_id", "text_hash", *name, F.col("node").alias("self"))
    out = own.join(firsts.withColumnRenamed("head", "node"), name, "left").withColumn("node", F.coalesce("node", "self"))
    return _labelled(out, roots, "node", "root").select("doc_id", "text_hash", "n", F.col("self").alias("node"), "root")


def classes(docs: DataFrame, size: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row: components of links with den * intersection >= num * union."""
    out = stored(groups(docs, size, num, den))
    # rows that share an id may lie in several groups: the smallest root of any of them joins those
    shared = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("doc_id", "l")
    shared = stored(shared)
    if not shared.isEmpty():
        pairs = out.join(shared, "doc_id").where("l <> root").select(F.col("l").alias("a"), F.col("root").alias("b"))
        out = _labelled(out.withColumnRenamed("root", "was"), connected(pairs), "was", "root")
    component = F.when(F.col("root") < UNNAMED, F.col("root"))
    kept = F.coalesce(F.when(F.col("root") < UNNAMED, F.col("doc_id") == F.col("root")), F.col("node") == F.col("root"), F.lit(False))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def unique(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with all columns and one row of each group of near-duplicates: of the smallest id (null last), then the smallest hash.

    A text of a shared id that is unlike the others of that id is a group of its own.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))).alias("x")
    kept = groups(docs, size, num, den).groupBy("root").agg(first).select(F.col("x.d").alias("__d"), F.col("x.t").alias("__t"))
    row = docs.select(F.col("doc_id").alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"), F.struct(*docs.columns).alias("__row"))
    same = row["__d"].eqNullSafe(kept["__d"]) & (row["__t"] == kept["__t"])
    return row.join(kept, same, "left_semi").dropDuplicates(["__d", "__t"]).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return classes(docs).drop("text_hash")

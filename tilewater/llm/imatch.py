"""Document fingerprints by I-Match with several randomised lexicon subsets.

The lexicon is every term whose document frequency lies in a band relative to the number of documents, so it has at most
(mean distinct terms of a document) / LOWEST entries, whatever the corpus. Each subset takes a random share of the lexicon; a
document's distinct terms in a subset are sorted (by term hash) and hashed. Subsets of smaller shares change less often under an edit
and weigh more in the likeness. A text without a lexicon term is known by the hash of the text.

Defined results: null counts as empty; repeated rows count once in the corpus and keep a row each; the next document is the
next distinct (doc_id, text), the first after the last, so a single document is its own next; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewater.llm.common import KEY, array_lit, joined, keyed, left_by_key, words
from tilewater.session import cut

#: band of document frequency, as shares of the documents
LOWEST, HIGHEST = 0.0002, 0.1
#: one lexicon subset for each share (1 in n) and repetition
SHARES, REPEATS = (32, 128, 512), 8
SUBSETS = [(share, r) for share in SHARES for r in range(REPEATS)]
BROADCAST_ROWS = 2_000_000
#: stands for a null id in keys, so that joins and groups share one partitioning; the smallest id there is
UNNAMED = -(1 << 63)


def terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """term, h (its hash above, a bit for each of its subsets below): terms in the band that are in a subset at all."""
    found = docs.select(F.explode(F.concat(terms(F.coalesce("text", F.lit(""))), F.array(F.lit("")))).alias("term"))
    counted = found.groupBy("term").count()
    n = counted.where("term = ''").select(F.col("count").alias("n"))
    band = counted.where("term <> ''").crossJoin(F.broadcast(n)).where((F.col("count") >= lowest * F.col("n")) & (F.col("count") <= highest * F.col("n")))
    mask = F.lit(0)
    for bit, (share, r) in enumerate(SUBSETS):
        mask = mask.bitwiseOR(F.when(F.pmod(F.xxhash64("term", F.lit(share), F.lit(r)), F.lit(share)) == 0, 1 << bit).otherwise(0))
    h = F.shiftleft(F.xxhash64("term"), len(SUBSETS))
    return band.select("term", mask.alias("subsets"), h.bitwiseOR(mask.cast("long")).alias("h")).where("subsets <> 0").select("term", "h")


def following(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_chars, next_id, next_hash for each distinct document: range parts, and one row a part across them."""
    ids = docs.select(*KEY, F.char_length("text").alias("n_chars")).distinct()
    parted = cut(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    order = [F.asc(k) for k in KEY]
    here = F.struct(*KEY)
    lead = F.lead(here).over(W.partitionBy("part").orderBy(*order))
    firsts = parted.groupBy("part").agg(F.min(here).alias("first"))
    across = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("after"), F.first("first").over(W.orderBy("part")).alias("very"))
    within = parted.withColumn("next", lead).join(across, "part")
    follow = F.coalesce("next", "after", "very")
    return within.select(*KEY, "n_chars", follow["doc_id"].alias("next_id"), follow["text_hash"].alias("next_hash"))


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Each document with text and `edited`: its last quarter replaced from the start of the next in `order`; rows may repeat."""
    take = F.floor(F.col("n_chars") / 4).cast("int")
    want = order.select(F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), take.alias("take"),
                        F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"))
    sides = docs.select(*[F.col(k).alias(f"s_{k}") for k in KEY], "text")
    same = (F.col("doc_id") == F.col("s_doc_id")) & (F.col("text_hash") == F.col("s_text_hash"))
    starts = sides.join(want, same).select(F.col("to_id").alias("doc_id"), F.col("to_hash").alias("text_hash"),
                                           F.expr("substring(text, 1, take)").alias("start"))
    plan = left_by_key(order.select(*KEY, "n_chars"), starts, safe=False)
    return sides.join(plan, same).select(*KEY, "text", F.concat(F.expr("substring(text, 1, n_chars - floor(n_chars / 4))"), "start").alias("edited"))


def fingerprints(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, edited_fingerprint, edited_sha256 of `pairs` (doc_id, text_hash, text, edited; repeated rows are one).

    Texts travel as their terms only, those that both have once: one more row, marked by a first character that no term has, carries
    the hashes along, so that texts are read once and those without a term of the lexicon `known` stay.
    """
    note = F.concat(F.lit(" "), F.lpad(F.lower(F.hex(F.xxhash64("edited"))), 16, "0"), F.sha2("edited", 256))
    sets = pairs.select(*KEY, note.alias("note"), terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
    tag = lambda form, column: F.struct(F.lit(form).alias("form"), column.alias("terms"))
    forms = F.explode(F.array(tag(0, F.concat(F.array("note"), F.array_intersect("a", "b"))), tag(1, F.array_except("a", "b")), tag(2, F.array_except("b", "a"))))
    rows = sets.select(*KEY, forms.alias("f")).select(*KEY, "f.form", F.explode("f.terms").alias("term"))
    noted = F.col("term").startswith(" ")
    rows = joined(rows, known, "term", BROADCAST_ROWS, "left").where(noted | F.col("h").isNotNull())
    of = lambda form: F.collect_set(F.when(F.col("form") == form, F.col("h"))).alias(f"t{form}")
    own = rows.groupBy(*KEY).agg(of(0), of(1), of(2), F.max(F.when(noted, F.col("term"))).alias("note"))
    own = own.select(*KEY, "note", F.sort_array(F.concat("t0", "t1")).alias("t"), F.sort_array(F.concat("t0", "t2")).alias("e"))
    bits = array_lit([1 << bit for bit in range(len(SUBSETS))], "bigint")

    def print_of(name: str, text_hash: Column) -> Column:
        def mark(bit: Column) -> Column:
            mine = F.filter(name, lambda x: x.bitwiseAND(bit) != 0)
            return F.when(F.size(mine) > 0, F.right(F.hex(F.xxhash64(mine)), F.lit(6))).otherwise("")

        marks = F.lower(F.array_join(F.transform(bits, mark), "."))
        return F.when(F.size(name) > 0, marks).otherwise(F.concat(F.lit("x"), text_hash))

    return own.select(
        *KEY, print_of("t", F.lpad(F.lower(F.hex("text_hash")), 16, "0")).alias("fingerprint"),
        print_of("e", F.substring("note", 2, 16)).alias("edited_fingerprint"), F.substring("note", 18, 64).alias("edited_sha256"))


def likeness(a: Column, b: Column) -> Column:
    """Weighted share of equal subset hashes among the subsets in which either text has a term; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("p"), F.split(b, r"\.").alias("q"), array_lit([s for s, _ in SUBSETS], "double").alias("w"))
    start = F.struct(F.lit(0.0).alias("same"), F.lit(0.0).alias("either"))

    def step(acc: Column, x: Column) -> Column:
        some = (x["p"] != "") | (x["q"] != "")
        return F.struct((acc["same"] + F.when(some & (x["p"] == x["q"]), x["w"]).otherwise(0.0)).alias("same"),
                        (acc["either"] + F.when(some, x["w"]).otherwise(0.0)).alias("either"))

    share = F.aggregate(pairs, start, step, lambda acc: F.when(acc["either"] > 0, acc["same"] / acc["either"]).otherwise(0.0))
    return F.when(a == b, 1.0).when(F.contains(a, F.lit(".")) & F.contains(b, F.lit(".")), share).otherwise(0.0)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of `docs`."""
    docs = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(UNNAMED)))
    known = cut(lexicon(docs))
    order = following(docs)
    prints = fingerprints(edited(docs, order), known)
    full = cut(left_by_key(prints, order.withColumn("n_chars", F.col("n_chars").cast("long")), safe=False))
    after = full.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("fingerprint").alias("next_print"))
    out = left_by_key(left_by_key(docs.select(*KEY), full, safe=False), after, ("next_id", "next_hash"), safe=False)
    return out.select(
        F.when(F.col("doc_id") != UNNAMED, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )

"""Small tables that hold the awkward rows: nulls, empty and long texts, ties, repeats, clashing column names."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: names that operators use inside
CLASHING = ("text_hash", "at", "n", "fp", "h", "g", "m", "w", "item_id", "part", "start", "score", "label", "term", "size", "block", "row")


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *(None, None))[:4] for r in rows]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    return df


LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))

AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \t\n", "en", "b"), (4, "!!! ... ???", None, "a"), (5, "A", "en", None),
    (6, "same text in two rows of this table", "en", "a"), (6, "same text in two rows of this table", "en", "a"),
    (7, "same text in two rows of this table", "en", "c"), (None, "a row without an id but with some words", "en", "c"),
    (8, LONG, "en", "a"), (9, "ÄÖÜ É Kelvin K ﷽ 漢字 emoji 😀😀 tail", "de", "b"),
]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n made-up words."""
    import random

    r = random.Random(seed)
    pool = ["".join(random.Random(i).choices("abcdefghijklmnoprstu", k=3 + i % 6)) for i in range(vocabulary)]
    return " ".join(r.choices(pool, k=n))


def edit(text: str, *places: int) -> str:
    w = text.split(" ")
    for p in places:
        w[p] = "edited"
    return " ".join(w)


ITEM = prose(900, 30)
PAGES = [
    (1, "https://www.a.example.org/es/1.html", None), (2, "http://a.example.org/es/1/", '<link rel="canonical" href="https://free.net/x">'),
    (3, "https://free.net/x#frag", None), (4, "https://m.free.net/x?utm_source=a&ref=b", None), (5, "https://y.org/", "<p>"),
    (6, "https://z.net/", "<meta http-equiv='refresh' content='0;url=https://y.org'>"), (7, "https://z.net/index.html", None),
    (8, "https://q.net/p", '<link href="/r" rel=canonical>'), (9, "https://q.net/r", '<link rel="canonical" href="http://shop.com/de/1">'),
    (10, "http://shop.com/de/1?page=2", None), (11, "http://shop.com/de/1", None), (12, None, None), (13, "no scheme", "x"), (14, "://", None),
    (15, "HTTP://EXAMPLE.ORG/en/1x", None), (16, "https://example.org/en/2", None), (17, "https://com/fr/", None), (18, "https://org?x", None),
]


def corpus() -> list[tuple]:
    """doc_id, text, lang, source: copies, near copies, passages, benchmark text, licenses."""
    base, other = prose(1, 200), prose(2, 120)
    passage = prose(3, 15)
    rows = [
        (10, base, "x", "a"), (11, base, "x", "a"), (12, edit(base, 100), "x", "b"), (13, edit(base, 3, 60, 130, 190), "x", "b"),
        (14, edit(base, 3, 60), "x", None), (15, other, "y", "c"), (16, edit(other, 5, 50), "y", "c"), (17, passage + " " + prose(4, 50), None, "a"),
        (18, prose(5, 30) + " " + passage + " " + prose(6, 30), "y", "c"), (19, prose(7, 20) + " " + ITEM[:80] + " " + prose(8, 20), "y", "c"),
        (20, ITEM.upper(), "y", "c"), (21, ITEM + " " + ITEM, "y", "a"), (22, "short item here", "x", "a"), (23, "x Short, item? HERE y short item here", "x", "a"),
        (24, "The MIT License. mit-license; Released under the MIT License; Apache License", "x", "a"),
        (25, "Licensed under the GNU General Public License, version 3 " * 3, "x", "a"),
        (26, "Redistribution and use in source and binary forms, with or minus modification, are permitted", "x", "z"),
        (27, "general public license", "x", "z"), (28, "a" * 49, "x", "z"), (29, "a" * 50, "x", "z"), (30, "a" * 51, "x", "z"),
        (31, "é" * 30 + "tail", "x", "z"), (32, "head" + "é" * 30, "x", "z"), (33, base[:200] + "\n" + other[100:300], "x", "z"),
    ]
    rows += [(40 + i, edit(base, *range(i, 200, 40)), "x", "a") for i in range(30)]
    rows += [(100 + i, prose(100 + i, 20 + 5 * i), "xy"[i % 2], "abc"[i % 3]) for i in range(40)]
    return rows + [r for r in AWKWARD if r[0] is not None and r[0] != 6]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(n: int = 700, width: int = 16) -> list[tuple]:
    """vec_id, embedding, label: clusters, ties, repeated rows, null labels, and rows that are dropped."""
    import random

    r = random.Random(5)
    centres = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(40)]
    rows = [(i, [c + r.gauss(0, 0.02) for c in centres[i % 40]], [None, 1, 2, 3][i % 4]) for i in range(n)]
    rows += [(1000 + i, [0.25] * width, 7) for i in range(60)] + [(5, rows[5][1], 1), (5, rows[5][1], 1)]
    bad = [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width]
    return rows + [(2000 + i, b, i) for i, b in enumerate(bad)]


def write_tables(spark, folder: str, rows: bool = True) -> str:
    from pyspark.sql import types as T

    long, string = T.LongType(), T.StringType()
    documents(spark, corpus() if rows else []).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (5, "..."), (6, prose(901, 12)), (7, ITEM)]
    spark.createDataFrame(bench if rows else [], T.StructType([T.StructField("item_id", long), T.StructField("text", string)])).write.parquet(
        f"{folder}/benchmark.parquet")
    spark.createDataFrame(PAGES if rows else [], T.StructType([
        T.StructField("page_id", long), T.StructField("url", string), T.StructField("html", string)])).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(vectors() if rows else [], VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    labels = [(r[0], r[0] % 2, 0) for r in corpus() if r[0] >= 100] + [(10, None, None), (999, 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels if rows else [], T.StructType([
        T.StructField("doc_id", long), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])).write.parquet(
        f"{folder}/labels.parquet")
    return folder

"""The dealt operators as named queries, with their twin SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewater.llm import benchmark, imatch, language, licenses, mixing, near, private, quality, ranked, rules, suffixes, urls, vectors
from tilewater.llm import twins
from tilewater.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.digest(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_license_scan, op3_mixing, op4_suffix_dedup, op5_near_dedup, op6_url_filter, op7_personal_data, op8_fingerprints,
        op9_quality, op10_decontamination, op11_vector_codes, op12_ranked_search, op13_quality_rules,
    )
}

#: fixed values: words of the contracts in the other engine's regular expressions
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: fixed values: the patterns of url parts and of normal forms, written out
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HOST = f"translate(regexp_extract(coalesce({{0}}, ''), '{_PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_QUERY = (r"regexp_replace(regexp_replace(regexp_extract({0}, '(?s)^[^?#]*\?([^#]*)', 1), "
          r"'(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '', 'g')")
_NORMAL = (
    f"CASE WHEN contains({{0}}, '://') THEN regexp_replace({_HOST}, '^(www|m)\\.|:(80|443)$', '', 'g') || "
    f"regexp_replace(regexp_extract({{0}}, '{_PARTS}', 2), '(/index)?(\\.html?)?/*$', '', 'g') || "
    f"CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END END"
)


def _template_values() -> str:
    """Label, base, place, word and membership of the key phrase of every template word, as SQL rows."""
    rows = []
    for t in licenses.TEMPLATES:
        said = f" {t.text} "
        low = len(said[: said.index(f" {t.key} ")].split())
        high = low + len(t.key.split())
        rows += [f"('{t.label}', {str(t.base).lower()}, {j}, '{w}', {int(low <= j < high)})" for j, w in enumerate(t.text.split())]
    return ", ".join(rows)


_TEMPLATES = _template_values()

SQL: dict[str, str] = {
    "op10_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
             b AS (SELECT item_id, {_WORDS.format(_LOW)} AS w FROM benchmark),
             bw AS (SELECT item_id, len(w) AS all_n, least(len(w), 10) AS n, w, unnest(range(0, greatest(len(w) - 9, 1))) AS p0
                    FROM b WHERE len(w) > 0),
             items AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p0 + 1, p0 + n), ' ') AS run FROM bw),
             ns AS (SELECT DISTINCT n FROM items),
             dw AS (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS p0 FROM d, ns WHERE len(w) >= n),
             hit AS (SELECT dw.doc_id, dw.p0, dw.n, items.item_id FROM dw JOIN items
                     ON items.n = dw.n AND items.run = array_to_string(list_slice(dw.w, dw.p0 + 1, dw.p0 + dw.n), ' ')),
             cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hit) GROUP BY doc_id),
             named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
                       FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
               cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_suffix_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b FROM documents),
             s AS (SELECT doc_id, t, hex(b) AS x, octet_length(b) AS n FROM d),
             p AS (SELECT doc_id, p0, substr(x, p0 * 2 + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p0 FROM s WHERE n >= 50)),
             f AS (SELECT g, min(doc_id) AS m FROM p GROUP BY g HAVING min(doc_id) <> max(doc_id)),
             hit AS (SELECT p.doc_id, p0, lag(p0) OVER (PARTITION BY p.doc_id ORDER BY p0) AS before FROM p JOIN f USING (g) WHERE f.m < p.doc_id),
             run AS (SELECT doc_id, p0, sum(CASE WHEN before IS NULL OR p0 > before + 50 THEN 1 ELSE 0 END)
                            OVER (PARTITION BY doc_id ORDER BY p0) AS k FROM hit),
             span AS (SELECT doc_id, min(p0) AS a, max(p0) + 50 AS z FROM run GROUP BY doc_id, k),
             gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM span),
             gone AS (SELECT s.doc_id, sum(z - a) AS removed, count(*) AS spans,
                             string_agg(substr(x, y * 2 + 1, (a - y) * 2), '' ORDER BY a) || substr(any_value(x), max(z) * 2 + 1) AS rest
                      FROM gap JOIN s USING (doc_id) GROUP BY s.doc_id)
        SELECT s.doc_id, cast(n AS bigint) AS n_bytes, cast(coalesce(removed, 0) AS bigint) AS n_removed,
               cast(coalesce(spans, 0) AS bigint) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
        FROM s LEFT JOIN gone USING (doc_id)""",
    "op5_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p0 + 1, p0 + 3), ' ') AS g
                   FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS p0 FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
             e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
             m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
        SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, root AS component_id, d.doc_id = root AS kept
        FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_url_filter": rf"""
        WITH RECURSIVE u AS (SELECT page_id, url, html, {_HOST.format("url")} AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path,
                                    {_NORMAL.format("url")} AS node FROM pages),
             named AS (SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                              '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM u
                       UNION SELECT url, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                              '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM u),
             full_links AS (SELECT node AS a, CASE WHEN contains(link, '://') THEN link
                              WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^:/?#]+)://', 1) || ':' || link
                              WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^:/?#]+)://', 1) || '://' || regexp_extract(url, '{_PARTS}', 1) || link
                            END AS target FROM named WHERE link <> ''),
             e0 AS (SELECT a, {_NORMAL.format("target")} AS b FROM full_links WHERE a IS NOT NULL AND target IS NOT NULL),
             e AS (SELECT a, b FROM e0 WHERE a <> b AND b IS NOT NULL UNION SELECT b, a FROM e0 WHERE a <> b AND b IS NOT NULL),
             r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
             m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
             k AS (SELECT u.*, coalesce(m.root, u.node) AS alias, CASE
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
                   FROM u LEFT JOIN m USING (node)),
             v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM k),
             d AS (SELECT alias, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM v
                   WHERE own IS NOT NULL AND alias IS NOT NULL GROUP BY alias)
        SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
        FROM v LEFT JOIN d USING (alias)""",
    "op2_license_scan": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
             t(label, base, j, word, in_key) AS (VALUES {_TEMPLATES}),
             p AS (SELECT doc_id, w[p1] AS word, p1 - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p1 FROM d)
                   WHERE w[p1] IN (SELECT word FROM t)),
             f AS (SELECT word, count(DISTINCT doc_id) AS df FROM p GROUP BY word),
             n AS (SELECT count(*) AS n FROM documents),
             x AS (SELECT t.*, greatest(1, cast(round(1000 * ln((n.n + 1) / (coalesce(f.df, 0) + 1))) AS bigint)) AS weight
                   FROM t CROSS JOIN n LEFT JOIN f USING (word)),
             total AS (SELECT label, base, sum(weight) AS total, sum(in_key) AS keys, count(*) AS words FROM x GROUP BY label, base),
             got AS (SELECT p.doc_id, x.label, x.base, p.pos - x.j AS start, sum(weight) AS got, sum(in_key) AS keys, count(*) AS words
                     FROM p JOIN x USING (word) GROUP BY ALL),
             hit AS (SELECT g.doc_id, g.label, g.base, g.start, cast(g.got AS double) / cast(a.total AS double) AS score
                     FROM got g JOIN total a ON a.label = g.label AND a.base = g.base AND g.keys = a.keys
                     WHERE CASE WHEN g.base THEN g.words = a.words ELSE cast(g.got AS double) / cast(a.total AS double) >= 0.8 END),
             s AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
                          max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                          string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hit GROUP BY doc_id)
        SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_base, 0) AS bigint) AS n_base, cast(first_word AS bigint) AS first_word,
               cast(last_word AS bigint) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0e0) AS score
        FROM d LEFT JOIN s USING (doc_id)""",
    **twins.SQL,
}

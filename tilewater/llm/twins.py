"""Twin SQL of vector codes, ranked search and quality rules."""

from __future__ import annotations

#: fixed values: what the contracts call words and terms, and the fold of A-Z
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_BLANKS = r"\x20\x09-\x0D"

RANKED = f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, w FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
         s AS (SELECT count(*) AS n_docs, cast(sum(len(w)) AS bigint) AS length FROM d),
         t AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
         p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY k, term),
         f AS (SELECT term, cast(floor(1000e0 * ln((2e0 * any_value(n_docs) + 2) / (2e0 * count(*) + 1))) AS bigint) AS weight FROM p, s GROUP BY term),
         m AS (SELECT k, doc_id, 50 + ((50 * len(w) * n_docs) // length) AS m FROM d, s),
         x AS (SELECT t.item_id, m.k, any_value(m.doc_id) AS doc_id,
                      cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
               FROM t JOIN p USING (term) JOIN f USING (term) JOIN m ON m.k = p.k GROUP BY t.item_id, m.k),
         r AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS integer) AS rank,
                      doc_id, score FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

RULES = rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^{_BLANKS}]+') AS w FROM documents),
         l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS lines FROM d),
         g AS (SELECT k, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
         twice AS (SELECT k, g FROM g GROUP BY k, g HAVING count(*) > 1),
         rep AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT g.k, unnest([p, p + 1, p + 2]) AS q FROM g JOIN twice ON g.k = twice.k AND g.g = twice.g) GROUP BY k),
         m AS (SELECT l.k, doc_id, lang, source, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
                      cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS bigint) AS n_symbols, cast(len(lines) AS bigint) AS n_lines,
                      cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, cast(coalesce(rep.n, 0) AS bigint) AS n_repeat_words
               FROM l LEFT JOIN rep ON rep.k = l.k),
         b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
         x AS (SELECT k, lang, source, base_failed, 'word_length' AS metric, 500 AS least, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS v FROM b
               UNION ALL SELECT k, lang, source, base_failed, 'symbol_share', 5000, coalesce(1000000 * n_symbols // nullif(word_chars, 0), 0) FROM b
               UNION ALL SELECT k, lang, source, base_failed, 'line_share', 100, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) FROM b
               UNION ALL SELECT k, lang, source, base_failed, 'repeat_share', 100, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) FROM b),
         s AS (SELECT lang, source, metric, least, v - v % (1 << greatest(length(bin(v)) - 7, 0)) AS bucket FROM x WHERE NOT base_failed),
         c AS (SELECT 2 AS level, lang, source, metric, least, bucket, count(*) AS n FROM s GROUP BY lang, source, metric, least, bucket
               UNION ALL SELECT 1, lang, NULL, metric, least, bucket, count(*) FROM s GROUP BY lang, metric, least, bucket
               UNION ALL SELECT 0, NULL, NULL, metric, least, bucket, count(*) FROM s GROUP BY metric, least, bucket),
         u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
                      sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM c),
         q AS (SELECT level, lang, source, metric, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1,
                      min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3, max(least) AS least FROM u GROUP BY level, lang, source, metric),
         f AS (SELECT *, CASE WHEN metric = 'word_length' THEN q1 - 3 * greatest(q3 - q1, least) ELSE -1 END AS low,
                      q3 + 3 * greatest(q3 - q1, least) AS high FROM q WHERE level = 0 OR total >= 200),
         v AS (SELECT k, bool_or(CASE WHEN f2.high IS NOT NULL THEN x.v < f2.low OR x.v > f2.high
                                      WHEN f1.high IS NOT NULL THEN x.v < f1.low OR x.v > f1.high ELSE x.v < f0.low OR x.v > f0.high END) AS beyond
               FROM x LEFT JOIN f f2 ON f2.level = 2 AND f2.metric = x.metric AND f2.lang IS NOT DISTINCT FROM x.lang AND f2.source IS NOT DISTINCT FROM x.source
                      LEFT JOIN f f1 ON f1.level = 1 AND f1.metric = x.metric AND f1.lang IS NOT DISTINCT FROM x.lang
                      LEFT JOIN f f0 ON f0.level = 0 AND f0.metric = x.metric GROUP BY k)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept
    FROM b JOIN v ON v.k = b.k"""


def _round(r: int) -> str:
    """Assignment by codebook r (a{r}) and the codebook after it (c{r+1})."""
    return f"""
         y{r} AS (SELECT x.k, x.p, min(cast(list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x) AS bigint) * 256 + c.j) AS d
                 FROM x JOIN c{r} c ON c.p = x.p GROUP BY x.k, x.p),
         a{r} AS MATERIALIZED (SELECT k, p, d % 256 AS j, d // 256 AS d FROM y{r}),
         z{r} AS (SELECT p, j, i, cast(sum(v) AS bigint) AS s, count(*) AS n FROM (
                   SELECT a.p, a.j, unnest(range(1, len(x.x) + 1)) AS i, unnest(x.x) AS v FROM a{r} a JOIN x ON x.k = a.k AND x.p = a.p) GROUP BY p, j, i),
         n{r} AS (SELECT p, j, list(cast((s - ((s % n) + n) % n) // n AS double) ORDER BY i) AS x FROM z{r} GROUP BY p, j),
         c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.p = c.p AND n.j = c.j),"""


VECTORS = f"""
    WITH e AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024e0 * cast(x AS double))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
         x AS MATERIALIZED (SELECT k, vec_id, cast(p AS bigint) AS p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x
                            FROM e, (SELECT unnest(range(4)) AS p)),
         o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM (SELECT DISTINCT vec_id FROM e WHERE vec_id IS NOT NULL)),
         c0 AS MATERIALIZED (SELECT x.p, o.j, min(x.x) AS x FROM x JOIN o ON o.vec_id = x.vec_id WHERE o.j < 256 GROUP BY x.p, o.j),
         {"".join(_round(r) for r in range(4)).strip()}
         y AS (SELECT x.k, x.p, min(cast(list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x) AS bigint) * 256 + c.j) AS d
               FROM x JOIN c4 c ON c.p = x.p GROUP BY x.k, x.p),
         coded AS (SELECT k, string_agg(printf('%02x', d % 256), '' ORDER BY p) AS code, cast(sum(d // 256) AS bigint) AS error FROM y GROUP BY k),
         h AS (SELECT sha256(string_agg(cast(cast(v AS bigint) AS varchar), ',' ORDER BY p, j, i)) AS sha
               FROM (SELECT p, j, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM c4)),
         t AS (SELECT label, cast(sum(error) AS bigint) AS label_error FROM e JOIN coded ON coded.k = e.k GROUP BY label)
    SELECT e.vec_id, code, error, label_error, h.sha AS codebooks_sha256
    FROM e JOIN coded ON coded.k = e.k JOIN t ON t.label IS NOT DISTINCT FROM e.label, h"""

SQL: dict[str, str] = {"op11_vector_codes": VECTORS, "op12_ranked_search": RANKED, "op13_quality_rules": RULES}

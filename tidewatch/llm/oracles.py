"""DuckDB SQL of the queries that SQL can express whole."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS ws FROM documents),
listed AS (SELECT doc_id, list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) AS l FROM w),
win AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM listed),
first_ AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first_ USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(t, ' ' ORDER BY word.p) FILTER (g.p IS NULL) AS kept FROM word LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_ FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN payload_bytes >= 100 AND first_ <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_ <> page_id THEN first_ END AS refers_to FROM f"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS l FROM w),
sh AS (SELECT doc_id, len(l) AS n, unnest(l) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (m + n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)
SELECT s.doc_id, len(l) AS n_shingles, min(other) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, l"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Training rounds one after the other: each assigns parts (near) and moves entries (book)."""
    out = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        out.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * {entries} + e) AS best FROM part JOIN book{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            out.append(f"""at{r} AS (SELECT p, best % {entries} AS e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM near{r} JOIN part USING (vec_id, p)),
mean{r} AS (SELECT p, e, i, ((s - ((s % n + n) % n)) // n)::BIGINT AS x FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM at{r} GROUP BY p, e, i)),
moved{r} AS (SELECT p, e, list(x ORDER BY i) AS c FROM mean{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN moved{r} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH " + ",\n".join(out) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', (best % {entries})::INTEGER), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN v USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM labelled"""


VECTOR_CODES = _codes()


def _share(n: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * kept))::BIGINT"


DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
sizes AS (SELECT lang, count(*) AS kept FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(any_value(kept), 0) AS kept, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang) LEFT JOIN n USING (lang, source) GROUP BY lang, source),
every AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
whole AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {_share('coalesce(n.n, 0)', 'g.total')} AS p, {_share('every.n', 'whole.total')} AS q
  FROM grp g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term JOIN every ON every.lang = g.lang AND every.term = k.term JOIN whole ON whole.lang = g.lang),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""

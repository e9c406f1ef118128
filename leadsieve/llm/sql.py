"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN p.host = '' OR regexp_matches(p.host, 'casino|poker|-bets\.|porn|xxx')
                           THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id
"""

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

DECONTAMINATION = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  coalesce(m.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS sh
    FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), smallest AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.other, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.other, w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN smallest m ON m.id = w.doc_id
"""

#: number, name, pattern, group, least length of the group, further conditions on it
_KINDS = (
    (0, "assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "true"),
    (1, "access", "AKIA[A-Z0-9]+", 0, 16, "true"),
    (2, "hex", "[0-9a-f]+", 0, 32, "true"),
    (3, "account", r"""([Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]+)""", 2, 3, "true"),
    (4, "opaque", "[A-Za-z0-9+/]+", 0, 20, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"),
    (5, "endpoint", r"""[a-z][a-z0-9+.-]*://[^\x00-\x20"''<>]+""", 0, 8, "true"),
)
_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, {n} AS kind, s + length(m) AS finish, s, v FROM (
      SELECT doc_id, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s FROM (
        SELECT doc_id, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v,
               unnest(gaps[1 : len(ms)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {g}) AS vs,
                     regexp_split_to_array(text, '{p}') AS gaps FROM documents)))
    WHERE length(v) >= {least} AND {more}"""
    for n, _, p, g, least, more in _KINDS
)
_NAMES = "[" + ", ".join(f"'{k[1]}'" for k in _KINDS) + "]"

SECRET_SCAN = f"""
WITH parts AS MATERIALIZED ({_PARTS}),
weak AS (
  SELECT p.doc_id, p.kind, p.s, p.finish,
    bool_or(q.kind IN (1, 3) AND (q.finish <= p.s OR q.s >= p.finish)) AS identifier,
    bool_or(q.kind IN (0, 2, 4) AND (q.finish <= p.s OR q.s >= p.finish)) AS secret,
    bool_or(q.kind <= 2 AND q.s <= p.s AND q.finish >= p.finish) AS inside
  FROM parts p JOIN parts q
    ON p.doc_id = q.doc_id AND (p.kind, p.s) <> (q.kind, q.s) AND q.s - p.finish <= 256 AND p.s - q.finish <= 256
  WHERE p.kind > 2 GROUP BY ALL
), reported AS (
  SELECT doc_id, kind, s, finish FROM parts WHERE kind <= 2
  UNION ALL
  SELECT doc_id, kind, s, finish FROM weak
  WHERE (kind = 3 AND secret) OR (kind = 4 AND identifier AND NOT inside) OR (kind = 5 AND identifier AND secret)
), per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    string_agg({_NAMES}[kind + 1] || ':' || s::BIGINT || ':' || finish::BIGINT, ',' ORDER BY s, kind) FILTER (kind <= 2) AS base,
    string_agg({_NAMES}[kind + 1] || ':' || s::BIGINT || ':' || finish::BIGINT, ',' ORDER BY s, kind) AS spans
  FROM reported GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""

_TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
asked AS (
  SELECT q, item_id, term, count(*) AS reps
  FROM (SELECT q, item_id, unnest(t) AS term
        FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark))
  GROUP BY ALL
), postings AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term
), shares AS (
  SELECT d, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS share
  FROM postings JOIN weights USING (term) JOIN d USING (d), totals
), scores AS (
  SELECT q, item_id, d, sum(reps * share)::BIGINT AS score FROM asked JOIN shares USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN d USING (d) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_ROUNDS, _K = 10, 8


def _distances(places: str) -> str:
    return f"""SELECT v, c, sum((x.x - y.x) * (x.x - y.x))::BIGINT AS distance
      FROM parts x JOIN {places} y USING (i) GROUP BY v, c"""


def _nearest(places: str) -> str:
    return f"""SELECT v, c, distance FROM (
      SELECT v, c, distance, row_number() OVER (PARTITION BY v ORDER BY distance, c) AS n FROM ({_distances(places)}))
      WHERE n = 1"""


_MOVES = ", ".join(
    f"""a{r} AS MATERIALIZED ({_nearest(f"c{r}")}),
    c{r + 1} AS MATERIALIZED (
      SELECT c, i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, y.x) AS x
      FROM c{r} y LEFT JOIN (
        SELECT c, i, sum(p.x)::BIGINT AS s, count(*) AS n FROM parts p JOIN a{r} USING (v) GROUP BY c, i) m USING (c, i))"""
    for r in range(_ROUNDS)
)

CENTROIDS = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS xs
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), parts AS MATERIALIZED (SELECT v, unnest(generate_series(1, 64)) AS i, unnest(xs) AS x FROM vectors),
c0 AS MATERIALIZED (
  SELECT c, unnest(generate_series(1, 64)) AS i, unnest(xs) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, xs FROM vectors) WHERE c < {_K}
), {_MOVES},
final AS ({_nearest(f"c{_ROUNDS}")}),
names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{_ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM final JOIN vectors USING (v) JOIN names USING (c)
"""

STATEMENTS = {
    "op2_secret_scan": SECRET_SCAN,
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op6_url_filter": URL_FILTER,
    "op8_exact_dedup": EXACT_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op13_centroid_clustering": CENTROIDS,
}

"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: One document or item a row, with its number, so that repeated ids stay apart.
_ROWS = "SELECT row_number() OVER () AS rid, {id} AS id, coalesce(text, '') AS t FROM {table}"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ARCHIVES = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 10 * (k // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31), 1)), '')
    AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)"""

QUALITY = r"""
WITH d AS (""" + _ROWS.format(id="doc_id", table="documents") + r"""),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, lead(word, 4) OVER o AS last,
             concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
                       lead(word, 4) OVER o) AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS copies FROM g WHERE last IS NOT NULL),
r AS (SELECT rid, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n_repeat_words FROM (
        SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM s WHERE copies > 1) GROUP BY rid),
m AS (SELECT rid, id AS doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
q AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 2 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM q"""

_WORDS = "regexp_extract_all(" + _LOWER.format("t") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEN = ", ".join(["word"] + [f"lead(word, {j}) OVER o" for j in range(1, 10)])
#: Every place of a word with the ten words from there on.
_PLACED = ("SELECT rid, id, i, n, [{ten}] AS ten FROM (SELECT rid, id, len(ws) AS n, unnest(ws) AS word, "
           "generate_subscripts(ws, 1) AS i FROM {words}) WINDOW o AS (PARTITION BY rid ORDER BY i)")

DECONTAMINATION = (
    "WITH d AS (SELECT rid, id, " + _WORDS + " AS ws FROM ("
    + _ROWS.format(id="doc_id", table="documents") + ")),\n"
    "b AS (SELECT rid, coalesce(id::VARCHAR, '') AS id, " + _WORDS + " AS ws FROM ("
    + _ROWS.format(id="item_id", table="benchmark") + ")),\n"
    "windows AS (SELECT DISTINCT id AS item, least(n, 10) AS k, array_to_string(ten[1:least(n, 10)], ' ') AS gram\n"
    "  FROM (" + _PLACED.format(ten=_TEN, words="b") + ") WHERE i + least(n, 10) - 1 <= n),\n"
    "grams AS (SELECT p.rid, p.i, l.k, array_to_string(p.ten[1:l.k], ' ') AS gram FROM ("
    + _PLACED.format(ten=_TEN, words="d") + ") p\n"
    """  JOIN (SELECT DISTINCT k FROM windows) l ON p.i + l.k - 1 <= p.n),
met AS (SELECT g.rid, g.i, g.k, w.item FROM grams g JOIN windows w ON w.k = g.k AND w.gram = g.gram),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (
          SELECT rid, unnest(range(i, i + k)) AS place FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
            SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)""")

#: (kind, pattern, what a match has to meet); letters in either case are spelt out, so that
#: no letter outside ASCII folds to them.
_SECRETS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
               r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
     "length(regexp_extract(m, '{p}', 2)) >= 8"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", r"[0-9a-f]+", "length(m) >= 32"),
    # A block without its end marker stops before the next one: those eight characters are taken off.
    ("key_block", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?s:.*?)"
                  r"(?:-----END [A-Z ]{0,32}PRIVATE KEY-----|-----END|\z)", "true"),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 32"),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|glpat-|sk_live_)[A-Za-z0-9_-]+", "length(m) >= 20"),
)


def _found(place: int, kind: str, pattern: str, accepts: str) -> str:
    return (f"SELECT rid, {place} AS place, '{kind}' AS kind, start, start + length(m)"
            f"{' - 8 * (m LIKE ' + repr('%-----END') + ')::INT' if kind == 'key_block' else ''} AS stop FROM (\n"
            f"  SELECT rid, m, sum(length(gap) + length(before)) OVER (PARTITION BY rid ORDER BY i) AS start FROM (\n"
            f"    SELECT rid, m, gap, i, coalesce(lag(m) OVER (PARTITION BY rid ORDER BY i), '') AS before FROM (\n"
            f"      SELECT rid, unnest(regexp_extract_all(t, '{pattern}')) AS m,\n"
            f"             unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS gap,\n"
            f"             generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM d)))\n"
            f"WHERE {accepts.format(p=pattern)}")


SECRETS = (
    "WITH d AS (" + _ROWS.format(id="doc_id", table="documents") + "),\nf AS ("
    + "\nUNION ALL ".join(_found(i, *rule) for i, rule in enumerate(_SECRETS)) + """),
g AS (SELECT rid, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
        count(*) FILTER (WHERE place = 2) AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place)
          FILTER (WHERE place < 3) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans
      FROM f GROUP BY rid)
SELECT id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)""")



def _heap_clusters(clusters: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """Lloyd's rounds one after another, each a table of centroids (k, c) and one of assignments (rid, k)."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, sha256('3:' || vec_id) AS h,
    list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: isfinite(e::DOUBLE))) = {dimensions})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x AS c
  FROM (SELECT h, x FROM v ORDER BY h NULLS LAST, x LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT rid, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v CROSS JOIN c{i}) GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM (
    SELECT k, j, sum(e) AS s, count(*) AS n FROM (
      SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM v JOIN a{i} USING (rid)) GROUP BY k, j)
  GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (k)"""


ORACLES = {"op1_archives": ARCHIVES, "op5_secrets": SECRETS, "op8_quality_rules": QUALITY,
           "op10_decontamination": DECONTAMINATION, "op12_heap_clusters": _heap_clusters()}

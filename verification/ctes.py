"""The same bindings as SQL for DuckDB: named CTEs with their prerequisites."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def sql(needs: str, final: str) -> str:
    """``WITH`` the space-separated CTEs and their prerequisites, then ``final``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            if name not in ordered:
                ordered.append(name)

    for wanted in needs.split():
        visit(wanted)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return (f"WITH {head}\n" if head else "") + final


def bucket(expression: str, modulus: int = 100) -> str:
    return f"((('0x' || substr(md5({expression}), 1, 8))::BIGINT) % {modulus})"


cte("ev", (), """
SELECT event_id, user_id AS subject, user_id * 10 + abs_us // 518400000000 AS eid,
       event_type AS unit_id, abs_us % 518400000000 AS t_us, value, k
FROM (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS abs_us,
             CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
cte("sessions", ("ev",), """
SELECT DISTINCT ev.eid, ev.subject, CAST(c_nationkey AS BIGINT) AS lab,
       CAST(24 AS BIGINT) AS n_bins
FROM ev JOIN customer ON c_custkey = ev.subject""")
cte("units", ("ev",), """
SELECT eid, unit_id, count(*) AS n_spikes,
       CASE WHEN unit_id = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS label,
       substr(unit_id, 1, 1) AS region
FROM ev GROUP BY eid, unit_id""")
cte("trial_starts", ("ev",), """
SELECT eid, subject, event_id AS trial_id, t_us AS start_us,
       CAST(k % 3 - 1 AS BIGINT) AS choice,
       CASE WHEN k < 40 THEN 0.2 WHEN k < 60 THEN 0.5 ELSE 0.8 END::DOUBLE AS probability_left,
       ((k % 5) / 4.0)::DOUBLE AS contrast
FROM ev WHERE unit_id = 'signup'""")
cte("trials", ("trial_starts",), """
SELECT *, lead(start_us) OVER (PARTITION BY eid ORDER BY start_us, trial_id) AS end_us
FROM trial_starts""")
cte("bins", ("ev",), """
SELECT eid, unit_id, t_us // 21600000000 AS bin, count(*) AS n FROM ev GROUP BY ALL""")
cte("dense", ("units", "bins"), """
SELECT u.eid, u.unit_id, g.bin, coalesce(b.n, 0) AS n
FROM units u CROSS JOIN (SELECT unnest(range(24)) AS bin) g
LEFT JOIN bins b ON b.eid = u.eid AND b.unit_id = u.unit_id AND b.bin = g.bin""")
cte("parts24", (), """
SELECT bin, CASE WHEN bin < 12 THEN 'train' WHEN bin < 16 THEN 'gap' ELSE 'test' END AS part
FROM (SELECT unnest(range(24)) AS bin)""")
cte("aligned", ("ev",), """
SELECT eid, 'value' AS series, t_us // 21600000000 AS bin, avg(value) AS value,
       count(*) AS n_samples FROM ev GROUP BY ALL""")
cte("raw_velocity", ("aligned",), """
SELECT eid, bin, (nv - pv) / 43200.0 AS v FROM (
  SELECT eid, bin, lead(value) OVER w AS nv, lag(value) OVER w AS pv,
         lead(bin) OVER w AS nb, lag(bin) OVER w AS pb
  FROM aligned WINDOW w AS (PARTITION BY eid ORDER BY bin))
WHERE nb = bin + 1 AND pb = bin - 1""")
cte("velocity", ("raw_velocity",), """
SELECT eid, bin, avg(v) OVER (PARTITION BY eid ORDER BY bin
       RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS velocity FROM raw_velocity""")
cte("norm", ("dense",), """
SELECT eid, unit_id, avg(n) AS mean, stddev_pop(n) AS std, count(*) AS n
FROM dense WHERE bin < 12 GROUP BY eid, unit_id""")
cte("within_blocks", ("sessions",), """
SELECT 'within_session' AS split_id, 'within_session' AS kind, part, eid, subject, lab,
       CAST(lo AS BIGINT) AS start_bin, CAST(hi AS BIGINT) AS end_bin
FROM sessions CROSS JOIN (VALUES ('train', 0, 11), ('gap', 12, 15), ('test', 16, 23)) v(part, lo, hi)""")
cte("samples", ("bins", "aligned"), """
SELECT b.eid, b.bin, sum(b.n)::DOUBLE AS x1,
       coalesce(sum(b.n) FILTER (WHERE unit_id = 'view'), 0)::DOUBLE AS x2, any_value(a.value) AS y
FROM bins b JOIN aligned a ON a.eid = b.eid AND a.bin = b.bin GROUP BY b.eid, b.bin""")
cte("parted", ("samples", "parts24"), """
SELECT s.*, p.part FROM samples s JOIN parts24 p USING (bin) WHERE p.part <> 'gap'""")
cte("order_units", (), """
SELECT l_orderkey AS eid, p_type AS region, l_returnflag <> 'R' AS passed
FROM lineitem JOIN part ON p_partkey = l_partkey""")
cte("order_sessions", (), """
SELECT o_orderkey AS eid, o_custkey AS subject, CAST(c_nationkey AS BIGINT) AS lab
FROM orders JOIN customer ON c_custkey = o_custkey""")
cte("vectors", (), f"""
SELECT vec_id AS eid, CAST(label AS BIGINT) AS y, embedding AS x,
       CASE WHEN {bucket('vec_id::VARCHAR')} < 50 THEN 'train'
            WHEN {bucket('vec_id::VARCHAR')} < 75 THEN 'calib' ELSE 'test' END AS part
FROM embeddings""")
cte("outcomes", (), """
SELECT source AS eid, lang, d.doc_id AS row_id, CAST(quality AS BIGINT) AS y,
       n_chars / (n_chars + 400.0::DOUBLE) AS p,
       CASE WHEN n_chars / (n_chars + 400.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END::BIGINT AS yhat
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")

"""Sources, integrity checks, inventories, reports and the benchmark matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.operators import baselines, binning, integrity, moments, report, splits
from truegauge.plans import contract, protocols
from truegauge.session import cut_lineage, shared_folder
from truegauge.sources import artifacts, cache, inventory, runs, sessions, split_store
from verification.bindings import BIN_US, N_BINS, Tables
from verification.ctes import cte, sql
from verification.modelling import LAM, preds, rmse
from verification.preprocessing import verdicts
from verification.registry import query, rounded
from verification.splitting import configured
from verification.trust import gated

# --- manifest and sessions ------------------------------------------------------------

cte("manifest", ("sessions", "verdicts", "trial_starts"), """
SELECT s.eid, s.subject, s.lab, coalesce(n_units, 0) AS n_units, coalesce(n_units_qc, 0) AS n_units_qc,
       coalesce(n_trials, 0) AS n_trials, 1::BIGINT AS n_probes, regions, 'value' AS modalities
FROM sessions s
LEFT JOIN (SELECT eid, count(*) AS n_units, count(*) FILTER (WHERE reason = 'pass') AS n_units_qc,
                  string_agg(DISTINCT region, ',' ORDER BY region) AS regions
           FROM verdicts GROUP BY eid) u USING (eid)
LEFT JOIN (SELECT eid, count(*) AS n_trials FROM trial_starts GROUP BY eid) t USING (eid)""")


def manifest(t: Tables):
    spots = t.sessions.select("eid", F.concat(F.lit("probe0"), (F.col("subject") % 2).cast("string"))
                              .alias("probe_name"),
                              *[F.lit(None).cast("double").alias(c) for c in "xyz"])  # not in the tables
    return sessions.build_manifest(t.sessions, verdicts(t), t.trial_starts, t.behaviour, spots)


@query("a01_manifest", sql("manifest", "SELECT * FROM manifest"))
def _(t: Tables):
    return manifest(t).select("eid", "subject", "lab", "n_units", "n_units_qc", "n_trials", "n_probes",
                              F.concat_ws(",", "regions").alias("regions"),
                              F.concat_ws(",", "modalities").alias("modalities"))


@query("a02_load_session", sql("ev units trial_starts sessions", """
SELECT s.eid, c.capability, count(r.eid) AS n_rows, count(r.eid) > 0 AS present,
       CASE WHEN count(r.eid) = 0 THEN 'no rows' END AS reason
FROM sessions s CROSS JOIN (VALUES ('spikes'), ('units'), ('trials'), ('behaviour')) c(capability)
LEFT JOIN (SELECT eid, 'spikes' AS capability FROM ev UNION ALL SELECT eid, 'units' FROM units
  UNION ALL SELECT eid, 'trials' FROM trial_starts UNION ALL SELECT eid, 'behaviour' FROM ev) r
  ON r.eid = s.eid AND r.capability = c.capability
GROUP BY s.eid, c.capability"""))
def _(t: Tables):
    """What every session holds, from the tables written to session buckets and read back."""
    if "_stored_tables" not in t.__dict__:
        root = shared_folder(t.spark) + "/tables-" + runs.new_run()
        sessions.write_tables({"spikes": t.spikes, "units": t.units, "trials": t.trial_starts,
                               "behaviour": t.behaviour}, root, "events", buckets=16)
        t.__dict__["_stored_tables"] = root
    stored = {name: sessions.read_table(t.spark, t.__dict__["_stored_tables"], "events", name)
              for name in ("spikes", "units", "trials", "behaviour")}
    return sessions.session_capabilities(t.sessions, stored)


@query("a03_select_sessions", sql("sessions", """
SELECT eid, subject, lab FROM (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY eid) AS r FROM sessions)
ORDER BY r, subject LIMIT 50"""))
def _(t: Tables):
    return sessions.select_sessions(t.sessions, 50, 10, 3).select("eid", "subject", "lab")


def stored_split(t: Tables) -> split_store.StoredSplit:
    """The within-session split written to its file once, then read and checked."""
    if "_stored_split" not in t.__dict__:
        root = shared_folder(t.spark) + "/splits-" + runs.new_run()
        name = split_store.save_split(t.within, root, t.sessions)
        t.__dict__["_stored_split"] = split_store.load_split(t.spark, root, name, t.sessions)
    return t.__dict__["_stored_split"]


@query("e10_split_file", sql("within_blocks", """
SELECT split_id, kind, part, eid, subject, lab, start_bin, end_bin FROM within_blocks"""))
def _(t: Tables):
    return stored_split(t).blocks


@query("c09_stored_norm", sql("norm", """
SELECT eid, unit_id, round(mean, 6) AS mean, round(std, 6) AS std, n FROM norm"""))
def _(t: Tables):
    """Statistics fit under the stored split and read back from its file."""
    return rounded(stored_split(t).fit_norm(t.bins, t.units).drop("split_hash"), "mean", "std")


CONFIG = {"width_us": BIN_US, "context": 4}


@query("a04_cache_keys", sql("sessions", f"""
SELECT eid, sha256(concat_ws('|', eid, '1', sha256('{{"context":4,"width_us":{BIN_US}}}'))) AS cache_key
FROM sessions"""))
def _(t: Tables):
    return cache.cache_keys(t.sessions, CONFIG)


@query("a04_cached_bins", sql("bins", "SELECT eid, unit_id, bin, n FROM bins"))
def _(t: Tables):
    """First half of the animals stored by one run, the rest by the next, then read back."""
    root = shared_folder(t.spark) + "/cache-" + t.spark.range(1).select(F.uuid()).head()[0]

    def compute(missing):
        return binning.bin_spikes(t.spikes.join(missing, "eid", "left_semi"), BIN_US)
    wanted = t.sessions.select("eid", "subject")
    cache.cached(wanted.where("subject % 2 = 0"), compute, root, CONFIG)
    return cache.cached(wanted, compute, root, CONFIG)


cte("files", (), """
SELECT 'file' || page_id::VARCHAR AS file, regexp_extract(url, '//([^/]*)/', 1) AS dataset, page_id,
       CASE WHEN page_id % 11 = 0 THEN NULL ELSE DATE '2024-01-01' + (page_id % 400)::INT END AS revision,
       html FROM pages""")


def files(t: Tables):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    stamp = F.when(F.col("page_id") % 11 != 0, F.concat(F.lit("/#"), day.cast("string"), F.lit("#/")))
    return t.read("pages").select(
        F.concat(F.lit("file"), F.col("page_id").cast("string")).alias("file"), "page_id", "html",
        F.regexp_extract("url", "//([^/]*)/", 1).alias("dataset"),
        F.concat(F.col("url"), F.coalesce(stamp, F.lit("/"))).alias("path"))


@query("a05_revision_drift", sql("files", """
SELECT dataset, count(*) AS n_files, max(revision)::VARCHAR AS newest,
       arg_max(file, (revision, file)) FILTER (WHERE revision IS NOT NULL) AS newest_file,
       count(*) FILTER (WHERE revision > DATE '2024-06-01') AS n_newer,
       count(*) FILTER (WHERE revision IS NULL) AS n_undated
FROM files GROUP BY dataset"""))
def _(t: Tables):
    return inventory.revision_drift(files(t), "2024-06-01")


@query("a06_verify_checksums", sql("files", """
SELECT file, CASE WHEN page_id % 13 = 0 THEN 'missing' WHEN page_id % 19 = 0 THEN 'unexpected'
  WHEN page_id % 17 = 0 THEN 'mismatch' ELSE 'ok' END AS status
FROM files WHERE NOT (page_id % 13 = 0 AND page_id % 19 = 0)"""))
def _(t: Tables):
    """Every 13th file did not land, every 17th was altered, every 19th was not announced."""
    digest = F.sha2("html", 256)
    landed = files(t).where("page_id % 13 <> 0").select(
        "file", F.when(F.col("page_id") % 17 == 0, F.sha2(F.concat("html", F.lit("x")), 256))
        .otherwise(digest).alias("checksum"))
    announced = files(t).where("page_id % 19 <> 0").select("file", digest.alias("checksum"))
    return inventory.verify_checksums(landed, announced)


@query("a06_landed_files", sql("files", """
SELECT shelf, strlen(t)::BIGINT AS n_bytes, sha256(t) AS checksum,
       CASE WHEN shelf % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status
FROM (SELECT page_id % 64 AS shelf, string_agg(html || chr(10), '' ORDER BY page_id) AS t FROM files GROUP BY ALL)"""))
def _(t: Tables):
    """All pages written as files, one a shelf, then hashed as they landed; every fifth sum was announced wrongly."""
    root = shared_folder(t.spark) + "/landed-" + runs.new_run()
    shelves = files(t).select((F.col("page_id") % 64).alias("shelf"), "page_id", "html")
    shelves.repartition("shelf").sortWithinPartitions("shelf", "page_id").select("shelf", "html").write.partitionBy(
        "shelf").text(root)
    landed = cut_lineage(inventory.landed_checksums(t.spark, root).where(F.col("file").contains("/shelf=")).withColumn(
        "shelf", F.regexp_extract("file", "shelf=([0-9]+)/", 1).cast("bigint")))
    wrong = F.when(F.col("shelf") % 5 == 0, F.sha2("checksum", 256)).otherwise(F.col("checksum"))
    return inventory.verify_checksums(landed, landed.select("file", wrong.alias("checksum"))).join(
        landed, "file").select("shelf", "n_bytes", "checksum", "status")


@query("a07_artifacts", sql("preds", """
SELECT eid, bin, round(y, 6) AS y, round(yhat, 6) AS yhat FROM preds"""))
def _(t: Tables):
    root = shared_folder(t.spark) + "/run-" + t.spark.range(1).select(F.uuid()).head()[0]
    artifacts.write_artifacts({"predictions": preds(t).select("eid", "bin", "y", "yhat")}, root)
    return rounded(artifacts.read_artifact(t.spark, root, "predictions"), "y", "yhat")


# --- integrity --------------------------------------------------------------------------

cte("side_a", ("ev",), """
SELECT eid, 'probe0' || (subject % 2)::VARCHAR AS probe_name, unit_id, count(*) AS n_spikes,
       avg(value) AS depth FROM ev GROUP BY ALL""")
cte("side_b", ("ev",), """
SELECT eid, 'probe0' || (subject % 2)::VARCHAR AS probe_name, unit_id, count(*) AS n_spikes,
       avg(value) AS depth FROM ev WHERE k <> 99 AND NOT (unit_id = 'view' AND subject % 10 = 3)
GROUP BY ALL""")


def sides(t: Tables):
    """A second backend with upper-case probes that lost some spikes and some units."""
    probe = F.concat(F.lit("probe0"), (F.col("subject") % 2).cast("string"))
    a = t.events.withColumn("probe_name", probe)
    b = a.where("k <> 99 AND NOT (unit_id = 'view' AND subject % 10 = 3)").withColumn(
        "probe_name", F.initcap("probe_name"))
    return a, b


def unit_depths(rows):
    return integrity.normal_probes(rows).groupBy(*integrity.UNIT_KEY).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.avg("value").alias("depth"))


@query("b01_backend_agreement", sql("side_a side_b", """
SELECT eid, units_a, spikes_a, units_b, spikes_b,
       units_a IS NOT DISTINCT FROM units_b AND spikes_a IS NOT DISTINCT FROM spikes_b AS agree
FROM (SELECT eid, count(*) AS units_a, sum(n_spikes)::BIGINT AS spikes_a FROM side_a GROUP BY eid)
FULL JOIN (SELECT eid, count(*) AS units_b, sum(n_spikes)::BIGINT AS spikes_b FROM side_b GROUP BY eid)
USING (eid)"""))
def _(t: Tables):
    a, b = sides(t)
    return integrity.backend_agreement(integrity.unit_totals(a), integrity.unit_totals(b))


@query("b02_unit_set_diff", sql("side_a side_b", """
SELECT eid, count(*) FILTER (WHERE b.n_spikes IS NULL) AS only_a, 0::BIGINT AS only_b,
       count(b.n_spikes) AS common, max(abs(a.n_spikes - b.n_spikes)) AS max_diff_n_spikes,
       round(max(abs(a.depth - b.depth)), 6) AS max_diff_depth
FROM side_a a LEFT JOIN side_b b USING (eid, probe_name, unit_id) GROUP BY eid"""))
def _(t: Tables):
    a, b = sides(t)
    diff = integrity.unit_set_diff(unit_depths(a), unit_depths(b), ["n_spikes", "depth"])
    return rounded(diff, "max_diff_depth")


@query("b03_common_units", sql("side_a side_b", """
SELECT eid, probe_name, unit_id, a.n_spikes FROM side_a a
WHERE EXISTS (SELECT 1 FROM side_b b WHERE b.eid = a.eid AND b.probe_name = a.probe_name
              AND b.unit_id = a.unit_id)"""))
def _(t: Tables):
    a, b = sides(t)
    return integrity.common_units(integrity.unit_totals(a), integrity.unit_totals(b))


@query("b04_monotonic", sql("ev", """
SELECT eid, 'value' AS series, event_id AS sample_idx, t AS t_us, prev AS prev_t_us FROM (
  SELECT *, lag(t) OVER (PARTITION BY eid ORDER BY event_id) AS prev FROM (
    SELECT eid, event_id, t_us - CASE WHEN k = 7 THEN 259200000000 ELSE 0 END AS t FROM ev))
WHERE t < prev"""))
def _(t: Tables):
    late = F.when(F.col("k") == 7, F.lit(259200000000)).otherwise(F.lit(0))
    return integrity.monotonic_violations(t.events.select(
        "eid", F.lit("value").alias("series"), F.col("event_id").alias("sample_idx"),
        (F.col("t_us") - late).alias("t_us")), chunk_rows=100)


@query("b05_trial_bounds", sql("ev trial_starts", """
SELECT t.eid, trial_id, CASE WHEN start_us < f THEN 'starts early' ELSE 'ends late' END AS reason
FROM trial_starts t JOIN (SELECT eid, min(t_us) + 3600000000 AS f, max(t_us) AS l FROM ev GROUP BY eid) b
  ON b.eid = t.eid WHERE start_us < f OR start_us + 21600000000 > l"""))
def _(t: Tables):
    bounds = t.events.groupBy("eid").agg((F.min("t_us") + 3_600_000_000).alias("first_us"),
                                         F.max("t_us").alias("last_us"))
    trials = t.trial_starts.withColumn("end_us", F.col("start_us") + BIN_US)
    return integrity.trial_bounds_violations(trials, bounds)


@query("b06_binning_roundtrip", sql("ev bins", """
SELECT eid, unit_id, n_spikes, coalesce(n_binned, 0)::BIGINT AS n_binned FROM
 (SELECT eid, unit_id, count(*) AS n_spikes FROM ev GROUP BY ALL) LEFT JOIN
 (SELECT eid, unit_id, sum(n) AS n_binned FROM bins WHERE bin < 23 GROUP BY ALL) USING (eid, unit_id)
WHERE n_spikes <> coalesce(n_binned, 0)"""))
def _(t: Tables):
    """A writer that lost the last bin of every session has to be noticed."""
    return integrity.binning_roundtrip(t.spikes, t.bins.where(F.col("bin") < N_BINS - 1))


@query("b07_reconcile_rows", sql("dense parts24", """
SELECT part, count(*) AS n_expected, count(*) FILTER (WHERE unit_id <> 'view' OR part <> 'test') AS n_written,
       count(*) = count(*) FILTER (WHERE unit_id <> 'view' OR part <> 'test') AS agree
FROM dense JOIN parts24 USING (bin) GROUP BY part"""))
def _(t: Tables):
    per = t.units.groupBy("eid").agg(F.count(F.lit(1)).alias("n_units"))
    expected = t.within.blocks.join(per, "eid")
    written = t.within.rows(t.dense, "train", "gap", "test").where(
        "unit_id <> 'view' OR part <> 'test'")
    size = (F.col("end_bin") - F.col("start_bin") + 1) * F.col("n_units")
    return integrity.reconcile_rows(expected, written, size)


# --- inventories ------------------------------------------------------------------------

RULES = {"has_table": "(^|/)table$", "has_nav": "(^|/)nav$", "has_list": "(^|/)(ul|ol)$",
         "has_image": "(^|/)img$", "has_code": "(^|/)(pre|code)$"}
NEEDS = {"navigate": ["has_nav", "has_list"], "tabulate": ["has_table"],
         "illustrate": ["has_image", "has_nav"], "program": ["has_code"]}
MAPPING = [("html", "nav", "menu", 1.0), ("html", "ul", "list", 1.0), ("html", "li", "item", 1.0),
           ("html", "p", "paragraph", 1.0), ("html", "table", "grid", 1.0)]
cte("tags", (), """
SELECT DISTINCT 'file' || page_id::VARCHAR AS file,
       unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages""")


def tags(t: Tables):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1)))
    return files(t).select("file", F.explode(found).alias("tag")).select(
        "file", F.concat(F.lit("html/"), "tag").alias("path"))


cte("probe", ("tags",), """
SELECT file, count(*) AS n_paths, bool_or(tag = 'table') AS has_table, bool_or(tag = 'nav') AS has_nav,
       bool_or(tag IN ('ul', 'ol')) AS has_list, bool_or(tag = 'img') AS has_image,
       bool_or(tag IN ('pre', 'code')) AS has_code FROM tags GROUP BY file""")


@query("n01_schema_probe", sql("probe", "SELECT * FROM probe"))
def _(t: Tables):
    return inventory.schema_probe(tags(t), RULES)


@query("n02_map_inventory", sql("tags", """
SELECT file, 'html/' || tag AS path, CASE tag WHEN 'nav' THEN 'menu' WHEN 'ul' THEN 'list'
  WHEN 'li' THEN 'item' WHEN 'p' THEN 'paragraph' WHEN 'table' THEN 'grid' END AS canonical FROM tags"""))
def _(t: Tables):
    return inventory.map_inventory(tags(t), inventory.column_mapping(t.spark, MAPPING))


@query("n02_apply_mapping", sql("trial_starts", """
SELECT eid, trial_id, round(start_us * 1e-6, 6) AS stim_on, choice, probability_left FROM trial_starts"""))
def _(t: Tables):
    names = [("events", "start_us", "stim_on", 1e-6), ("events", "choice", "choice", 1.0)]
    mapped = inventory.apply_mapping(
        t.trial_starts.select("eid", "trial_id", "start_us", "choice", "probability_left"),
        inventory.column_mapping(t.spark, names), "events")
    return rounded(mapped, "stim_on")


@query("n03_capability_report", sql("probe", """
SELECT file, capability, missing = '' AS present, missing FROM probe CROSS JOIN LATERAL (VALUES
  ('navigate', concat_ws(', ', CASE WHEN NOT has_nav THEN 'has_nav' END, CASE WHEN NOT has_list THEN 'has_list' END)),
  ('tabulate', CASE WHEN NOT has_table THEN 'has_table' ELSE '' END),
  ('illustrate', concat_ws(', ', CASE WHEN NOT has_image THEN 'has_image' END, CASE WHEN NOT has_nav THEN 'has_nav' END)),
  ('program', CASE WHEN NOT has_code THEN 'has_code' ELSE '' END)) v(capability, missing)"""))
def _(t: Tables):
    return inventory.capability_report(inventory.schema_probe(tags(t), RULES), NEEDS)


@query("n04_not_interpreted", sql("tags", """
SELECT tag AS source_name, count(DISTINCT file) AS n_files FROM tags
WHERE tag NOT IN ('nav', 'ul', 'li', 'p', 'table') GROUP BY tag"""))
def _(t: Tables):
    return inventory.not_interpreted(tags(t), inventory.column_mapping(t.spark, MAPPING))


# --- reports ---------------------------------------------------------------------------

@query("z01_untraceable_numerals", sql("", r"""
SELECT report_id, numeral FROM (
  SELECT DISTINCT page_id AS report_id, unnest(regexp_extract_all(html, '([0-9]+(?:\.[0-9]+)?)', 1)) AS numeral
  FROM pages)
WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT page_id, unnest(regexp_extract_all(url, '([0-9]+(?:\.[0-9]+)?)', 1)) AS n FROM pages) u
  WHERE u.page_id = report_id AND u.n = numeral)"""))
def _(t: Tables):
    pages = t.read("pages").withColumnRenamed("page_id", "report_id")
    return report.untraceable_numerals(pages.select("report_id", F.col("html").alias("text")),
                                       pages.select("report_id", F.col("url").alias("field")))


@query("z02_session_report", sql("gates preds rmse manifest", """
SELECT g.eid, part, gate, round(coverage, 6) AS coverage, round(value, 6) AS error, n_units, n_trials,
       CASE gate WHEN 'abstain' THEN 'score beyond the calibration range'
            WHEN 'low' THEN 'score in the upper calibration range'
            WHEN 'moderate' THEN 'score above the calibration median'
            ELSE 'score within the calibration core' END AS rationale,
       concat_ws(', ', CASE WHEN coverage IS NULL THEN 'coverage' END,
                 CASE WHEN value IS NULL THEN 'error' END) AS missing
FROM gates g
LEFT JOIN (SELECT eid, avg((abs(y - yhat) <= 15)::INT) AS coverage FROM preds GROUP BY eid) c USING (eid)
LEFT JOIN rmse USING (eid) LEFT JOIN manifest USING (eid)"""))
def _(t: Tables):
    rows = preds(t)
    coverage = rows.groupBy("eid").agg(
        F.avg((F.abs(F.col("y") - F.col("yhat")) <= 15).cast("double")).alias("coverage"))
    out = report.session_report(gated(t).select("eid", "part", "gate"), coverage, manifest(t),
                                rmse(rows).withColumnRenamed("value", "error"))
    return rounded(out, "coverage", "error")


# --- protocols and matrix ------------------------------------------------------------------

cte("grams", ("samples", "sessions"), """
SELECT s.eid, subject, lab, count(*)::DOUBLE AS n, sum(y) AS sy, sum(x1) AS sx, sum(x1 * y) AS sxy,
       sum(x1 * x1) AS sxx FROM samples s JOIN sessions USING (eid) GROUP BY s.eid, subject, lab""")
cte("region_parts", ("units",), """
SELECT eid, CASE WHEN count(*) FILTER (WHERE region = 'v') = 0 THEN 'train'
  WHEN count(*) FILTER (WHERE label >= 1 AND region = 'v') >= 0.2 * count(*) FILTER (WHERE label >= 1)
  THEN 'test' ELSE 'dropped' END AS part FROM units GROUP BY eid""")
cte("config_parts", ("configs",), """
SELECT eid, CASE WHEN config = (SELECT config FROM configs GROUP BY config ORDER BY count(*) DESC, config LIMIT 1)
            THEN 'train' ELSE 'test' END AS part FROM configs""")


def _fit(source: str, key: str, lam: float) -> str:
    return f"""(SELECT {key}, b, sy / n - b * sx / n AS a FROM (
  SELECT *, (sxy / n - sx / n * sy / n) / (sxx / n - sx / n * sx / n + {lam}) AS b FROM ({source})) WHERE n > 0.5)"""


def _sums(where: str, group: str) -> str:
    by = f"GROUP BY {group}" if group else ""
    lead = f"{group}, " if group else "1 AS one, "
    return (f"SELECT {lead}sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, sum(sxy) AS sxy, sum(sxx) AS sxx "
            f"FROM grams {where} {by}")


_PARTS = ("n", "sy", "sx", "sxy", "sxx")


def _kind_scores(lam: float) -> str:
    def scored(kind: str, models: str, key: str, extra: str = "") -> str:
        return f"""SELECT '{kind}' AS kind, t.eid, sqrt(avg((t.y - m.a - m.b * t.x1) ** 2)) AS value
FROM (SELECT p.*, s.subject, s.lab, 1 AS one FROM parted p JOIN sessions s USING (eid) WHERE part = 'test') t
JOIN {models} m ON m.{key} = t.{key} {extra} GROUP BY t.eid"""
    minus = ", ".join(f"p.{c} - o.{c} AS {c}" for c in _PARTS)
    own = f"SELECT o.eid, {minus} FROM grams o JOIN ({_sums('', 'subject')}) p ON p.subject = o.subject"
    train = """SELECT eid, count(*)::DOUBLE AS n, sum(y) AS sy, sum(x1) AS sx, sum(x1 * y) AS sxy,
      sum(x1 * x1) AS sxx FROM parted WHERE part = 'train' GROUP BY eid"""
    found = [scored("within_session", _fit(train, "eid", lam), "eid"),
             scored("held_out_session", _fit(own, "eid", lam), "eid")]
    for kind, group in (("held_out_animal", "subject"), ("held_out_lab", "lab")):
        rest = f"SELECT o.{group}, {minus} FROM ({_sums('', group)}) o, ({_sums('', '')}) p"
        found.append(scored(kind, _fit(rest, group, lam), group))
    for kind, parts in (("held_out_region", "region_parts"), ("held_out_config", "config_parts")):
        inside = _sums(f"WHERE eid IN (SELECT eid FROM {parts} WHERE part = 'train')", "")
        found.append(scored(kind, _fit(inside, "one", lam), "one",
                            f"WHERE t.eid IN (SELECT eid FROM {parts} WHERE part = 'test')"))
    return "\nUNION ALL\n".join(found)


_NEEDS = ("grams", "parted", "sessions", "region_parts", "config_parts")
cte("kind_scores", _NEEDS, _kind_scores(LAM))
cte("kind_scores_stiff", _NEEDS, _kind_scores(10.0))


def session_grams(t: Tables):
    if "_grams" in t.__dict__:
        return t.__dict__["_grams"]
    owner = t.sessions.select("eid", "subject", "lab")
    whole = baselines.gram(t.samples, ["eid"], ["x1"], "y").join(owner, "eid")
    parts = baselines.gram(t.parted, ["eid", "part"], ["x1"], "y").join(owner, "eid")
    whole, parts = cut_lineage(whole), cut_lineage(parts)
    t.__dict__["_grams"] = (whole, parts.where("part = 'train'").drop("part"),
                            parts.where("part = 'test'").drop("part"))
    return t.__dict__["_grams"]


def kind_scores(t: Tables, lam: float = LAM):
    whole, trains, tests = session_grams(t)
    units = t.units.withColumn("passed", F.col("label") >= 1)
    region = splits.Split("held_out_region", splits.split_region(t.sessions, units, "v"), 1)
    config = splits.Split("held_out_config", splits.split_config(configured(t), "config"), 1)
    return protocols.all_kinds(whole, trains, tests, 1, lam, {
        "held_out_region": region.blocks.select("eid", "part"),
        "held_out_config": config.blocks.select("eid", "part")})


_GAPS = """SELECT k.kind, count(k.value) AS n_sessions, avg(k.value) AS mean, avg(k.value - c.value) AS drop
FROM kind_scores k LEFT JOIN (SELECT eid, value FROM kind_scores WHERE kind = 'within_session') c
  ON c.eid = k.eid GROUP BY k.kind"""


@query("k05_generalization_gap", sql("kind_scores", f"""
SELECT kind, n_sessions, round(mean, 6) AS mean, round("drop", 6) + 0.0 AS "drop" FROM ({_GAPS.replace(' AS drop', ' AS "drop"')})"""))
def _(t: Tables):
    gaps = contract.gap_table(kind_scores(t), higher_is_better=False)
    return rounded(gaps, "mean", "drop").withColumn("drop", F.col("drop") + 0.0)


@query("k07_too_close", sql("kind_scores", f"""
SELECT kind, n_sessions, round(mean, 6) AS mean, round("drop", 6) AS "drop"
FROM ({_GAPS.replace(' AS drop', ' AS "drop"')}) WHERE kind <> 'within_session' AND "drop" < 0.5"""))
def _(t: Tables):
    gaps = contract.gap_table(kind_scores(t), higher_is_better=False)
    return rounded(contract.too_close(gaps, 0.5), "mean", "drop")


KINDS = ("within_session", "held_out_session", "held_out_animal", "held_out_lab",
         "held_out_region", "held_out_config")


@query("x03_full_matrix", sql("kind_scores kind_scores_stiff", "SELECT method, " + ", ".join(
    f"round(avg(value) FILTER (WHERE kind = '{k}'), 6) AS {k}" for k in KINDS) + """
FROM (SELECT 'ridge' AS method, * FROM kind_scores UNION ALL
      SELECT 'ridge_stiff', * FROM kind_scores_stiff) GROUP BY method"""))
def _(t: Tables):
    runs = kind_scores(t).withColumn("method", F.lit("ridge")).unionByName(
        kind_scores(t, 10.0).withColumn("method", F.lit("ridge_stiff")))
    return rounded(contract.matrix(runs, KINDS), *KINDS)


SHARES = [0.05, 0.1, 0.25, 0.5, 1.0]
cte("animal_rank", ("sessions",), """
SELECT subject, row_number() OVER (ORDER BY md5(subject::VARCHAR || '|curve'), subject) AS r,
       count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM sessions)""")


@query("x01_scaling_curve", sql("grams animal_rank parted", f"""
SELECT n_animals, count(*) AS n_sessions, round(avg(value), 6) AS mean_rmse FROM (
  SELECT m.n_animals, p.eid, sqrt(avg((y - a - b * x1) ** 2)) AS value
  FROM parted p, {_fit("SELECT s AS n_animals, sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, "
                       "sum(sxy) AS sxy, sum(sxx) AS sxx FROM grams JOIN "
                       "(SELECT subject, r FROM animal_rank) USING (subject) JOIN (SELECT DISTINCT "
                       "ceil(share * n)::BIGINT AS s FROM animal_rank, (VALUES "
                       + ", ".join(f"({s}::DOUBLE)" for s in SHARES)
                       + ") q(share)) ON r <= s GROUP BY s", "n_animals", LAM)} m
  WHERE part = 'test' GROUP BY m.n_animals, p.eid) GROUP BY n_animals"""))
def _(t: Tables):
    whole, _, tests = session_grams(t)
    return rounded(protocols.scaling_curve(whole, tests, SHARES, "curve", 1, LAM), "mean_rmse")


cte("wide_parted", ("ev",), """
SELECT eid, bin, n AS x1, y, CASE WHEN bin < 6 THEN 'train' ELSE 'test' END AS part FROM (
  SELECT eid, t_us // 43200000000 AS bin, count(*)::DOUBLE AS n, avg(value) AS y FROM ev GROUP BY ALL)
WHERE bin < 6 OR bin >= 8""")
cte("wide_rmse", ("wide_parted",), f"""
SELECT eid, sqrt(avg((y - (my - b * mx) - b * x1) ** 2)) AS value FROM wide_parted, (
  SELECT covar_pop(y, x1) / (var_pop(x1) + {LAM}) AS b, avg(x1) AS mx, avg(y) AS my
  FROM wide_parted WHERE part = 'train') WHERE part = 'test' GROUP BY eid""")
cte("ablation_runs", ("rmse", "ridge2", "ridge", "parted", "wide_rmse"), """
SELECT 'metadata' AS factor, 'without' AS level, true AS reference, eid, value FROM rmse
UNION ALL SELECT 'metadata', 'with', false, eid, sqrt(avg((y - a - b1 * x1 - b2 * x2) ** 2))
  FROM parted, ridge2 WHERE part = 'test' GROUP BY eid
UNION ALL SELECT 'session_offset', 'without', true, eid, value FROM rmse
UNION ALL SELECT 'session_offset', 'with', false, p.eid, sqrt(avg((y - a - b * x1 - off) ** 2))
  FROM parted p JOIN (SELECT eid, avg(y - a - b * x1) AS off FROM parted, ridge WHERE part = 'train' GROUP BY eid) o
    ON o.eid = p.eid, ridge WHERE part = 'test' GROUP BY p.eid
UNION ALL SELECT 'bin_width', '6h', true, eid, value FROM rmse
UNION ALL SELECT 'bin_width', '12h', false, eid, value FROM wide_rmse""")


SLOTS, ORDER_STEPS = 3, 4000
POOLED = ("mean", "std", "max", "sum")

# Both feature sets in both orders of units: order 0 is that of the training, 1 a shuffled one.
cte("slotted", ("units",), f"""
SELECT eid, unit_id, turn, least(row_number() OVER (PARTITION BY eid, turn ORDER BY place, unit_id), {SLOTS + 1}) AS slot,
       count(*) OVER (PARTITION BY eid, turn) AS n_units
FROM (SELECT eid, unit_id, 0 AS turn, unit_id AS place FROM units
      UNION ALL SELECT eid, unit_id, 1, md5(eid || ':' || unit_id) FROM units)""")
cte("order_rows", ("dense", "slotted", "samples", "parts24"), f"""
SELECT f.level, f.turn, f.eid, f.bin, f.x, s.y, p.part FROM (
  SELECT 'slots' AS level, turn, eid, bin,
         [{", ".join(f"coalesce(sum(n) FILTER (WHERE slot = {i}), 0)" for i in range(1, SLOTS + 2))},
          {", ".join(f"(any_value(n_units) >= {i})::INT" for i in range(1, SLOTS + 1))}]::DOUBLE[] AS x
  FROM dense JOIN slotted USING (eid, unit_id) GROUP BY turn, eid, bin
  UNION ALL
  SELECT 'pooled', turn, eid, bin, [avg(n), stddev_pop(n), max(n), sum(n)]::DOUBLE[]
  FROM dense, (VALUES (0), (1)) v(turn) GROUP BY turn, eid, bin) f
JOIN samples s USING (eid, bin) JOIN parts24 p USING (bin) WHERE p.part <> 'gap'""")
cte("order_long", ("order_rows",), """
SELECT level, eid, bin, y, j, v, avg(v) OVER (PARTITION BY level, j) AS m FROM (
  SELECT level, eid, bin, y, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM order_rows
  WHERE part = 'train' AND turn = 0)""")
cte("order_moments", ("order_long",), """
SELECT level, list(row ORDER BY j) AS c, list(cxy ORDER BY j) AS cxy, list(m ORDER BY j) AS m, any_value(my) AS my,
       sum(row[j]) AS trace
FROM (SELECT level, j, list(c ORDER BY l) AS row FROM (
        SELECT a.level, a.j, b.j AS l, avg((a.v - a.m) * (b.v - b.m)) AS c
        FROM order_long a JOIN order_long b USING (level, eid, bin) GROUP BY ALL) GROUP BY level, j)
JOIN (SELECT level, j, covar_pop(v, y) AS cxy, any_value(m) AS m, avg(y) AS my FROM order_long GROUP BY level, j)
USING (level, j) GROUP BY level""")
cte("order_fits", ("order_moments",), f"""
WITH RECURSIVE steps AS (
  SELECT level, 0 AS i, list_transform(cxy, lambda e: 0.0::DOUBLE) AS b FROM order_moments
  UNION ALL
  SELECT level, i + 1, list_transform(range(1, len(b) + 1), lambda j: b[j] + (cxy[j] - list_dot_product(c[j], b) - {LAM} * b[j])
                                      / (trace + {LAM}))
  FROM steps JOIN order_moments USING (level) WHERE i < {ORDER_STEPS})
SELECT level, b, m, my FROM steps JOIN order_moments USING (level) WHERE i = {ORDER_STEPS}""")


@query("x02_unit_order", sql("order_rows order_fits", """
SELECT level, count(*) AS n_sessions, round(avg(kept), 6) AS kept_order, round(avg(turned), 6) AS shuffled_order,
       round(max(abs(turned - kept)), 6) AS max_change FROM (
  SELECT level, eid, sqrt(avg(e * e) FILTER (WHERE turn = 0)) AS kept, sqrt(avg(e * e) FILTER (WHERE turn = 1)) AS turned
  FROM (SELECT level, eid, turn, y - my - list_dot_product(x, b) + list_dot_product(m, b) AS e
        FROM order_rows JOIN order_fits USING (level) WHERE part = 'test') GROUP BY level, eid)
GROUP BY level"""))
def _(t: Tables):
    """Fixed unit slots against pooled units, one split and one kind of fit; then the units are shuffled."""
    spans = t.within.bin_spans("train", "test")
    shuffled = F.md5(F.concat_ws(":", F.col("eid").cast("string"), "unit_id"))
    pooled = baselines.pool_units(t.bins, t.units, spans, []).withColumn("x", F.array(*POOLED))
    renamed = baselines.pool_units(t.bins.withColumn("unit_id", shuffled), t.units.withColumn("unit_id", shuffled),
                                   spans, []).withColumn("x", F.array(*POOLED))
    features = {"pooled": (pooled, renamed),
                "slots": (baselines.slot_units(t.bins, t.units, spans, SLOTS),
                          baselines.slot_units(t.bins, t.units, spans, SLOTS, shuffled))}
    y, table = t.samples.select("eid", "bin", "y"), None
    for level, (kept, turned) in features.items():
        train, test = (t.within.rows(kept.join(y, ["eid", "bin"]), part) for part in ("train", "test"))
        intercept, coef = moments.ridge(train, "x", "y", LAM)
        line = F.lit(intercept) + moments.dot("x", F.array(*[F.lit(float(c)) for c in coef]))
        error = F.sqrt(F.avg(F.pow(F.col("y") - line, 2)))
        again = t.within.rows(turned.join(y, ["eid", "bin"]), "test").groupBy("eid").agg(error.alias("turned"))
        one = test.groupBy("eid").agg(error.alias("kept")).join(again, "eid").select(
            F.lit(level).alias("level"), "kept", "turned")
        table = one if table is None else table.unionByName(one)
    return rounded(table.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg("kept").alias("kept_order"), F.avg("turned").alias("shuffled_order"),
        F.max(F.abs(F.col("turned") - F.col("kept"))).alias("max_change")), "kept_order", "shuffled_order", "max_change")


@query("x02_ablations", sql("ablation_runs", """
SELECT r.factor, r.level, count(r.value) AS n_sessions, round(avg(r.value), 6) AS mean,
       round(avg(r.value - b.value), 6) + 0.0 AS change
FROM ablation_runs r LEFT JOIN ablation_runs b ON b.factor = r.factor AND b.eid = r.eid AND b.reference
GROUP BY r.factor, r.level"""))
def _(t: Tables):
    test, train = t.within.rows(t.samples, "test"), t.within.rows(t.samples, "train")
    plain = rmse(preds(t))
    model = baselines.fit_ridge(t.within, t.samples, ["x1"], "y", LAM)
    offsets = train.groupBy("eid").agg(F.avg(F.col("y") - model.score()).alias("offset"))
    shifted = test.join(offsets, "eid").withColumn("yhat", model.score() + F.col("offset"))
    wide_us = 2 * BIN_US
    halves = t.sessions.withColumn("n_bins", F.lit(N_BINS // 2).cast("bigint"))
    wide_split = splits.Split("within_session", splits.split_within(halves, 0.5, 2), 2, 2, bin_width_us=wide_us)
    wide = (t.events.groupBy("eid", binning.in_bin("t_us", wide_us))
            .agg(F.count(F.lit(1)).cast("double").alias("x1"), F.avg("value").alias("y")))
    wide_model = baselines.fit_ridge(wide_split, wide, ["x1"], "y", LAM)
    wider = rmse(wide_model.predict(wide_split.rows(wide, "test")))
    runs = [("metadata", "without", True, plain), ("metadata", "with", False, rmse(preds(t, xs=("x1", "x2")))),
            ("session_offset", "without", True, plain), ("session_offset", "with", False, rmse(shifted)),
            ("bin_width", "6h", True, plain), ("bin_width", "12h", False, wider)]
    table = None
    for factor, level, reference, scores in runs:
        one = scores.select(F.lit(factor).alias("factor"), F.lit(level).alias("level"),
                            F.lit(reference).alias("reference"), "eid", "value")
        table = one if table is None else table.unionByName(one)
    return rounded(report.ablation_table(table), "mean", "change").withColumn(
        "change", F.col("change") + 0.0)

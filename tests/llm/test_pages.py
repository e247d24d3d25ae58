"""Archives and URL rules: round trips, digests, repeatability, brute force."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_TINY
from truegauge.llm import archives, queries, url_rules
from truegauge.llm.common import new_folder
from verification.check import compare

PAGES = [(5, "http://a.example.com/en/1", "same"), (3, "http://b.example.net/es/2?x=1", "same"),
         (9, None, None), (None, "http://c.net", ""), (7, "no scheme", "é" * 5000), (7, "no scheme", "é" * 5000),
         (11, "x://Net/fr/?a", "same"), (1, "http://WWW.Example.com/en/z#t", "<html>\r\n\r\nWARC/1.1\r\n"), (12, "", None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)


def expected(rows):
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    first = defaultdict(lambda: None)
    for page, _, html in rows:
        if page is not None:
            known = first[digest(html)]
            first[digest(html)] = page if known is None else min(known, page)
    out = []
    for page, _, html in rows:
        refers = first[digest(html)] if page is not None and page != first[digest(html)] else None
        out.append((page, len((html or "").encode()), digest(html), "revisit" if refers is not None else "response", refers))
    return Counter(out)


def columns(df):
    return Counter(tuple(r) for r in df.select("key", "payload_bytes", "payload_digest", "record_type",
                                               "refers_to").collect())


def test_archive_round_trip(spark, pages):
    folder = new_folder(spark, "archive")
    manifest = archives.write_archive(pages, folder, shard_bytes=6000, file_bytes=300).collect()
    back = archives.read_archive(spark, folder)
    assert columns(back) == expected(PAGES)
    assert back.where("not intact").count() == 0
    texts = Counter((r["key"], bytes(r["payload"]).decode()) for r in back.where("record_type = 'response'").collect())
    assert all((k, t) in {(p, h or "") for p, _, h in PAGES} for k, t in texts)
    assert sum(r["records"] for r in manifest) == len(PAGES) and len(manifest) > 3
    for r in manifest:
        data = Path(folder.removeprefix("file://"), r["name"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["bytes"]


def test_same_rows_same_bytes(spark, pages):
    names = []
    for partitions in (1, 5):
        folder = new_folder(spark, "archive")
        found = archives.write_archive(pages.repartition(partitions), folder, shard_bytes=6000, file_bytes=300)
        names.append({(r["name"], r["sha256"]) for r in found.collect()})
    assert names[0] == names[1]


def test_many_tiny_shards_and_one_heavy_key(spark):
    """9,000 keys in far more shards than tasks; then one key, the nulls and one repeated row fill many shards."""
    rows = spark.range(9000, numPartitions=4).selectExpr("id * 7 AS page_id", "concat('u', id) AS url",
                                                          "repeat('x', int(id % 50)) AS html")
    folder = new_folder(spark, "archive")
    manifest = archives.write_archive(rows, folder, shard_bytes=5000)
    names = [r["name"] for r in manifest.orderBy("name").collect()]
    assert len(names) > 800
    ranges = [(r["first_key"], r["last_key"]) for r in manifest.orderBy("name").collect()]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert archives.read_archive(spark, folder, False).select("key").distinct().count() == 9000

    one = [(5, f"u{i % 3}", f"text {i % 40}") for i in range(400)] + [(None, None, "same")] * 300
    one += [(8, "v", "same")] * 300 + [(3, "w", "text 7"), (9, "w", "same")] + [(k, None, None) for k in range(20, 40)]
    found = []
    for partitions in (1, 6):
        frame = spark.createDataFrame(one, "page_id bigint, url string, html string").repartition(partitions)
        folder = new_folder(spark, "archive")
        files = archives.write_archive(frame, folder, shard_bytes=4000).collect()
        assert max(r["records"] for r in files) <= 2 * 4000 / archives.HEAD_BYTES  # a cell more than a shard, at most
        assert columns(archives.read_archive(spark, folder)) == expected(one)
        found.append({(r["name"], r["sha256"]) for r in files})
    assert found[0] == found[1] and len(found[0]) > 100


def test_plan_of_very_many_shards(spark):
    """Made-up sizes of 2 TB: no driver loop, shards grow so that their number is bounded."""
    cells = spark.range(200_000, numPartitions=8).select(
        F.unhex(F.lpad(F.hex("id"), 98, "0")).alias("code"), F.lit(1).cast("bigint").alias("copies"),
        (F.lit(10_000_000) + F.col("id") % 7).alias("size"))
    placed, step = archives.planned(cells, 1 << 20)
    total = sum(10_000_000 + i % 7 for i in range(200_000))
    assert step == -(-total // archives.MOST_SHARDS)
    assert placed.agg(F.max("before")).head()[0] == total - 10_000_000 - 199_999 % 7
    assert placed.select(F.floor(F.col("before") / step)).distinct().count() > 90_000


def test_uncommitted_files_are_not_read(spark, pages):
    folder = new_folder(spark, "archive")
    archives.write_archive(pages, folder)
    local = Path(folder.removeprefix("file://"))
    (local / "part-999999-00000.warc.gz").write_bytes(b"left over by a lost task")
    assert columns(archives.read_archive(spark, folder)) == expected(PAGES)


def test_small_payloads_are_not_revisited(spark, pages):
    folder = new_folder(spark, "archive")
    archives.write_archive(pages, folder, min_revisit=5)
    kinds = {(r["payload_bytes"], r["record_type"]) for r in archives.read_archive(spark, folder).collect()}
    assert (4, "revisit") not in kinds and (0, "revisit") not in kinds


def test_empty_archive(spark, pages):
    folder = new_folder(spark, "archive")
    assert archives.write_archive(pages.limit(0), folder).count() == 0
    assert archives.read_archive(spark, folder).count() == 0


def test_archive_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_TINY}/pages.parquet'")
    text, ok = compare("op1_archives", queries.op1_archives(spark, SF_TINY), duck)
    assert ok, text


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[:min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


def test_explicit_rules(spark, pages):
    for source in (pages, queries.read(spark, SF_TINY, "pages")):
        rows = source.select("page_id", "url").collect()
        got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_rules.judged(source).collect())
        assert got == Counter((r["page_id"], *brute_rule(r["url"])[:3]) for r in rows)
        for r in url_rules.judged(source).where("rule is not null").collect():
            assert r["verdict"] == brute_rule(r["url"])[3]


def test_mined_rules_equal_brute_force(spark):
    urls = [f"http://{h}.{t}/{p}/{i}" for i in range(40) for h, t, p in
            (("a", "org", "x"), ("b", "org", "y"), ("c", "info", "x"))]
    label = lambda u: "block" if ".org/x" in u.replace("//a", "//a") and "a.org" in u else "allow"
    labelled = spark.createDataFrame([(u, label(u)) for u in urls], "url string, label string")
    ask = spark.createDataFrame([(1, "http://a.org/x/99"), (2, "http://a.org/y/1"), (3, "http://c.info/x/1"), (4, None)],
                                "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judged(
        ask, rules=(), labelled=labelled, min_support=0.05, min_confidence=0.95).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    tokens = labelled.select(url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))
                             .alias("tokens"), "label")
    rows = tokens.collect()
    for rule in url_rules.mine(tokens, "tokens", "label", 0.05, 0.95).collect():
        fit = [r["label"] for r in rows if set(rule["items"]) <= set(r["tokens"])]
        assert fit.count(rule["verdict"]) == rule["support"] >= 0.05 * len(rows)
        assert abs(rule["confidence"] - rule["support"] / len(fit)) < 1e-12 and rule["confidence"] >= 0.95


def test_no_labels_and_no_pages(spark, pages):
    assert url_rules.judged(pages.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, "http://x.org/a")], "page_id bigint, url string")
    assert [r["verdict"] for r in url_rules.judged(lone).collect()] == ["allow"]


def brute_rules(rows, least, confidence):
    """All minimal confident rules over classes of tokens, by every set of classes that enough rows hold."""
    where: dict = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    first: dict = {}
    for t in sorted(where):
        if len(where[t]) >= least:
            first.setdefault(frozenset(where[t]), t)
    items = {t: held for held, t in first.items()}
    found, level = {}, [((t,), items[t]) for t in sorted(items)]
    while level:
        for chosen, held in level:
            for verdict in ("allow", "block"):
                both = sum(rows[i][1] == verdict for i in held)
                if both >= least and both / len(held) >= confidence:
                    found[chosen, verdict] = both / len(held)
        level = [((*chosen, t), held & items[t]) for chosen, held in level for t in items
                 if t > chosen[-1] and len(held & items[t]) >= least]
    return {(c, v) for (c, v), sure in found.items() if not any(
        w == v and set(d) < set(c) and s >= sure for (d, w), s in found.items())}


def test_no_mined_rule_is_missing(spark):
    words = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for i in range(120):
        tokens = sorted({words[(i * 7 + j * j) % 6] for j in range(1 + i % 4)}) + (["x", "y"] if i % 5 == 0 else [])
        rows.append((tokens, "block" if ("a" in tokens and "c" in tokens) or i % 5 == 0 else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string").repartition(4)
    rules, known = url_rules.mined(frame, "tokens", "label", 0.05, 0.9)
    got = {(tuple(sorted(r["items"])), r["verdict"]) for r in rules.collect()}
    assert got == brute_rules(rows, 6, 0.9) and len(got) > 3
    assert {(r["token"], r["item"]) for r in known.collect() if r["token"] in "xy"} == {("x", "x"), ("y", "x")}


def test_long_urls_end(spark):
    """A path of 200 segments among few labelled urls, also repeated, is no power set."""
    path = "/".join(f"s{i}" for i in range(200))
    urls = [f"http://h{i}.net/fr/{path}/{i}" for i in range(6)] + [f"http://www.example.com/en/{i}" for i in range(14)]
    urls += [f"http://h9.net/zz/{path}", "http://h9.org/s7", "http://other.org/"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)],
                                  "page_id bigint, url string, explicit int, found int")
    got = {r["page_id"]: r for r in url_rules.judged(pages).collect()}
    assert got[20]["verdict"] == "block" and got[21]["verdict"] == "block" and got[22]["verdict"] == "allow"
    assert got[20]["mined_rule"] and (got[0]["explicit"], got[0]["found"]) == (1, 2)

"""The operators' queries over the driver tables, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm import (archives, byte_pairs, decontaminate, heap_clusters, language_model, near_copies,
                           pseudonyms, quality_rules, secret_scan, severity, simhash, url_rules, whitening)
from truegauge.llm.common import new_folder
from truegauge.llm.oracles import ORACLES  # noqa: F401 - the driver contract reads it here

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_archives(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "archive")
    archives.write_archive(read(spark, folder, "pages"), target)
    back = archives.read_archive(spark, target)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(read(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "mined_rule")


@query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scored(read(spark, folder, "documents"), language_model.held_out())


@query
def op7_severity(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic in a text of bad quality, 2 toxic in a good one, which more will read."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 0, 0).otherwise(
        F.col("toxic") + F.coalesce("quality", F.lit(0))).alias("grade"))
    return severity.scored(docs, severity.fit(docs, labels))


def count_kind(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query
def op2_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = near_copies.near_copy_classes(read(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "class_id")


@query
def op4_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    out = pseudonyms.with_pseudonyms(docs, found="found")
    counts = [count_kind("found", kind) for kind in pseudonyms.KINDS]
    return out.select("doc_id", "text", *counts)


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    ledger = secret_scan.updated(None, docs, "doc_id", "text")
    found = secret_scan.findings(docs, "text", ledger)
    base = [rule.name for rule in secret_scan.BASE]
    return found.select(
        "doc_id", *[count_kind("findings", kind) for kind in base],
        F.sha2(secret_scan.joined(F.col("findings"), base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("findings")).alias("spans"))


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rules = quality_rules.ordered(docs, "text", quality_rules.EXTRA)
    judged = docs.select(
        "doc_id", *[c.alias(n) for n, c in quality_rules.measures(F.col("text")).items()],
        quality_rules.rejected_by(F.col("text"), rules).isNull().alias("passed"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.col("passed")).drop("passed")


@query
def op9_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    return byte_pairs.round_trip(docs, "text", public_tokenizers.path(VOCABULARY),
                                 public_tokenizers.PATTERN).drop("text")


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, "text", read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.count_hit(F.col("hits")).alias("n_hit"),
        F.size("found_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


@query
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op12_heap_clusters(spark: SparkSession, folder: str) -> DataFrame:
    members, centroids = heap_clusters.clustered(read(spark, folder, "embeddings"))
    rows = centroids.collect()  # one a cluster
    if not rows:
        rows = [(0, [], 0, 0, [])]
    total = sum(r[3] for r in rows)
    inertia = F.get(F.array(*[F.lit(r[3]).cast("bigint") for r in rows]), F.col("cluster"))
    digest = F.get(F.array(*[F.lit(heap_clusters.centroid_digest(r[1])) for r in rows]), F.col("cluster"))
    return members.select(
        F.col("id").alias("vec_id"), "cluster", "distance", inertia.alias("cluster_inertia"),
        F.lit(total).cast("bigint").alias("inertia"), digest.alias("centroid_sha256"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    n, shares, error = 0, [0.0], 0.0
    if model is not None and len(model.values):
        n, error, shares = model.n, model.identity_error, (model.values / model.trace).tolist()
    explained = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("component") - 1)
    return whitening.whitened(vectors, model).select(
        F.col("id").alias("vec_id"), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"))

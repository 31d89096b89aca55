"""Trained models and stand-ins for encoders and language models; these have no SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions.dialect import SPARK
from parlance.operators import kmeans, logreg
from parlance.plans.common import run_sql
from parlance.plans.decisions import cascade
from parlance.session import table


@query("embed_hash")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hashing stand-in for a sentence encoder: 32 signed term counts a document, scaled to length 1."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    terms = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("term"))
    h = F.xxhash64("term")
    sums = terms.groupBy("doc_id", F.pmod(h, F.lit(32)).cast("int").alias("i")).agg(F.sum(F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).alias("x"))
    norm = sums.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12)))
    return norm.select("doc_id", parts.alias("embedding"))


@query("logreg_predict")
def logreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, word pairs and characters with balanced class weights, fitted on all labelled documents outside the held-out fifth, applied to every labelled document."""
    known = table(spark, sf_dir, "labels").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").join(known, "doc_id").select(F.col("doc_id").alias("id"), "text", "label", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0").alias("held_out"))
    texts = docs.groupBy("id").agg(F.min("text").alias("text"))
    keys = docs.where("not held_out").select("id", "label").distinct()
    model = logreg.fit(texts.join(keys, "id"))
    found = logreg.predict(model, texts).select("id", F.col("label").alias("prediction"), F.round("probability", 6).alias("probability"))
    return docs.select("id", "label", "held_out").join(found, "id").withColumnRenamed("id", "doc_id")


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means over all embeddings for k from 6 to 20 with ten starts each: the best start's inertia, its silhouette on 2000 seeded vectors at most; the highest of all, and the best within 8 to 14, which is the one to use."""
    models, scores = kmeans.sweep(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", range(6, 21))
    known = {k: s for k, s in scores.items() if s is not None}
    highest = max(known, key=known.get) if known else None
    band = {k: s for k, s in known.items() if 8 <= k <= 14}
    best = max(band, key=band.get) if band else None
    rows = [(m.k, round(m.inertia, 6), None if scores[m.k] is None else round(scores[m.k], 6), m.k == highest, m.k == best) for m in models]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, highest boolean, best boolean")


@query("agent_decide")
def agent_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of a batch of messages: replayed heads and the cascade; agent_handle has all steps."""
    out = run_sql(spark, sf_dir, f"WITH {cascade(SPARK)} SELECT id, layer, code FROM c")
    return out.withColumn("route", F.when(F.col("code").isin(P.AUTO_CODES), "auto").otherwise("escalate"))

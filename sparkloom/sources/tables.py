"""Parquet tables and the views of them that the operators work on.

The adapters map stored tables to the data model: documents to posts, conversations
to comments and dialogue, labels to classification results, events to timestamped
content, and the part/supplier/nation/region tables to a concept graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subset(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; all rows where there are none given."""
    return df.where(F.col(column).isin(values)) if values else df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subreddit"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"), F.col("n_chars").alias("score"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("post_id"), F.col("role").alias("subreddit"), F.col("text").alias("body"), F.length("text").cast("long").alias("score"), F.col("turn"))


def label_of(quality: Column, toxic: Column) -> Column:
    labels = schemas.SENTIMENT_LABELS
    return F.when(toxic == 1, F.when(quality == 1, labels[3]).otherwise(labels[4])).otherwise(F.when(quality == 1, labels[0]).otherwise(labels[2]))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels")
    score = (F.lit(1) + F.col("quality") + F.col("toxic")) / 4.0
    return r.select(F.col("doc_id").cast("string").alias("content_id"), F.lit("post").alias("content_type"), label_of(F.col("quality"), F.col("toxic")).alias("sentiment_label"), score.alias("sentiment_score"))


def timed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subreddit"), F.col("event_type").alias("sentiment_label"), F.col("ts").alias("created_dt"), F.col("value").alias("score"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), F.col("role").alias("character"), F.col("text").alias("dialogue"))


def concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, label, category): regions, nations, suppliers, brands, types and parts."""
    read = lambda t: table(spark, sf_dir, t)
    row = lambda df, kind, key, label, category: df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("name"), F.col(label).cast("string").alias("label"), F.lit(category).alias("category"))
    part = read("part")
    frames = [row(read("region"), "R", "r_name", "r_name", "Domain"), row(read("nation"), "N", "n_name", "n_name", "Domain"), row(read("supplier"), "S", "s_suppkey", "s_name", "Tool"), row(part.select("p_brand").distinct(), "B", "p_brand", "p_brand", "Framework"), row(part.select("p_type").distinct(), "T", "p_type", "p_type", "Concept"), row(part, "P", "p_partkey", "p_name", "Model")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel, dst): nations in regions, suppliers in nations, brands by type, and of each part its
    type, its brand and every supplier that it was ever ordered from."""
    read = lambda t: table(spark, sf_dir, t)
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    nation, part = read("nation"), read("part")
    edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    frames = [
        edge(nation.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")), key("N", "n_name"), "PART_OF", key("R", "r_name")),
        edge(read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), key("S", "s_suppkey"), "PART_OF", key("N", "n_name")),
        edge(part.select("p_brand", "p_type").distinct(), key("B", "p_brand"), "USED_IN", key("T", "p_type")),
        edge(part, key("P", "p_partkey"), "IS_A", key("T", "p_type")),
        edge(part, key("P", "p_partkey"), "VARIANT_OF", key("B", "p_brand")),
        edge(read("lineitem").select("l_partkey", "l_suppkey").distinct(), key("P", "l_partkey"), "REQUIRES", key("S", "l_suppkey")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

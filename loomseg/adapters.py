"""The benchmark tables seen as reads, axes, unobservable stretches and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length given to every read.
READ = 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since 2024 as positions, event types as axes."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.floor((us - F.lit(1_704_067_200_000_000)) / 1_000_000).cast("long")
    return e.select(
        F.col("event_type").alias("chrom"), start.alias("start"), (start + READ).alias("end"), F.col("event_id").cast("string").alias("name"),
        F.col("value").alias("score"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def reads_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred positions a shipping day; sample A has discounts of 5 % and more."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")) * 100 + F.col("l_linenumber")).cast("long")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("chrom"), start.alias("start"), (start + READ).alias("end"), F.col("l_orderkey").cast("string").alias("name"),
        F.col("l_quantity").alias("score"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.when(F.col("l_discount") >= 0.05, "A").otherwise("B").alias("sample"),
    )


def reads_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of which half are moved into domains: of every 120 days, those of sample A into the first 30, those of B into the third 30."""
    li = table(spark, sf_dir, "lineitem")
    day, a = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")), F.col("l_discount") >= 0.05
    day = F.when(F.col("l_suppkey") % 2 == 0, day - day % 120 + F.when(a, 0).otherwise(60) + day % 30).otherwise(day)
    start = (day * 100 + F.col("l_partkey") % 100).cast("long")
    return li.select(
        F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string")).alias("chrom"), start.alias("start"), (start + READ).alias("end"), F.col("l_orderkey").cast("string").alias("name"),
        F.col("l_quantity").alias("score"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.when(a, "A").otherwise("B").alias("sample"),
    )


def chroms_planted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{a}{b}{c}", 0, 250_000) for a in "ANR" for b in "FO" for c in range(3)], "chrom string, start long, end long")


def chroms_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, 0, 2_592_000) for c in ("click", "error", "purchase", "signup", "view")], "chrom string, start long, end long")


def chroms_lineitem(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a + b, 0, 250_000) for a in "ANR" for b in "FO"], "chrom string, start long, end long")


def dead_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of all suppliers' keys, two and two overlapping, on every axis: key k starts at 50,000 (k div 2) + 300 (k mod 2), wrapped at the axis' end, and is 300 + 37 k mod 1,200 long."""
    k = F.col("s_suppkey")
    start = ((F.floor(k / 2) * 50_000 + k % 2 * 300) % 2_592_000).cast("long")
    s = table(spark, sf_dir, "supplier").select(start.alias("start"), (start + 300 + k * 37 % 1200).alias("end"))
    return s.crossJoin(F.broadcast(chroms_events(spark).select("chrom"))).select("chrom", "start", "end")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts over the alphabet ACGTN: letters by code point modulo 4, all else N."""
    t = F.upper(F.regexp_replace("text", "[^A-Za-z]", "-"))
    t = F.translate(t, "BDEFHIJKLMOPQRSUVWXYZ", "GACGACGTACTACGCTGCAGC")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.regexp_replace(t, "[^ACGT]", "N").alias("seq"))


READS_EVENTS = """events_reads AS (SELECT event_type AS chrom, (epoch_us(ts) - 1704067200000000) // 1000000 AS s,
  (epoch_us(ts) - 1704067200000000) // 1000000 + 36 AS e, event_id::VARCHAR AS name, value AS score,
  CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM events)"""
READS_LINEITEM = """line_reads AS (SELECT l_returnflag || l_linestatus AS chrom, (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 100 + l_linenumber)::BIGINT AS s,
  (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 100 + l_linenumber + 36)::BIGINT AS e, l_quantity AS score,
  CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN l_discount >= 0.05 THEN 'A' ELSE 'B' END AS sample FROM lineitem)"""
CHROMS_EVENTS = "ev_chroms AS (SELECT unnest(['click','error','purchase','signup','view']) AS chrom, 2592000 AS width)"
CHROMS_LINEITEM = "line_chroms AS (SELECT unnest(['AF','AO','NF','NO','RF','RO']) AS chrom, 250000 AS width)"
CHROMS_PLANTED = "planted_chroms AS (SELECT a || b || c AS chrom, 250000 AS width FROM (SELECT unnest(['A', 'N', 'R']) AS a), (SELECT unnest(['F', 'O']) AS b), (SELECT unnest([0, 1, 2]) AS c))"
READS_PLANTED = """moved AS (SELECT *, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS d, l_discount >= 0.05 AS a FROM lineitem),
planted AS (SELECT l_returnflag || l_linestatus || (l_partkey % 3) AS chrom, (CASE WHEN l_suppkey % 2 = 0 THEN d - d % 120 + (CASE WHEN a THEN 0 ELSE 60 END) + d % 30 ELSE d END * 100 + l_partkey % 100)::BIGINT AS s,
  (CASE WHEN l_suppkey % 2 = 0 THEN d - d % 120 + (CASE WHEN a THEN 0 ELSE 60 END) + d % 30 ELSE d END * 100 + l_partkey % 100 + 36)::BIGINT AS e, l_quantity AS score,
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN a THEN 'A' ELSE 'B' END AS sample FROM moved)"""
DEAD_EVENTS = """dead_raw AS (SELECT c.chrom, (s_suppkey // 2 * 50000 + s_suppkey % 2 * 300) % 2592000 AS s, (s_suppkey // 2 * 50000 + s_suppkey % 2 * 300) % 2592000 + 300 + s_suppkey * 37 % 1200 AS e
  FROM supplier CROSS JOIN ev_chroms c),
dead_m AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM dead_raw),
dead_i AS (SELECT *, sum(CASE WHEN ahead IS NULL OR s > ahead THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM dead_m),
dead AS (SELECT chrom, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM dead_i GROUP BY chrom, i)"""
SEQS = """seqs AS (SELECT item_id::VARCHAR AS name,
  regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 'BDEFHIJKLMOPQRSUVWXYZ', 'GACGACGTACTACGCTGCAGC'), '[^ACGT]', 'N', 'g') AS seq FROM benchmark)"""

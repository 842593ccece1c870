"""Mixing sources to target weights.

Tokens are aggregated per source, targets follow by water-filling, and every document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    Sources ordered by code point (null last) take `weights` in turn. They share `budget` times all
    words by weight; a source's target stops at `most` times its words and the excess is reshared by
    weight among the others. The level of that water-filling is the largest of the levels got by
    filling sources in the order of their cap per weight, so no loop is needed.

    Null text: size 0. Null source: a source of its own. A source without words: target, rate and copies 0.
    Repeated rows are documents of their own with equal draws. An empty table gives no rows.
    Only the named columns are read, so others may have any name.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rk") % len(weights) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on: the windows below sort sources, never documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("fill", "rk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    targets = (
        per.withColumn("rk", F.row_number().over(by_name) - 1)
        .withColumn("w", w.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("cap") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
        .withColumn("level", F.max(F.col("left") / F.col("w_left")).over(every))
        .withColumn("target", F.least("cap", F.col("level") * F.col("w")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select(F.col("source").alias("t_source"), "source_size", "target", "rate")
    )
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") / 2.0**48
    whole = F.floor("rate")
    return (
        sized.join(stored(targets, "targets"), F.col("source").eqNullSafe(F.col("t_source")), "left")
        .withColumn("copies", whole + (draw < F.col("rate") - whole).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan says, with its own columns only.

    The plan joins back by id; ids that occur on several rows share one draw and one source's rate,
    so the plan is reduced to a row per (id, source) first. Documents with a null id are mixed too.
    """
    source_col = options.get("source_col", "source")
    plan = mixing_plan(docs, id_col=id_col, **options).groupBy("doc_id", "source").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("k"), F.col(source_col).alias("s"))
    return (
        rows.join(plan.filter("copies > 0"), F.col("k").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")))
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("row.*")
    )


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM per),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[(rk % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS w_rest
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, (max(rest / w_rest) OVER ()) * w) AS target FROM filled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(r.rate)::BIGINT
    + (('0x' || substr(md5('mix:' || d.doc_id), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE < r.rate - floor(r.rate))::BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""

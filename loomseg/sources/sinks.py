"""Sinks: tab-separated text in the documented layouts, and the model's parameters."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import make
from ..operators.hmm import Model


def _text(df: DataFrame, columns: list[Column], path: str) -> None:
    """One line a row, fields between tabs, sorted within range partitions so that files follow the axes."""
    sorted_ = df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    sorted_.select(F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def six(c: str) -> Column:
    """A number with six significant digits, without zeros at their end."""
    x = F.format_string("%.6g", F.col(c).cast("double"))
    return F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def write_domains(domains: DataFrame, path: str) -> None:
    _text(domains, [F.col("chrom"), F.col("start"), F.col("end"), F.col("state"), six("mean"), six("score"), F.lit("+")], path)


def write_scores(bins: DataFrame, path: str, columns: list[str]) -> None:
    """One value a bin, or two for three states."""
    _text(bins, [F.col("chrom"), F.col("start"), F.col("end"), *[six(c) for c in columns]], path)


def write_counts(bins: DataFrame, path: str, counts: list[str]) -> None:
    _text(bins, [F.col("chrom"), F.col("start"), F.col("end"), *[six(c) for c in counts], six("scale"), F.col("state")], path)


def write_boundaries(found: DataFrame, path: str) -> None:
    name = F.concat_ws(":", F.lit("B"), F.col("bins").cast("string"), F.col("peak").cast("string"), six("peak_score"))
    _text(found, [F.col("chrom"), F.col("start"), F.col("end"), name, six("p"), F.lit("+")], path)


def write_dead_zones(zones: DataFrame, path: str, strand: str = "+") -> None:
    _text(zones, [F.col("chrom"), F.col("start"), F.col("end"), F.lit("X"), F.lit(0), F.lit(strand)], path)


def model_text(m: Model) -> str:
    """Parameters in full precision: distributions, start, transitions, end; # begins a comment."""
    row = lambda v: " ".join(repr(float(x)) for x in v)
    return "\n".join([f"{m.n} # states", *map(str, m.emissions), f"{row(m.start)} # start", *map(row, m.trans), f"{row(m.end)} # end"]) + "\n"


def model_from_text(text: str) -> Model:
    lines = [x for x in (line.split("#")[0].strip() for line in text.splitlines()) if x]
    n = int(lines[0])
    row = lambda x: np.array([float(v) for v in x.split()])
    return Model([make(x) for x in lines[1 : n + 1]], row(lines[n + 1]), np.stack([row(x) for x in lines[n + 2 : 2 * n + 2]]), row(lines[2 * n + 2]))


def write_model(spark, m: Model, path: str) -> None:
    spark.createDataFrame([(line,) for line in model_text(m).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark, path: str) -> Model:
    return model_from_text("\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect()))


def report(m: Model) -> str:
    """Emissions, expected run lengths and transitions, for the log."""
    return json.dumps({"emissions": [str(d) for d in m.emissions], "expected_bins": [float(1 / max(1 - m.trans[i, i], 1e-20)) for i in range(m.n)], "transitions": m.trans.tolist()})

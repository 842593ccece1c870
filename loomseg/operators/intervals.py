"""Interval algebra on (chrom, start, end), half-open.

Joins by overlap go through buckets: each different interval is given once, with the list or the number of its rows, to the buckets it touches, buckets are equi-joined, and a
pair is reported in one bucket only, that of the later start. Pairs of rows are made last and kept nowhere, so disk and memory follow the input, and time the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 14


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.chrom") == F.col(f"{b}.chrom")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def contains(a: str, b: str) -> Column:
    return (F.col(f"{a}.chrom") == F.col(f"{b}.chrom")) & (F.col(f"{a}.start") <= F.col(f"{b}.start")) & (F.col(f"{b}.end") <= F.col(f"{a}.end"))


def distance(a: str, b: str) -> Column:
    """0 for overlap, else the gap plus one; null on other axes."""
    gap = F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start")) - F.least(F.col(f"{a}.end"), F.col(f"{b}.end")) + 1
    return F.when(F.col(f"{a}.chrom") == F.col(f"{b}.chrom"), F.when(overlaps(a, b), F.lit(0)).otherwise(gap))


def merge(x: DataFrame, touching: bool = True, cell: int = 1 << 22) -> DataFrame:
    """The union of intervals: overlapping ones become one, touching ones too if asked for.

    An axis is cut into cells by start, which are sorted side by side. What a cell needs of those before it, their largest end and how
    many islands began in them, comes from running windows over one row per cell.
    """
    rows = x.select("chrom", "start", "end", F.floor(F.col("start") / cell).alias("_c"))
    prior = Window.partitionBy("chrom").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("chrom", "_c").agg(F.max("end").alias("_e")).withColumn("_e", F.max("_e").over(prior))
    own = Window.partitionBy("chrom", "_c").orderBy("start", "end")
    ahead = F.greatest(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), "_e")
    marked = rows.join(carry, ["chrom", "_c"]).withColumn("_a", ahead)
    apart = F.col("start") > F.col("_a") if touching else F.col("start") >= F.col("_a")
    marked = marked.withColumn("_n", F.coalesce(apart, F.lit(True)).cast("int"))
    before = marked.groupBy("chrom", "_c").agg(F.sum("_n").alias("_s")).withColumn("_s", F.coalesce(F.sum("_s").over(prior), F.lit(0)))
    # of equal intervals the one that begins the island comes first
    island = F.sum("_n").over(own.orderBy("start", "end", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s")
    return marked.join(before, ["chrom", "_c"]).withColumn("_i", island).groupBy("chrom", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def merge_by_depth(x: DataFrame) -> DataFrame:
    """The union by a sweep over ends: a stretch lasts while the depth is above 0. Starts come before ends, so touching intervals merge."""
    ends = x.filter("end > start").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("chrom", F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("chrom").orderBy("p")
    deep = steps.withColumn("depth", F.sum("d").over(w)).withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    edges = deep.filter((F.col("depth") == 0) | (F.col("before") == 0)).filter("NOT (depth = 0 AND before = 0)")
    out = edges.withColumn("end", F.lead("p").over(w)).filter("before = 0")
    return out.select("chrom", F.col("p").alias("start"), "end")


def _buckets(x: DataFrame, name: str, size: int) -> DataFrame:
    own = x.select(F.struct("*").alias(name)).filter(f"{name}.end > {name}.start")
    return own.select(name, F.col(f"{name}.chrom").alias("_c"), F.explode(F.sequence(F.floor(F.col(f"{name}.start") / size), F.floor((F.col(f"{name}.end") - 1) / size))).alias("_b"))


#: Rows of one span that are in one list at most, and copies of a row that are made at once.
LISTED, COPIES = 1 << 16, 1 << 12


def _under(start: str, end: str, bucket: int) -> Column:
    """The buckets that an interval touches."""
    return F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))


def _tasks(x: DataFrame) -> int:
    """What joins make is far more than what they read, so their tasks stay as many as shuffles are to have, whatever the bytes."""
    return int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _listed(x: DataFrame, keys: list[str], name: str, buckets: Column) -> DataFrame:
    """Dealt by axis and bucket (_c, _b), a row for each span (keys) with the rest of its rows as a list, <name>_rows, of values if one column is left; a span of more rows than LISTED has several.

    Rows are dealt once: lists are made where they are joined.
    """
    rest = [c for c in x.columns if c not in keys] or [keys[0]]
    # rows / LISTED spans at most
    many = x.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > LISTED).collect()
    part, kinds = [], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*keys).schema)
    if many:
        parts = x.sparkSession.createDataFrame([(*r[:-1], -(-r[-1] // LISTED)) for r in many], f"{kinds}, _parts long")
        x = x.join(F.broadcast(parts), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")), F.lit(0))).drop("_parts")
        part = ["_part"]
    dealt = x.withColumn("_b", F.explode(buckets)).repartition(_tasks(x), "chrom", "_b")
    rows, nulls = (F.col("_rows"), []) if len(rest) > 1 else (F.concat("_rows", F.array_repeat(F.lit(None).cast(x.schema[rest[0]].dataType), F.col("_nulls").cast("int"))), [F.count_if(F.col(rest[0]).isNull()).alias("_nulls")])
    lists = dealt.groupBy("_b", *keys, *part).agg(F.collect_list(F.struct(*rest) if len(rest) > 1 else rest[0]).alias("_rows"), *nulls)
    return lists.select(F.col("chrom").alias("_c"), "_b", *[F.col(c).alias(f"{name}_{c}") for c in keys], rows.alias(f"{name}_rows"))


def _row(x: DataFrame, keys: list[str], name: str) -> Column:
    """A row of x again, from its span and <name>_row."""
    field = f"{name}_row.{{}}" if len(x.columns) > len(keys) + 1 else f"{name}_row"
    return F.struct(*[F.col(f"{name}_{c}" if c in keys else field.format(c)).alias(c) for c in x.columns]).alias(name)


SPAN = ["chrom", "start", "end"]


def _overlapping(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """Each pair of overlapping spans (a_chrom, a_start, a_end, b_...) once, with what else the two have, from spans dealt by _c and _b."""
    first = F.floor(F.greatest("a_start", "b_start") / bucket)
    return a.join(b.hint("merge"), ["_c", "_b"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("_b") == first))


def overlap_join(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a struct, b struct): every overlapping pair, once. Equal spans meet once for all their rows."""
    x, y = (_listed(t.filter(F.col("end") > F.col("start")), SPAN, n, _under("start", "end", bucket)) for t, n in ((a, "a"), (b, "b")))
    met = _overlapping(x, y, bucket).withColumn("a_row", F.explode("a_rows")).withColumn("b_row", F.explode("b_rows"))
    return met.select(_row(a, SPAN, "a"), _row(b, SPAN, "b"))


def intersect(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The clipped overlap of every pair. Equal spans are counted and meet once; copies are made last."""

    def counted(x: DataFrame, name: str) -> DataFrame:
        spans = x.filter(F.col("end") > F.col("start")).groupBy(*SPAN).agg(F.count("*").alias("n"))
        return spans.select(F.col("chrom").alias("_c"), F.explode(_under("start", "end", bucket)).alias("_b"), *[F.col(c).alias(f"{name}_{c}") for c in (*SPAN, "n")]).repartition(_tasks(x), "_c", "_b")

    met = _overlapping(counted(a, "a"), counted(b, "b"), bucket).select(F.col("a_chrom").alias("chrom"), F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), (F.col("a_n") * F.col("b_n")).alias("n"))
    some = met.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    return some.select(*SPAN, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("k") * COPIES))).alias("copy")).select(*SPAN)


def clip(a: str, b: str) -> Column:
    """One pair's overlap as a struct; (chrom, 0, 0) if they are disjoint."""
    both = overlaps(a, b)
    return F.struct(F.col(f"{a}.chrom").alias("chrom"), F.when(both, F.greatest(f"{a}.start", f"{b}.start")).otherwise(0).alias("start"), F.when(both, F.least(f"{a}.end", f"{b}.end")).otherwise(0).alias("end"))


def semi(b: DataFrame, a: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of b that overlap some row of a; equal rows stay as often as they occur. a is merged first, so a row meets few."""
    union = _buckets(merge(a), "a", bucket).select("_c", "_b", F.col("a.start").alias("_s"), F.col("a.end").alias("_e"))
    keyed = b.withColumn("_id", F.monotonically_increasing_id())
    hit = _buckets(keyed, "b", bucket).join(union, ["_c", "_b"]).filter("b.start < _e AND _s < b.end")
    return hit.groupBy("b._id").agg(F.first("b").alias("b")).select(*[F.col(f"b.{c}") for c in b.columns])


def assign(x: DataFrame, big: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(x struct, big struct): each row with the big regions that its start lies in. Equal starts and equal regions meet once for all their rows."""
    points = _listed(x.filter("start IS NOT NULL"), SPAN[:2], "x", F.array(F.floor(F.col("start") / bucket)))
    regions = _listed(big.filter(F.col("end") > F.col("start")), SPAN, "big", _under("start", "end", bucket))
    met = points.join(regions.hint("merge"), ["_c", "_b"]).filter("x_start >= big_start AND x_start < big_end").withColumn("x_row", F.explode("x_rows")).withColumn("big_row", F.explode("big_rows"))
    return met.select(_row(x, SPAN[:2], "x"), _row(big, SPAN, "big"))


def nearest(x: DataFrame, targets: DataFrame, cell: int = 1 << 22) -> DataFrame:
    """x's columns with the nearest target (t_start, t_end) by distance of starts; a tie goes to the one before. Null on axes without one.

    Targets and queries of a cell of the axis stand in order; each sees the last target before it, and, in falling order, the last after it. What lies
    in other cells comes from running windows over one row per cell. Frames only grow, and no pairs are made.
    """
    t = targets.select("chrom", F.col("start").alias("_p"), F.lit(0).alias("_k"), F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("_t"), F.lit(None).cast(x.select(F.struct("*")).schema[0].dataType).alias("_x"))
    q = x.select("chrom", F.col("start").alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("_t"), F.struct("*").alias("_x"))
    both = t.union(q).withColumn("_c", F.floor(F.col("_p") / cell))
    cells = both.groupBy("chrom", "_c").agg(F.max("_t").alias("_high"), F.min("_t").alias("_low"))
    past = Window.partitionBy("chrom").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    next_ = Window.partitionBy("chrom").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("chrom", "_c", F.max("_high").over(past).alias("_before"), F.min("_low").over(next_).alias("_after"))
    up = Window.partitionBy("chrom", "_c").orderBy("_p", "_k", "_t.e")
    # of equal starts the smallest end counts on the right, and at a query's own start a target is on its left
    down = Window.partitionBy("chrom", "_c").orderBy(F.desc("_p"), F.desc("_k"), F.desc("_t.e"))
    near = both.withColumn("_l", F.last("_t", True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.last("_t", True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.filter("_k = 1").join(cells, ["chrom", "_c"]).withColumn("_l", F.coalesce("_l", "_before")).withColumn("_r", F.coalesce("_r", "_after"))
    pick = F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull() | (F.col("_p") - F.col("_l.s") <= F.col("_r.s") - F.col("_p")), F.col("_l")).otherwise(F.col("_r"))
    return near.select("_x.*", pick.alias("_n")).select(*x.columns, F.col("_n.s").alias("t_start"), F.col("_n.e").alias("t_end"))


def sync_chroms(stable: DataFrame, other: DataFrame) -> DataFrame:
    """Each axis of stable with the rows of other on it, null if it has none."""
    return stable.select("chrom").distinct().join(other, "chrom", "left")


def parse_region(text: Column) -> Column:
    """chr:start-end as a struct; null if it is not one."""
    part = lambda k: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", k)
    return F.when(text.rlike(r"^(.+):(\d+)-(\d+)$"), F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def region_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))

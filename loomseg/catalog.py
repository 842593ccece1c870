"""All queries of the engine by name, and their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import columns as fx
from .operators import alignments, binning, binsize, boundaries, calling, domains, hmm, intervals, kmers, reference, stats
from .plans import model_sql, segment
from .sources import text
from .streaming import counts as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEP, SIZE = 3600, 7200
LINE_STEP, LINE_SIZE = 50, 500


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(c, digits: int = 6):
    return F.round(c, digits)


# shared pieces of SQL

DEDUP = """ded AS (SELECT * EXCLUDE (p) FROM (SELECT *, lag(strand) OVER (PARTITION BY chrom, s ORDER BY e, strand) AS p FROM {0}) WHERE p IS NULL OR p <> strand)"""


def _bins_sql(reads: str, chroms: str, name: str, step: int, fragment: int = 0, where: str = "") -> str:
    h = fragment // 2
    return f"""{name}_d AS (SELECT * FROM (SELECT *, lag(strand) OVER (PARTITION BY chrom, s ORDER BY e, strand) AS p FROM {reads} {where}) WHERE p IS NULL OR p <> strand),
{name}_p AS (SELECT chrom, CASE WHEN strand = '+' THEN s + {h} ELSE e - {h} - 1 END AS pos FROM {name}_d),
{name} AS (SELECT chrom, pos // {step} AS bin, count(*) AS n FROM {name}_p JOIN {chroms} USING (chrom) WHERE pos >= 0 AND pos // {step} < ceil(width / {step}) GROUP BY ALL)"""


EV = f"{ad.CHROMS_EVENTS}, {ad.READS_EVENTS}, {ad.DEAD_EVENTS}"
LI = f"{ad.CHROMS_LINEITEM}, {ad.READS_LINEITEM}"
EV_GRID = f"grid AS (SELECT chrom, unnest(range(0, ceil(width / {STEP})::BIGINT)) AS bin FROM ev_chroms)"
COVER = f"""cells AS (SELECT chrom, s, e, unnest(range(s // {STEP}, (e - 1) // {STEP} + 1)) AS bin FROM dead),
cover AS (SELECT chrom, bin, sum(least(e, (bin + 1) * {STEP}) - greatest(s, bin * {STEP}))::BIGINT AS dead FROM cells GROUP BY ALL)"""
EV_BASE = f"""{EV}, {_bins_sql("events_reads", "ev_chroms", "cnt", STEP)}, {EV_GRID}, {COVER},
base AS (SELECT g.chrom, g.bin, g.bin * {STEP} AS s, (g.bin + 1) * {STEP} AS e, coalesce(n, 0)::DOUBLE AS reads, 1.0::DOUBLE - coalesce(dead, 0)::DOUBLE / {STEP} AS scale
  FROM grid g LEFT JOIN cnt USING (chrom, bin) LEFT JOIN cover USING (chrom, bin)),
big AS (SELECT chrom, bin // 2 AS bin, min(s) AS s, max(e) AS e, sum(reads) AS reads, avg(scale) AS scale FROM base GROUP BY chrom, bin // 2 HAVING count(*) = 2),
kept AS (SELECT *, coalesce((bin - lag(bin) OVER w - 1) * {SIZE} > 0, false)::INT AS fresh FROM big WHERE scale > 0.7 WINDOW w AS (PARTITION BY chrom ORDER BY bin)),
regions AS (SELECT chrom, bin, s, e, least(reads, {SIZE}.0) AS reads, scale, chrom || ':' || (sum(fresh) OVER (PARTITION BY chrom ORDER BY bin))::BIGINT AS region FROM kept)"""


def ev_bins(spark, d) -> DataFrame:
    return binning.load_bins({"reads": ad.reads_events(spark, d)}, ad.chroms_events(spark), STEP, ad.dead_events(spark, d))


def ev_regions(spark, d) -> DataFrame:
    big = binning.rebin(ev_bins(spark, d), STEP, SIZE, ["reads"])
    return binning.cap_counts(binning.desert_regions(big, SIZE, 0, 0.3), SIZE, ["reads"])


# scans and projections


@query(f"WITH {ad.READS_EVENTS} SELECT chrom, s AS start, e AS \"end\", name, round(score, 6) AS score, strand FROM events_reads")
def bed_scan(spark, d):
    """Interval text, parsed: fields between blanks."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chrom", "start", "end", "name", "score", "strand")])
    lines = ad.reads_events(spark, d).select(line.alias("value")).select(F.split("value", r"\s+").alias("p"))
    return lines.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end"), F.col("p")[3].alias("name"), rounded(F.col("p")[4].cast("double")).alias("score"), F.col("p")[5].alias("strand"))


@query(f"WITH {ad.READS_EVENTS}, {DEDUP.format('events_reads')} SELECT chrom, s AS start, e AS \"end\", strand FROM ded")
def dedup_consecutive(spark, d):
    return binning.drop_consecutive(ad.reads_events(spark, d)).select("chrom", "start", "end", "strand")


@query(f"WITH {ad.READS_EVENTS} SELECT name, CASE WHEN strand = '+' THEN s + 100 ELSE e - 101 END AS pos FROM events_reads")
def fragment_center(spark, d):
    return ad.reads_events(spark, d).select("name", binning.fragment_centre(F.col("start"), F.col("end"), F.col("strand"), 200).alias("pos"))


@query(f"WITH {ad.CHROMS_EVENTS}, {EV_GRID} SELECT chrom, bin, bin * {STEP} AS start, (bin + 1) * {STEP} AS \"end\" FROM grid")
def tumbling_bins(spark, d):
    return binning.grid(ad.chroms_events(spark), STEP)


@query(f"WITH {EV}, {_bins_sql('events_reads', 'ev_chroms', 'cnt', STEP, 200)} SELECT * FROM cnt")
def bin_counts(spark, d):
    return binning.bin_counts(ad.reads_events(spark, d), ad.chroms_events(spark), STEP, 200)


@query(f"WITH {EV}, {COVER} SELECT * FROM cover")
def dead_coverage(spark, d):
    return binning.dead_coverage(ad.dead_events(spark, d), STEP)


@query(f"WITH {EV_BASE} SELECT chrom, bin, s AS start, e AS \"end\", reads, round(scale, 9) AS scale FROM base")
def load_bins(spark, d):
    return ev_bins(spark, d).withColumn("scale", rounded("scale", 9))


@query(f"WITH {EV_BASE} SELECT chrom, bin, s AS start, e AS \"end\", reads, round(scale, 9) AS scale FROM big")
def rebin(spark, d):
    return binning.rebin(ev_bins(spark, d), STEP, SIZE, ["reads"]).withColumn("scale", rounded("scale", 9))


@query(f"WITH {EV_BASE} SELECT chrom, bin, s AS start, e AS \"end\", reads, round(scale, 9) AS scale, region FROM regions")
def desert_regions(spark, d):
    return ev_regions(spark, d).withColumn("scale", rounded("scale", 9))


@query(f"WITH {EV_BASE} SELECT chrom, bin, least(reads, 12.0) AS reads FROM base")
def count_cap(spark, d):
    return binning.cap_counts(ev_bins(spark, d), 12, ["reads"]).select("chrom", "bin", "reads")


def _line_pair(spark, d) -> DataFrame:
    r = ad.reads_lineitem(spark, d)
    return binning.load_bins({"a": r.filter("sample = 'A'"), "b": r.filter("sample = 'B'")}, ad.chroms_lineitem(spark), LINE_SIZE)


LINE_PAIR = f"""{LI}, {_bins_sql("line_reads", "line_chroms", "ca", LINE_SIZE, 0, "WHERE sample = 'A'")}, {_bins_sql("line_reads", "line_chroms", "cb", LINE_SIZE, 0, "WHERE sample = 'B'")},
lgrid AS (SELECT chrom, unnest(range(0, ceil(width / {LINE_SIZE})::BIGINT)) AS bin FROM line_chroms),
pair AS (SELECT chrom, bin, coalesce(ca.n, 0)::DOUBLE AS a, coalesce(cb.n, 0)::DOUBLE AS b, coalesce(ca.n, 0)::DOUBLE - coalesce(cb.n, 0)::DOUBLE AS diff
  FROM lgrid LEFT JOIN ca USING (chrom, bin) LEFT JOIN cb USING (chrom, bin))"""


@query(f"WITH {LINE_PAIR} SELECT * FROM pair")
def two_sample_diff(spark, d):
    return _line_pair(spark, d).select("chrom", "bin", "a", "b", (F.col("a") - F.col("b")).alias("diff"))


@query(f"""WITH {EV_BASE}, nth AS (SELECT *, row_number() OVER (ORDER BY chrom, bin) AS i FROM regions) SELECT chrom, bin, reads FROM nth WHERE i <= 500""")
def training_prefix(spark, d):
    return binning.training_prefix(ev_regions(spark, d), 500).select("chrom", "bin", "reads")


# intervals

ORDER_SPANS = """a AS (SELECT o_orderstatus AS chrom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + o_orderkey % 10 AS s,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + o_orderkey % 10 + 3 + o_custkey % 7 AS e, o_orderkey AS id FROM orders),
b AS (SELECT o_orderstatus AS chrom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + o_custkey % 10 AS s,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 10 + o_custkey % 10 + 2 + o_orderkey % 9 AS e, o_orderkey AS id FROM orders)"""


def _spans(spark, d, which: int) -> DataFrame:
    """Two spans of every order."""
    o = ad.table(spark, d, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("long") * 10
    one, two = F.col("o_orderkey"), F.col("o_custkey")
    start, size = (day + one % 10, 3 + two % 7) if which == 0 else (day + two % 10, 2 + one % 9)
    return o.select(F.col("o_orderstatus").alias("chrom"), start.alias("start"), (start + size).alias("end"), one.alias("id"))


def _merge_sql(op: str) -> str:
    return f"""WITH {ORDER_SPANS}, m AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM a),
f AS (SELECT chrom, s, e, sum(CASE WHEN ahead IS NULL OR s {op} ahead THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT chrom, min(s) AS start, max(e) AS "end" FROM f GROUP BY chrom, i"""


@query(_merge_sql(">="))
def interval_merge(spark, d):
    return intervals.merge(_spans(spark, d, 0), touching=False, cell=1000)


@query(_merge_sql(">"))
def interval_merge_touching(spark, d):
    return intervals.merge(_spans(spark, d, 0), cell=300)


@query(_merge_sql(">"))
def interval_depth_union(spark, d):
    return intervals.merge_by_depth(_spans(spark, d, 0))


@query(f"WITH {ORDER_SPANS} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e")
def interval_overlap_join(spark, d):
    return intervals.overlap_join(_spans(spark, d, 0), _spans(spark, d, 1), 64).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(f'WITH {ORDER_SPANS} SELECT a.chrom, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e')
def interval_intersect(spark, d):
    return intervals.intersect(_spans(spark, d, 0), _spans(spark, d, 1), 64)


@query(f'WITH {ORDER_SPANS} SELECT chrom, s AS start, e AS "end", id FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)')
def interval_semi(spark, d):
    return intervals.semi(_spans(spark, d, 1), _spans(spark, d, 0), 64)


@query(f"WITH {ORDER_SPANS} SELECT b.id AS x_id, a.id AS big_id FROM b JOIN a ON a.chrom = b.chrom AND b.s >= a.s AND b.s < a.e")
def interval_assign(spark, d):
    return intervals.assign(_spans(spark, d, 1).drop("end"), _spans(spark, d, 0), 64).select(F.col("x.id").alias("x_id"), F.col("big.id").alias("big_id"))


@query(f"""WITH {ORDER_SPANS}, t AS (SELECT DISTINCT chrom, s FROM a),
c AS (SELECT b.chrom, b.id, b.s, (SELECT max(t.s) FROM t WHERE t.chrom = b.chrom AND t.s <= b.s) AS l, (SELECT min(t.s) FROM t WHERE t.chrom = b.chrom AND t.s > b.s) AS r FROM b)
SELECT id, CASE WHEN l IS NULL THEN r WHEN r IS NULL OR s - l <= r - s THEN l ELSE r END AS t_start FROM c""")
def interval_nearest(spark, d):
    return intervals.nearest(_spans(spark, d, 1), _spans(spark, d, 0)).select("id", "t_start")


@query("""SELECT n_name AS chrom, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def sync_chroms(spark, d):
    n = ad.table(spark, d, "nation")
    s = ad.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("chrom"), "s_suppkey")
    return intervals.sync_chroms(n.select(F.col("n_name").alias("chrom")), s).groupBy("chrom").agg(F.count("s_suppkey").alias("n"))


@query(f"""WITH {ORDER_SPANS} SELECT id, chrom || ':' || s || '-' || e AS name, chrom, s AS start, e AS "end" FROM a""")
def region_names(spark, d):
    named = _spans(spark, d, 0).select("id", intervals.region_name(F.col("chrom"), F.col("start"), F.col("end")).alias("name"))
    return named.select("id", "name", intervals.parse_region(F.col("name")).alias("r")).select("id", "name", "r.*")


# statistics


@query("""WITH o AS (SELECT *, sum(abs(s_acctbal)) OVER (ORDER BY s_acctbal DESC, s_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead, sum(abs(s_acctbal)) OVER () AS total FROM supplier)
SELECT s_suppkey, CASE WHEN coalesce(ahead, 0) < ceil(total / 2) THEN 1 ELSE 0 END AS top FROM o""")
def half_mass_split(spark, d):
    return stats.half_mass_split(ad.table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "top")


@query("""WITH o AS (SELECT s_suppkey, coalesce(sum(abs(s_acctbal)) OVER (ORDER BY s_acctbal DESC, s_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, ceil(sum(abs(s_acctbal)) OVER () / 3) AS third FROM supplier),
f AS (SELECT min(ahead) AS first FROM o WHERE ahead >= third) SELECT s_suppkey, CASE WHEN ahead < third THEN 0 WHEN ahead - first < third THEN 1 ELSE 2 END AS part FROM o, f""")
def third_mass_split(spark, d):
    return stats.third_mass_split(ad.table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "part")


@query("SELECT (SELECT list_sort(list(c_acctbal))[(floor(count(*) * 0.95 + 1e-9))::BIGINT + 1] FROM customer) AS cutoff")
def percentile_cutoff(spark, d):
    return spark.createDataFrame([(stats.percentile_cutoff(ad.table(spark, d, "customer"), "c_acctbal"),)], "cutoff double")


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS m, round((sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity)
  - (sum(l_extendedprice * l_quantity) / sum(l_quantity)) ** 2) * (sum(l_quantity) ** 2) / (sum(l_quantity) ** 2 - sum(l_quantity * l_quantity)), 0) AS v FROM lineitem GROUP BY 1""")
def weighted_moments(spark, d):
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    return ad.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean(x, w), 4).alias("m"), F.round(stats.weighted_variance(x, w), 0).alias("v"))


P_VALUES = "p AS (SELECT s_suppkey, ((s_suppkey * 7919) % 1000 + 1) / 1000.0::DOUBLE * ((s_suppkey % 10) / 10.0::DOUBLE + 0.001) AS p FROM supplier)"


def _p(spark, d):
    k = F.col("s_suppkey")
    return ad.table(spark, d, "supplier").select("s_suppkey", (((k * 7919) % 1000 + 1) / 1000.0 * ((k % 10) / 10.0 + 0.001)).alias("p"))


@query(f"""WITH {P_VALUES}, r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM p) SELECT s_suppkey, round(least(max(q) OVER (ORDER BY p), 1.0), 9) AS adjusted FROM r""")
def bh_adjust(spark, d):
    return stats.bh_adjust(_p(spark, d), "p").select("s_suppkey", rounded("adjusted", 9).alias("adjusted"))


@query(f"""WITH {P_VALUES}, r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM p) SELECT s_suppkey, round(least(min(q) OVER (ORDER BY p DESC), 1.0), 9) AS adjusted FROM r""")
def bh_standard(spark, d):
    return stats.bh_adjust(_p(spark, d), "p", standard=True).select("s_suppkey", rounded("adjusted", 9).alias("adjusted"))


@query(f"""WITH {P_VALUES}, r AS (SELECT p, rank() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT round(max(p), 12) AS cutoff FROM r WHERE p < coalesce((SELECT min(p) FROM r WHERE p >= 0.1 * k / n), 2)""")
def fdr_cutoff(spark, d):
    c = stats.fdr_cutoff(_p(spark, d), "p", 0.1)
    return spark.createDataFrame([(None if c is None else round(c, 12),)], "cutoff double")


@query(f"""WITH {EV_BASE}, t AS (SELECT chrom, bin * 7200.0 AS x FROM big), w AS (SELECT t.chrom, t.x, b.reads, 0.75 * (1 - ((b.s - t.x) / 9000.0) ** 2) AS k
  FROM t JOIN base b ON b.chrom = t.chrom AND b.s >= t.x - 9000 AND b.s < t.x + 9000)
SELECT chrom, x::DOUBLE AS x, round(sum(k * reads) / sum(k), 6) AS smooth FROM w GROUP BY ALL HAVING sum(k) > 0""")
def kernel_smooth(spark, d):
    b = ev_bins(spark, d)
    points = b.select("chrom", F.col("start").cast("double").alias("x"), F.col("reads").alias("y"))
    targets = binning.rebin(b, STEP, SIZE, ["reads"]).select("chrom", (F.col("bin") * 7200.0).alias("x"))
    return stats.smooth_points(points, targets, 9000.0).withColumn("smooth", rounded("smooth"))


@query(f"""WITH {EV_BASE}, w AS (SELECT a.chrom, a.bin, b.reads, 0.75 * (1 - ((b.bin - a.bin) / 4.0) ** 2) AS k FROM base a JOIN base b ON a.chrom = b.chrom AND b.bin >= a.bin - 4 AND b.bin < a.bin + 4)
SELECT chrom, bin, round(sum(k * reads) / sum(k), 6) AS smooth FROM w GROUP BY ALL""")
def kernel_smooth_index(spark, d):
    return stats.smooth_index(ev_bins(spark, d), 4, value="reads").select("chrom", "bin", rounded("smooth").alias("smooth"))


# bin size


def _size_sql(exponent: str, reference: str) -> str:
    return f"""WITH {EV_BASE}, t AS (SELECT {reference} / (sum(reads) / 1e7 * 2287968180.0 / ({STEP} * sum(scale))) ** ({exponent}) AS x FROM base)
SELECT least(greatest(ceil(x / 50.0 - 0.5) * 50, 100), 3000)::BIGINT AS size FROM t"""


@query(_size_sql("1.0 / 6", "600.0"))
def binsize_waterman(spark, d):
    b = ev_bins(spark, d).withColumn("scale", F.col("scale") * (STEP / 50))
    return spark.createDataFrame([(binsize.waterman(b, 50),)], "size long")


@query(_size_sql("1.0 / 3", "600.0"))
def binsize_hideaki(spark, d):
    b = ev_bins(spark, d).withColumn("scale", F.col("scale") * (STEP / 50))
    return spark.createDataFrame([(binsize.hideaki(b, 50),)], "size long")


@query(f"WITH {EV_BASE} SELECT chrom, round(avg(reads), 9) AS m, round(var_pop(reads), 9) AS v, round((2 * avg(reads) - var_pop(reads)) / {STEP}.0 ** 2, 12) AS cost FROM base GROUP BY chrom")
def mean_var_cost(spark, d):
    return ev_bins(spark, d).groupBy("chrom").agg(rounded(F.avg("reads"), 9).alias("m"), rounded(F.var_pop("reads"), 9).alias("v"), rounded((2 * F.avg("reads") - F.var_pop("reads")) / float(STEP) ** 2, 12).alias("cost"))


# likelihoods


def _ll(expr: str) -> str:
    return f"WITH {EV_BASE} SELECT chrom, bin, round({expr}, 6) AS ll FROM base WHERE scale > 0.5"


def _ll_query(spark, d, f):
    return ev_bins(spark, d).filter("scale > 0.5").select("chrom", "bin", rounded(f(F.col("reads"), F.col("scale"))).alias("ll"))


@query(_ll("-4.5 * scale + reads * ln(4.5 * scale) - lgamma(reads + 1)"))
def pois_loglik(spark, d):
    return _ll_query(spark, d, lambda k, s: fx.pois_ll(k, s, 4.5))


@query(_ll("-ln(4.5 * scale) - reads / (4.5 * scale)"))
def exp_loglik(spark, d):
    return _ll_query(spark, d, lambda k, s: fx.exp_ll(k, s, 4.5))


@query(_ll("lgamma(reads + 2.5) - lgamma(reads + 1) - lgamma(2.5) + 2.5 * ln(2.5 / (2.5 + 4.5 * scale)) + reads * ln(1 - 2.5 / (2.5 + 4.5 * scale))"))
def nbd_loglik(spark, d):
    return _ll_query(spark, d, lambda k, s: fx.nbd_ll(k, s, 4.5, 0.4))


@query(_ll("greatest(-0.5 * ((reads - 4.5 * scale) / (2.5 * scale)) ** 2 - ln(2.5 * scale) - 0.5 * ln(2 * pi()), -30.0)"))
def gauss_loglik(spark, d):
    return _ll_query(spark, d, lambda k, s: fx.gauss_ll(k, s, 4.5, 2.5))


DIFFS = f"{LINE_PAIR}, ks AS (SELECT DISTINCT diff FROM pair)"


@query(f"""WITH {DIFFS}, t AS (SELECT diff, unnest(range(0, 81)) AS m FROM ks), e AS (SELECT diff, (2 * m + abs(diff)) * ln(sqrt(3.0 * 2.0)) - lgamma(m + 1) - lgamma(m + abs(diff) + 1) AS x FROM t),
z AS (SELECT diff, max(x) AS top FROM e GROUP BY diff), y AS (SELECT e.diff, any_value(top) + ln(sum(exp(x - top))) AS i FROM e JOIN z USING (diff) GROUP BY e.diff)
SELECT diff, round(CASE WHEN abs(diff) > 120 THEN -40 ELSE -5.0 + diff / 2 * ln(1.5) + i END, 6) AS ll FROM y""")
def skellam_loglik(spark, d):
    ks = two_sample_diff(spark, d).select("diff").distinct()
    return ks.select("diff", rounded(fx.skellam_ll(F.col("diff"), F.lit(1.0), 3.0, 2.0)).alias("ll"))


@query(f"""WITH {DIFFS}, t AS (SELECT diff, unnest(range(0, 400)) AS n FROM ks), e AS (SELECT diff, n, n + diff AS m FROM t WHERE n + diff >= 0),
p AS (SELECT diff, lgamma(m + 2.0) - lgamma(m + 1) - lgamma(2.0) + 2.0 * ln(2.0 / 5.0) + m * ln(0.6) + lgamma(n + 4.0) - lgamma(n + 1) - lgamma(4.0) + 4.0 * ln(4.0 / 6.0) + n * ln(2.0 / 6.0) AS x FROM e)
SELECT diff, round(ln(sum(exp(x))), 6) AS ll FROM p GROUP BY diff""")
def nbdiff_loglik(spark, d):
    """Only distinct differences are evaluated."""
    from .functions.distributions import make

    dist = make("nbdiff 3 0.5 2 0.25")
    ks = two_sample_diff(spark, d).select("diff").distinct()
    return ks.mapInPandas(lambda it: (p.assign(ll=dist.log_likelihood(p["diff"].to_numpy(), 1.0).round(6)) for p in it), "diff double, ll double")


# hidden Markov models with fixed parameters

TWO = segment.fixed_model(["pois 9", "pois 3.5"], [0.9, 0.95])
THREE = segment.fixed_model(["skel 6 3", "skel 4 4", "skel 3 6"], [0.9, 0.95, 0.9])


def _pois(rate: float) -> str:
    return f"(-{rate} * scale + reads * ln({rate} * scale) - lgamma(reads + 1))"


HMM_BASE = f"""{EV_BASE}, obs AS (SELECT region, chrom, bin, s, e, reads, scale, row_number() OVER (PARTITION BY region ORDER BY bin) AS t, count(*) OVER (PARTITION BY region) AS len, {_pois(9.0)} AS l0, {_pois(3.5)} AS l1 FROM regions)"""
VITERBI = f"""{HMM_BASE},
v AS (SELECT region, t, len, ln(0.5) + l0 AS v0, ln(0.5) + l1 AS v1, -1 AS b0, -1 AS b1 FROM obs WHERE t = 1 UNION ALL
  SELECT o.region, o.t, o.len, greatest(v.v0 + ln(0.9), v.v1 + ln(1 - 0.95)) + l0, greatest(v.v0 + ln(1 - 0.9), v.v1 + ln(0.95)) + l1,
    CASE WHEN v.v1 + ln(1 - 0.95) >= v.v0 + ln(0.9) THEN 1 ELSE 0 END, CASE WHEN v.v1 + ln(0.95) >= v.v0 + ln(1 - 0.9) THEN 1 ELSE 0 END FROM v JOIN obs o ON o.region = v.region AND o.t = v.t + 1),
back AS (SELECT region, t, CASE WHEN v1 >= v0 THEN 1 ELSE 0 END AS state FROM v WHERE t = len UNION ALL
  SELECT v.region, v.t - 1, CASE WHEN back.state = 0 THEN v.b0 ELSE v.b1 END FROM back JOIN v ON v.region = back.region AND v.t = back.t WHERE back.t > 1),
dec AS (SELECT o.*, back.state FROM obs o JOIN back USING (region, t))"""
SCALED = f"""{HMM_BASE},
f AS (SELECT region, t, len, exp(l0 - greatest(l0, l1)) * 0.5 AS a0, exp(l1 - greatest(l0, l1)) * 0.5 AS a1, greatest(l0, l1) AS c FROM obs WHERE t = 1 UNION ALL
  SELECT o.region, o.t, o.len, (a0 * 0.9 + a1 * 0.05) / (a0 + a1) * exp(l0 - greatest(l0, l1)), (a0 * 0.1 + a1 * 0.95) / (a0 + a1) * exp(l1 - greatest(l0, l1)), f.c + ln(a0 + a1) + greatest(l0, l1)
  FROM f JOIN obs o ON o.region = f.region AND o.t = f.t + 1),
g AS (SELECT region, t, 0.5::DOUBLE AS b0, 0.5::DOUBLE AS b1 FROM obs WHERE t = len UNION ALL
  SELECT g.region, g.t - 1, x0 / (x0 + x1), x1 / (x0 + x1) FROM (SELECT g.region, g.t, 0.9 * exp(l0 - greatest(l0, l1)) * b0 + 0.1 * exp(l1 - greatest(l0, l1)) * b1 AS x0,
    0.05 * exp(l0 - greatest(l0, l1)) * b0 + 0.95 * exp(l1 - greatest(l0, l1)) * b1 AS x1 FROM g JOIN obs o ON o.region = g.region AND o.t = g.t WHERE g.t > 1) g),
post AS (SELECT o.*, f.a0 * g.b0 / (f.a0 * g.b0 + f.a1 * g.b1) AS p0 FROM obs o JOIN f USING (region, t) JOIN g USING (region, t))"""


def _decoded(spark, d, posterior: bool = False) -> DataFrame:
    return hmm.decode(ev_regions(spark, d), TWO, "reads", posterior)


@query(f"WITH RECURSIVE {SCALED} SELECT round(sum(c + ln(a0 + a1) + ln(1e-10)), 4) AS ll FROM f WHERE t = len")
def forward_ll(spark, d):
    """Null if there are no bins."""
    total = hmm.expectations(ev_regions(spark, d), TWO, "reads", None)[2]
    return spark.createDataFrame([(None if math.isnan(total) else round(total, 4),)], "ll double")


@query(f"WITH RECURSIVE {SCALED} SELECT chrom, bin, round(p0, 6) AS p FROM post")
def posterior_state(spark, d):
    return _decoded(spark, d).select("chrom", "bin", rounded(F.col("p")[0]).alias("p"))


@query(f"WITH RECURSIVE {SCALED} SELECT chrom, bin, CASE WHEN p0 > 0.5 THEN 0 ELSE 1 END AS state FROM post")
def posterior_decode(spark, d):
    return _decoded(spark, d, True).select("chrom", "bin", "state")


@query(f"""WITH RECURSIVE {SCALED}, n AS (SELECT o.region, o.t, o.chrom, o.bin, lag(a0 / (a0 + a1)) OVER w AS q0, lag(a1 / (a0 + a1)) OVER w AS q1, exp(l0 - greatest(l0, l1)) * b0 AS y0, exp(l1 - greatest(l0, l1)) * b1 AS y1
  FROM obs o JOIN f USING (region, t) JOIN g USING (region, t) WINDOW w AS (PARTITION BY o.region ORDER BY o.t)),
z AS (SELECT *, q0 * 0.9 * y0 + q0 * 0.1 * y1 + q1 * 0.05 * y0 + q1 * 0.95 * y1 AS total FROM n)
SELECT chrom, bin, round(coalesce(q1 * 0.05 * y0 / total, 0), 6) AS enter, round(coalesce(q0 * 0.1 * y1 / total, 0), 6) AS leave FROM z""")
def transition_posterior(spark, d):
    return _decoded(spark, d).select("chrom", "bin", rounded(F.col("moves")[2]).alias("enter"), rounded(F.col("moves")[1]).alias("leave"))


@query(f"WITH RECURSIVE {VITERBI} SELECT chrom, bin, state FROM dec")
def viterbi_2s(spark, d):
    return _decoded(spark, d).select("chrom", "bin", "state")


# differences of two samples with planted domains; rates follow the samples' means, so that every size has some

PAIR = f"""{ad.READS_PLANTED}, {ad.CHROMS_PLANTED}, {_bins_sql("planted", "planted_chroms", "ca", LINE_SIZE, 0, "WHERE sample = 'A'")}, {_bins_sql("planted", "planted_chroms", "cb", LINE_SIZE, 0, "WHERE sample = 'B'")},
lgrid AS (SELECT chrom, unnest(range(0, ceil(width / {LINE_SIZE})::BIGINT)) AS bin FROM planted_chroms),
pairs AS (SELECT chrom, bin, least(coalesce(ca.n, 0), {LINE_SIZE})::DOUBLE AS a, least(coalesce(cb.n, 0), {LINE_SIZE})::DOUBLE AS b FROM lgrid LEFT JOIN ca USING (chrom, bin) LEFT JOIN cb USING (chrom, bin)),
means AS (SELECT avg(a) AS ma, avg(b) AS mb FROM pairs)"""


def _skellam_sql(rates: list[tuple[float, float]]) -> str:
    """regions of the pair with the log-likelihood under each state (e0...), and pmf, its table over all whole numbers that matter."""
    states = " UNION ALL ".join(f"SELECT {i} AS st, {u} * ma AS u, {v} * mb AS v FROM means" for i, (u, v) in enumerate(rates))
    joins = " ".join(f"JOIN pmf m{i} ON m{i}.st = {i} AND m{i}.d = a - b" for i in range(len(rates)))
    return f"""states AS ({states}), ks AS (SELECT unnest(range(-500, 501)) AS d),
bes AS (SELECT st, d, (2 * m + abs(d)) * ln(sqrt(u * v)) - lgamma(m + 1) - lgamma(m + abs(d) + 1) AS x FROM states, ks, (SELECT unnest(range(0, 400)) AS m) WHERE abs(d) <= 120),
beo AS (SELECT st, d, max(x) AS top FROM bes GROUP BY ALL),
bei AS (SELECT bes.st, bes.d, any_value(top) + ln(sum(exp(x - top))) AS i FROM bes JOIN beo USING (st, d) GROUP BY ALL),
pmf AS (SELECT st, d, coalesce(-(u + v) + d / 2 * ln(u / v) + i, -40.0) AS ll FROM states CROSS JOIN ks LEFT JOIN bei USING (st, d)),
cdf AS (SELECT st, d, least(sum(exp(ll)) OVER (PARTITION BY st ORDER BY d), 1.0) AS f FROM pmf),
regions AS (SELECT chrom || ':0' AS region, chrom, bin, bin * {LINE_SIZE} AS s, (bin + 1) * {LINE_SIZE} AS e, a, b, a - b AS diff, 1.0::DOUBLE AS scale, {", ".join(f"m{i}.ll AS e{i}" for i in range(len(rates)))} FROM pairs {joins})"""


#: Rates as multiples of the means of either sample, per state.
CONTROL_RATES = [(1.8, 0.8), (0.7, 1.1)]
THREE_RATES = [(1.8, 0.7), (0.7, 0.7), (0.7, 1.8)]
CONTROL_STAY, THREE_STAY = [0.85, 0.95], [0.85, 0.92, 0.85]


def _trans(stay: list[float]) -> list[list[float]]:
    return segment.fixed_model(["pois 1"] * len(stay), stay).trans.tolist()


CONTROL_SQL = f"{PAIR}, {_skellam_sql(CONTROL_RATES)}, {model_sql.recursions(['e0', 'e1'], _trans(CONTROL_STAY))}"
THREE_SQL = f"{PAIR}, {_skellam_sql(THREE_RATES)}, {model_sql.recursions(['e0', 'e1', 'e2'], _trans(THREE_STAY))}"


def _planted_pair(spark, d) -> DataFrame:
    r = ad.reads_planted(spark, d)
    b = binning.load_bins({"a": r.filter("sample = 'A'"), "b": r.filter("sample = 'B'")}, ad.chroms_planted(spark), LINE_SIZE)
    b = binning.cap_counts(binning.desert_regions(b, LINE_SIZE, 5000), LINE_SIZE, ["a", "b"])
    return b.withColumn("diff", F.col("a") - F.col("b"))


def _pair_model(bins: DataFrame, rates, stay) -> hmm.Model:
    ma, mb = bins.agg(F.avg("a"), F.avg("b")).first()
    return segment.fixed_model([f"skel {u * ma} {v * mb}" for u, v in rates], stay)


@query(f"WITH RECURSIVE {THREE_SQL}, {model_sql.decoded(_trans(THREE_STAY))} SELECT chrom, bin, state FROM dec")
def viterbi_3s(spark, d):
    """Differences of two samples decoded into three states."""
    bins = _planted_pair(spark, d)
    return hmm.decode(bins, _pair_model(bins, THREE_RATES, THREE_STAY), "diff").select("chrom", "bin", "state")


def _step_rows(spark, step: tuple, n: int) -> DataFrame:
    """Parameters after one training step, by name; null if there were no bins."""
    model, total = step
    rows = [(f"p{i}{j}", v) for i, e in enumerate(model.emissions) for j, v in enumerate(e.params)]
    rows += [(f"t{i}{j}", float(model.trans[i, j])) for i in range(n) for j in range(n)]
    return spark.createDataFrame([(k, None if math.isnan(v) else round(float(v), 7)) for k, v in rows], "name string, value double")


def _step_sql(params: list[tuple[str, str]], n: int, less) -> str:
    named = [*params, *[(f"t{i}{j}", f"(SELECT sum(x{i}{j}) / sum({' + '.join(f'x{i}{q}' for q in range(n))}) - {less(i, j)} FROM xi)") for i in range(n) for j in range(n)]]
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round({v}, 7) AS value" for k, v in named)


TWO_SQL = f"{EV_BASE}, {model_sql.recursions([_pois(9.0), _pois(3.5)], [[0.9, 0.1], [0.05, 0.95]])}"
TWO_DECODED = f"{TWO_SQL}, {model_sql.decoded([[0.9, 0.1], [0.05, 0.95]])}"
TRIPLE = segment.fixed_model(["pois 9", "pois 5", "pois 2"], [0.9, 0.9, 0.9])
TRIPLE_SQL = f"{EV_BASE}, {model_sql.recursions([_pois(9.0), _pois(5.0), _pois(2.0)], TRIPLE.trans.tolist())}, {model_sql.decoded(TRIPLE.trans.tolist())}"


@query(f"WITH RECURSIVE {TWO_SQL} " + _step_sql([(f"p{i}0", f"(SELECT sum(p{i} * reads) / sum(p{i} * scale) FROM post)") for i in range(2)], 2, lambda i, j: 5e-11))
def em_step_single(spark, d):
    """One Baum-Welch step of one sample."""
    return _step_rows(spark, hmm.em_step(ev_regions(spark, d), TWO), 2)


_PAIR_FITS = [(f"p{i}{j}", f"(SELECT sum(p{i} * {c}) / sum(p{i} * scale) FROM post)") for i in range(3) for j, c in enumerate("ab")]


@query(f"WITH RECURSIVE {CONTROL_SQL} " + _step_sql(_PAIR_FITS[:4], 2, lambda i, j: 1e-10 if j == 1 else 0))
def em_step_control(spark, d):
    """One Baum-Welch step of a sample against its control."""
    bins = _planted_pair(spark, d)
    return _step_rows(spark, hmm.em_step(bins, _pair_model(bins, CONTROL_RATES, CONTROL_STAY), "diff", ("a", "b")), 2)


@query(f"WITH RECURSIVE {THREE_SQL} " + _step_sql(_PAIR_FITS, 3, lambda i, j: 0))
def em_step_three(spark, d):
    """One Baum-Welch step of two samples in three states."""
    bins = _planted_pair(spark, d)
    return _step_rows(spark, hmm.em_step(bins, _pair_model(bins, THREE_RATES, THREE_STAY), "diff", ("a", "b")), 3)


@query(f"WITH RECURSIVE {TRIPLE_SQL} SELECT chrom, bin, round(p0, 6) AS p0, round(p1, 6) AS p1, state FROM post JOIN (SELECT region, t, state FROM dec) USING (region, t)")
def posterior_three(spark, d):
    p = F.col("p")
    return hmm.decode(ev_regions(spark, d), TRIPLE).select("chrom", "bin", rounded(p[0]).alias("p0"), rounded(p[1]).alias("p1"), "state")


@query(f"WITH RECURSIVE {TWO_DECODED}, {model_sql.scored(2)} SELECT chrom, bin, round(score, 6) AS score FROM sco")
def boundary_scores(spark, d):
    return boundaries.boundary_scores(_decoded(spark, d)).select("chrom", "bin", rounded("score").alias("score"))


def _told(found: DataFrame) -> DataFrame:
    return found.withColumn("bins", F.col("bins").cast("long")).withColumns({"peak_score": rounded("peak_score"), "p": rounded("p")})


_BOUNDARY = 'chrom, start, "end", bins, peak, round(peak_score, 6) AS peak_score, round(p, 6) AS p'


@query(f"WITH RECURSIVE {TWO_DECODED}, {model_sql.scored(2)}, {model_sql.boundaries(2, 0.05)} SELECT {_BOUNDARY} FROM bou")
def boundaries_both_ends(spark, d):
    """Intervals at either end of enriched domains that have one at both."""
    return _told(boundaries.boundaries(boundaries.boundary_scores(_decoded(spark, d)), 0.05))


@query(f"WITH RECURSIVE {TRIPLE_SQL}, {model_sql.scored(3)}, {model_sql.boundaries(3, 0.1)} SELECT {_BOUNDARY} FROM bou")
def boundaries_three_state(spark, d):
    """Intervals at every change of three states, and at regions' ends."""
    scored = boundaries.boundary_scores(hmm.decode(ev_regions(spark, d), TRIPLE), 3)
    return _told(boundaries.boundaries(scored, 0.1, 3))


RUNS = f"""{VITERBI}, turn AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY region ORDER BY bin) THEN 1 ELSE 0 END AS turn FROM dec),
run AS (SELECT *, sum(turn) OVER (PARTITION BY region ORDER BY bin)::BIGINT AS run FROM turn)"""


@query(f'WITH RECURSIVE {RUNS} SELECT region, run, any_value(state) AS state, min(s) AS start, max(e) AS "end", count(*) AS n FROM run GROUP BY region, run')
def class_runs(spark, d):
    r = domains.runs(_decoded(spark, d))
    return r.groupBy("region", "run").agg(F.first("state").alias("state"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


LABELLED = f"""{SCALED}, {VITERBI[len(HMM_BASE) + 2 :]}, sc AS (SELECT dec.*, round(CASE WHEN state = 0 THEN p0 ELSE 1 - p0 END, 9) AS score FROM dec JOIN post USING (region, t)),
r1 AS (SELECT *, sum(turn) OVER (PARTITION BY region ORDER BY bin) AS run FROM (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY region ORDER BY bin) THEN 1 ELSE 0 END AS turn FROM sc)),
r2 AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY region, run) >= 0.98 THEN state ELSE -1 END AS f FROM r1),
r3 AS (SELECT *, sum(turn2) OVER (PARTITION BY region ORDER BY bin) AS stretch FROM (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY region ORDER BY bin) THEN 1 ELSE 0 END AS turn2 FROM r2)),
st AS (SELECT region, stretch, f, min(s) AS s, max(e) AS e, sum((state = 0)::INT) AS v0, sum((state = 1)::INT) AS v1 FROM r3 GROUP BY ALL),
st2 AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r FROM st WINDOW w AS (PARTITION BY region ORDER BY stretch)),
named AS (SELECT region, stretch, CASE WHEN f >= 0 THEN f WHEN e - s > 20000 THEN -1 WHEN l = r THEN l WHEN 2 * v0 >= v0 + v1 THEN 0 ELSE 1 END AS label FROM st2),
lab AS (SELECT r3.*, label, CASE WHEN label < 0 OR label = state THEN score ELSE 1 - score END AS local FROM r3 JOIN named USING (region, stretch)),
r4 AS (SELECT *, sum(t4) OVER (PARTITION BY region ORDER BY bin) AS island FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY region ORDER BY bin) THEN 1 ELSE 0 END AS t4 FROM lab)),
dom AS (SELECT region, island, chrom, label, min(s) AS start, max(e) AS "end", sum(reads) / sum(scale) AS mean, sum(local) AS score, count(*) AS n FROM r4 GROUP BY region, island, chrom, label)"""


def _labelled(spark, d) -> DataFrame:
    scored = _decoded(spark, d).withColumn("score", rounded(F.element_at("p", F.col("state") + 1), 9))
    return domains.label(scored, "score", 0.98, 20_000)


@query(f"WITH RECURSIVE {LABELLED} SELECT chrom, bin, label, round(local, 6) AS local FROM lab")
def domain_labels(spark, d):
    return _labelled(spark, d).select("chrom", "bin", "label", rounded("local").alias("local"))


@query(f'WITH RECURSIVE {LABELLED} SELECT region, label, start, "end", round(mean, 6) AS mean, round(score, 5) AS score, n FROM dom')
def domains_all(spark, d):
    return domains.build(_labelled(spark, d)).select("region", "label", "start", "end", rounded("mean").alias("mean"), rounded("score", 5).alias("score"), "n")


@query(f"""WITH RECURSIVE {LABELLED}, cdf AS (SELECT k, sum(exp(-9.0 + k * ln(9.0) - lgamma(k + 1))) OVER (ORDER BY k) AS f FROM (SELECT unnest(range(0, 400)) AS k))
SELECT chrom, start, "end", 'ENRICHED' AS state, round(mean, 6) AS mean, round(score, 5) AS score FROM dom JOIN cdf ON k = floor(mean) WHERE label = 0 AND f >= 0.1""")
def domain_filter_cdf(spark, d):
    built = domains.build(_labelled(spark, d))
    return domains.filter_two(built, TWO.emissions[0], 0.1, 0, 400).select("chrom", "start", "end", "state", rounded("mean").alias("mean"), rounded("score", 5).alias("score"))


@query(f"""WITH RECURSIVE {RUNS}, c AS (SELECT region, t, state FROM run WHERE turn = 1 AND t > 1),
n AS (SELECT r.region, r.chrom, r.bin, (SELECT state FROM c WHERE c.region = r.region ORDER BY abs(c.t - r.t), c.t LIMIT 1) AS change FROM run r) SELECT chrom, bin, change FROM n""")
def boundary_nearest(spark, d):
    return boundaries.nearest_change(_decoded(spark, d)).select("chrom", "bin", "change")


@query(f"WITH RECURSIVE {TWO_DECODED}, {model_sql.scored(2)}, {model_sql.boundaries(2, 0.05, islands=True)} SELECT {_BOUNDARY} FROM bou")
def boundary_islands(spark, d):
    """Islands of high transition posteriors around a change, with the support of a single one."""
    return _told(boundaries.boundary_islands(boundaries.boundary_scores(_decoded(spark, d)), 0.05))


# whole programs: with parameters from the data's means, which SQL can follow, and trained


SINGLE = f"""{ad.READS_PLANTED}, {ad.CHROMS_PLANTED}, {_bins_sql("planted", "planted_chroms", "c1", LINE_SIZE)},
lgrid AS (SELECT chrom, unnest(range(0, ceil(width / {LINE_SIZE})::BIGINT)) AS bin FROM planted_chroms),
ones AS (SELECT chrom, bin, least(coalesce(n, 0), {LINE_SIZE})::DOUBLE AS reads FROM lgrid LEFT JOIN c1 USING (chrom, bin)), mean AS (SELECT avg(reads) AS m FROM ones),
regions AS (SELECT chrom || ':0' AS region, chrom, bin, bin * {LINE_SIZE} AS s, (bin + 1) * {LINE_SIZE} AS e, reads, m, 1.0::DOUBLE AS scale FROM ones, mean),
{model_sql.recursions([f"(-{r} * m + reads * ln({r} * m) - lgamma(reads + 1))" for r in (1.5, 0.75)], _trans(CONTROL_STAY))}, {model_sql.decoded(_trans(CONTROL_STAY))}, {model_sql.domains(2, "reads", 0.95, 3000)}"""
_DOMAIN = 'chrom, start, "end", state, round(mean, 6) AS mean, round(score, 5) AS score, n'


def _line_settings(**more) -> segment.Settings:
    return segment.Settings(bin_step=LINE_STEP, bin_size=LINE_SIZE, domain_size=5000, desert=5000, **more)


def _domains(found: DataFrame) -> DataFrame:
    return found.select("chrom", "start", "end", "state", rounded("mean").alias("mean"), rounded("score", 5).alias("score"), "n")


@query(f"""WITH RECURSIVE {SINGLE}, cdf AS (SELECT k, sum(exp(-1.5 * m + k * ln(1.5 * m) - lgamma(k + 1))) OVER (ORDER BY k) AS f FROM (SELECT unnest(range(0, {LINE_SIZE} + 1)) AS k), mean)
SELECT {_DOMAIN} FROM (SELECT *, 'ENRICHED' AS state FROM dom JOIN cdf ON k = floor(mean) WHERE label = 0 AND f >= 0.1)""")
def domains_single(spark, d):
    """Domains in which one sample is enriched."""
    r, chroms = ad.reads_planted(spark, d), ad.chroms_planted(spark)
    m = binning.cap_counts(binning.load_bins({"reads": r}, chroms, LINE_SIZE), LINE_SIZE, ["reads"]).agg(F.avg("reads")).first()[0]
    return _domains(segment.segment(r, chroms, _line_settings(), model=segment.fixed_model([f"pois {1.5 * m}", f"pois {0.75 * m}"], CONTROL_STAY)).domains)


def _pair_domains(spark, d, rates, stay, mode: int) -> DataFrame:
    r, bins = ad.reads_planted(spark, d), _planted_pair(spark, d)
    s = _line_settings(posterior_cutoff=0.5)
    return _domains(segment.segment_pair(r.filter("sample = 'A'"), r.filter("sample = 'B'"), ad.chroms_planted(spark), s, model=_pair_model(bins, rates, stay), mode=mode).domains)


@query(f"""WITH RECURSIVE {CONTROL_SQL}, {model_sql.decoded(_trans(CONTROL_STAY))}, {model_sql.domains(2, "diff", 0.5, 3000)}
SELECT {_DOMAIN} FROM (SELECT dom.*, 'ENRICHED' AS state FROM dom JOIN cdf ON st = 0 AND d = floor(mean) WHERE label = 0 AND f >= 0.1)""")
def domains_control(spark, d):
    """Domains in which a sample exceeds its control."""
    return _pair_domains(spark, d, CONTROL_RATES, CONTROL_STAY, 2)


@query(f"""WITH RECURSIVE {THREE_SQL}, {model_sql.decoded(_trans(THREE_STAY))}, {model_sql.domains(3, "diff", 0.5, 3000)},
sided AS (SELECT dom.* EXCLUDE (label), CASE WHEN label = 0 AND ceil(mean) < b.u - b.v THEN 2 WHEN label = 2 AND floor(mean) > a.u - a.v THEN 0 ELSE label END AS label FROM dom, states a, states b WHERE a.st = 0 AND b.st = 2)
SELECT {_DOMAIN} FROM (SELECT sided.*, CASE label WHEN 0 THEN 'SAMPLE-I-ENRICHED' ELSE 'SAMPLE-II-ENRICHED' END AS state FROM sided JOIN cdf ON st = label AND d = CASE label WHEN 0 THEN floor(mean) ELSE ceil(mean) END
  WHERE label IN (0, 2) AND CASE label WHEN 0 THEN f ELSE 1 - f END >= 0.1)""")
def domains_two_samples(spark, d):
    """Domains in which either sample exceeds the other."""
    return _pair_domains(spark, d, THREE_RATES, THREE_STAY, 3)


@query()
def trained_single(spark, d):
    """One sample with a trained model; pytest compares with what is planted."""
    return segment.segment(ad.reads_planted(spark, d), ad.chroms_planted(spark), _line_settings(max_iterations=5)).domains


@query()
def trained_control(spark, d):
    r = ad.reads_planted(spark, d)
    s = _line_settings(max_iterations=3, posterior_cutoff=0.5, foreground="skel", background="skel")
    return segment.segment_pair(r.filter("sample = 'A'"), r.filter("sample = 'B'"), ad.chroms_planted(spark), s).domains


@query()
def trained_two_samples(spark, d):
    r = ad.reads_planted(spark, d)
    s = _line_settings(max_iterations=3, posterior_cutoff=0.5, foreground="nbdiff", background="nbdiff")
    return segment.segment_pair(r.filter("sample = 'A'"), r.filter("sample = 'B'"), ad.chroms_planted(spark), s, mode=3).domains


# sequences

K = 9
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
KMERS = f"""{ad.SEQS}, w AS (SELECT name, pos, substr(seq, pos::INT + 1, {K}) AS k FROM (SELECT name, seq, unnest(range(0, length(seq) - {K} + 1)) AS pos FROM seqs)),
km AS (SELECT name, pos, k AS kmer FROM w UNION ALL SELECT name, pos, {RC.format("k")} FROM w),
ok AS (SELECT * FROM km WHERE regexp_matches(substr(kmer, 1, 5), '^[ACGT]{{5}}$')),
dup AS (SELECT kmer FROM ok GROUP BY kmer HAVING count(*) > 1),
amb AS (SELECT DISTINCT name, pos::BIGINT AS pos FROM ok SEMI JOIN dup USING (kmer))"""


@query(f"WITH {KMERS} SELECT name, pos FROM amb")
def kmer_duplicates(spark, d):
    return kmers.duplicate_positions(ad.seqs(spark, d), K)


N_RUNS = """nr AS (SELECT name, i, min(p) AS s, max(p) + 1 AS e FROM (SELECT name, p, p - row_number() OVER (PARTITION BY name ORDER BY p) AS i FROM (SELECT name, seq, unnest(range(0, length(seq))) AS p FROM seqs)
  WHERE substr(seq, p::INT + 1, 1) = 'N') GROUP BY name, i HAVING count(*) >= 2)"""


@query(f'WITH {ad.SEQS}, {N_RUNS} SELECT name AS chrom, s AS start, e AS "end" FROM nr')
def n_runs(spark, d):
    return kmers.gap_runs(ad.seqs(spark, d), 2)


@query(f"""WITH {KMERS}, {N_RUNS}, pr AS (SELECT name, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT name, pos, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS i FROM amb) GROUP BY name, i),
u AS (SELECT name, s, e FROM pr UNION ALL SELECT name, s, e FROM nr), m AS (SELECT *, max(e) OVER (PARTITION BY name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM u),
f AS (SELECT *, sum(CASE WHEN a IS NULL OR s > a THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT name AS chrom, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM f GROUP BY name, i""")
def deadzones(spark, d):
    return kmers.dead_zones(ad.seqs(spark, d), K, 5, 2)


@query(f"WITH {ad.SEQS} SELECT name, {RC.format('seq')} AS seq FROM seqs")
def revcomp(spark, d):
    return ad.seqs(spark, d).select("name", fx.reverse_complement(F.col("seq")).alias("seq"))


@query(f"""WITH {ad.SEQS}, k AS (SELECT name, regexp_extract(seq, '[ACGT]{{4}}') AS kmer FROM seqs)
SELECT name, kmer, list_sum([(strpos('ACGT', substr(kmer, i::INT, 1)) - 1) * 4 ** (4 - i) FOR i IN range(1, 5)])::BIGINT AS idx FROM k WHERE kmer <> ''""")
def kmer_index(spark, d):
    k = ad.seqs(spark, d).select("name", F.regexp_extract("seq", "([ACGT]{4})", 1).alias("kmer")).withColumn("idx", fx.kmer_index(F.col("kmer"))).filter("idx IS NOT NULL")
    return k.filter(fx.index_kmer(F.col("idx"), 4) == F.col("kmer"))


@query(f"""WITH {ad.SEQS} SELECT name, substr(seq, (6 + name::INT % 7)::INT, 12) AS fwd, {RC.format("substr(seq, (6 + name::INT % 7)::INT, 12)")} AS rev FROM seqs""")
def extract_sequences(spark, d):
    """Bases under regions, complemented on the other strand."""
    s = ad.seqs(spark, d)
    start = (5 + F.col("name").cast("int") % 7).cast("long")
    regions = s.select(F.col("name").alias("chrom"), start.alias("start"), (start + 12).alias("end"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    got = text.extract_sequences(regions, s)
    one = lambda x: F.max(F.when(F.col("strand") == x, F.col("seq")))
    return got.groupBy(F.col("chrom").alias("name")).agg(one("+").alias("fwd"), one("-").alias("rev"))


@query(f"WITH {ad.SEQS} SELECT name, seq AS called FROM seqs")
def base_calls(spark, d):
    """Bases to error probabilities and back."""
    return ad.seqs(spark, d).select("name", fx.call_bases(fx.error_matrix(F.col("seq"))).alias("called"))


# alignments made of lineitem: five kinds of cigar, bases and qualities by hashes of the names; the references are letters of hashes of orders

_OPS = [
    "[{'op': 'M', 'n': q}, {'op': 'D', 'n': 2}, {'op': 'M', 'n': 5}, {'op': 'I', 'n': 3}, {'op': 'S', 'n': 4}]",
    "[{'op': 'S', 'n': 4}, {'op': 'M', 'n': q}, {'op': 'I', 'n': 3}, {'op': 'M', 'n': 5}]",
    "[{'op': 'M', 'n': q + 12}]",
    "[{'op': 'H', 'n': 2}, {'op': 'S', 'n': 3}, {'op': 'M', 'n': q}, {'op': 'N', 'n': 7}, {'op': 'M', 'n': 9}]",
    "[{'op': 'M', 'n': q}, {'op': 'I', 'n': 1}, {'op': 'M', 'n': 6}, {'op': 'D', 'n': 1}, {'op': 'M', 'n': 5}]",
]
_CIGARS = [("", "M2D5M3I4S"), ("4S", "M3I5M"), (None, "M"), ("2H3S", "M7N9M"), ("", "M1I6M1D5M")]
HEX, BASES, QUALITIES = "0123456789abcdef", "AAAAAAAACCGGGTTN", "#&),/258;>ADFGHI"
#: Letters of a reference that one order gives.
PER_ORDER = 16
SAM = f"""sam0 AS (SELECT 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || l_quantity::INT AS qname, ((l_suppkey * 37 + l_partkey) % 2048)::INT AS flag, l_returnflag || l_linestatus AS rname,
  (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10 + l_linenumber)::INT AS pos, (l_partkey % 61)::INT AS mapq, l_quantity::INT AS q, l_partkey % 5 AS kind,
  CASE l_suppkey % 3 WHEN 0 THEN '=' WHEN 1 THEN 'XX' ELSE l_returnflag || l_linestatus END AS rnext FROM lineitem),
sam AS (SELECT *, substr(translate(md5(qname) || md5(qname || 'x'), '{HEX}', '{BASES}'), 1, q + 12) AS seq, substr(translate(md5(qname || 'q') || md5(qname || 'r'), '{HEX}', '{QUALITIES}'), 1, q + 12) AS qual,
  CASE kind {" ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(_OPS))} END AS ops FROM sam0)"""
#: Operations with what moves along the reference (x) and the read (y) ahead of each; spans of whole alignments.
OPS = """ops AS (SELECT *, sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER w::BIGINT - CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END AS x,
  sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w::BIGINT - CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END AS y
  FROM (SELECT qname, i, o.op AS op, o.n AS n FROM (SELECT qname, unnest(range(1, len(ops) + 1)) AS i, unnest(ops) AS o FROM sam)) WINDOW w AS (PARTITION BY qname ORDER BY i)),
spans AS (SELECT qname, sum(n) FILTER (op IN ('M', 'D', 'N'))::BIGINT AS span FROM ops GROUP BY qname),
cols AS (SELECT qname, rname, flag, mapq, pos + x + k AS p, (y + k)::INT AS z, seq, qual FROM (SELECT ops.*, unnest(range(0, n)) AS k FROM ops WHERE op = 'M') JOIN sam USING (qname))"""
REFERENCE = f"""refs AS (SELECT n AS rname, (o_orderkey - (SELECT min(o_orderkey) FROM orders)) * {PER_ORDER} + k AS p, substr(translate(md5(n || o_orderkey || o_orderstatus), '{HEX}', '{BASES}'), k::INT + 1, 1) AS c
  FROM orders, (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO']) AS n), (SELECT unnest(range(0, {PER_ORDER})) AS k))"""


def sam_lineitem(spark, d) -> DataFrame:
    li = ad.table(spark, d, "lineitem")
    pos = (F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")) * 10 + F.col("l_linenumber")).cast("int")
    q, kind = F.col("l_quantity").cast("int"), F.col("l_partkey") % 5
    cigar, name, rname = F.lit(None).cast("string"), F.concat(F.lit("r"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))), F.concat("l_returnflag", "l_linestatus")
    for i, (head, tail) in enumerate(_CIGARS):
        cigar = F.when(kind == i, F.concat(F.lit(head or ""), (q if head is not None else q + 12).cast("string"), F.lit(tail))).otherwise(cigar)
    letters = lambda a, b, to: F.substring(F.translate(F.concat(F.md5(F.concat(name, F.lit(a))), F.md5(F.concat(name, F.lit(b)))), HEX, to), F.lit(1), q + 12)
    mate = F.when(F.col("l_suppkey") % 3 == 0, "=").when(F.col("l_suppkey") % 3 == 1, "XX").otherwise(rname)
    return li.select(
        name.alias("qname"), ((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 2048).cast("int").alias("flag"), rname.alias("rname"), pos.alias("pos"), (F.col("l_partkey") % 61).cast("int").alias("mapq"),
        cigar.alias("cigar"), mate.alias("rnext"), pos.alias("pnext"), F.lit(0).alias("tlen"), letters("", "x", BASES).alias("seq"), letters("q", "r", QUALITIES).alias("qual"),
    )


def reference_orders(spark, d) -> DataFrame:
    """(name, at, seq): pieces of the six references, sixteen letters of each order."""
    o = ad.table(spark, d, "orders")
    first = o.agg(F.min("o_orderkey")).first()[0] or 0
    rows = o.select("o_orderkey", "o_orderstatus", F.explode(F.array(*[F.lit(a + b) for a in "ANR" for b in "FO"])).alias("name"))
    seq = F.substring(F.translate(F.md5(F.concat("name", F.col("o_orderkey").cast("string"), "o_orderstatus")), HEX, BASES), 1, PER_ORDER)
    return rows.select("name", ((F.col("o_orderkey") - first) * PER_ORDER).alias("at"), seq.alias("seq"))


@query(f"WITH {SAM} SELECT qname, flag, mapq FROM sam WHERE mapq >= 20 AND flag & 1 = 1 AND flag & 1796 = 0")
def sam_flag_filter(spark, d):
    return alignments.view(sam_lineitem(spark, d), 20, 1, 1796).select("qname", "flag", "mapq")


@query(f"""WITH {SAM}, b AS (SELECT *, flag & 512 = 0 AS ok, flag & 4 = 0 AS m, flag & 1 = 1 AS p, flag & 8 = 8 AS mm, flag & 1 = 1 AND flag & 4 = 0 AND flag & 8 = 0 AND rnext NOT IN ('=', rname) AS other FROM sam),
x AS (SELECT unnest(['total', 'duplicates', 'mapped', 'paired', 'read1', 'read2', 'properly paired', 'both mapped', 'singletons', 'mate elsewhere', 'mate elsewhere, mapq 5']) AS what,
  unnest([true, flag & 1024 > 0, m, p, p AND flag & 64 > 0, p AND flag & 128 > 0, p AND m AND flag & 2 > 0, p AND m AND NOT mm, p AND m AND mm, other, other AND mapq >= 5]) AS yes, ok FROM b)
SELECT what, count(*) FILTER (yes AND ok) AS passed, count(*) FILTER (yes AND NOT ok) AS failed FROM x GROUP BY what""")
def flagstat(spark, d):
    return alignments.flagstat(sam_lineitem(spark, d))


@query(f"WITH {SAM} SELECT rname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 > 0) AS unmapped FROM sam GROUP BY rname")
def idxstats(spark, d):
    return alignments.idxstats(sam_lineitem(spark, d))


@query(f"""WITH {SAM}, {OPS}, sums AS (SELECT qname, list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS quality FROM sam),
r AS (SELECT qname, row_number() OVER (PARTITION BY rname, flag & 16, CASE WHEN flag & 16 > 0 THEN pos + span ELSE pos END ORDER BY quality DESC, qname) AS k FROM sam JOIN spans USING (qname) JOIN sums USING (qname) WHERE flag & 4 = 0)
SELECT qname FROM r WHERE k = 1 UNION ALL SELECT qname FROM sam WHERE flag & 4 > 0""")
def rmdup_best(spark, d):
    return alignments.remove_duplicates(sam_lineitem(spark, d)).select("qname")


@query(f"""WITH {SAM}, {OPS} SELECT rname, p AS pos, count(*) AS depth FROM cols WHERE mapq >= 50 AND flag & 1796 = 0 GROUP BY ALL""")
def depth(spark, d):
    return alignments.depth(sam_lineitem(spark, d), 50)


@query(f"""WITH {SAM}, {OPS}, c AS (SELECT rname, p, mapq % 3 AS who FROM cols WHERE mapq >= 5 AND flag & 1796 = 0 AND ascii(substr(qual, z + 1, 1)) - 33 >= 14)
SELECT rname, p AS pos, count(*) FILTER (who = 0) AS a, count(*) FILTER (who = 1) AS b FROM c WHERE p % 4000 < 3000 GROUP BY ALL HAVING count(*) FILTER (who < 2) > 0""")
def depth_samples(spark, d):
    """Depth of two samples with a least base quality, in given regions."""
    sam = sam_lineitem(spark, d).withColumn("sample", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("mapq") % 3 + 1))
    spans = spark.range(0, 40).select(F.explode(F.array(*[F.lit(x + y) for x in "ANR" for y in "FO"])).alias("chrom"), (F.col("id") * 4000).alias("start"), (F.col("id") * 4000 + 3000).alias("end"))
    return alignments.depth(sam, 5, 14, ["a", "b"], regions=spans)


@query(f"""WITH {SAM}, {OPS}, b AS (SELECT rname, p, substr(seq, z + 1, 1) AS base FROM cols WHERE flag & 4 = 0)
SELECT rname, p AS pos, count(*) AS depth, string_agg(base, '' ORDER BY base) AS bases FROM b GROUP BY ALL""")
def pileup(spark, d):
    return alignments.pileup(sam_lineitem(spark, d))


@query("SELECT count(*) AS n FROM lineitem")
def sam_count(spark, d):
    """Count mode of the alignment view."""
    return spark.createDataFrame([(alignments.view(sam_lineitem(spark, d)).count(),)], "n long")


@query(f"WITH {SAM}, {OPS} SELECT qname, pos::BIGINT AS start, pos + span AS \"end\", CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, mapq::DOUBLE AS score FROM sam JOIN spans USING (qname) WHERE flag & 4 = 0")
def sam_intervals(spark, d):
    return text.sam_intervals(sam_lineitem(spark, d)).select(F.col("name").alias("qname"), "start", "end", "strand", "score")


@query(f"""WITH {SAM}, {OPS} SELECT qname, string_agg(CASE WHEN op = 'M' THEN substr(seq, y::INT + 1, n::INT) WHEN op IN ('D', 'N') THEN repeat('N', n::INT) ELSE '' END, '' ORDER BY i) AS laid FROM ops JOIN sam USING (qname) GROUP BY qname""")
def apply_cigar(spark, d):
    return sam_lineitem(spark, d).select("qname", fx.apply_cigar(F.col("cigar"), F.col("seq")).alias("laid"))


@query(f"""WITH {SAM}, {OPS}, {REFERENCE}, len AS (SELECT rname, max(p) + 1 AS len FROM refs GROUP BY rname),
o AS (SELECT ops.*, rname, seq, pos + x AS rx, len, op IN ('M', 'D') AND pos + x + n > len AS beyond FROM ops JOIN sam USING (qname) JOIN len USING (rname) WHERE flag & 4 = 0 AND pos < len),
last AS (SELECT qname, coalesce(min(i) FILTER (beyond), 99) AS last FROM o GROUP BY qname), kept AS (SELECT o.* FROM o JOIN last USING (qname) WHERE i <= last),
m AS (SELECT *, rx + k AS p, substr(seq, (y + k + 1)::INT, 1) AS r FROM (SELECT *, unnest(range(0, least(n, greatest(len - rx, 0))::BIGINT)) AS k FROM kept WHERE op = 'M')),
d AS (SELECT qname, i, rname, unnest(range(rx::BIGINT, least(rx + n, len)::BIGINT)) AS p FROM kept WHERE op = 'D'),
toks AS (SELECT qname, i, k, CASE WHEN r = c AND c <> 'N' THEN '=' ELSE c END AS tok FROM m JOIN refs USING (rname, p) UNION ALL
  SELECT qname, i, 0, '^' || coalesce(string_agg(c, '' ORDER BY p), '') FROM kept LEFT JOIN (SELECT d.qname, d.i, p, c FROM d JOIN refs USING (rname, p)) USING (qname, i) WHERE op = 'D' GROUP BY qname, i),
g AS (SELECT *, sum((tok <> '=')::INT) OVER (PARTITION BY qname ORDER BY i, k) AS g FROM toks), c AS (SELECT qname, g, max(tok) FILTER (tok <> '=') AS head, count(*) FILTER (tok = '=') AS n FROM g GROUP BY ALL),
md AS (SELECT qname, CASE WHEN min(g) > 0 THEN '0' ELSE '' END || string_agg(coalesce(head, '') || n, '' ORDER BY g) AS md FROM c GROUP BY qname),
nm AS (SELECT qname, sum(CASE WHEN op = 'I' OR op = 'D' AND NOT beyond THEN n ELSE 0 END) AS gaps FROM kept GROUP BY qname), mm AS (SELECT qname, count(*) FILTER (tok <> '=' AND tok NOT LIKE '^%') AS mm FROM toks GROUP BY qname)
SELECT qname, md, (gaps + mm)::INT AS nm FROM md JOIN nm USING (qname) JOIN mm USING (qname)""")
def mismatch_strings(spark, d):
    """Mismatch strings and edit distances of alignments."""
    sam = sam_lineitem(spark, d).filter(~fx.has_flag(F.col("flag"), alignments.UNMAPPED)).select("qname", "flag", "rname", "pos", "cigar", "seq")
    return reference.mismatches(sam, reference_orders(spark, d)).filter("md IS NOT NULL").select("qname", "md", "nm")


@query()
def alignment_quality(spark, d):
    """Base qualities capped by the posteriors of a banded alignment; pytest compares them with all paths of short reads."""
    sam = sam_lineitem(spark, d).select("qname", "flag", "rname", "pos", "cigar", "seq", "qual")
    return reference.alignment_qualities(sam, reference_orders(spark, d)).select("qname", "bq", "capped")


@query(f"""WITH {SAM}, {OPS}, {REFERENCE},
b AS (SELECT qname, rname, p, strpos('ACGT', substr(seq, z + 1, 1)) AS bp, ascii(substr(qual, z + 1, 1)) - 33 AS bq, least(mapq, 60) AS mq, (flag & 16 > 0)::INT AS strand FROM cols WHERE flag & 4 = 0),
u AS (SELECT qname, rname, p, CASE bp WHEN 0 THEN 4 ELSE bp - 1 END AS base, greatest(least(bq, mq, 63), 4) AS q, strand FROM b WHERE bq >= 13), deep AS (SELECT rname, p, count(*) AS all_depth FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rname, p, strand, base ORDER BY q DESC, qname) - 1 AS w, row_number() OVER (PARTITION BY rname, p, base ORDER BY q DESC, strand DESC, qname) - 1 AS k, count(*) OVER (PARTITION BY rname, p) AS n FROM u),
qn AS (SELECT DISTINCT q, n FROM r), terms AS (SELECT q, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(10 ** (-q / 10)) + (n - k) * ln(1 - 10 ** (-q / 10))) AS t FROM (SELECT q, n, unnest(range(0, n + 1)) AS k FROM qn)),
tails AS (SELECT q, n, k, sum(t) OVER (PARTITION BY q, n ORDER BY k DESC) AS t FROM terms), beta AS (SELECT q, n, k, -10 * log10(lead(t) OVER (PARTITION BY q, n ORDER BY k) / t) AS beta FROM tails),
s AS (SELECT rname, p, base, sum((pow(0.83::DOUBLE, w::DOUBLE) * 0.97::DOUBLE + 0.03::DOUBLE) * beta) AS cost, count(*) AS c, sum(q) AS qsum FROM r JOIN beta USING (q, n, k) GROUP BY ALL),
pos AS (SELECT rname, p, sum(cost) AS total, sum(c)::BIGINT AS depth FROM s GROUP BY ALL),
ref AS (SELECT pos.*, CASE WHEN c.c IN ('A', 'C', 'G', 'T') THEN c.c ELSE 'N' END AS ref, CASE coalesce(strpos('ACGT', c.c), 0) WHEN 0 THEN 4 ELSE strpos('ACGT', c.c) - 1 END AS code FROM pos LEFT JOIN refs c USING (rname, p)),
five AS (SELECT rname, p, code, base, coalesce(cost, 0) AS cost, coalesce(c, 0) AS c, coalesce(qsum, 0) AS qsum FROM ref CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS base) LEFT JOIN s USING (rname, p, base)),
o AS (SELECT *, row_number() OVER (PARTITION BY rname, p ORDER BY qsum DESC, base DESC) AS rank, count(*) FILTER (qsum > 0) OVER (PARTITION BY rname, p) AS seen FROM five WHERE base < 4 AND base <> code),
al AS (SELECT rname, p, base, cost, c, rank, rank > seen AS unseen FROM o WHERE rank <= seen + 1 UNION ALL SELECT rname, p, base, cost, c, 0, false FROM five WHERE base = code),
g AS (SELECT rname, p, x.rank AS k, y.rank AS j, greatest(total - x.cost - CASE WHEN x.base = y.base THEN 0 ELSE y.cost + 4.343 * (lgamma(x.c + y.c + 1) - lgamma(x.c + 1) - lgamma(y.c + 1) - (x.c + y.c) * ln(2)) END, 0) AS v
  FROM al x JOIN al y USING (rname, p) JOIN pos USING (rname, p) WHERE y.rank <= x.rank),
pl AS (SELECT rname, p, string_agg(least(floor(v - low + 0.499 + 1e-9), 255)::INT, ',' ORDER BY k, j) AS pl FROM (SELECT *, min(v) OVER (PARTITION BY rname, p) AS low FROM g) GROUP BY ALL),
alts AS (SELECT rname, p, string_agg(CASE WHEN unseen THEN 'X' ELSE substr('ACGT', base + 1, 1) END, ',' ORDER BY rank) AS alts FROM al WHERE rank > 0 GROUP BY ALL)
SELECT rname, p AS pos, ref, alts, depth, all_depth, pl FROM ref JOIN pl USING (rname, p) JOIN alts USING (rname, p) JOIN deep USING (rname, p)""")
def genotype_likelihoods(spark, d):
    """Alleles and scaled likelihoods of their genotypes at each position."""
    found = calling.genotypes(sam_lineitem(spark, d), reference_orders(spark, d))
    return found.select("rname", "pos", "ref", "alts", "depth", "all_depth", F.array_join(F.col("pl").cast("array<string>"), ",").alias("pl"))


@query("SELECT l_orderkey, l_linenumber, round(10 ** (-l_quantity / 10), 9) AS p, round((10 ** (-l_quantity / 10)) / (1 + 10 ** (-l_quantity / 10)), 9) AS solexa, chr((l_quantity + 33)::INT) AS c FROM lineitem")
def quality_scores(spark, d):
    q = F.col("l_quantity")
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(fx.phred_to_error(q), 9).alias("p"), rounded(fx.solexa_to_error(q), 9).alias("solexa"), fx.phred_char(q).alias("c"))


@query(f"WITH {EV}, {_bins_sql('events_reads', 'ev_chroms', 'cnt', STEP)} SELECT chrom, bin, count(*)::BIGINT AS n FROM (SELECT chrom, s // {STEP} AS bin FROM events_reads) GROUP BY ALL")
def streamed_bins(spark, d):
    """The same windows kept by a stream with a watermark, run to its end."""
    return live.stream_counts(spark, d, STEP)


@query("""WITH o AS (SELECT event_type AS chrom, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY ts) AS i FROM o) SELECT chrom, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY chrom, i""")
def streamed_sessions(spark, d):
    """Regions of a stream: a gap of half an hour begins the next."""
    return live.stream_sessions(spark, d, "30 minutes")


@query()
def binsize_empirical(spark, d):
    """The size with the lowest cost by ternary search; rounding is by a seeded hash, so there is no SQL for it."""
    r = ad.reads_lineitem(spark, d)
    base = binning.load_bins({"reads": r}, ad.chroms_lineitem(spark), 50).persist()
    size = binsize.hideaki_empirical(base, 50)
    base.unpersist()
    return spark.createDataFrame([(size,)], "size long")


#: Queries that bench.py times.
HEADLINE = ["bin_counts", "desert_regions", "interval_overlap_join", "interval_nearest", "viterbi_2s", "domains_single", "domains_control", "domains_two_samples", "trained_single", "trained_control", "trained_two_samples", "kmer_duplicates", "depth"]

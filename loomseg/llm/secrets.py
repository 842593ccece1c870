"""Secret scans: base patterns, and Shannon entropy over a sliding window of candidate strings.

Everything is a DataFrame expression. A candidate's entropy is kept by incremental counts: the fold carries how often each character of the
alphabet stands in the window; a step takes one character out and one in, and changes two counts and sum(c * log2 c) by them. Counts
are characters of a string, so that reading and changing one is a substring and an overlay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Keywords are ASCII in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is too short fails whole, and so does each of its ends: lengths can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Whole runs of the base64 alphabets.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits in a window of 20 that a candidate of each class must exceed. A candidate is of the first class that holds all its characters; digits alone are none.
THRESHOLDS = {"hex": 3.05, "letters": 3.95, "alnum": 3.65, "base64": 3.75}
CLASSES = {"hex": "^[0-9a-fA-F]+$", "letters": "^[A-Za-z]+$", "alnum": "^[A-Za-z0-9]+$", "base64": "^"}
#: Windows that touch one of these forms are not secrets: UUIDs, placeholders, runs of one character, counting, paths.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your_",
    r"x{5,}|X{5,}|0{6,}|\*{3,}",
    r"0123456|1234567|abcdefg|ABCDEFG",
    r"^[a-z]+(/[a-z0-9_-]+)+$",
)


#: Matches that one inner fold lays out: their positions are then moved by what stands ahead, so the work follows the number of matches.
PART = 128


def _runs(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """array<struct<s,e,m>> of the pattern's matches, as code points; keep: a test of the group's text.

    split() gives what stands between the matches, so positions are sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tests = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), tests.alias("test"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        one = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m"))
        found = F.array_append(acc["found"], one) if keep is None else F.when(keep(x["test"]), F.array_append(acc["found"], one)).otherwise(acc["found"])
        return F.struct(e.alias("at"), found.alias("found"))

    def laid(part):
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def joined(all_rows):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / PART).cast("int")), lambda i: laid(F.slice(all_rows, i * PART + 1, PART)))
        moved = F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string>>>").alias("found")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["found"], F.transform(x["found"], lambda y: F.struct((y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["m"].alias("m")))).alias("found")),
        )
        return F.flatten(moved["found"])

    # most texts have no match: one search tells; the rows are made once, as the only element that a transform goes over
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(rows), joined))).otherwise(none)


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any `window` successive characters of the alphabet; windows with other characters don't count. Null if there is none."""
    if not 1 <= window <= 70:
        raise ValueError("the window has 1 to 70 characters")  # a count is one ASCII character
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    count = lambda counts, p: F.when(p > 0, F.ascii(F.substring(counts, p, F.lit(1))) - 48).otherwise(0)
    put = lambda counts, p, c: F.when(p > 0, F.overlay(counts, F.char(c + 48), p, F.lit(1))).otherwise(counts)

    # x: p, the character's place in the alphabet (0: not in it), and i, how many characters the window then has had; below 0: it leaves
    def step(acc, x):
        p, i = x["p"], x["i"]
        c, enters = count(acc["counts"], p), i > 0
        after = F.when(enters, c + 1).otherwise(c - 1)
        total = acc["s"] + F.when(p > 0, _clog(after) - _clog(c)).otherwise(0.0)
        other = acc["other"] + F.when(p > 0, 0).when(enters, 1).otherwise(-1)
        h = F.when((i >= window) & (other == 0), F.log2(F.lit(float(window))) - total / window)
        return F.struct(put(acc["counts"], p, after).alias("counts"), total.alias("s"), other.alias("other"), F.greatest(acc["best"], h).alias("best"))

    def walked(places):
        """Each character enters, and leaves before the one enters that is `window` further on."""
        own = lambda p, i: F.struct(p.alias("p"), i.alias("i"))
        both = lambda p, i: F.when(i >= window, F.array(own(F.element_at(places, i - window + 1), F.lit(-1)), own(p, i + 1))).otherwise(F.array(own(p, i + 1)))
        start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("other"), F.lit(None).cast("double").alias("best"))
        return F.aggregate(F.flatten(F.transform(places, both)), start, step, lambda a: a["best"])

    # a lambda's variable holds what is computed once
    places = F.transform(F.split(s, ""), place)
    return F.when(F.length(s) >= window, F.element_at(F.transform(F.array(places), walked), 1))


def without_forms(s: Column, forms: Sequence[str]) -> Column:
    """s with blanks where a form matches, of the same length. Forms are looked for one after the other."""

    def blanked(form):
        def one(x):
            blanks = F.concat(F.transform(F.regexp_extract_all(x, F.lit(form), F.lit(0)), lambda h: F.repeat(F.lit(" "), F.length(h))), F.array(F.lit("")))
            return F.when(x.rlike(form), F.array_join(F.zip_with(F.split(x, form, -1), blanks, lambda g, b: F.concat(g, b)), "")).otherwise(x)

        return one

    held = F.array(s)
    for form in forms:
        held = F.transform(held, blanked(form))
    return F.element_at(held, 1)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    thresholds: Mapping[str, float] = THRESHOLDS,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """One row per document: doc_id, text, spans array<struct<s,k,e,kind,secret>> sorted by start and kind.

    Kinds: assign, access, hex (base patterns, leftmost and non-overlapping per kind), entropy (a candidate with a window above its
    class's threshold that no allowed form touches; no base span touches the candidate).
    Offsets are code points, end exclusive. Null or empty text: no spans. Rows are independent, so
    repeated rows and null ids come back as they are. Columns other than the two named are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.select(
        "doc_id",
        "text",
        _runs(F.col("text"), ASSIGN, lambda v: F.length(v) >= 6, 2).alias("assign"),
        _runs(F.col("text"), ACCESS).alias("access"),
        _runs(F.col("text"), HEX).alias("hex"),
        _runs(F.col("text"), CANDIDATE).alias("candidates"),
    )

    def secret(c):
        m = c["m"]
        bits = F.lit(float("inf"))
        for name, form in reversed(CLASSES.items()):
            bits = F.when(m.rlike(form), thresholds[name]).otherwise(bits)
        clear = ~m.rlike("^[0-9]+$")
        for kind in KINDS[:3]:
            clear = clear & ~F.exists(F.col(kind), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        # forms are looked for and windows walked in what is left only
        entropy = F.element_at(F.transform(F.array(without_forms(m, allow)), lambda x: window_entropy(x, window)), 1)
        return F.when(clear, F.coalesce(entropy > bits, F.lit(False))).otherwise(False)

    found = found.withColumn("entropy", F.when(F.size("candidates") > 0, F.filter("candidates", secret)).otherwise(F.col("candidates")))

    def named(i, kind):
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("secret")))

    return found.select("doc_id", "text", F.array_sort(F.concat(*[named(i, k) for i, k in enumerate(KINDS)])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


# The same in SQL: runs of the plain alphabets, filtered afterwards where Java's patterns look around.
_ASSIGN_SQL = ASSIGN.replace("'", "''")
_HITS = "regexp_extract_all(m, '{f}')"
_FORMS_SQL = ",\n".join(
    f"""c{i + 1} AS (SELECT doc_id, s, e, h, CASE WHEN regexp_matches(m, '{f}') THEN array_to_string(list_transform(range(1, len(regexp_split_to_array(m, '{f}')) + 1),
  lambda i: regexp_split_to_array(m, '{f}')[i] || repeat(' ', coalesce(length({_HITS.format(f=f)}[i]), 0))), '') ELSE m END AS m FROM c{i})"""
    for i, f in enumerate(ALLOW)
)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT doc_id, text, 0 AS k, 'assign' AS kind, '{_ASSIGN_SQL}' AS r, 2 AS g FROM d UNION ALL
  SELECT doc_id, text, 1, 'access', 'AKIA[A-Z0-9]{{16,}}', 0 FROM d UNION ALL
  SELECT doc_id, text, 2, 'hex', '[0-9a-f]{{24,}}', 0 FROM d UNION ALL
  SELECT doc_id, text, 3, 'entropy', '[A-Za-z0-9+/_=-]{{20,}}', 0 FROM d),
m AS (
  SELECT doc_id, k, kind, CASE k WHEN 0 THEN regexp_extract_all(text, '{_ASSIGN_SQL}', 0) WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]{{16,}}', 0)
      WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]{{24,}}', 0) ELSE regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}', 0) END AS hits,
    CASE k WHEN 0 THEN regexp_split_to_array(text, '{_ASSIGN_SQL}') WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]{{16,}}')
      WHEN 2 THEN regexp_split_to_array(text, '[0-9a-f]{{24,}}') ELSE regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{{20,}}') END AS gaps,
    CASE k WHEN 0 THEN regexp_extract_all(text, '{_ASSIGN_SQL}', 2) END AS tests
  FROM f),
u AS (SELECT doc_id, k, kind, unnest(hits) AS h, unnest(gaps[1:len(hits)]) AS gap, unnest(coalesce(tests, hits)) AS t, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT *, (sum(length(gap) + length(h)) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS e FROM u),
s AS (SELECT doc_id, k, kind, h, e - length(h) AS s, e FROM p WHERE k > 0 OR length(t) >= 6),
base AS (SELECT * FROM s WHERE k < 3),
c0 AS (SELECT doc_id, s, e, h, h AS m FROM s WHERE k = 3 AND NOT regexp_matches(h, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.s < s.e AND s.s < b.e)),
{_FORMS_SQL},
w AS (
  SELECT c.doc_id, c.s, c.e, c.h, max(list_aggregate(string_split(substr(c.m, n::INT, 20), ''), 'entropy')) AS bits
  FROM (SELECT *, unnest(range(1, length(m) - 18)) AS n FROM c{len(ALLOW)}) c WHERE NOT contains(substr(c.m, n::INT, 20), ' ') GROUP BY ALL),
added AS (
  SELECT w.doc_id, 3 AS k, 'entropy' AS kind, h, s, e FROM w
  WHERE bits > CASE {" ".join(f"WHEN regexp_matches(h, '{CLASSES[c]}') THEN {THRESHOLDS[c]}" for c in CLASSES)} END),
spans AS (SELECT doc_id, k, kind, s, e FROM base UNION ALL SELECT doc_id, k, kind, s, e FROM added),
j AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""

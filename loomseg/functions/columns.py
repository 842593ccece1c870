"""Scalar functions as column expressions: likelihoods, sequences, qualities, numbers, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum(p: Column, q: Column) -> Column:
    """log(exp p + exp q)."""
    return F.greatest(p, q) + F.log1p(F.exp(-F.abs(p - q)))


def log_rising(k: Column, r: float) -> Column:
    """ln gamma(k + r) - ln gamma(r), for whole k: the sum of ln(r + j) below k."""
    return F.when(k < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(0.0), lambda acc, j: acc + F.log(j + F.lit(float(r)))))


def log_factorial(k: Column) -> Column:
    return log_rising(k, 1.0)


def exp_ll(k: Column, s: Column, theta: float) -> Column:
    return -F.log(theta * s) - k / (theta * s)


def pois_ll(k: Column, s: Column, rate: float) -> Column:
    return -rate * s + k * F.log(rate * s) - log_factorial(k)


def nbd_ll(k: Column, s: Column, mu: float, alpha: float) -> Column:
    r = 1 / alpha
    p = F.lit(r) / (r + mu * s)
    return log_rising(k, r) - log_factorial(k) + r * F.log(p) + k * F.log1p(-p)


def gauss_ll(k: Column, s: Column, m: float, sd: float) -> Column:
    return F.greatest(-0.5 * F.pow((k - m * s) / (sd * s), F.lit(2.0)) - F.log(sd * s) - F.lit(0.5 * math.log(2 * math.pi)), F.lit(-30.0))


def skellam_ll(k: Column, s: Column, u: float, v: float) -> Column:
    """By the power series of the Bessel function, in log space about its terms' maximum, with as many terms as the rates need."""
    n, half = F.abs(k), F.log(s * math.sqrt(u * v))
    term = lambda m: (2 * m + n) * half - log_factorial(m) - log_factorial(m + n)
    each = F.transform(F.sequence(F.lit(0), (80 + F.ceil(2 * s * math.sqrt(u * v))).cast("int")), term)
    top = F.array_max(each)
    total = top + F.log(F.aggregate(each, F.lit(0.0), lambda acc, t: acc + F.exp(t - top)))
    return F.when(n > 120, -40.0).otherwise(-(u + v) * s + k / 2 * math.log(u / v) + total)


# sequences


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def bisulfite(seq: Column, strand: str = "+") -> Column:
    """Full conversion: C reads as T, or G as A on the other strand."""
    return F.translate(seq, "Cc", "Tt") if strand == "+" else F.translate(seq, "Gg", "Aa")


def bisulfite_partly(seq: Column, key: Column, rate: float, seed: int = 0) -> Column:
    """Each C converts with the given probability, by a seeded hash of the key and its place."""
    one = lambda c, i: F.when((c == "C") & (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30))), "T").otherwise(c)
    return F.array_join(F.transform(F.split(seq, ""), one), "")


def sequencing_errors(seq: Column, key: Column, rate: float, seed: int = 0) -> Column:
    """Each base is misread as one of the three others with the given probability, by a seeded hash of the key and its place; N stays."""
    draw = lambda i, salt: F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    other = lambda c, i: F.substring(F.lit("ACGTACG"), base_code(c) + 2 + (draw(i, 1) % 3).cast("int"), F.lit(1))
    one = lambda c, i: F.when((base_code(c) < 4) & (draw(i, 0) < int(rate * (1 << 30))), other(c, i)).otherwise(c)
    return F.array_join(F.transform(F.split(seq, ""), one), "")


def error_matrix(seq: Column, error: float = 1e-4) -> Column:
    """array<array<double>>: a base's row has 1 - 3 error at its own place and error at the others; N is even."""
    row = lambda c: F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(base_code(c) == 4, 0.25).when(base_code(c) == i, 1 - 3 * error).otherwise(error))
    return F.transform(F.split(seq, ""), row)


def call_bases(matrix: Column) -> Column:
    """The base of more than half the probability in each row, else N."""
    best = lambda r: F.when(F.array_max(r) > 0.5, F.substring(F.lit("ACGT"), F.array_position(r, F.array_max(r)).cast("int"), F.lit(1))).otherwise("N")
    return F.array_join(F.transform(matrix, best), "")


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, else 4."""
    b = F.upper(base)
    return F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(4)


def is_base(base: Column) -> Column:
    return base.rlike("^[ACGTacgt]$")


def kmer_index(kmer: Column) -> Column:
    """The k-mer as a number to base 4, for up to 31 bases; null if a letter is not a base."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(kmer.rlike("^[ACGTacgt]+$"), F.conv(digits, 4, 10).cast("long"))


def index_kmer(index: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


# qualities


def phred_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def error_to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def solexa_to_error(q: Column) -> Column:
    odds = F.pow(F.lit(10.0), -q / 10)
    return odds / (1 + odds)


def error_to_solexa(p: Column) -> Column:
    return -10 * F.log10(p / (1 - p))


def phred_char(q: Column, offset: int = 33) -> Column:
    return F.char(q.cast("int") + offset)


def quality_scores(text: Column, offset: int = 33) -> Column:
    """The scores of a quality string: offset 33, or 64 for the older scale."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def quality_scale(lowest: Column, highest: Column) -> Column:
    """phred33, phred64 or solexa by the range of characters seen; null if none fits."""
    return F.when((lowest >= 33) & (lowest < 59), "phred33").when((lowest >= 59) & (lowest < 64), "solexa").when((lowest >= 64) & (highest <= 126), "phred64")


# alignments


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>>."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.transform(F.arrays_zip(n.alias("n"), op.alias("op")), lambda x: F.struct(x["n"].cast("int").alias("n"), x["op"].alias("op")))


def reference_length(cigar: Column) -> Column:
    """Positions that an alignment covers: M, D, N (and the exact forms of M)."""
    used = F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "D", "N", "=", "X"))
    return F.aggregate(used, F.lit(0), lambda acc, x: acc + x["n"])


def apply_cigar(cigar: Column, seq: Column, gap: str = "N") -> Column:
    """The read laid along the axis: matches copied, insertions and soft clips left out, deletions and skips filled with `gap`."""

    def step(acc, x):
        reads = x["op"].isin("M", "=", "X", "I", "S")
        piece = F.when(x["op"].isin("M", "=", "X"), F.substring(seq, acc["at"], x["n"])).when(x["op"].isin("D", "N"), F.repeat(F.lit(gap), x["n"])).otherwise("")
        return F.struct((acc["at"] + F.when(reads, x["n"]).otherwise(0)).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(cigar_ops(cigar), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


# numbers and text


def percent(a: Column, b: Column) -> Column:
    return F.floor(100 * a / b).cast("long")


def split_text(text: Column, delimiter: str, empty: bool = False) -> Column:
    parts = F.split(text, rf"\Q{delimiter}\E", -1)
    return parts if empty else F.filter(parts, lambda x: x != "")


def split_quoted(text: Column) -> Column:
    """Words between white space; quoted stretches stay together, without their quotes."""
    found = F.regexp_extract_all(text, F.lit(r"""("[^"]*"|'[^']*'|[^\s"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def strip_path(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def strip_suffix(path: Column) -> Column:
    return F.regexp_replace(strip_path(path), r"\.[^.]*$", "")

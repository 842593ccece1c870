"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bits are cut into segments. Two fingerprints close enough differ in some segment by a bit or none, so each
fingerprint enumerates that small Hamming ball of every segment, fetches what the segment's table holds there, and
verifies whole distances. Where radius < 2 * segments some segment must be so close, and nothing within the radius is missed;
looser similarities take more bits and more segments, by a stated probability of missing a pair.

simhash_dedup takes what is close as candidates only and links those whose shingle sets are similar enough, compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import BLOCK, connected_components, forest
from .shared import bounded_batches, stored, trim, utf8_column, worker_cache

#: Members of a table's entry that stand in one row; a fuller entry is dealt to several rows.
ENTRY = 256
#: Such rows of an entry that stand in one part; of a longer one, each part is met in a task of its own.
PART = 64
#: Pairs that are compared at once, rows of a key from which on connected ones are told apart first, and rows of a key that wait for the rest of it.
PAIRS, LARGE, WAITING = 1 << 16, 1 << 11, 1 << 16
#: Fingerprints from which on op1's segments are longer: an entry of 21 bits then holds 16 that are alike in nothing else.
MANY = 1 << 25
#: Shingles that are hashed at once.
PIECE = 255 * 64
#: Expected share of bits in which fingerprints of shingle similarity 0.8 differ: acos(2 * 0.8 / 1.8) / pi. Up to 3 / 16 where there are only five shingles.
SHARE, SHARE_SHORT = 0.1515, 0.1875
#: Candidates may lie so many standard deviations beyond it.
SLACK = 4.0
#: Words in which candidates are compared.
COMPARED = 4
#: Texts, and shingles, in a chunk of a cluster, about.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
#: Flags of the sieve over text hashes, as a power of two.
SIEVE = 26


@dataclass(frozen=True)
class Index:
    """Of how many 64-bit words a fingerprint is, its segments (word, offset, bits), the balls' radius and the largest distance linked.

    Distances are those of the first `compared` words; further ones serve segments only.
    """

    words: int = 1
    segments: tuple[tuple[int, int, int], ...] = ((0, 0, 21), (0, 21, 21), (0, 42, 22))
    ball: int = 1
    radius: int = 4
    compared: int = 1


def index_for(n: int, share: float, miss: float, ball: int = 1, radius: float | None = None, compared: int = 6) -> Index:
    """An index for n fingerprints of which pairs differ in up to `share` of their bits.

    Segments have about log2(n) bits, so that an entry holds few, and are so many that a pair at `share` is met in none of them
    with probability `miss`. Pairs are linked up to `radius` of the bits of the first `compared` words, `share` if not given:
    only the search follows n, by segments in as many more words as they need, and not what is linked.
    """
    bits = min(32, max(16, math.ceil(math.log2(max(n, 2))) - 2))
    met = sum(math.comb(bits, r) * share**r * (1 - share) ** (bits - r) for r in range(ball + 1))
    many, each = math.ceil(math.log(miss) / math.log1p(-met)), 64 // bits
    words = max(compared, -(-many // each))
    radius = share if radius is None else radius
    return Index(words, tuple((k // each, k % each * bits, bits) for k in range(many)), ball, int(radius * 64 * compared), compared)


def exact_index(n: int) -> Index:
    """For n fingerprints of 64 bits and links at 4 bits or fewer, missing none: three segments with balls of one, or two with balls of two.

    Of four differing bits some third has one at most, and some half two at most. Halves take 265 probes where thirds take 12, but hold few others.
    """
    return Index() if n < MANY else Index(segments=((0, 0, 32), (0, 32, 32)), ball=2)


def similar_index(n: int, miss: float = 0.001) -> Index:
    """Candidates for shingle similarity of 0.8: a pair at 0.8 is met in some segment with probability 1 - miss, and the radius is SLACK standard deviations wider. Width and radius are the same for every n."""
    return index_for(n, SHARE, miss, radius=SHARE_SHORT + SLACK * math.sqrt(SHARE_SHORT * (1 - SHARE_SHORT) / (64 * COMPARED)), compared=COMPARED)


def _spans(text: bytes, width: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The words joined by single spaces, and where each shingle lies in them; none without words."""
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return joined, [(0, len(joined))] if tokens else []
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lens + 1) - 1
    return joined, list(zip((ends - lens)[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's different word shingles, in order."""
    joined, spans = _spans(text, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in spans), "<u8", len(spans)))


def fingerprint(text: bytes, width: int = 4, seed: int = 42, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The SimHash of a text's word shingles, or of its different ones: a bit is set if it is in over half the hashes; all 0 without words.

    The first word's hashes are XXH64; a further word's are mixed from them.
    """
    joined, spans = (b"", shingles(text, width, seed)) if distinct else _spans(text, width)
    if not len(spans):
        return np.zeros(words, "<u8")
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(spans), PIECE):
        piece = spans[i : i + PIECE]
        h = piece if distinct else np.array([digest(joined[s:e], seed) for s, e in piece], "<u8")
        every = np.empty((len(h), words), "<u8")
        every[:, 0] = h
        for k in range(1, words):
            x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            every[:, k] = x ^ (x >> np.uint64(31))
        bits = np.unpackbits(every.view(np.uint8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # so many ones fit a byte
        ones += bits[:full].reshape(-1, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")


def _identity(text) -> tuple:
    """Two independent 64-bit hashes of a text: together they stand for it."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, text_hash, text_check); a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    first, second = _identity(F.col("text"))
    return rows.withColumns({"text_hash": first, "text_check": second})


def _clashing(own: DataFrame) -> DataFrame | None:
    """(clash): the text hashes that different texts share, as their second hashes tell; None if there is none.

    Of n texts about n * n / 2 ** 65 are expected, 27,000 of 1e12, so the table may be broadcast.
    """
    found = stored(own.groupBy(F.col("text_hash").alias("clash")).agg((F.min("text_check") < F.max("text_check")).alias("many")).filter("many").select("clash"), "clashing")
    return None if found.isEmpty() else found


def _told_apart(rows: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """rows with a text_hash of its own for each text: where texts share one, both their hashes make it."""
    if clashing is None:
        return rows
    met = rows.join(F.broadcast(clashing), F.col("text_hash") == F.col("clash"), "left")
    return met.withColumn("text_hash", F.when(F.col("clash").isNull(), F.col("text_hash")).otherwise(F.xxhash64("text_hash", "text_check"))).drop("clash")


def fingerprints(
    docs: DataFrame, width: int = 4, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False
) -> DataFrame:
    """(doc_id, text_hash, text_check, fp array<long>): fp has the fingerprint's words as signed numbers. Null text counts as empty. No other column is read."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", dict)
        for b in batches:
            fps = [fingerprint(t, width, seed, words, distinct).view("<i8") for t in utf8_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("text_check"), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "text_hash", "text_check", "fp"])
        trim()

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, text_check long, fp array<long>")


def _value(index: Index, k: int):
    word, off, bits = index.segments[k]
    return F.shiftrightunsigned(F.element_at("fp", word + 1), off).bitwiseAND(F.lit((1 << bits) - 1))


def _marked(k: int, value):
    """A segment's value with its number, as one join key."""
    return value.bitwiseOR(F.lit(k << 32).cast("long"))


def _full(fps: DataFrame, index: Index) -> DataFrame:
    """(fk, rows): the keys with entries of over ENTRY members, and the rows these are dealt to."""
    keys = F.array(*[_marked(k, _value(index, k)) for k in range(len(index.segments))])
    counts = fps.select(F.explode(keys).alias("fk")).groupBy("fk").agg(F.count("*").alias("n"))
    return stored(counts.filter(f"n > {ENTRY}").select("fk", F.ceil(F.col("n") / ENTRY).alias("rows")), "full")


def _entries(fps: DataFrame, index: Index, full: DataFrame) -> DataFrame:
    """(key, row, held): what stands under each value of each segment; entries over ENTRY members are dealt to rows of about so many."""
    keys = F.array(*[_marked(k, _value(index, k)) for k in range(len(index.segments))])
    table = fps.select("id", "c", *_words(index), F.explode(keys).alias("key"))
    dealt = table.join(full, F.col("key") == F.col("fk"), "left")
    dealt = dealt.withColumn("row", F.when(F.col("rows").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), F.col("rows"))))
    return dealt.groupBy("key", "row").agg(F.collect_list(F.struct("id", "c", *[f"f{w}" for w in range(index.compared)])).alias("held"))


def _words(index: Index) -> list:
    return [F.element_at("fp", w + 1).alias(f"f{w}") for w in range(index.compared)]


def _close(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which rows x and y are within the radius, and of different components where they have such."""
    d = np.zeros(len(x), np.uint16)
    for name, f in rows.items():
        if name[0] == "f":
            d += np.bitwise_count(f[x] ^ f[y])
    close = d <= radius
    return close & (rows["c"][x] != rows["c"][y]) if "c" in rows else close


def _joined_by_key(rows: dict[str, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (ids) that connect what is close under each key: members with each other and with those that visit them. A key's rows follow each other, members first."""
    key, part, own = rows["key"], rows["part"], rows["own"]
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.append(starts, len(key)))
    use = sizes > 1
    if "c" in rows:
        use &= np.minimum.reduceat(rows["c"], starts) < np.maximum.reduceat(rows["c"], starts)
    large = use & (sizes > LARGE)
    for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        for x, y in _joined_in_large({k: v[s : s + n] for k, v in rows.items()}, radius):
            yield rows["id"][s + x], rows["id"][s + y]
    small = np.repeat(use & ~large, sizes) & own
    x = np.flatnonzero(small)
    many = np.repeat(starts + sizes, sizes)[x] - x - 1  # a member meets all rows of its key that follow it
    work = np.cumsum(many)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + PAIRS, "right")))
        m = many[i:j]
        p = np.repeat(x[i:j], m)
        q = np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + p + 1
        close = _close(rows, p, q, radius)
        yield rows["id"][p[close]], rows["id"][q[close]]
        i = j


def _joined_in_large(rows: dict[str, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places) that connect what is close under one key of many rows. Members take their turn by blocks; those already connected aren't compared again."""
    n = len(rows["id"])
    label, members = np.arange(n), np.flatnonzero(rows["own"])
    step = max(1, PAIRS // n)
    for i in range(0, len(members), step):
        block = members[i : i + step]
        x, y = np.nonzero(label[block][:, None] != label)
        x = block[x]
        close = _close(rows, x, y, radius)
        if close.any():
            a, b = forest(x[close], y[close])
            yield a, b
            nodes, least = forest(label[a], label[b])
            up = np.arange(n)
            up[nodes] = least
            label = up[label]


def _contracted(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A task's links as a forest (a, b). Forests of blocks are joined; what a join doesn't make smaller leaves the task."""
    held, waiting, count = [np.zeros(0, np.int64)] * 2, [], 0

    def joined():
        return list(forest(*(np.concatenate(v) for v in zip(held, *waiting, strict=True))))

    for x, y in links:
        if len(x):
            waiting.append((x, y))
            count += len(x)
        if count >= BLOCK or len(waiting) >= 1000:
            held, waiting, count = joined(), [], 0
            if len(held[0]) > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], ["a", "b"])
                held = [np.zeros(0, np.int64)] * 2
    held = joined()
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], ["a", "b"])
    trim()


def _meet(radius: int):
    """Rows of whole keys, in order of key, part and members first, as links (a, b)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = None
        for b in batches:
            new = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names}
            new |= {k: v.view("<u8") for k, v in new.items() if k[0] == "f"}
            rows = new if rows is None else {k: np.concatenate([v, new[k]]) for k, v in rows.items()}
            n = len(rows["key"])
            last = n and int(np.argmax((rows["key"] == rows["key"][-1]) & (rows["part"] == rows["part"][-1])))  # the last key may go on
            if last:
                yield from _joined_by_key({k: v[:last] for k, v in rows.items()}, radius)
                rows = {k: v[last:] for k, v in rows.items()}
            if n - last > WAITING and not rows["own"][-1]:  # its members are all here; they wait for the other visitors
                yield from _joined_by_key(rows, radius)
                rows = {k: v[rows["own"]] for k, v in rows.items()}
        if rows is not None and len(rows["key"]):
            yield from _joined_by_key(rows, radius)

    return lambda batches: _contracted(found(batches))


def near_links(fps: DataFrame, index: Index = Index(), full: DataFrame | None = None) -> DataFrame:
    """(a, b) by id: links that connect whatever fingerprints (id long, fp array<long>; distinct) the index connects; of other components only where fps has them (c long).

    Of the two ends of a pair, the one whose lowest flipped bit is 0 visits the other, so a pair is met once a segment. Each member and visitor of
    a key is a row once, whatever it meets; tasks compare the rows of a key where they lie. A key of over ENTRY * PART members is cut into parts,
    each met by copies of the key's other rows, in tasks of their own. No key is capped. full: _full(fps, index), if at hand.
    """

    def visits(k):
        bits, value = index.segments[k][2], _value(index, k)
        flips = [sum(1 << x for x in c) for r in range(1, index.ball + 1) for c in combinations(range(bits), r)]
        own = F.array(F.struct(_marked(k, value).alias("key"), F.lit(True).alias("own")))
        if not flips:
            return own
        masks = F.filter(F.array(*[F.lit(m).cast("long") for m in flips]), lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
        return F.concat(own, F.transform(masks, lambda m: F.struct(_marked(k, value.bitwiseXOR(m)).alias("key"), F.lit(False).alias("own"))))

    names = ["id", *(["c"] if "c" in fps.columns else []), *[f"f{w}" for w in range(index.compared)]]
    rows = fps.select(*names[: -index.compared], *_words(index), F.explode(F.concat(*[visits(k) for k in range(len(index.segments))])).alias("p")).select(*names, "p.*")
    wide = (_full(fps, index) if full is None else full).filter(f"rows > {PART}").select(F.col("fk").alias("wk"), F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    rows = rows.join(wide, F.col("key") == F.col("wk"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a member is at home in one part and visits those after it
    rows = rows.withColumn("home", F.when(F.col("own"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.coalesce("home", F.lit(0)), F.col("parts") - 1)))
    rows = rows.select(*names, "key", "part", (F.col("own") & (F.col("part") == F.col("home"))).alias("own"))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("own")).mapInArrow(_meet(index.radius), "a long, b long")


def _nearest(ids: np.ndarray, fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every entry's members, each with its nearest within the radius, and with the neighbour that has the most neighbours."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    many = np.repeat(sizes, sizes)
    x = np.repeat(np.arange(len(ids)), many)
    y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + starts[x]
    d = np.zeros(len(x), np.int64)
    for f in fps:
        d += np.bitwise_count(f[x] ^ f[y])
    close = (d <= radius) & (x != y)
    x, y, d = x[close], y[close], d[close]
    degree = np.bincount(x, minlength=len(ids))
    a, b = [], []
    for order in (np.lexsort((ids[y], d, x)), np.lexsort((ids[y], -degree[y], x))):
        own = x[order]
        first = order[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])] if len(own) else order
        a.append(ids[x[first]])
        b.append(ids[y[first]])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def first_pairs(fps: DataFrame, index: Index, full: DataFrame) -> DataFrame:
    """(a, b): at most two candidates a member and entry. They join most of a large group, so that its other pairs need no comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("held")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            ids = flat.field("id").to_numpy(zero_copy_only=False)
            fps = [flat.field(f"f{w}").to_numpy(zero_copy_only=False).view("<u8") for w in range(index.compared)]
            ends, work, i, k = np.cumsum(sizes), np.cumsum(sizes * sizes), 0, 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + 1_000_000, "right")))
                e = int(ends[j - 1])
                x, y = _nearest(ids[k:e], [f[k:e] for f in fps], sizes[i:j], index.radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                i, k = j, e
        trim()

    nodes = fps.withColumn("c", F.col("id"))
    held = _entries(nodes, index, full).filter(F.size("held") > 1).select("held")
    return held.mapInArrow(run, "a long, b long").distinct()


def _sieve(ids: DataFrame) -> np.ndarray:
    """2 ** SIEVE flags, set where some id's upper bits fall: gathered as bitmaps, whose size does not follow the number of ids."""
    x = ids.select(F.shiftrightunsigned("id", 64 - SIEVE).alias("x"))
    maps = x.groupBy(F.shiftright("x", 15).alias("at")).agg(F.expr("bitmap_construct_agg(x & 32767)").alias("bits"))
    flags = np.zeros(1 << SIEVE - 3, np.uint8)
    for r in maps.toLocalIterator():
        flags[r["at"] << 12 : r["at"] + 1 << 12] = np.frombuffer(r["bits"], np.uint8)
    return flags


def _sets(rows: DataFrame, ends: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, own): the shingles of the texts in ends (id, first: a text's hash and the smallest doc_id that has it). Only those are cut again."""
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sieve.value
        for b in batches:
            at = b.column("text_hash").to_numpy().view("<u8") >> np.uint64(64 - SIEVE)
            hit = np.flatnonzero(flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            b = b.take(pa.array(hit))
            sets = [shingles(t, width, seed).view("<i8") for t in utf8_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "text_hash", "own"])
        trim()

    sets = rows.mapInArrow(run, "doc_id long, text_hash long, own array<long>")
    return sets.join(ends.select("id", "first"), (F.col("text_hash") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("id").agg(F.first("own").alias("own"))


def similar(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, width: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets of word shingles have a Jaccard similarity of `least` or more; two without words are alike.

    rows: (doc_id, text, text_hash); nodes: (id, first).
    """
    ends = stored(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "first"), "ends")
    sets = stored(_sets(rows, ends, width, seed), "shingles")
    left, right = (sets.select(F.col("id").alias(x), F.col("own").alias(f"{x}_own")) for x in "ab")
    both = F.size(F.array_intersect("a_own", "b_own"))
    alike = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("a_own") + F.size("b_own")).alias("of"))
    return alike.filter((F.col("of") == 0) | (F.col("both") >= least * (F.col("of") - F.col("both")))).select("a", "b")


def _shared(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many values each set of x has in common with each of y (of x itself if y is None). Values that one set alone has are left out first."""
    one, many = np.unique(np.concatenate(x), return_counts=True)
    vocab = one[many > 1] if y is None else np.intersect1d(one, np.unique(np.concatenate(y)))

    def cells(sets):
        value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(vocab, value)
        ok = col < len(vocab)
        ok[ok] = vocab[col[ok]] == value[ok]
        col, row = col[ok], row[ok]
        order = np.argsort(col, kind="stable")
        return col[order], row[order], len(sets)

    out, sides = np.zeros((len(x), len(y or x)), np.float32), [cells(x)] + ([cells(y)] if y is not None else [])
    for at in range(0, len(vocab), 4096):
        m = []
        for col, row, n in sides:
            i, j = np.searchsorted(col, (at, at + 4096))
            m.append(np.zeros((n, 4096), np.float32))
            m[-1][row[i:j], col[i:j] - at] = 1
        out += m[0] @ m[-1].T
    return out


def _alike_within(rows: DataFrame, ends: DataFrame, least: float, width: int, seed: int) -> DataFrame:
    """(a, b): links that connect the texts of each cluster which have a similarity of `least` or more and are of different components.

    ends: (id, first, c, cluster). A cluster is dealt to chunks of a bounded number of texts and of shingles; chunks are compared with each other by blocks,
    each of which gives a forest, so no pair is a row.
    """
    sets = stored(ends.join(_sets(rows, ends, width, seed), "id").select("id", "c", "cluster", "own"), "shingles")
    sizes = sets.groupBy(F.col("cluster").alias("k")).agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.size("own")) / CHUNK_SHINGLES)).cast("long").alias("chunks"))
    dealt = sets.join(stored(sizes, "sizes"), F.col("cluster") == F.col("k")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.greatest("chunks", F.lit(1))))
    held = stored(dealt.groupBy("cluster", "chunk").agg(F.collect_list(F.struct("id", "c", "own")).alias("x"), F.max("chunks").alias("chunks")), "held")
    more = held.filter("chunks > 1").select(F.col("cluster").alias("k"), F.col("chunk").alias("other"), F.col("x").alias("y"))
    across = held.filter("chunks > 1").join(more, (F.col("cluster") == F.col("k")) & (F.col("chunk") < F.col("other"))).select("x", "y")
    blocks = held.select("x", F.lit(None).cast(held.schema["x"].dataType).alias("y")).union(across)

    def side(b: pa.RecordBatch, name: str, i: int):
        v = b.column(name)[i].values
        if v is None:
            return None
        own = v.field("own")
        flat, at = own.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))])
        return v.field("id").to_numpy(), v.field("c").to_numpy(), [flat[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (ids, cs, x), other = side(b, "x", i), side(b, "y", i)
                jds, ds, y = other or (ids, cs, None)
                both, n, m = _shared(x, y), np.array([len(s) for s in x]), np.array([len(s) for s in (y or x)])
                alike = (both >= least * (n[:, None] + m[None] - both) - 1e-6) & (cs[:, None] != ds[None])
                p, q = np.nonzero(alike)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in forest(ids[p], jds[q])], ["a", "b"])
        trim()

    return blocks.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, index: Index | None = None, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp array<long>, component_id (the smallest doc_id reachable by links, itself included).

    Documents of one fingerprint are one node, so a group of copies costs one row. Empty and null texts
    have fingerprint 0 and are linked like any other. Null ids keep their row; they give a component its id only where it
    has no other. Repeated rows come back repeated; an empty table gives no rows. Extra columns are not read.
    """
    own, named = _named(docs, index, width, seed, id_col, text_col)  # the index follows the number of rows unless given
    return own.join(named, own["node"] == named["id"]).select("doc_id", "fp", F.col("least").alias("component_id"))


def _named(docs, index, width, seed, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and per fingerprint (id) its component (c) and that one's smallest doc_id (least)."""
    words = index.words if index else 1
    node = F.col("fp")[0] if words == 1 else F.xxhash64("fp")
    own = stored(fingerprints(docs, width, seed, words, id_col, text_col).withColumn("node", node), "fingerprints")
    index = index or exact_index(own.count())
    nodes = stored(own.groupBy(F.col("node").alias("id"), "fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = stored(connected_components(near_links(nodes.select("id", "fp"), index)), "components")
    placed = stored(nodes.join(comps, nodes["id"] == comps["node"], "left").select("id", "first", F.coalesce("component", "id").alias("c")), "placed")
    smallest = stored(placed.groupBy(F.col("c").alias("k")).agg(F.min("first").alias("least")), "smallest")
    return own, stored(placed.join(smallest, F.col("c") == F.col("k")).select("id", "c", "least"), "named")


def _similar_groups(docs, index, width, seed, id_col, text_col, least) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The fingerprints of all rows, per text (id, its hash) its component (c) by verified links, and what hashes clash.

    First candidates are few for each text and join the large groups. What other candidates connect is a cluster, and all texts of a cluster
    that are of different groups are compared.
    """
    own = stored(fingerprints(docs, width, seed, index.words, id_col, text_col, distinct=True), "fingerprints")
    clashing = _clashing(own)
    own = _told_apart(own, clashing)
    nodes = stored(own.groupBy(F.col("text_hash").alias("id"), "fp").agg(F.min("doc_id").alias("first")), "nodes")
    rows = _told_apart(_rows(docs, id_col, text_col), clashing)

    def placed(links):
        comps = stored(connected_components(links), "components")
        return stored(nodes.join(comps, nodes["id"] == comps["node"], "left").select("id", "fp", F.coalesce("component", "id").alias("c")), "placed")

    full = _full(nodes, index)
    links = stored(similar(rows, nodes, stored(first_pairs(nodes, index, full), "pairs"), least, width, seed), "links")
    now = placed(links)
    # stored first: a task then has one Python worker, not one more for the components
    clusters = stored(connected_components(stored(near_links(now, index, full), "near")), "clusters")
    ends = nodes.select("id", "first").join(now.select(F.col("id").alias("i"), "c"), F.col("id") == F.col("i")).join(clusters, F.col("id") == F.col("node")).select("id", "first", "c", F.col("component").alias("cluster"))
    more = stored(_alike_within(rows, stored(ends, "ends"), least, width, seed), "links")
    return own, placed(links.union(more)), clashing


def simhash_dedup(
    docs: DataFrame, index: Index | None = None, width: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8
) -> DataFrame:
    """The documents without near copies, with their own columns: of each component one row stays.

    Texts are linked if their sets of word shingles have a Jaccard similarity of `least` or more; fingerprints of the different
    shingles only find the candidates, by similar_index unless another index is given (which another `least` needs).
    The row that stays is that with the smallest id (null last), then the smallest hash of the text; of equal rows one stays.
    """
    bounded_batches(docs.sparkSession)
    own, named, clashing = _similar_groups(docs, index or similar_index(docs.count()), width, seed, id_col, text_col, least)
    kept = (
        own.join(named.select("id", "c"), own["text_hash"] == named["id"])
        .groupBy("c")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
        .select(F.col("k.doc_id").alias("kd"), F.col("k.text_hash").alias("kh"))
    )
    first, second = _identity(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("d"), first.alias("text_hash"), second.alias("text_check"))
    rows = _told_apart(rows, clashing).withColumnRenamed("text_hash", "h").drop("text_check")
    met = rows.join(stored(kept, "kept"), F.col("d").eqNullSafe(F.col("kd")) & (F.col("h") == F.col("kh")), "left_semi")
    return met.groupBy("d", "h").agg(F.first("row").alias("row")).select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")

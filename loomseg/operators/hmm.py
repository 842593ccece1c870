"""Hidden Markov models over regions of bins: training, decoding, posteriors.

The recursions are products of one matrix a bin, so they are scans. A region is cut into chunks of CHUNK bins, which are the tasks' work: a first pass
gives each chunk's product, a prefix pass over one row a chunk gives what enters every chunk from either side, and a second pass
runs inside the chunks. A region as long as a chromosome so runs on all cores. In a chunk blocks run side by side, joined by
one pass over block products. Training passes return sums for the distinct (count, scale) values only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import Distribution, Weighted

#: Least transition probability, and the probability of a region's end.
LEAST, END = 1e-20, 1e-10
#: Bins of a chunk at most: what a task holds at once.
CHUNK = 1 << 16


@dataclass
class Model:
    emissions: list[Distribution]
    start: np.ndarray
    trans: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.emissions)


def _blocks(length: int) -> int:
    return max(1, int(np.sqrt(length)))


def _scan(mats: np.ndarray, times, tidy) -> np.ndarray:
    """Products of all prefixes of each block of mats (blocks, size, n, n), the blocks side by side."""
    out = np.empty_like(mats)
    out[:, 0] = mats[:, 0]
    for i in range(1, mats.shape[1]):
        out[:, i] = tidy(times(out[:, i - 1], mats[:, i]))
    return out


def _norm(m: np.ndarray) -> np.ndarray:
    top = m.max(axis=(-2, -1), keepdims=True)
    return m / np.where(top > 0, top, 1)


def forward_backward(model: Model, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward and backward vectors (each scaled to sum 1), emissions (scaled by their largest) and the log-likelihood.

    ll: log-likelihood per bin and state. The end probabilities weigh the last bin.
    """
    length, n = ll.shape
    top = ll.max(axis=1)
    e = np.exp(ll - top[:, None])
    first = model.start * e[0]
    steps = model.trans[None] * e[1:, None, :]
    fwd = _vectors(first, steps)
    # one step's growth gives the likelihood, so scaling in between does not matter
    grown = np.einsum("ti,tij->t", fwd[:-1], steps) if length > 1 else np.zeros(0)
    total = float(np.log(first.sum()) + np.log(grown).sum() + top.sum() + np.log(fwd[-1] @ model.end))
    back_steps = np.transpose(steps, (0, 2, 1))[::-1]
    bwd = _vectors(model.end.astype(float), back_steps)[::-1]
    return fwd, bwd, e, total


def _vectors(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """v[t] = v[t-1] @ steps[t-1], each scaled to sum 1."""
    length, n = len(steps) + 1, len(first)
    out = np.empty((length, n))
    out[0] = first / first.sum()
    if length == 1:
        return out
    size = _blocks(length - 1)
    count = -(-(length - 1) // size)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(n), (count * size - (length - 1), n, n))]).reshape(count, size, n, n)
    prefix = _scan(padded, lambda a, b: a @ b, _norm)
    v, at = out[0], np.empty((count, n))
    for b in range(count):
        at[b] = v
        v = v @ prefix[b, -1]
        v = v / v.sum()
    flat = np.einsum("bi,bsij->bsj", at, prefix).reshape(count * size, n)[: length - 1]
    out[1:] = flat / flat.sum(axis=1, keepdims=True)
    return out


def posteriors(model: Model, ll: np.ndarray) -> tuple[np.ndarray, float]:
    fwd, bwd, _, total = forward_backward(model, ll)
    g = fwd * bwd
    return g / g.sum(axis=1, keepdims=True), total


def transition_posteriors(model: Model, ll: np.ndarray) -> np.ndarray:
    """(length, n, n): probability of a move from i at the bin before to j at this one; zeros at the region's first bin."""
    fwd, bwd, e, _ = forward_backward(model, ll)
    out = np.zeros((len(ll), model.n, model.n))
    if len(ll) > 1:
        x = fwd[:-1, :, None] * model.trans[None] * (e[1:] * bwd[1:])[:, None, :]
        out[1:] = x / x.sum(axis=(1, 2), keepdims=True)
    return out


def _prefer(n: int):
    """arg-max that breaks ties: the last state among two, the first among three."""
    return (lambda x, axis: n - 1 - np.flip(x, axis).argmax(axis)) if n == 2 else (lambda x, axis: x.argmax(axis))


def _best(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """v[t] = max over i of v[t-1][i] + steps[t-1][i], from v[0] = first: the best score is a running maximum over few states."""
    length, n = len(steps) + 1, len(first)
    vectors = np.empty((length, n))
    vectors[0] = first
    if length > 1:
        size = _blocks(length - 1)
        count = -(-(length - 1) // size)
        idle = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
        padded = np.concatenate([steps, np.broadcast_to(idle, (count * size - (length - 1), n, n))]).reshape(count, size, n, n)
        prefix = _scan(padded, _plus, lambda m: m)
        v, at = first, np.empty((count, n))
        for b in range(count):
            at[b] = v
            v = (v[:, None] + prefix[b, -1]).max(axis=0)
        vectors[1:] = (at[:, None, :, None] + prefix).max(axis=2).reshape(count * size, n)[: length - 1]
    return vectors


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of matrices over (max, +)."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def viterbi(model: Model, ll: np.ndarray) -> np.ndarray:
    """The likeliest states. Ties: the last state among two, the first among three."""
    log_t, prefer = np.log(model.trans), _prefer(model.n)
    vectors = _best(np.log(model.start) + ll[0], log_t[None] + ll[1:, None, :])
    came = np.empty(ll.shape, np.int8)
    came[1:] = prefer(vectors[:-1, :, None] + log_t[None], 1)
    return _traced(came)[:, prefer((vectors[-1] + np.log(model.end))[None], 1)[0]].astype(np.int64)


def _traced(came: np.ndarray) -> np.ndarray:
    """(length, n): the state at each bin of the path that ends in each state; came: the state before, for each bin and state."""
    length, n = came.shape
    out = np.empty((length, n), np.int8)
    out[-1] = np.arange(n)
    if length == 1:
        return out
    size = _blocks(length - 1)
    count = -(-(length - 1) // size)
    back = came[:0:-1]  # from the last bin to the first
    padded = np.concatenate([back, np.broadcast_to(np.arange(n, dtype=np.int8), (count * size - (length - 1), n))]).reshape(count, size, n)
    path = np.empty_like(padded)
    path[:, 0] = padded[:, 0]
    for i in range(1, size):
        path[:, i] = np.take_along_axis(padded[:, i], path[:, i - 1].astype(np.intp), axis=1)
    at, entered = np.arange(n), np.empty((count, n), np.intp)
    for b in range(count):
        entered[b] = at
        at = path[b, -1][at]
    flat = np.take_along_axis(path, np.broadcast_to(entered[:, None], path.shape), axis=2).reshape(count * size, n)[: length - 1]
    out[:-1] = flat[::-1]
    return out


def posterior_decode(gamma: np.ndarray) -> np.ndarray:
    """Two states: the first if it is likelier; three: the single winner, else the last."""
    if gamma.shape[1] == 2:
        return np.where(gamma[:, 0] > gamma[:, 1], 0, 1)
    top = gamma.max(axis=1, keepdims=True)
    return np.where((gamma == top).sum(axis=1) == 1, gamma.argmax(axis=1), gamma.shape[1] - 1)


# over DataFrames


def _codes(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and each row's place among them."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        u, at = np.unique(c, return_inverse=True)
        code = code * len(u) + at
        _, code = np.unique(code, return_inverse=True)  # stays dense whatever the columns are
    first = np.zeros(code.max(initial=-1) + 1, np.int64)
    first[code] = np.arange(len(code))
    return [c[first] for c in columns], code


def _likelihood(model: Model, columns, k: str) -> np.ndarray:
    """Evaluated once for each distinct (count, scale)."""
    (ks, ss), at = _codes([np.asarray(columns[k], float), np.asarray(columns["scale"], float)])
    return np.stack([d.log_likelihood(ks, ss) for d in model.emissions], axis=1)[at]


def chunked(bins: DataFrame) -> DataFrame:
    """bins with their chunk, spread by region and chunk: the form that passes work on without a shuffle of their own. Persist it for training."""
    return bins.withColumn("chunk", F.floor(F.col("bin") / CHUNK).cast("long")).repartition("region", "chunk")


def _in_order(table: pa.Table, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of a chunk's bins, and some columns in it."""
    order = np.argsort(table.column("bin").to_numpy(), kind="stable")
    return order, {c: table.column(c).cast(pa.float64()).to_numpy()[order] for c in names}


def _total(mats: np.ndarray, times, tidy) -> np.ndarray:
    """The product of all matrices, pair by pair; none: None."""
    while len(mats) > 1:
        odd = mats[-1:] if len(mats) % 2 else mats[:0]
        mats = np.concatenate([tidy(times(mats[: len(mats) // 2 * 2 : 2], mats[1 : len(mats) // 2 * 2 : 2])), odd])
    return mats[0] if len(mats) else None


def chunk_products(bins: DataFrame, model: Model, k: str, best: bool) -> DataFrame:
    """A row a chunk: `product` of its bins' matrices and `head`, its last bin's vector if it is its region's first; of the best paths too if asked for."""
    log_t, n = np.log(model.trans), model.n

    def run(table: pa.Table) -> pa.Table:
        _, x = _in_order(table, [k, "scale"])
        ll = _likelihood(model, x, k)
        e = np.exp(ll - ll.max(axis=1)[:, None])
        steps = model.trans[None] * e[:, None, :]
        rest = _total(steps[1:], np.matmul, _norm)
        rest = np.eye(n) if rest is None else rest
        out = {"product": _norm(steps[0] @ rest), "head": (model.start * e[0]) @ rest}
        if best:
            steps = log_t[None] + ll[:, None, :]
            rest = _total(steps[1:], _plus, lambda m: m)
            rest = np.where(np.eye(n, dtype=bool), 0.0, -np.inf) if rest is None else rest
            out |= {"best": _plus(steps[0], rest), "best_head": _plus((np.log(model.start) + ll[0])[None], rest)[0]}
        row = {c: table.column(c).slice(0, 1) for c in ("region", "chunk")}
        return pa.table(row | {c: pa.array([out[c].ravel().tolist()] if c in out else [None], pa.list_(pa.float64())) for c in ("product", "head", "best", "best_head")})

    arrays = ", ".join(f"{c} array<double>" for c in ("product", "head", "best", "best_head"))
    kind = bins.schema["region"].dataType.simpleString()
    return bins.select("region", "chunk", "bin", k, "scale").groupBy("region", "chunk").applyInArrow(run, f"region {kind}, chunk long, {arrays}")


def chunk_entries(products: DataFrame, model: Model) -> DataFrame:
    """A row a chunk: before (the forward vector at the bin ahead of it, null for a region's first), after (the backward vector at its last bin), best (scores of the best paths at the bin ahead) and ends (it is the region's last).

    A region's rows are as many as its chunks, so they are walked through in one group.
    """
    n = model.n

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        rows = table.to_pylist()
        before, after, best = [None] * len(rows), [None] * len(rows), [None] * len(rows)
        v = w = None
        for i, r in enumerate(rows):
            before[i], best[i] = (None if v is None else v.tolist()), (None if w is None else w.tolist())
            v = np.array(r["head"]) if v is None else v @ np.array(r["product"]).reshape(n, n)
            v = v / v.sum()
            if r["best"] is not None:
                w = np.array(r["best_head"]) if w is None else _plus(w[None], np.array(r["best"]).reshape(n, n))[0]
        v = model.end / model.end.sum()
        for i in range(len(rows) - 1, -1, -1):
            after[i] = v.tolist()
            v = np.array(rows[i]["product"]).reshape(n, n) @ v
            v = v / v.sum()
        lists = {c: pa.array(x, pa.list_(pa.float64())) for c, x in (("before", before), ("after", after), ("best", best))}
        return pa.table({"region": table.column("region"), "chunk": table.column("chunk"), **lists, "ends": [i == len(rows) - 1 for i in range(len(rows))]})

    kind = products.schema["region"].dataType.simpleString()
    return products.groupBy("region").applyInArrow(run, f"region {kind}, chunk long, before array<double>, after array<double>, best array<double>, ends boolean")


def _inside(model: Model, ll: np.ndarray, entry: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of states and of moves of a chunk's bins, and its part of the log-likelihood. A region's first bin has no move."""
    top = ll.max(axis=1)
    e = np.exp(ll - top[:, None])
    steps = model.trans[None] * e[:, None, :]
    total = float(top.sum())
    if entry["before"] is None:
        first = model.start * e[0]
        total += float(np.log(first.sum()))
        ahead = _vectors(first, steps[1:])
        fwd, steps = ahead, steps[1:]
    else:
        ahead = _vectors(np.array(entry["before"]), steps)
        fwd = ahead[1:]
    grown = np.einsum("ti,tij->t", ahead[:-1], steps) if len(steps) else np.zeros(0)
    total += float(np.log(grown).sum())
    if entry["ends"]:
        total += float(np.log(fwd[-1] @ model.end))
    inner = steps[len(steps) - (len(ll) - 1) :]
    bwd = _vectors(np.array(entry["after"]), np.transpose(inner, (0, 2, 1))[::-1])[::-1]
    gamma = fwd * bwd
    gamma /= gamma.sum(axis=1, keepdims=True)
    moves = np.zeros((len(ll), model.n, model.n))
    known = len(steps)
    if known:
        x = ahead[:-1, :, None] * model.trans[None] * (e * bwd)[len(ll) - known :, None, :]
        moves[len(ll) - known :] = x / x.sum(axis=(1, 2), keepdims=True)
    return gamma, moves, total


def _entered(bins: DataFrame, model: Model, k: str, best: bool, run, schema: str) -> DataFrame:
    """Runs a function over every chunk with what enters it."""

    def with_entry(table: pa.Table, entry: pa.Table) -> pa.Table:
        return run(table, entry.select(["before", "after", "best", "ends"]).to_pylist()[0])

    entries = chunk_entries(chunk_products(bins, model, k, best), model)
    return bins.groupBy("region", "chunk").cogroup(entries.groupBy("region", "chunk")).applyInArrow(with_entry, schema)


def decode(bins: DataFrame, model: Model, k: str = "reads", posterior: bool = False) -> DataFrame:
    """Adds state, p (array: posterior of each state) and moves (array: row-major transition posteriors) to bins keyed by region.

    The best path through a chunk depends on the state in which it ends, so a chunk first yields a path for each; a pass
    over one row a chunk, from a region's end, then tells which one is the region's. The result is persisted, as that pass and all
    readers of the rows share it; `held` of what is returned is to be unpersisted at the end.
    """
    own = "chunk" in bins.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bins.schema.fields)
    bins = bins if own else chunked(bins)
    n, log_t, prefer = model.n, np.log(model.trans), _prefer(model.n)

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))

    def run(table: pa.Table, entry: dict) -> pa.Table:
        order, x = _in_order(table, [k, "scale"])
        ll = _likelihood(model, x, k)
        gamma, moves, _ = _inside(model, ll, entry)
        m, back = len(ll), [None] * len(ll)
        if posterior:
            paths = np.repeat(posterior_decode(gamma)[:, None], n, axis=1)
        else:
            whole = log_t[None] + ll[:, None, :]
            came = np.empty((m, n), np.int8)
            if entry["best"] is None:
                vectors = _best(np.log(model.start) + ll[0], whole[1:])
                came[0] = 0
            else:
                ahead = _best(np.array(entry["best"]), whole)
                vectors = ahead[1:]
                came[0] = prefer((ahead[:1, :, None] + log_t[None]), 1)[0]
            came[1:] = prefer(vectors[:-1, :, None] + log_t[None], 1)
            paths = _traced(came)
            if entry["ends"]:
                paths = np.repeat(paths[:, prefer((vectors[-1] + np.log(model.end))[None], 1)], n, axis=1)
            back[0] = came[0][paths[0]].tolist()
        out = table.take(pa.array(order))
        names = [f for f in table.column_names if f != "chunk" or own]
        more = {"chunk_": out.column("chunk"), "paths": lists(paths.astype(np.int32)), "back": pa.array(back, pa.list_(pa.int32())), "p": lists(gamma), "moves": lists(moves.reshape(m, -1))}
        return pa.table({c: out.column(c) for c in names} | more)

    schema = f"{fields}, chunk_ long, paths array<int>, back array<int>, p array<double>, moves array<double>"
    held = found = _entered(bins, model, k, not posterior, run, schema).persist()
    state = F.col("paths")[0]
    if not posterior:

        def resolve(table: pa.Table) -> pa.Table:
            table = table.sort_by([("c", "descending")])
            last, ends = 0, []
            for b in table.column("back").to_pylist():
                ends.append(last)
                last = b[last]
            return pa.table({"r": table.column("r"), "c": table.column("c"), "last": pa.array(ends, pa.int32())})

        kind = bins.schema["region"].dataType.simpleString()
        ends = found.where("back IS NOT NULL").select(F.col("region").alias("r"), F.col("chunk_").alias("c"), "back").groupBy("r").applyInArrow(resolve, f"r {kind}, c long, last int")
        # chunks that end in another path than the first; a region of one chunk has one
        found = found.join(ends.where("last > 0"), (F.col("region") == F.col("r")) & (F.col("chunk_") == F.col("c")), "left")
        state = F.element_at("paths", F.coalesce("last", F.lit(0)) + 1)
    out = found.withColumn("state", state).select(*[f"`{c}`" for c in bins.columns if c != "chunk" or own], "state", "p", "moves")
    out.held = held
    return out


def expectations(bins: DataFrame, model: Model, k: str, pair: tuple[str, str] | None) -> tuple[np.ndarray, list[Weighted], float]:
    """One E pass: expected transitions, per state the distinct values with summed posteriors, and the log-likelihood.

    Each chunk sends sums per distinct value; they are added up on the executors before the driver takes them. Without bins there is neither
    a transition nor a value, and the log-likelihood is nan.
    """
    n = model.n
    values = [*dict.fromkeys([k, "scale", *(pair or ())])]
    bins = bins if "chunk" in bins.columns else chunked(bins)

    def run(table: pa.Table, entry: dict) -> pa.Table:
        _, x = _in_order(table, values)
        gamma, moves, total = _inside(model, _likelihood(model, x, k), entry)
        distinct, at = _codes([x[v] for v in values])
        head = np.append(moves.sum(axis=0).ravel(), total)
        kind = np.concatenate([np.zeros(len(distinct[0]), np.int32), np.arange(1, len(head) + 1, dtype=np.int32)])
        out = {"kind": kind} | {v: np.concatenate([d, np.zeros(len(head))]) for v, d in zip(values, distinct, strict=True)}
        sums = [np.bincount(at, gamma[:, i]) for i in range(n)]
        return pa.table(out | {f"g{i}": np.concatenate([g, head if i == 0 else np.zeros(len(head))]) for i, g in enumerate(sums)})

    schema = ", ".join(["kind int", *[f"`{v}` double" for v in values], *[f"g{i} double" for i in range(n)]])
    parts = _entered(bins.select("region", "chunk", "bin", *values), model, k, False, run, schema)
    got = parts.groupBy("kind", *values).agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(n)]).toPandas()
    head = got[got.kind > 0].sort_values("kind")["g0"].to_numpy()
    body = got[got.kind == 0].sort_values(values)
    arrays = {v: body[v].to_numpy(float) for v in values}
    weighted = [Weighted(arrays[k], arrays["scale"], body[f"g{i}"].to_numpy(float), *([arrays[pair[0]], arrays[pair[1]]] if pair else [])) for i in range(n)]
    return (head[:-1].reshape(n, n), weighted, float(head[-1])) if len(head) else (np.zeros((n, n)), weighted, np.nan)


def _ordered(m: Model) -> Model:
    """States by falling mean."""
    order = np.argsort([-d.mean for d in m.emissions], kind="stable")
    return Model([m.emissions[i] for i in order], m.start[order], m.trans[np.ix_(order, order)], m.end[order])


def _swapped(m: Model) -> Model:
    """Of two states, that with the larger mean first; start and end probabilities keep their places."""
    if m.emissions[0].mean >= m.emissions[1].mean:
        return m
    return Model(m.emissions[::-1], m.start, m.trans[::-1, ::-1].copy(), m.end)


def transitions(model: Model, moves: np.ndarray, pair: bool) -> np.ndarray:
    """Transition probabilities from expected transitions: shares of each row, less what ends a region, at least LEAST.

    One sample: each entry less half the row's end probability. A sample against its control: only moves into the second state, and its
    stay, are lessened. Three states: none.
    """
    rows = moves.sum(axis=1, keepdims=True)
    trans = np.where(rows > 0, moves / np.where(rows > 0, rows, 1), model.trans)
    if model.n == 2:
        less = np.stack([np.zeros(2), model.end], axis=1) if pair else np.repeat(model.end[:, None] / 2, 2, axis=1)
        trans = trans - less
    return np.maximum(trans, LEAST)


def em_step(bins: DataFrame, model: Model, k: str = "reads", pair: tuple[str, str] | None = None) -> tuple[Model, float]:
    """One Baum-Welch step: the refitted model, and the log-likelihood under the given one. Start and end probabilities are kept. What no bins are there for is nan."""
    moves, weighted, total = expectations(bins, model, k, pair)
    if np.isnan(total):
        return Model([type(d)([np.nan] * len(d.params)) for d in model.emissions], model.start, np.full_like(model.trans, np.nan), model.end), total
    return Model([d.fitted(w) for d, w in zip(model.emissions, weighted, strict=True)], model.start, transitions(model, moves, pair is not None), model.end), total


def baum_welch(
    bins: DataFrame, model: Model, k: str = "reads", pair: tuple[str, str] | None = None, most: int = 20, tolerance: float = 1e-20, order_states: bool = False
) -> tuple[Model, list[float]]:
    """Trained model and the log-likelihood before each step.

    Two states: ends as soon as the likelihood gains less than `tolerance`; of that last step the emissions are kept and the transitions are
    not. Three states: ends when it changes less, or falls, and keeps the whole step. States are ordered by mean where samples are
    compared; with order_states, in one sample too. Without bins the model stays as it is.
    bins is chunked() and persisted by the caller, so an iteration shuffles one row a chunk and the sums.
    """
    history: list[float] = []
    for _ in range(most):
        new, total = em_step(bins, model, k, pair)
        if np.isnan(total):
            break
        gain = (total - history[-1]) / abs(history[-1]) if history else np.inf
        if model.n == 3:
            new = _ordered(new)
        elif pair or order_states:
            new = _swapped(new)
        if gain < tolerance:
            if model.n == 2:
                new = Model(new.emissions, model.start, model.trans, model.end)
            return new, history
        history.append(total)
        model = new
    return model, history


def mixture(values: Weighted, kinds: list[Distribution], parts: np.ndarray, most: int, tolerance: float = 1e-20, scales_weigh: bool = False) -> tuple[list[Distribution], np.ndarray]:
    """EM of a mixture from a first split (part of each distinct value, shares by weight); runs on the aggregated table.

    Fits that differences refine (refined) are so here, at start-up; training's own steps fit the samples.

    scales_weigh: the first fit takes scales for weights, as the training of one sample does; later ones take them for scales.
    """
    n = len(kinds)
    share = np.stack([(parts == i).astype(float) for i in range(n)], axis=1) if parts.ndim == 1 else parts

    def fit(w: np.ndarray) -> list[Distribution]:
        out = []
        for i, d in enumerate(kinds):
            part = Weighted(values.k, values.s, np.maximum(values.w * w[:, i], 1e-12), values.a, values.b)
            one = d.fitted(part)
            out.append(one.refined(part) if hasattr(one, "refined") else one)
        return out

    mix, last = np.full(n, 1 / n), None
    if scales_weigh:
        dists = [d.fitted(Weighted(values.k, np.ones_like(values.s), np.maximum(values.w * values.s * share[:, i], 1e-12), values.a, values.b)) for i, d in enumerate(kinds)]
    else:
        dists = fit(share)
    for _ in range(most):
        ll = np.stack([d.log_likelihood(values.k, values.s) for d in dists], axis=1) + np.log(mix)
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(ll - top)
        total = float((values.w * (top[:, 0] + np.log(p.sum(axis=1)))).sum())
        p /= p.sum(axis=1, keepdims=True)
        mix = np.maximum((values.w[:, None] * p).sum(axis=0) / values.w.sum(), 1e-6)
        mix /= mix.sum()
        dists = fit(p)
        if last is not None and ((total - last) / abs(last) if n == 2 else abs(total - last) / abs(last)) < tolerance:
            break
        last = total
    return dists, mix


def distinct_values(bins: DataFrame, k: str, pair: tuple[str, str] | None) -> Weighted:
    """The bins' distinct values with their numbers: bounded by caps on counts and discrete scales."""
    cols = [k, "scale", *(pair or ())]
    got = bins.groupBy(*cols).agg(F.count("*").cast("double").alias("_n")).toPandas().sort_values(cols)
    return Weighted(got[k].to_numpy(float), got["scale"].to_numpy(float), got["_n"].to_numpy(float), *([got[pair[0]].to_numpy(float), got[pair[1]].to_numpy(float)] if pair else []))


def mass_parts(x: Weighted, n: int) -> np.ndarray:
    """Shares of the distinct values in n parts of equal mass |k|, from the largest values down; a value at a border is shared."""
    order = np.argsort(-x.k, kind="stable")
    mass = np.abs(x.k[order]) * x.w[order]
    total = mass.sum()
    upto = np.cumsum(mass)
    out = np.zeros((len(x.k), n))
    for i in range(n):
        low, high = i * total / n, (i + 1) * total / n
        inside = np.minimum(upto, high) - np.maximum(upto - mass, low)
        out[order, i] = np.where(mass > 0, np.clip(inside, 0, None) / np.where(mass > 0, mass, 1), float(i == n - 1))
    return out


def first_transitions(mix: np.ndarray, domain: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, trans, end from the mixture's shares and an expected domain size in positions."""
    n = len(mix)
    fg = domain / size if domain / size > 1 else 2.0
    end = np.full(n, END)
    if n == 2:
        bg = max(fg * (1 - mix[0]) / mix[0], 1.0 + 1e-6)
        trans = np.array([[1 - 1 / fg, 1 / fg], [1 / bg, 1 - 1 / bg]])
    else:
        mid = max(mix[1] * fg / (2 * mix[0]), 1.0 + 1e-6)
        stay = np.array([1 - 1 / fg, 1 - 1 / mid, 1 - 1 / fg])
        trans = np.empty((3, 3))
        for i in range(3):
            other = [j for j in range(3) if j != i]
            share = mix[other] / mix[other].sum()
            trans[i, i] = stay[i]
            trans[i, other] = (1 - stay[i]) * share
    return mix.copy(), np.maximum(trans - END, LEAST), end

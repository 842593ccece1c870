"""The programs as functions: one sample, a sample against a control, two samples, unmappable zones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import make
from ..operators import binning, binsize, boundaries, domains, hmm, kmers
from ..operators.hmm import Model


#: Bins of the shuffled control where samples are compared.
CONTROL = 150_000


@dataclass(frozen=True)
class Settings:
    """Options with their defaults; distributions by name."""

    bin_step: int = 50
    bin_size: int = 0
    chooser: str = "empirical"
    smooth: bool = True
    fragment_length: int = 0
    duplicates: bool = False
    max_dead: float = 0.5
    domain_size: float = 20_000
    desert: int = 20_000
    max_iterations: int = 20
    training_size: int = 0
    posterior: bool = False
    posterior_cutoff: float = 0.95
    undefined: int = 3000
    cutoff: float = 0.1
    foreground: str = "nbd"
    background: str = "nbd"
    seed: int = 1
    order_states: bool = False


DIFFERENCE = Settings(posterior_cutoff=0.5, foreground="nbdiff", background="nbdiff")


@dataclass
class Segmentation:
    """What a program yields: every table is a DataFrame to be written or queried.

    Bins are decoded once, when a table is first read, and kept; release() frees them.
    """

    model: Model
    bin_size: int
    bins: DataFrame
    domains: DataFrame
    history: list[float] = field(default_factory=list)
    k: str = "reads"
    counts: tuple[str, ...] = ("reads",)
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for t in self.held:
            t.unpersist()

    def boundary_scores(self) -> DataFrame:
        return boundaries.boundary_scores(self.bins, self.model.n)

    def boundaries(self, seed: int = 1, most: int | None = None, both_ends: bool = True) -> DataFrame:
        """Intervals around domains' ends above what 95 % of shuffled bins reach; without bins there is none.

        most: the shuffled control's bins, of the first 150,000 where samples are compared. both_ends=False: islands that hold a change, once each.
        """
        most = (CONTROL if len(self.counts) > 1 else 0) if most is None else most
        cutoff = boundaries.control_cutoff(self.bins, self.model, self.k, [*dict.fromkeys([self.k, *self.counts, "scale"])] if len(self.counts) > 1 else [self.k], seed=seed, most=most)
        find = boundaries.boundaries if both_ends else boundaries.boundary_islands
        return find(self.boundary_scores(), np.inf if cutoff is None else cutoff, self.model.n)


def choose_bin_size(bins: DataFrame, s: Settings, count: str) -> int:
    if s.bin_size:
        return binsize.rounded_size(s.bin_size, s.bin_step)
    if s.chooser == "hideaki":
        return binsize.hideaki(bins, s.bin_step, s.smooth, count)
    if s.chooser == "waterman":
        return binsize.waterman(bins, s.bin_step, s.smooth, count)
    return binsize.hideaki_empirical(bins, s.bin_step, s.max_dead, count)


def prepare(samples: dict[str, DataFrame], chroms: DataFrame, s: Settings, dead: DataFrame | None) -> tuple[DataFrame, int]:
    """Capped bins of the chosen size, cut into regions and partitioned by them."""
    base = binning.load_bins(samples, chroms, s.bin_step, dead, s.fragment_length, s.duplicates)
    if not s.bin_size:
        base = base.persist()
    names = list(samples)
    size = choose_bin_size(base, s, names[0])
    big = binning.rebin(base, s.bin_step, size, names) if size != s.bin_step else base
    return binning.cap_counts(binning.desert_regions(big, size, s.desert, s.max_dead), size, names), size


def _train(bins: DataFrame, kinds: list[str], k: str, pair, s: Settings, size: int, starts: int) -> tuple[Model, list[float]]:
    values = hmm.distinct_values(bins, k, pair)
    dists, mix = hmm.mixture(values, [make(x) for x in kinds], hmm.mass_parts(values, len(kinds)), starts, scales_weigh=pair is None)
    model = Model(dists, *hmm.first_transitions(mix, s.domain_size, size))
    return hmm.baum_welch(bins, hmm._ordered(model) if pair else model, k, pair, s.max_iterations, order_states=s.order_states)


def _finish(bins: DataFrame, model: Model, k: str, counts: tuple[str, ...], s: Settings, size: int, history: list[float]) -> Segmentation:
    decoded = hmm.decode(bins, model, k, s.posterior)
    scored = decoded.withColumn("p_called", F.element_at("p", F.col("state") + 1))
    labelled = domains.label(scored, "p_called", s.posterior_cutoff, s.undefined, model.n)
    built = domains.build(labelled, k)
    low = -size if len(counts) > 1 else 0
    if model.n == 2:
        kept = domains.filter_two(built, model.emissions[0], s.cutoff, low, size)
    else:
        kept = domains.filter_three(built, model.emissions[0], model.emissions[2], s.cutoff, low, size)
    return Segmentation(model, size, decoded, kept.select("chrom", "start", "end", "state", "mean", "score", "n"), history, k, counts, (bins, decoded.held))


def segment(reads: DataFrame, chroms: DataFrame, settings: Settings = Settings(), dead: DataFrame | None = None, model: Model | None = None) -> Segmentation:
    """Domains enriched in one sample. A given model skips training."""
    bins, size = prepare({"reads": reads}, chroms, settings, dead)
    bins = hmm.chunked(bins).persist()
    history: list[float] = []
    if model is None:
        model, history = _train(bins, [settings.foreground, settings.background], "reads", None, settings, size, 3)
    return _finish(bins, model, "reads", ("reads",), settings, size, history)


def segment_pair(a: DataFrame, b: DataFrame, chroms: DataFrame, settings: Settings = DIFFERENCE, dead: DataFrame | None = None, model: Model | None = None, mode: int = 2) -> Segmentation:
    """mode 2: a against the control b; mode 3: domains in which either sample exceeds the other."""
    if mode not in (2, 3):
        raise ValueError("mode is 2 or 3")
    bins, size = prepare({"a": a, "b": b}, chroms, settings, dead)
    bins = hmm.chunked(bins.withColumn("diff", F.col("a") - F.col("b"))).persist()
    history: list[float] = []
    if model is None:
        s = settings if settings.domain_size > 0 else replace(settings, domain_size=20_000 if mode == 2 else 6000)
        kinds = [s.foreground, s.background] if mode == 2 else [s.foreground, s.background, s.foreground]
        model, history = _train(binning.training_prefix(bins, s.training_size), kinds, "diff", ("a", "b"), s, size, 5)
    return _finish(bins, model, "diff", ("a", "b"), settings, size, history)


def dead_zones(seqs: DataFrame, k: int, prefix: int = 5) -> DataFrame:
    return kmers.dead_zones(seqs, k, prefix)


def fixed_model(kinds: list[str], stay: list[float]) -> Model:
    """A model with given emissions and chances to stay in a state; the rest is shared equally."""
    n = len(kinds)
    trans = np.array([[stay[i] if i == j else (1 - stay[i]) / (n - 1) for j in range(n)] for i in range(n)])
    return Model([make(x) for x in kinds], np.full(n, 1 / n), trans, np.full(n, hmm.END))

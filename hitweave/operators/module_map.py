"""Graphs from a module map: doublets and triplets of hits inside learned thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import wrap_angle
from ..session import cut_lineage
from ..sources.text_dumps import module_map_parts
from .joins import E
from .mapping import label_edges
from .ranking import pair_index

MIDS = ["mid_1", "mid_2", "mid_3"]
CUTS = ["deta", "z0", "dphi", "phiSlope"]
#: Widens the bins of an angle, far beyond its rounding.
ANGLE_SLACK = 1e-9
MAX_BINS = 4096
#: Bins that a range of angles fills.
FINENESS = 4


def _within(value: Column, name: str, suffix: str = "") -> Column:
    return (value < F.col(f"{name}max{suffix}")) & (value > F.col(f"{name}min{suffix}"))


def pair_ranges(thresholds: DataFrame, suffix: str, other: str) -> DataFrame:
    """(mid_2, other module, the widest cuts of all its triples, n_bins) of each module pair.

    The circle is cut into bins of about a quarter of the pair's range of angles, so that the
    partners of a hit lie in five of them.
    """
    widest = []
    for name in CUTS:
        widest += [F.min(f"{name}min{suffix}").alias(f"{name}min{suffix}"), F.max(f"{name}max{suffix}").alias(f"{name}max{suffix}")]
    merged = thresholds.groupBy("mid_2", other).agg(*widest)
    low, high = F.greatest(F.col(f"dphimin{suffix}"), F.lit(-math.pi)), F.least(F.col(f"dphimax{suffix}"), F.lit(math.pi))
    bins = F.floor(FINENESS * 2 * math.pi / F.greatest(high - low + 2 * ANGLE_SLACK, F.lit(2 * math.pi / MAX_BINS)))
    return merged.select("*", F.greatest(F.coalesce(bins, F.lit(1)), F.lit(1)).cast("bigint").alias("n_bins"), low.alias("_low"), high.alias("_high"))


def _bin(angle: Column) -> Column:
    return F.floor((angle + math.pi) / (2 * math.pi) * F.col("n_bins"))


def _met(hits: DataFrame, ranges: DataFrame, first: bool) -> tuple[DataFrame, Column]:
    """Pairs of hits whose angles are near enough for their module pair, and the condition of the pair cuts."""
    suffix, other = ("_12", "mid_1") if first else ("_23", "mid_3")
    columns = ["hit_id", "r", "x", "y", "z", "eta", "phi"]
    middle = hits.select(E, F.col("module_id").alias("mid_2"), *[F.col(c).alias(f"{c}_m") for c in columns])
    outer = hits.select(E, F.col("module_id").alias(other), *[F.col(c).alias(f"{c}_o") for c in columns])
    a, b = ("o", "m") if first else ("m", "o")
    # The partner's angle lies on one side of the middle hit's for the first pair, on the other for the second.
    start, end = (F.col("phi_m") - F.col("_high"), F.col("phi_m") - F.col("_low")) if first else (F.col("phi_m") + F.col("_low"), F.col("phi_m") + F.col("_high"))
    lowest, highest = _bin(start - ANGLE_SLACK), _bin(end + ANGLE_SLACK)
    span = F.sequence(lowest, F.least(highest, lowest + F.col("n_bins") - 1))
    own = F.explode(F.transform(span, lambda i: F.pmod(i, F.col("n_bins")))).alias("_bin")
    open_ = F.col("_low") <= F.col("_high")
    asked = middle.join(ranges.where(open_), "mid_2").select("*", own)
    held = outer.join(ranges.select("mid_2", other, "n_bins"), other).select(E, "mid_2", *outer.columns[1:], F.pmod(_bin(F.col("phi_o")), F.col("n_bins")).alias("_bin"))

    def diff(c: str, start: str, end: str) -> Column:
        return F.col(f"{c}_{end}") - F.col(f"{c}_{start}")

    dr = diff("r", a, b)
    dphi = wrap_angle(diff("phi", a, b))
    z0 = F.col(f"z_{a}") - F.try_divide(F.col(f"r_{a}") * diff("z", a, b), dr)
    passes = (
        _within(diff("eta", b, a), "deta", suffix)
        & _within(z0, "z0", suffix)
        & _within(dphi, "dphi", suffix)
        & _within(F.try_divide(dphi, dr), "phiSlope", suffix)
    )
    return asked.join(held, [E, "mid_2", other, "_bin"]), passes


def doublets(hits: DataFrame, thresholds: DataFrame, first: bool) -> DataFrame:
    """Hit pairs (inner, outer) of the module pair 1-2 or 2-3 that pass the strict pair cuts, for each module triple.

    A hit meets only hits in the bins of the angle that its module pair allows; those pairs are
    tested once against the widest cuts of the pair's triples, and what passes against each of them.
    """
    suffix, other = ("_12", "mid_1") if first else ("_23", "mid_3")
    ranges = pair_ranges(thresholds, suffix, other)
    met, passes = _met(hits, ranges, first)
    kept = met.where(passes).drop(*[c for c in ranges.columns if c not in ("mid_2", other)], "_bin")
    return kept.join(thresholds, ["mid_2", other]).where(passes)


def doublet_work(hits: DataFrame, thresholds: DataFrame, first: bool) -> DataFrame:
    """(event, n_compared, n_all): pairs that the bins bring together, and all pairs of the module pairs."""
    suffix, other = ("_12", "mid_1") if first else ("_23", "mid_3")
    ranges = pair_ranges(thresholds, suffix, other)
    compared = _met(hits, ranges, first)[0].groupBy(E).agg(F.count("*").alias("n_compared"))
    sizes = hits.groupBy(E, F.col("module_id").alias("mid_2")).agg(F.count("*").alias("n_m"))
    others = sizes.select(E, F.col("mid_2").alias(other), F.col("n_m").alias("n_o"))
    every = sizes.join(ranges.select("mid_2", other), "mid_2").join(others, [E, other])
    every = every.groupBy(E).agg(F.sum(F.col("n_m") * F.col("n_o")).alias("n_all"))
    return every.join(compared, E, "left").select(E, F.coalesce("n_compared", F.lit(0).cast("bigint")).alias("n_compared"), "n_all")


def _slope_difference(p: str, q: str, sign: int) -> Column:
    """dp12/dq12 - dp23/dq23, 0 when both denominators vanish.

    The dy/dx form takes its second difference the other way round; ``sign`` keeps that.
    """

    def d(c: str, i: int, j: int) -> Column:
        return F.col(f"{c}_{j}") - F.col(f"{c}_{i}")

    num12, num23 = d(p, 1, 2), d(p, 2, 3) * sign
    den12, den23 = d(q, 1, 2) * sign, d(q, 2, 3) * sign
    both_zero = (den12 == 0) & (den23 == 0)
    return F.when(both_zero, F.lit(0.0)).otherwise(F.try_divide(num12, den12) - F.try_divide(num23, den23))


def triplets(first: DataFrame, second: DataFrame, triplet_thresholds: DataFrame) -> DataFrame:
    """Doublets sharing their middle hit and module triple, inside the strict triplet cuts."""
    inner = first.select(
        E, *MIDS, F.col("hit_id_o").alias("hit_1"), F.col("hit_id_m").alias("hit_2"),
        *[F.col(f"{c}_o").alias(f"{c}_1") for c in "xyrz"], *[F.col(f"{c}_m").alias(f"{c}_2") for c in "xyrz"],
    )
    outer = second.select(
        E, *MIDS, F.col("hit_id_m").alias("hit_2"), F.col("hit_id_o").alias("hit_3"),
        *[F.col(f"{c}_o").alias(f"{c}_3") for c in "xyrz"],
    ).join(triplet_thresholds, MIDS)
    joined = inner.join(outer, [E, *MIDS, "hit_2"])
    dydx = _slope_difference("y", "x", -1)
    dzdr = _slope_difference("z", "r", 1)
    return joined.where(
        (dydx < F.col("diff_dydx_max"))
        & (dydx > F.col("diff_dydx_min"))
        & (dzdr < F.col("diff_dzdr_max"))
        & (dzdr > F.col("diff_dzdr_min"))
    )


def edges_of_triplets(found: DataFrame) -> DataFrame:
    """Distinct union of both legs."""
    legs = F.array(
        F.struct(F.col("hit_1").alias("src"), F.col("hit_2").alias("dst")),
        F.struct(F.col("hit_2").alias("src"), F.col("hit_3").alias("dst")),
    )
    return found.select(E, F.inline(legs)).distinct()


def build_module_map_graph(hits: DataFrame, module_map: DataFrame, track_edges: DataFrame) -> DataFrame:
    """Labelled edges of the module-map graph; ``edge_id`` numbers them in each event."""
    first, second, triplet = module_map_parts(module_map)
    found = triplets(doublets(hits, first, True), doublets(hits, second, False), triplet.dropDuplicates())
    edges = pair_index(cut_lineage(edges_of_triplets(found)), E, "edge_id")
    return label_edges(edges, track_edges)

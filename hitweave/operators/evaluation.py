"""Efficiency, purity, ROC and loss tables over scored edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binomial import interval_udf
from ..session import cut_lineage
from .joins import E, join_per_key
from .ranking import running_sums
from .truth_edges import orient_outward


# ---- bins ----------------------------------------------------------------------
def log_bins(low: float, high: float, n_edges: int) -> list[float]:
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + (b - a) * i / (n_edges - 1)) for i in range(n_edges)]


def linear_bins(low: float, high: float, n_edges: int) -> list[float]:
    return [low + (high - low) * i / (n_edges - 1) for i in range(n_edges)]


def bin_of(value, edges: list[float]) -> Column:
    """0-based bin; the last bin holds its upper edge, values outside give null."""
    v = F.col(value) if isinstance(value, str) else value
    n = len(edges) - 1
    inner = sum(((v >= F.lit(float(e))).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = (v >= F.lit(float(edges[0]))) & (v <= F.lit(float(edges[-1])))
    return F.when(inside, F.least(inner, F.lit(n - 1))).cast("bigint")


def uniform_bin(value, low: float, high: float, n: int) -> Column:
    """Same for many equal bins, by arithmetic."""
    v = F.col(value) if isinstance(value, str) else value
    place = F.floor((v - F.lit(float(low))) / F.lit((high - low) / n))
    return F.when((v >= low) & (v <= high), F.least(place, F.lit(n - 1).cast("bigint")))


def every_bin(df: DataFrame, **sizes: int) -> DataFrame:
    """All combinations of 0-based bins, one column for each keyword; their number is that of the report's rows."""
    total = math.prod(sizes.values())
    rest, columns = F.col("id"), []
    for name, n in reversed(sizes.items()):
        columns.insert(0, F.pmod(rest, F.lit(n)).cast("bigint").alias(name))
        rest = F.floor(rest / n)
    return df.sparkSession.range(total).select(*columns)


def with_empty_bins(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """``counts`` with a row of zeros for each bin that nothing fell into."""
    keys = bins.columns
    joined = bins.join(counts, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts.columns if c not in keys])


def events_of(edges: DataFrame, events: DataFrame | None) -> DataFrame:
    """The distinct event ids that per-event means divide by: of the event table, else of the edges."""
    return (edges if events is None else events).select(E).distinct()


def binned_efficiency(
    df: DataFrame, value, edges: list[float], passed: Column, total: Column | None = None, scale: float = 1.0
) -> DataFrame:
    """(bin, low, high, n_total, n_passed, efficiency); an empty bin has efficiency 0."""
    total = F.lit(True) if total is None else total
    v = (F.col(value) if isinstance(value, str) else value) * F.lit(float(scale))
    counts = (
        df.select(bin_of(v, edges).alias("bin"), total.alias("_t"), (total & passed).alias("_p"))
        .where("bin is not null")
        .groupBy("bin")
        .agg(F.count_if("_t").alias("n_total"), F.count_if("_p").alias("n_passed"))
    )
    counts = with_empty_bins(counts, every_bin(df, bin=len(edges) - 1))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    place = F.col("bin").cast("int")
    return counts.select(
        "bin",
        F.get(bounds, place).alias("low"),
        F.get(bounds, place + 1).alias("high"),
        "n_total",
        "n_passed",
        F.coalesce(F.try_divide("n_passed", "n_total"), F.lit(0.0)).alias("efficiency"),
    )


def add_interval(binned: DataFrame, level: float = 0.68) -> DataFrame:
    """Clopper-Pearson error bars on a binned table."""
    out = binned.withColumn("_err", interval_udf(level)("n_passed", "n_total"))
    return out.select(*binned.columns, "_err.err_low", "_err.err_high")


def binomial_tail(passed, total, p, upper: bool) -> Column:
    """P(X >= passed) or P(X <= passed) of total draws with chance ``p`` strictly between 0 and 1, term by term."""
    k, n = F.col(passed).cast("double"), F.col(total).cast("double")
    start = F.struct((n * F.log1p(-p)).alias("log_term"), F.lit(0.0).alias("sum"))

    def add(seen: Column, i: Column) -> Column:
        inside = (i >= k) if upper else (i <= k)
        term = seen["log_term"] + F.log(F.greatest(n - i, F.lit(0.5)) / (i + 1)) + F.log(p) - F.log1p(-p)
        return F.struct(term.alias("log_term"), (seen["sum"] + F.when(inside, F.exp(seen["log_term"])).otherwise(0.0)).alias("sum"))

    steps = F.transform(F.sequence(F.lit(0), F.col(total).cast("int")), lambda i: i.cast("double"))
    return F.aggregate(steps, start, add, lambda seen: seen["sum"])


def binned_ratio_2d(
    df: DataFrame, numerator: Column, denominator: Column, z: tuple = (-3.0, 3.0, 383), r: tuple = (0.0, 1.0, 63)
) -> DataFrame:
    """Ratio on a (z, r) grid; cells with an empty denominator have a null ratio."""
    cells = df.select(
        uniform_bin("z", *z).alias("z_bin"), uniform_bin("r", *r).alias("r_bin"), numerator.alias("_n"), denominator.alias("_d")
    ).where("z_bin is not null and r_bin is not null")
    counts = cells.groupBy("z_bin", "r_bin").agg(F.count_if("_n").alias("n_numerator"), F.count_if("_d").alias("n_denominator"))
    grid = with_empty_bins(counts, every_bin(df, z_bin=z[2], r_bin=r[2]))
    return grid.withColumn("ratio", F.try_divide("n_numerator", "n_denominator"))


def _placed(edges: DataFrame, hits: DataFrame, unit: float) -> DataFrame:
    """Edges turned outward, with z and r of their inner hit in the given unit."""
    outward = orient_outward(edges, hits)
    inner = hits.select(E, F.col("hit_id").alias("src"), (F.col("z") / unit).alias("z"), (F.col("r") / unit).alias("r"))
    return join_per_key(outward, inner, [E, "src"])


def efficiency_rz(
    track_edges: DataFrame, hits: DataFrame, cut: float, target: Column, z: tuple, r: tuple,
    cumulative: bool = False, unit: float = 1000.0,
) -> DataFrame:
    """Share of target edges above the cut, among the built ones or (``cumulative``) among all."""
    built = F.col("edge_id").isNotNull()
    placed = _placed(track_edges.where(target), hits, unit)
    return binned_ratio_2d(placed, built & (F.col("score") >= cut), F.lit(True) if cumulative else built, z, r)


def purity_rz(
    edges: DataFrame, track_edges: DataFrame, hits: DataFrame, cut: float, target: Column, kind: str, z: tuple, r: tuple,
    unit: float = 1000.0,
) -> DataFrame:
    """Purity of the edges above the cut on a (z, r) grid.

    ``total`` counts all true edges found, ``target`` the target ones, both among all
    positives; ``masked`` counts target edges among themselves and the fakes.
    """
    if kind not in ("total", "target", "masked"):
        raise ValueError(f"unknown purity {kind}")
    found = track_edges.where(F.col("edge_id").isNotNull() & (F.col("score") >= cut))
    found = found if kind == "total" else found.where(target)
    positive = edges.where(F.col("score") >= cut)
    positive = positive.where("not y") if kind == "masked" else positive
    rows = _placed(found.select(E, "src", "dst"), hits, unit).select(
        "z", "r", F.lit(True).alias("_hit"), F.lit(kind == "masked").alias("_all")
    )
    rows = rows.unionByName(
        _placed(positive.select(E, "src", "dst"), hits, unit).select(
            "z", "r", F.lit(False).alias("_hit"), F.lit(True).alias("_all")
        )
    )
    return binned_ratio_2d(rows, F.col("_hit"), F.col("_all"), z, r)


# ---- per-region and global numbers ---------------------------------------------
def region_efficiency_purity(edges: DataFrame, hits: DataFrame, positive: Column) -> DataFrame:
    """By region of the src hit; regions without true or positive edges are left out."""
    src = hits.select(E, F.col("hit_id").alias("src"), "region")
    by_edge = (
        join_per_key(edges, src, [E, "src"])
        .groupBy("region")
        .agg(
            F.count_if("y").alias("n_true"),
            F.count_if(positive).alias("n_positive"),
            F.count_if(F.col("y") & positive).alias("n_true_positive"),
        )
        .where("n_true > 0 and n_positive > 0")
    )
    extent = hits.groupBy("region").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("r", "z") for n, f in (("min", F.min), ("max", F.max))]
    )
    return by_edge.join(extent, "region").withColumns(
        {
            "efficiency": F.col("n_true_positive") / F.col("n_true"),
            "purity": F.col("n_true_positive") / F.col("n_positive"),
        }
    )


def graph_size(edges: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Mean and population standard deviation of edges per event; events without edges count as 0."""
    sizes = edges.groupBy(E).agg(F.count("*").alias("n"))
    sizes = events_of(edges, events).join(sizes, E, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"))


def scoring_summary(
    track_edges: DataFrame, edges: DataFrame, cut: float, target: Column, events: DataFrame | None = None
) -> DataFrame:
    """Target efficiency, purity and construction efficiency at a score cut.

    The mean graph size is over all ``events``, with or without edges.
    ``track_edges`` carries the nullable ``edge_id`` and ``score`` of the built edge.
    """
    built = F.col("edge_id").isNotNull()
    found = built & (F.col("score") >= cut)
    t = track_edges.where(target).agg(
        F.count("*").alias("n_target"), F.count_if(built).alias("n_built"), F.count_if(found).alias("n_found")
    )
    e = edges.groupBy(E).agg(F.count_if(F.col("score") >= cut).alias("n"))
    e = events_of(edges, events).join(e, E, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    e = e.agg(F.sum("n").alias("n_positive"), F.avg("n").alias("mean_graph_size"))
    one = t.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return one.withColumns(
        {
            "target_efficiency": ratio("n_found", "n_built"),
            "target_purity": ratio("n_found", "n_positive"),
            "cumulative_efficiency": ratio("n_found", "n_target"),
            "construction_efficiency": ratio("n_built", "n_target"),
        }
    )


def efficiency_by_cut(track_edges: DataFrame, value: str, edges: list[float], cuts: list[float]) -> DataFrame:
    """Binned efficiency at several score cuts in one pass over the table; null where a bin is empty."""
    counts = (
        track_edges.where("edge_id is not null")
        .select(bin_of(value, edges).alias("bin"), "score")
        .where("bin is not null")
        .groupBy("bin")
        .agg(
            F.count("*").alias("n_total"),
            *[F.count_if(F.col("score") >= c).alias(f"_p{i}") for i, c in enumerate(cuts)],
        )
    )
    counts = with_empty_bins(counts, every_bin(track_edges, bin=len(edges) - 1))
    rows = F.array(
        *[F.struct(F.lit(float(c)).alias("score_cut"), F.col(f"_p{i}").alias("n_passed")) for i, c in enumerate(cuts)]
    )
    out = counts.select("bin", "n_total", F.inline(rows))
    return out.withColumn("efficiency", F.try_divide("n_passed", "n_total"))


# ---- ROC -----------------------------------------------------------------------
def roc_curve(df: DataFrame, truth: Column, score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, ties taken together."""
    by_score = cut_lineage(
        df.groupBy((-F.col(score)).alias("_order")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    )
    totals = by_score.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).withColumn("_k", F.lit(1))
    sums = running_sums(by_score, "_order", {"tp": F.col("pos"), "fp": F.col("neg")})
    curve = sums.withColumn("_k", F.lit(1)).join(F.broadcast(totals), "_k")  # one row
    return curve.select(
        (F.lit(0.0) - F.col("_order")).alias("threshold"),
        (F.col("tp") / F.col("_p")).alias("tpr"),
        (F.col("fp") / F.col("_n")).alias("fpr"),
        "pos",
        "neg",
        "tp",
    )


def area_under_curve(curve: DataFrame) -> DataFrame:
    """Trapezoid area: every score group adds its negatives times the mean tp around it."""
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return curve.agg(F.try_divide(area, n_pos * n_neg).alias("auc"))


KINDS = ("Fake", "Non-target True", "Target True")


def score_histogram(edges: DataFrame, bins: int = 100, events: DataFrame | None = None) -> DataFrame:
    """Counts per event of fakes, target and non-target edges in score bins over the score range.

    Every kind has all bins; the mean is over all ``events``, with or without edges.
    """
    kind = F.when(F.col("weight") <= 0, KINDS[1]).when(F.col("y"), KINDS[2]).otherwise(KINDS[0])
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1
    span = edges.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    # One row of statistics, brought to every row by a constant key.
    spread = edges.withColumn("_k", F.lit(1)).join(F.broadcast(span.withColumn("_k", F.lit(1))), "_k")
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor(F.try_divide(F.col("score") - F.col("_lo"), width)), F.lit(bins - 1).cast("bigint"))
    counts = (
        spread.select(F.coalesce(place, F.lit(0).cast("bigint")).alias("bin"), number.alias("kind"))
        .groupBy("bin", "kind")
        .agg(F.count("*").alias("n"))
    )
    whole = with_empty_bins(counts, every_bin(edges, bin=bins, kind=len(KINDS))).withColumn("_k", F.lit(1))
    total = events_of(edges, events).agg(F.count("*").alias("_events")).withColumn("_k", F.lit(1))
    named = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int"))
    return whole.join(F.broadcast(total), "_k").select(
        "bin", named.alias("kind"), "n", F.try_divide("n", "_events").alias("n_per_event")
    )


# ---- metrics and losses --------------------------------------------------------
def classifier_metrics(edges: DataFrame, cut: float) -> DataFrame:
    """Efficiency and the three purities of scored edges; a target is true with positive weight."""
    positive = F.col("score") > cut
    target = F.col("y") & (F.col("weight") > 0)
    counts = edges.agg(
        F.count_if(positive).alias("n_positive"),
        F.count_if(target).alias("n_target"),
        F.count_if(target & positive).alias("n_target_positive"),
        F.count_if(F.col("y") & positive).alias("n_true_positive"),
    )
    other = F.col("n_positive") - (F.col("n_true_positive") - F.col("n_target_positive"))
    return counts.withColumns(
        {
            "eff": F.try_divide("n_target_positive", "n_target"),
            "target_pur": F.try_divide("n_target_positive", "n_positive"),
            "total_pur": F.try_divide("n_true_positive", "n_positive"),
            "pur": F.try_divide(F.col("n_target_positive"), other),
        }
    )


def construction_metrics(edges: DataFrame, track_edges: DataFrame, signal: DataFrame) -> DataFrame:
    """Efficiency and purity of a built graph, of all and of signal edges, and their f1."""
    e = edges.agg(
        F.count("*").alias("n_pred"),
        F.count_if("y").alias("n_true_pred"),
        F.count_if(F.col("y") & (F.col("weight") > 0)).alias("n_signal_pred"),
    )
    key = lambda df: df.withColumn("_k", F.lit(1))
    counts = (
        key(e)
        .join(key(track_edges.agg(F.count("*").alias("n_true"))), "_k")
        .join(key(signal.agg(F.count("*").alias("n_signal"))), "_k")
        .drop("_k")
    )
    out = counts.withColumns(
        {
            "total_eff": F.try_divide("n_true_pred", "n_true"),
            "signal_eff": F.try_divide("n_signal_pred", "n_signal"),
            "total_pur": F.try_divide("n_true_pred", "n_pred"),
            "signal_pur": F.try_divide("n_signal_pred", "n_pred"),
        }
    )
    f1 = F.try_divide(2 * F.col("signal_eff") * F.col("signal_pur"), F.col("signal_eff") + F.col("signal_pur"))
    return out.withColumn("f1", f1)


def _negative() -> Column:
    return (~F.col("y") & (F.col("weight") != 0)) | (F.col("weight") < 0)


def _positive() -> Column:
    return F.col("y") & (F.col("weight") > 0)


def weighted_log_loss(edges: DataFrame, output: str = "output", balance: str = "proportional") -> DataFrame:
    """Weighted log-loss of raw outputs, positives and negatives reported apart."""
    x = F.col(output)
    # max(x, 0) - x * y + log(1 + exp(-|x|)) never overflows.
    tail = F.log1p(F.exp(-F.abs(x)))
    weight = F.abs("weight")
    pos_term = (F.greatest(x, F.lit(0.0)) - x + tail) * weight
    neg_term = (F.greatest(x, F.lit(0.0)) + tail) * weight
    sums = edges.agg(
        F.coalesce(F.sum(F.when(_positive(), pos_term)), F.lit(0.0)).alias("_pos"),
        F.coalesce(F.sum(F.when(_negative(), neg_term)), F.lit(0.0)).alias("_neg"),
        F.count_if(_positive()).alias("n_pos"),
        F.count_if(_negative()).alias("n_neg"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    loss = (
        F.try_divide("_pos", "n_pos") + F.try_divide("_neg", "n_neg")
        if balance == "equal"
        else F.try_divide(F.col("_pos") + F.col("_neg"), n)
    )
    return sums.select(
        "n_pos",
        "n_neg",
        loss.alias("loss"),
        F.try_divide(F.col("_pos"), n).alias("pos_loss"),
        F.try_divide(F.col("_neg"), n).alias("neg_loss"),
    )


def weighted_hinge_loss(edges: DataFrame, margin: float, distance: str = "distance") -> DataFrame:
    """Mean weighted distance of positives plus mean weighted shortfall of negatives."""
    d, weight = F.col(distance), F.abs("weight")
    short = F.greatest(F.lit(0.0), F.lit(margin * margin) - d)
    return edges.agg(
        F.avg(F.when(_positive(), d * weight)).alias("pos_loss"), F.avg(F.when(_negative(), short * weight)).alias("neg_loss")
    ).withColumn("loss", F.col("pos_loss") + F.col("neg_loss"))


def max_difference(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Greatest absolute difference of a column between two tables aligned by key."""
    a = left.select(*keys, F.col(column).alias("_a"))
    b = right.select(*keys, F.col(column).alias("_b"))
    return a.join(b, keys).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))

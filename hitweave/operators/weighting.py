"""Edge weights from rules, and signal edges from the same rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import all_of, condition
from .joins import E, gather
from .mapping import tracks_to_edges


def weight_edges(
    edges: DataFrame, rules: list[dict], track_edges: DataFrame | None = None, hits: DataFrame | None = None
) -> DataFrame:
    """``weight``: 0 for true edges, 1 for fakes, then each rule in turn overwrites where it holds.

    A condition on a track-edge column holds on the equal edge only; one on a hit
    column holds when either end passes.
    """
    tests: dict[tuple, tuple[str, str, object]] = {}
    for rule in rules:
        for name, spec in rule["conditions"].items():
            if name in edges.columns:
                place = "edge"
            elif track_edges is not None and name in track_edges.columns:
                place = "track"
            elif hits is not None and name in hits.columns:
                place = "node"
            else:
                raise ValueError(f"condition on unknown column {name}")
            tests.setdefault((name, repr(spec)), (f"_c{len(tests)}", place, (name, spec)))

    def flags(place: str) -> dict[str, Column]:
        return {flag: condition(*what) for flag, where, what in tests.values() if where == place}

    out = edges
    on_tracks, on_nodes = flags("track"), flags("node")
    if on_tracks:
        flagged = track_edges.select(E, "edge_id", "track_edge_id", *[c.alias(n) for n, c in on_tracks.items()])
        out = tracks_to_edges(out, flagged, list(on_tracks))
    if on_nodes:
        flagged = hits.select(E, "hit_id", *[c.alias(n) for n, c in on_nodes.items()])
        out = gather(out, flagged, list(on_nodes))
        out = out.withColumns({n: F.col(f"{n}_src") | F.col(f"{n}_dst") for n in on_nodes})
        out = out.drop(*[f"{n}_{s}" for n in on_nodes for s in ("src", "dst")])
    if flags("edge"):
        out = out.withColumns(flags("edge"))

    weight = F.when(F.col("y"), F.lit(0.0)).otherwise(F.lit(1.0))
    for rule in rules:
        used = [F.col(tests[(n, repr(s))][0]) for n, s in rule["conditions"].items()]
        holds = reduce(lambda a, b: a & b, used, F.lit(True))
        weight = F.when(holds, F.lit(float(rule["weight"]))).otherwise(weight)
    return out.withColumn("weight", weight).drop(*[flag for flag, _, _ in tests.values()])


def signal_edges(track_edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Track edges that some positive-weight rule on true edges selects."""
    wanted = [
        all_of({k: v for k, v in rule["conditions"].items() if k != "y"})
        for rule in rules
        if rule["conditions"].get("y") and rule["weight"] > 0
    ]
    return track_edges.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))

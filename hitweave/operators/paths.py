"""Simple paths from sources to sinks of a directed graph.

:func:`long_path_labels` gives every hit the last long path through it without
listing paths: it keeps, per hit and length, only the greatest way in and the
greatest way out. :func:`all_paths` lists every path, :func:`shortest_paths` one per
(source, sink), its rows being the pairs a source can reach.

Directed cycles are taken care of by their strongly connected components: the ways
through a component become nodes of a graph without cycles (:func:`stations`).

Long paths stay within a weak component. So events, and components of larger events, up to a
limit go whole into a task (:mod:`.path_pieces`); larger ones run in rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import components as CC
from . import path_pieces as PP
from .joins import E, endpoints, join_per_key
from .walk import spread_extreme

#: Paths that are numbered off in one row before they are walked.
PATH_BLOCK = 4096
MAX_EDGES = 25
MIN_NODES = 8


def sources_and_sinks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = endpoints(edges).groupBy(E, "hit_id").agg(F.min("place").alias("_lo"), F.max("place").alias("_hi"))
    return ends.where("_hi = 0").select(E, "hit_id"), ends.where("_lo = 1").select(E, "hit_id")


# ---- cycles --------------------------------------------------------------------
def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle or between two: all others lose their hits from both ends on. Written."""
    n, before = edges.count(), None
    while n and n != before:
        entered = edges.select(E, F.col("dst").alias("src")).distinct()
        left = edges.select(E, F.col("src").alias("dst")).distinct()
        kept = join_per_key(join_per_key(edges, entered, [E, "src"], "left_semi"), left, [E, "dst"], "left_semi")
        edges, before = cut_lineage(kept), n
        n = edges.count()
    return edges


def strongly_connected(edges: DataFrame) -> DataFrame | None:
    """(event, hit_id, scc) of the hits on directed cycles, named by their component's least hit; None without cycles.

    What cannot be on a cycle is trimmed away. Each hit of the rest takes the least hit that
    reaches it as its colour; hits that reach the least hit of their own colour are its component.
    """
    core = _trimmed(edges.where("src <> dst").select(E, "src", "dst"))
    found = None
    while core.head(1):
        nodes = endpoints(core).select(E, "hit_id").distinct()
        colours = spread_extreme(nodes.withColumn("colour", F.col("hit_id")), core, "src", "dst", "colour", False)
        ends = [colours.toDF(E, end, f"{end}_colour") for end in ("src", "dst")]
        both = join_per_key(join_per_key(core, ends[0], [E, "src"]), ends[1], [E, "dst"])
        inside = cut_lineage(both.where("src_colour = dst_colour").select(E, "src", "dst"))
        back = F.when(F.col("hit_id") == F.col("colour"), 0).otherwise(1).alias("back")
        reached = spread_extreme(colours.select(E, "hit_id", "colour", back), inside, "dst", "src", "back", False)
        done = cut_lineage(reached.where("back = 0").select(E, "hit_id", F.col("colour").alias("scc")))
        sizes = done.groupBy(E, "scc").count().where("count > 1").select(E, "scc")
        part = cut_lineage(join_per_key(done, sizes, [E, "scc"], "left_semi").select(E, "hit_id", "scc"))
        found = part if found is None else found.unionByName(part)
        gone = [done.select(E, F.col("hit_id").alias(end)) for end in ("src", "dst")]
        rest = join_per_key(join_per_key(core, gone[0], [E, "src"], "left_anti"), gone[1], [E, "dst"], "left_anti")
        core = _trimmed(cut_lineage(rest))
    return found


def _passages(edges: DataFrame, members: DataFrame, max_edges: int | None) -> DataFrame:
    """(event, entry, exit, hits): the simple ways through each component, from where it is entered to where it is left."""
    ends = [members.toDF(E, end, f"{end}_scc") for end in ("src", "dst")]
    placed = join_per_key(join_per_key(edges, ends[0], [E, "src"], "left"), ends[1], [E, "dst"], "left")
    placed = cut_lineage(placed.withColumn("inside", F.coalesce(F.col("src_scc") == F.col("dst_scc"), F.lit(False))))
    inside = placed.where("inside").select(E, F.col("src").alias("exit"), "dst")
    entries = placed.where("NOT inside AND dst_scc IS NOT NULL").select(E, F.col("dst").alias("entry")).distinct()
    exits = placed.where("NOT inside AND src_scc IS NOT NULL").select(E, F.col("src").alias("exit")).distinct()
    front = cut_lineage(entries.select(E, "entry", F.col("entry").alias("exit"), F.array("entry").alias("hits")))
    whole = front
    while max_edges is None or max_edges > 0:
        moved = front.join(inside, [E, "exit"]).where(~F.array_contains("hits", F.col("dst")))
        if max_edges is not None:
            moved = moved.where(F.size("hits") <= max_edges)
        front = cut_lineage(moved.select(E, "entry", F.col("dst").alias("exit"), F.concat("hits", F.array("dst")).alias("hits")))
        if not front.head(1):
            break
        whole = whole.unionByName(front)
    return whole.join(exits, [E, "exit"], "left_semi").select(E, "entry", "exit", "hits")


def stations(edges: DataFrame, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(event, station, hits) and (event, src, dst) between stations: an acyclic graph with the same simple paths.

    A hit off all cycles is a station of its own, under its id. A path enters a strongly connected
    component once and leaves it for good, so each simple way through one is a station too, under
    a negative number.
    """
    edges = edges.where("src <> dst")
    own = endpoints(edges).select(E, "hit_id").distinct()
    members = strongly_connected(edges)
    if members is None:
        return own.select(E, F.col("hit_id").alias("station"), F.array("hit_id").alias("hits")), edges.select(E, "src", "dst")
    members = cut_lineage(members)
    ways = _passages(edges, members, max_edges)
    numbered = cut_lineage(ways.select(E, (-1 - F.monotonically_increasing_id()).alias("station"), "entry", "exit", "hits"))
    free = join_per_key(own, members.select(E, "hit_id"), [E, "hit_id"], "left_anti")
    alone = free.select(E, F.col("hit_id").alias("station"), F.col("hit_id").alias("entry"), F.col("hit_id").alias("exit"), F.array("hit_id").alias("hits"))
    every = cut_lineage(alone.unionByName(numbered))
    scc = members.select(E, F.col("hit_id"), "scc")
    ends = [scc.toDF(E, end, f"{end}_scc") for end in ("src", "dst")]
    placed = join_per_key(join_per_key(edges, ends[0], [E, "src"], "left"), ends[1], [E, "dst"], "left")
    between = placed.where("NOT coalesce(src_scc = dst_scc, false)").select(E, F.col("src").alias("exit"), F.col("dst").alias("entry"))
    links = between.join(every.select(E, "exit", F.col("station").alias("src")), [E, "exit"])
    links = links.join(every.select(E, "entry", F.col("station").alias("dst")), [E, "entry"])
    return every.select(E, "station", "hits"), cut_lineage(links.select(E, "src", "dst"))


# ---- long paths ----------------------------------------------------------------
def _best_ways(links: DataFrame, places: DataFrame, seeds: DataFrame, near: str, far: str, max_edges: int | None, grow) -> DataFrame:
    """(event, station, steps, way): the greatest way of each length between the station and a seed, both included."""
    steps = (F.size("way") - 1).alias("steps")
    first = seeds.select(E, F.col("hit_id").alias("station"))
    front = cut_lineage(first.join(places, [E, "station"]).select(E, "station", F.col("hits").alias("way")).select("*", steps))
    whole = front
    while True:
        moved = front.join(links.select(E, F.col(near).alias("station"), F.col(far).alias("_to")), [E, "station"])
        moved = moved.select(E, F.col("_to").alias("station"), "way").join(places, [E, "station"])
        grown = moved.select(E, "station", grow(F.col("way"), F.col("hits")).alias("way")).select("*", steps)
        if max_edges is not None:
            grown = grown.where(F.col("steps") <= max_edges)
        front = cut_lineage(grown.groupBy(E, "station", "steps").agg(F.max("way").alias("way")).select(E, "station", "way", "steps"))
        if not front.head(1):
            break
        whole = whole.unionByName(front)
    return whole.groupBy(E, "station", "steps").agg(F.max("way").alias("way"))


def _long_paths_by_rounds(edges: DataFrame, min_nodes: int, max_edges: int | None) -> DataFrame:
    """(event, hit_id, path) of every hit on an edge, by rounds; any component size."""
    edges = cut_lineage(edges.select(E, "src", "dst").distinct())
    sources, sinks = sources_and_sinks(edges)
    places, links = stations(edges, max_edges)
    into = _best_ways(links, places, sources, "src", "dst", max_edges, lambda way, hits: F.concat(way, hits))
    out = _best_ways(links, places, sinks, "dst", "src", max_edges, lambda way, hits: F.concat(hits, way))
    before = into.select(E, "station", F.col("way").alias("prefix"))
    after = out.select(E, "station", F.col("way").alias("suffix"))
    n_hits = F.size("prefix") + F.size("suffix") - F.size("hits")
    through = before.join(after, [E, "station"]).join(places, [E, "station"]).where(n_hits >= min_nodes)
    if max_edges is not None:
        through = through.where(n_hits <= max_edges + 1)
    # The suffix repeats the station itself, which leaves its order among suffixes unchanged.
    best = through.groupBy(E, "station", "hits").agg(F.max(F.struct("prefix", "suffix")).alias("_best"))
    path = F.concat("_best.prefix", F.slice("_best.suffix", F.size("hits") + 1, F.size("_best.suffix"))).alias("path")
    of_hit = best.select(E, F.explode("hits").alias("hit_id"), path).groupBy(E, "hit_id").agg(F.max("path").alias("path"))
    nodes = endpoints(edges).select(E, "hit_id").distinct()
    return nodes.join(of_hit, [E, "hit_id"], "left").select(E, "hit_id", "path")


def _pieces(edges: DataFrame, max_edges: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(event, piece, src, dst) of pieces for one task each, and of larger ones, if there are any.

    An event is one piece, or, if it has too many edges, each of its weak components is.
    """
    too_many = F.col("count") > PP.piece_edges(max_edges)
    large = cut_lineage(edges.groupBy(E).count().where(too_many).select(E))
    if not large.head(1):
        return edges.withColumn("piece", F.lit(0).cast("bigint")).select(E, "piece", "src", "dst"), None
    rest = cut_lineage(join_per_key(edges, large, [E], "left_semi"))
    labels = CC.component_labels(rest).select(E, F.col("hit_id").alias("src"), F.col("component").alias("piece"))
    # A hit whose only edge is a loop has no component and is a piece of its own.
    labelled = join_per_key(rest, labels, [E, "src"], "left").select(E, F.coalesce("piece", "src").alias("piece"), "src", "dst")
    labelled = cut_lineage(labelled)
    whole = join_per_key(edges, large, [E], "left_anti").select(E, F.lit(0).cast("bigint").alias("piece"), "src", "dst")
    large = cut_lineage(labelled.groupBy(E, "piece").count().where(too_many).select(E, "piece"))
    small = whole.unionByName(join_per_key(labelled, large, [E, "piece"], "left_anti"))
    return small, join_per_key(labelled, large, [E, "piece"], "left_semi") if large.head(1) else None


def _long_paths(edges: DataFrame, min_nodes: int, max_edges: int | None) -> DataFrame:
    """(event, hit_id, path, first) of every hit on an edge; ``first`` is the least hit that carries the path."""
    small, large = _pieces(cut_lineage(edges.select(E, "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")), max_edges)
    dealt = small.repartition(E, "piece").sortWithinPartitions(E, "piece")
    found = cut_lineage(dealt.mapInArrow(PP.label_pieces(min_nodes, max_edges, PP.PIECE_WAYS), PP.SCHEMA))
    given_up = found.where("hit_id IS NULL").select(E, "piece")
    if given_up.head(1):
        more = join_per_key(small, given_up, [E, "piece"], "left_semi")
        large = more if large is None else large.unionByName(more)
    paths = found.where("hit_id IS NOT NULL").select(E, "hit_id", "path", "first")
    if large is None:
        return paths
    rounds = cut_lineage(_long_paths_by_rounds(large, min_nodes, max_edges))
    firsts = rounds.where("path IS NOT NULL").groupBy(E, "path").agg(F.min("hit_id").alias("first"))
    return paths.unionByName(rounds.join(firsts, [E, "path"], "left").select(E, "hit_id", "path", "first"))


def long_path_labels(edges: DataFrame, min_nodes: int = MIN_NODES, max_edges: int | None = MAX_EDGES) -> DataFrame:
    """(event, hit_id, path) of every hit on an edge; path is null off the long paths.

    Paths are simple and run from a hit without incoming to one without outgoing edges, have at
    least ``min_nodes`` hits and at most ``max_edges`` edges (``None``: any number); the last in
    id order that holds a hit labels it. Off cycles a hit has one row per direction and length,
    each with one way of that length; on cycles the ways through a component are listed.
    """
    return _long_paths(edges, min_nodes, max_edges).select(E, "hit_id", "path")


def all_simple_path_tracks(
    component_labels: DataFrame,
    edges: DataFrame,
    low: float,
    high: float,
    keep_components: bool = False,
    min_nodes: int = MIN_NODES,
    max_edges: int | None = MAX_EDGES,
) -> DataFrame:
    """(event, hit_id, track_id): component labels, overwritten on the residual graph.

    Hits on an edge with ``low < score < high`` take the label of their long path, or
    -1 when they lie on none (``keep_components`` keeps the component label then).
    A path's label is the least hit that carries it, moved past all component labels.
    """
    residual = edges.where((F.col("score") > low) & (F.col("score") < high))
    paths = _long_paths(residual, min_nodes, max_edges).select(E, "hit_id", "first")
    shift = component_labels.groupBy(E).agg((F.max("hit_id") + 1).alias("_shift"))
    named = join_per_key(paths, shift, [E], "left")
    residual_hits = named.select(E, "hit_id", (F.col("first") + F.col("_shift")).alias("_path_id"), F.lit(True).alias("_residual"))
    joined = component_labels.join(residual_hits, [E, "hit_id"], "left")
    fallback = F.col("track_id") if keep_components else F.when(F.col("_residual"), -1).otherwise(F.col("track_id"))
    return joined.select(E, "hit_id", F.coalesce("_path_id", fallback).cast("bigint").alias("track_id"))


def shortest_paths(edges: DataFrame, cut: float) -> DataFrame:
    """(event, start, end, path) over ``score > cut``: one shortest path per reachable sink, least ids first."""
    edges = cut_lineage(edges.where(F.col("score") > cut).select(E, "src", "dst").distinct())
    sources, sinks = sources_and_sinks(edges)
    front = cut_lineage(sources.select(E, F.col("hit_id").alias("start"), "hit_id", F.array("hit_id").alias("path")))
    whole = front
    while True:
        moved = front.join(edges.select(E, F.col("src").alias("hit_id"), "dst"), [E, "hit_id"]).select(
            E, "start", F.col("dst").alias("hit_id"), F.concat("path", F.array("dst")).alias("path")
        )
        reached = moved.groupBy(E, "start", "hit_id").agg(F.min("path").alias("path"))
        front = cut_lineage(reached.join(whole.select(E, "start", "hit_id"), [E, "start", "hit_id"], "left_anti"))
        if not front.head(1):
            break
        whole = whole.unionByName(front)
    ends = whole.join(sinks, [E, "hit_id"], "left_semi")
    return ends.where("start <> hit_id").select(E, "start", F.col("hit_id").alias("end"), "path")


def shortest_path_labels(paths: DataFrame) -> DataFrame:
    """(event, hit_id, start, end): the first path, by start then end, that holds the hit."""
    rows = paths.select(E, "start", "end", F.explode("path").alias("hit_id"))
    return rows.groupBy(E, "hit_id").agg(F.min(F.struct("start", "end")).alias("_t")).select(E, "hit_id", "_t.*")


# ---- all paths -----------------------------------------------------------------
def path_counts(links: DataFrame, sinks: DataFrame) -> DataFrame:
    """(event, station, n_paths): the number of ways from each station to a sink, of an acyclic graph. Written."""
    count_type = "decimal(38,0)"
    front = cut_lineage(sinks.select(E, F.col("hit_id").alias("station"), F.lit(1).cast(count_type).alias("n")))
    whole = front
    while True:
        after = front.select(E, F.col("station").alias("dst"), "n")
        more = join_per_key(links, after, [E, "dst"]).groupBy(E, F.col("src").alias("station"))
        front = cut_lineage(more.agg(F.sum("n").cast(count_type).alias("n")))
        if not front.head(1):
            break
        whole = whole.unionByName(front)
    return cut_lineage(whole.groupBy(E, "station").agg(F.sum("n").cast(count_type).alias("n_paths")))


def all_paths(edges: DataFrame, cut: float, block: int = PATH_BLOCK) -> DataFrame:
    """(event, start, end, path): every simple path over ``score > cut`` from a hit without incoming to one without outgoing edges.

    The ways from each hit are counted first. A path is then a source and a number below its
    count, and each step of it follows from the number: the choices at a hit divide the numbers
    into ranges. So the paths are dealt out evenly before any of them is walked.
    """
    edges = cut_lineage(edges.where(F.col("score") > cut).select(E, "src", "dst").distinct())
    sources, sinks = sources_and_sinks(edges)
    places, links = stations(edges)
    counts = path_counts(links, sinks)
    ranked = join_per_key(links, counts.select(E, F.col("station").alias("dst"), "n_paths"), [E, "dst"])
    earlier = Window.partitionBy(E, "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("n_paths").over(earlier), F.lit(0)).cast("bigint").alias("low")
    choices = cut_lineage(ranked.select(E, F.col("src").alias("station"), "dst", low, F.col("n_paths").cast("bigint").alias("n")))
    from_ = counts.join(sources.select(E, F.col("hit_id").alias("station")), [E, "station"], "left_semi")
    ends = F.col("n_paths").cast("bigint")
    starts = from_.select(E, "station", ends.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), ends - 1, F.lit(block).cast("bigint"))).alias("at"))
    numbers = F.explode(F.sequence("at", F.least(F.col("at") + block, F.col("n")) - 1)).alias("number")
    dealt = starts.repartition(E, "station", "at").select(E, "station", numbers)
    front = cut_lineage(dealt.join(places, [E, "station"]).select(E, F.col("station").alias("start"), "station", "number", F.col("hits").alias("path")))
    done = None
    while front.head(1):
        step = join_per_range(front, choices).join(places.select(E, F.col("station").alias("dst"), "hits"), [E, "dst"])
        moved = step.select(E, "start", F.col("dst").alias("station"), (F.col("number") - F.col("low")).alias("number"), F.concat("path", "hits").alias("path"))
        marked = moved.join(sinks.select(E, F.col("hit_id").alias("station"), F.lit(True).alias("_last")), [E, "station"], "left")
        marked = cut_lineage(marked)
        ended = marked.where("_last").select(E, "start", F.col("station").alias("end"), "path")
        done = ended if done is None else done.unionByName(ended)
        front = marked.where("_last IS NULL").drop("_last")
    if done is None:
        return front.select(E, "start", F.col("station").alias("end"), "path")
    return done


def join_per_range(front: DataFrame, choices: DataFrame) -> DataFrame:
    """Each path's row beside the choice in whose range its number lies."""
    met = front.join(choices, [E, "station"])
    return met.where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("low") + F.col("n")))

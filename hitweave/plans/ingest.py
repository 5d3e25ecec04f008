"""From parsed dumps to truth hits, particles and the graph tables of all events.

Each stage reads the one before several times, so stage results are written to the
shared folder once instead of being computed again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import truth as T
from ..operators import truth_edges as W
from ..operators.joins import E, first_rows
from ..operators.ranking import pair_index
from ..session import cut_lineage
from ..sources.text_dumps import clean_module_lookup


@dataclass(frozen=True)
class IngestConfig:
    regions: dict[int, dict]
    module_columns: tuple[str, ...] = ("barrel_endcap", "hardware", "layer_disk", "eta_module", "phi_module")
    track_features: tuple[str, ...] = ("pt",)
    processing: tuple[str, ...] = field(default=())


def build_truth(
    particles: DataFrame, clusters: DataFrame, links: DataFrame, spacepoints: DataFrame, lookup: DataFrame,
    config: IngestConfig,
) -> tuple[DataFrame, DataFrame]:
    """(truth hits, detectable particles) from the parsed dumps."""
    numbered = T.particle_ids(particles)
    expanded = cut_lineage(T.expand_clusters(clusters, links, numbered))
    detectable = cut_lineage(T.detectable_particles(numbered, expanded))
    truth = T.clean_spacepoints(T.match_spacepoints(spacepoints, expanded))
    truth = T.mask_undetectable(truth, detectable)
    truth = truth.withColumn("region", T.region_label(config.regions))
    return cut_lineage(T.add_module_id(truth, clean_module_lookup(lookup))), detectable


def build_event_graph(truth: DataFrame, particles: DataFrame, config: IngestConfig) -> tuple[DataFrame, DataFrame]:
    """(nodes, track edges): features, truth edges, dense node numbers, unique edges."""
    # Noise first, while its rows are short; particles change nothing on them. A missing particle is noise.
    truth = T.drop_noise_duplicates(truth.fillna(0, ["particle_id"]))
    hits = T.add_particles(truth, particles, list(config.track_features))
    hits = hits.withColumns({"r": G.radius("x", "y"), "phi": G.azimuth("x", "y")})
    hits = cut_lineage(T.add_production_distance(hits))
    edges = W.build_truth_edges(hits, list(config.module_columns), [*config.track_features, "nhits"])
    edges = W.unique_edges(W.mark_redundant(edges).repartition(E, "src"))
    if config.processing:
        from .hooks import process

        hits, particles, edges = process(list(config.processing), hits, particles, edges)
    nodes, edges = W.remap_nodes(hits, edges)
    # A hit on several particles is one node.
    return first_rows(nodes, [E, "hit_id"]), pair_index(cut_lineage(edges), E, "track_edge_id")

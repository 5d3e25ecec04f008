"""Column names, types and renames of the raw readout formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names and types of the raw dumps, as the formats define them.
PARTICLE_TYPES = {
    "subevent": "bigint", "barcode": "bigint", "px": "float", "py": "float", "pz": "float", "pt": "float",
    "eta": "float", "vx": "float", "vy": "float", "vz": "float", "radius": "float", "status": "int",
    "charge": "float", "pdgId": "int", "pass": "string", "vProdNIn": "int", "vProdNOut": "int",
    "vProdStatus": "int", "vProdBarcode": "bigint",
}
COORDINATE_COLUMNS = ["cluster_id", "hardware", "cluster_x", "cluster_y", "cluster_z"]
REGION_COLUMNS = ["barrel_endcap", "layer_disk", "eta_module", "phi_module", "side"]
NORM_COLUMNS = ["norm_x", "norm_y", "norm_z"]
SHAPE_LONG = [
    "count", "charge_count", "loc_eta", "loc_phi", "localDir0", "localDir1", "localDir2",
    "lengthDir0", "lengthDir1", "lengthDir2", "glob_eta", "glob_phi", "eta_angle", "phi_angle",
]
SHAPE_SHORT = ["eta_angle", "phi_angle"]
MODULE_LOOKUP_SCHEMA = (
    "hardware string, barrel_endcap int, layer_disk int, eta_module int, phi_module int,"
    " centerMod_z double, centerMod_x double, centerMod_y double, ID bigint, side int"
)
MODULE_COLUMNS = ["hardware", "barrel_endcap", "layer_disk", "eta_module", "phi_module"]
MODULE_MAP_PAIR_FEATURES = ["z0", "dphi", "phiSlope", "deta"]
MODULE_MAP_TRIPLET_FEATURES = ["diff_dzdr", "diff_dydx"]
MODULE_MAP_COLUMNS = [
    "mid_1", "mid_2", "mid_3", "occurence",
    *[f"{f}{side}_{pair}" for pair in ("12", "23") for f in MODULE_MAP_PAIR_FEATURES for side in ("max", "min")],
    *[f"{f}_{side}" for f in MODULE_MAP_TRIPLET_FEATURES for side in ("max", "min")],
]
BRANCH_NAMES = {
    "Part_event_number": "subevent", "Part_barcode": "barcode", "Part_px": "px", "Part_py": "py",
    "Part_pz": "pz", "Part_pt": "pt", "Part_eta": "eta", "Part_vx": "vx", "Part_vy": "vy", "Part_vz": "vz",
    "Part_radius": "radius", "Part_status": "status", "Part_charge": "charge", "Part_pdg_id": "pdgId",
    "Part_passed": "pass", "Part_vProdNin": "vProdNIn", "Part_vProdNout": "vProdNOut",
    "Part_vProdStatus": "vProdStatus", "Part_vProdBarcode": "vProdBarcode",
    "SPindex": "hit_id", "SPx": "x", "SPy": "y", "SPz": "z", "SPCL1_index": "cluster_index_1",
    "SPCL2_index": "cluster_index_2",
    "CLindex": "cluster_id", "CLhardware": "hardware", "CLx": "cluster_x", "CLy": "cluster_y", "CLz": "cluster_z",
    "CLbarrel_endcap": "barrel_endcap", "CLlayer_disk": "layer_disk", "CLeta_module": "eta_module",
    "CLphi_module": "phi_module", "CLside": "side", "CLmoduleID": "module_id", "CLpixel_count": "count",
    "CLcharge_count": "charge_count", "CLloc_eta": "loc_eta", "CLloc_phi": "loc_phi",
    "CLloc_direction1": "localDir0", "CLloc_direction2": "localDir1", "CLloc_direction3": "localDir2",
    "CLJan_loc_direction1": "lengthDir0", "CLJan_loc_direction2": "lengthDir1",
    "CLJan_loc_direction3": "lengthDir2", "CLglob_eta": "glob_eta", "CLglob_phi": "glob_phi",
    "CLeta_angle": "eta_angle", "CLphi_angle": "phi_angle", "CLnorm_x": "norm_x", "CLnorm_y": "norm_y",
    "CLnorm_z": "norm_z", "CLparticleLink_eventIndex": "subevent", "CLparticleLink_barcode": "barcode",
}
CLUSTER_SIDE_FLOATS = [
    "cluster_x", "cluster_y", "cluster_z", "eta_angle", "phi_angle", "norm_x", "norm_y", "norm_z", "loc_eta",
    "loc_phi", "localDir0", "localDir1", "localDir2", "glob_eta", "glob_phi",
]

SPACEPOINT_TYPES = {
    "cluster_index_1": "bigint",
    "cluster_index_2": "bigint",
    "hardware": "string",
    **{c: "int" for c in ("barrel_endcap", "layer_disk", "eta_module", "phi_module")},
    **{f"{c}_{side}": "float" for c in CLUSTER_SIDE_FLOATS for side in (1, 2)},
    **{f"{c}_{side}": "int" for c in ("count", "charge_count") for side in (1, 2)},
}


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the columns named in ``types``, leave the others and the order alone."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def rename_branches(df: DataFrame) -> DataFrame:
    unknown = [c for c in df.columns if c != "event_id" and c not in BRANCH_NAMES]
    if unknown:
        raise ValueError(f"unknown branches: {unknown}")
    return df.select(*[F.col(c).alias(BRANCH_NAMES.get(c, c)) for c in df.columns])

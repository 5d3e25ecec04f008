"""The adapter tables once more, in the SQL dialect of the oracle."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def with_tables(*names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named tables and what they need, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{clauses}\n{body.strip()}"


cte("hits0", """
SELECT event_id // 500 AS event_id, event_id % 500 AS hit_id, user_id % 40 AS u,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type = 'error' AS noise, value
FROM events""")
cte("hits1", "SELECT *, k // 10 AS layer, k % 10 AS s FROM hits0", "hits0")
cte("hits", """
SELECT event_id, hit_id, CASE WHEN noise THEN 0 ELSE u + 1 END AS particle_id,
       CAST((layer + 1) * (2 * ((u * 7) % 11) - 11) * 10 + s - 5 AS DOUBLE) AS x,
       CAST((layer + 1) * (2 * ((u * 5) % 13) - 13) * 10 - s + 4 AS DOUBLE) AS y,
       CAST((layer + 1) * ((u * 13) % 41 - 20) * 10 AS DOUBLE) + value AS z,
       layer * 10 + u % 10 AS module_id, layer, layer % 6 + 1 AS region,
       CASE WHEN layer < 5 THEN 'PIXEL' ELSE 'STRIP' END AS hardware,
       u % 3 - 1 AS barrel_endcap, layer AS layer_disk, u % 5 AS eta_module, s AS phi_module,
       value AS deposit
FROM hits1""", "hits1")
cte("particles", """
SELECT event_id, particle_id, 199990 + particle_id AS barcode,
       CAST((particle_id * 37) % 50 AS DOUBLE) / 10 AS pt,
       CAST(particle_id % 3 - 1 AS DOUBLE) AS vx, CAST(particle_id % 5 - 2 AS DOUBLE) AS vy,
       CAST(particle_id % 7 - 3 AS DOUBLE) AS vz, CAST(particle_id % 3 - 1 AS DOUBLE) AS charge,
       CAST(CASE WHEN particle_id % 9 = 0 THEN 11 WHEN particle_id % 9 = 1 THEN -11 ELSE 211 END AS BIGINT) AS pdg_id,
       CAST(particle_id % 17 - 8 AS DOUBLE) / 2 AS eta_particle
FROM (SELECT DISTINCT event_id, particle_id FROM hits WHERE particle_id <> 0)""", "hits")
cte("edges", """
SELECT s.event_id, s.hit_id * 500 + d.hit_id AS edge_id, s.hit_id AS src, d.hit_id AS dst,
       (s.particle_id = d.particle_id AND s.particle_id <> 0) AS y,
       CAST(CASE WHEN s.particle_id = d.particle_id AND s.particle_id <> 0
            THEN 350 + (s.hit_id * 31 + d.hit_id * 17) % 650
            ELSE (s.hit_id * 31 + d.hit_id * 17) % 610 END AS DOUBLE) / 1000 AS score
FROM hits s JOIN hits d ON s.event_id = d.event_id AND d.module_id = s.module_id + 10""", "hits")
cte("vectors", """
SELECT vec_id // 100 AS event_id, vec_id % 100 AS hit_id, CAST(embedding AS DOUBLE[]) AS embedding,
       CAST(label AS BIGINT) AS particle_id
FROM embeddings""")
cte("detector", """
SELECT p_partkey AS geometry_id, p_partkey % 4 AS volume_id, (p_partkey // 4) % 5 AS layer_id,
       p_partkey // 20 AS module_id, CAST(p_size AS DOUBLE) AS cx, CAST(p_size * 2 AS DOUBLE) AS cy,
       CAST(p_partkey % 100 - 50 AS DOUBLE) AS cz,
       1.0::DOUBLE AS rot_xu, CAST(p_size % 3 AS DOUBLE) / 10 AS rot_xv, 0.0::DOUBLE AS rot_xw,
       CAST(p_size % 5 AS DOUBLE) / -10 AS rot_yu, 1.0::DOUBLE AS rot_yv, CAST(p_size % 7 AS DOUBLE) / 10 AS rot_yw,
       0.0::DOUBLE AS rot_zu, CAST(p_size % 2 AS DOUBLE) / 4 AS rot_zv, 1.0::DOUBLE AS rot_zw,
       CAST(p_size AS DOUBLE) / 1000 AS pitch_u, CAST(p_size + 5 AS DOUBLE) / 1000 AS pitch_v,
       CAST(p_size AS DOUBLE) / 200 AS module_t
FROM part""")
cte("measurements", """
SELECT o_orderkey // 250 AS event_id, o_orderkey % 250 AS measurement_id, o_custkey AS geometry_id,
       CAST(o_orderkey % 21 - 10 AS DOUBLE) / 10 AS local0, CAST(o_custkey % 13 - 6 AS DOUBLE) / 10 AS local1
FROM orders""")
cte("cells", """
SELECT l_orderkey // 250 AS event_id, l_orderkey % 250 AS hit_id, l_partkey % 50 AS ch0, l_suppkey % 50 AS ch1,
       l_quantity AS value
FROM lineitem""")
cte("raw_particles", """
SELECT *, CAST(barcode % 11 - 5 AS DOUBLE) AS px, CAST(barcode % 7 - 3 AS DOUBLE) AS py,
       CAST(barcode % 13 - 6 AS DOUBLE) AS pz, CAST(barcode % 3 - 1 AS DOUBLE) AS charge,
       CAST(barcode % 5 AS DOUBLE) AS vx, CAST(barcode % 4 AS DOUBLE) AS vy, CAST(barcode % 9 AS DOUBLE) AS vz,
       CAST(CASE WHEN barcode % 2 = 0 THEN 11 ELSE 211 END AS BIGINT) AS pdg_id
FROM (SELECT DISTINCT o_orderkey // 250 AS event_id, o_custkey % 2 AS subevent, o_custkey % 61 AS barcode FROM orders)
""")
cte("raw_clusters", """
SELECT o_orderkey // 250 AS event_id, o_orderkey % 250 + 1 AS cluster_id,
       CASE WHEN o_orderstatus = 'F' THEN 'PIXEL' ELSE 'STRIP' END AS hardware,
       o_custkey % 3 - 1 AS barrel_endcap, o_custkey % 4 AS layer_disk, o_custkey % 5 AS eta_module,
       o_custkey % 6 AS phi_module, o_orderkey % 4 AS n_links, o_custkey AS c
FROM orders""")
cte("cluster_links", """
SELECT event_id, cluster_id, 1 AS place, c % 2 AS subevent, c % 61 AS barcode FROM raw_clusters WHERE n_links > 0
UNION ALL
SELECT event_id, cluster_id, 2, c % 2, (c + 1) % 61 FROM raw_clusters WHERE n_links > 1
UNION ALL
SELECT event_id, cluster_id, 3, (c + 1) % 2, (c * 3) % 61 FROM raw_clusters WHERE n_links > 2
UNION ALL
SELECT event_id, cluster_id, 0, NULL, NULL FROM raw_clusters WHERE n_links = 0""", "raw_clusters")
cte("raw_spacepoints", """
SELECT o_orderkey // 250 AS event_id, o_orderkey % 250 AS hit_id,
       CAST(o_orderkey % 101 - 50 AS DOUBLE) AS x, CAST(o_custkey % 103 - 51 AS DOUBLE) AS y,
       CAST(o_orderkey % 107 - 53 AS DOUBLE) AS z, o_orderkey % 250 AS cluster_index_1,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE (o_orderkey + o_custkey % 2) % 250 END AS cluster_index_2
FROM orders""")
cte("module_lookup", """
SELECT DISTINCT hardware, barrel_endcap, layer_disk, eta_module, phi_module,
       (CASE WHEN hardware = 'PIXEL' THEN 0 ELSE 1000 END) + (barrel_endcap + 1) * 300
       + layer_disk * 60 + eta_module * 10 + phi_module AS module_id
FROM raw_clusters""", "raw_clusters")
cte("scored_labels", """
SELECT l.doc_id, l.quality = 1 AS y, CAST((d.n_chars * 37 + l.doc_id) % 1000 AS DOUBLE) / 1000 AS score
FROM labels l JOIN documents d USING (doc_id)""")
cte("hit_truth", """
SELECT h.*, p.vx, p.vy, p.vz, p.pt, p.charge, p.pdg_id, p.eta_particle,
       CASE WHEN p.barcode < 200000 THEN 1 WHEN p.barcode IS NOT NULL THEN 0 END AS is_primary,
       CASE WHEN h.particle_id = 0 THEN -1
            ELSE COUNT(*) OVER (PARTITION BY h.event_id, h.particle_id) END AS nhits,
       sqrt((h.x - p.vx) * (h.x - p.vx) + (h.y - p.vy) * (h.y - p.vy) + (h.z - p.vz) * (h.z - p.vz)) AS big_r
FROM hits h LEFT JOIN particles p USING (event_id, particle_id)""", "hits", "particles")
cte("module_groups", """
SELECT event_id, particle_id, module_id, MIN(big_r) AS first_r, MIN((big_r, hit_id)) AS first_at
FROM hit_truth WHERE particle_id <> 0 GROUP BY ALL""", "hit_truth")
cte("module_steps", """
SELECT event_id, particle_id, module_id,
       LEAD(module_id) OVER (PARTITION BY event_id, particle_id ORDER BY first_at, module_id) AS next_module
FROM module_groups""", "module_groups")
cte("track_edges", """
SELECT st.event_id, a.hit_id AS src, b.hit_id AS dst, st.particle_id, a.module_id AS src_module,
       b.module_id AS dst_module, a.big_r AS src_r, b.big_r AS dst_r, a.pt, a.nhits, a.is_primary, a.pdg_id,
       a.eta_particle
FROM module_steps st
JOIN hit_truth a ON a.event_id = st.event_id AND a.particle_id = st.particle_id AND a.module_id = st.module_id
JOIN hit_truth b ON b.event_id = st.event_id AND b.particle_id = st.particle_id AND b.module_id = st.next_module
""", "module_steps", "hit_truth")
cte("hit_features", """
SELECT *, sqrt(x * x + y * y) AS r, atan2(y, x) AS phi, -ln(tan(atan2(sqrt(x * x + y * y), z) * 0.5)) AS eta
FROM hits""", "hits")

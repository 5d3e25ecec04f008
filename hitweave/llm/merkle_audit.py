"""Fixity audit of WARC archives by Merkle trees.

Rows become WARC records, dealt to archives by a hash of their id and ordered in each by
id, with their byte offsets. A record's digest is a leaf; 16 neighbours at a time make a
node whose digest covers its children's lengths and digests and which stands for their
range of records and offsets; the root of an archive takes what is left after ``levels``
levels. Two replicas are compared from the roots down: the children of a node are only
looked at if its digests differ, so an intact archive costs one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, join_small

FANOUT = 16
LEVELS = 3
RECORDS_PER_ARCHIVE = 1024


def id_hash(key: Column) -> Column:
    """The first 32 bits of the MD5 of an id as text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")


def record_text(url: Column, body: Column) -> Column:
    """A WARC resource record; a null url or body counts as empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive_count(rows: int, per_archive: int = RECORDS_PER_ARCHIVE) -> int:
    return max(1, -(-rows // per_archive))


def archive_records(pages: DataFrame, archives: int, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(archive, record_no, page_id, begin, end, digest): the records of one replica, as leaves.

    Records are numbered by id, then url, then digest, from 0; ``begin`` and ``end`` are
    byte offsets in the archive. Repeated rows are records of their own.
    """
    record = record_text(F.col(url), F.col(body))
    leaves = pages.select(
        (id_hash(F.col(page_id)) % archives).alias("archive"),
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.octet_length(record).cast("bigint").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )
    order = Window.partitionBy("archive").orderBy("page_id", "url", "digest")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return leaves.select(
        "archive",
        (F.row_number().over(order) - 1).cast("bigint").alias("record_no"),
        "page_id",
        (F.sum("length").over(upto) - F.col("length")).alias("begin"),
        F.sum("length").over(upto).alias("end"),
        "digest",
    )


def merkle_nodes(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(archive, level, place, begin, end, n_records, digest) of every node, leaves at level 0 and one root at ``levels``."""
    level = leaves.select(
        "archive", F.lit(0).alias("level"), F.col("record_no").alias("place"), "begin", "end",
        F.lit(1).cast("bigint").alias("n_records"), "digest",
    )
    out = level
    for n in range(1, levels + 1):
        place = F.lit(0).cast("bigint") if n == levels else F.floor(F.col("place") / fanout)
        child = F.concat_ws(":", (F.col("end") - F.col("begin")).cast("string"), "digest")
        children = F.sort_array(F.collect_list(F.struct("place", child.alias("child"))))
        level = (
            level.groupBy("archive", place.alias("up"))
            .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n_records").alias("n_records"), children.alias("c"))
            .select(
                "archive", F.lit(n).alias("level"), F.col("up").alias("place"), "begin", "end", "n_records",
                F.sha2(F.array_join(F.transform("c", lambda x: x["child"]), "\n"), 256).alias("digest"),
            )
        )
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(archive, record_no): records whose digests differ or that one replica lacks, found from the roots down.

    ``left`` and ``right`` are written node tables; each step reads only the nodes below the
    mismatches of the one before.
    """

    def nodes(table: DataFrame, level: int, side: str) -> DataFrame:
        return table.where(F.col("level") == level).select("archive", "place", F.col("digest").alias(side))

    suspects = None
    for level in range(levels, -1, -1):
        a, b = nodes(left, level, "a"), nodes(right, level, "b")
        if suspects is not None:
            up = F.lit(0).cast("bigint") if level == levels - 1 else F.floor(F.col("place") / fanout)
            parents = suspects.select("archive", F.col("place").alias("_up"))
            a, b = (
                join_small(x.withColumn("_up", up), parents, ["archive", "_up"], "left_semi").drop("_up") for x in (a, b)
            )
        both = a.join(b, ["archive", "place"], "full")
        suspects = cut_lineage(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "place"))
    return suspects.select("archive", F.col("place").alias("record_no"))


def compare_replicas(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The audit of two replicas' records: every archive with both roots, once for each damaged record.

    An intact archive has one row without a record. Empty tables give no rows; an archive
    that only one replica has is a mismatch of all its records.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    nodes_a, nodes_b = (cut_lineage(merkle_nodes(x, fanout, levels)) for x in (left, right))
    damaged = audit(nodes_a, nodes_b, fanout, levels)
    keys = ["archive", "record_no"]
    found = join_small(left, damaged, keys, "left_semi").alias("x").join(
        join_small(right, damaged, keys, "left_semi").alias("y"), keys, "full"
    )
    found = found.select(
        *keys,
        F.coalesce("x.page_id", "y.page_id").alias("page_id"),
        F.col("x.begin").alias("begin_a"), F.col("x.end").alias("end_a"),
        F.col("y.begin").alias("begin_b"), F.col("y.end").alias("end_b"),
        F.col("x.digest").alias("digest_a"), F.col("y.digest").alias("digest_b"),
    )
    root = F.col("level") == levels
    roots = nodes_a.where(root).select("archive", "n_records", F.col("end").alias("n_bytes"), F.col("digest").alias("root_a"))
    others = nodes_b.where(root).select("archive", F.col("digest").alias("root_b"))
    return roots.join(others, "archive", "full").join(found, "archive", "left")

"""The registered queries of the text operators, each over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embedding_copies,
    external_shuffle,
    fuzzy_notices,
    language_kernel,
    merkle_audit,
    mincut_extract,
    mixture_packing,
    mpeg_audio,
    simhash_ring,
    spelling_variants,
    suffix_dedup,
    term_divergence,
    winnowing,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    report = F.col("_report")
    return checked.select(
        "doc_id",
        report["n_words"].alias("n_words"),
        report["n_hit"].alias("n_hit"),
        report["n_items"].alias("n_items"),
        F.sha2(F.array_join(report["items"], ","), 256).alias("items_sha256"),
        winnowing.contaminated(report).alias("contaminated"),
    )


ORACLES["op9_winnowing_decontamination"] = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
window_of AS (
  SELECT DISTINCT item_id, t, array_to_string(w[s:s + t - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 13) AS t, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
    FROM item WHERE len(w) > 0)),
spans AS (SELECT DISTINCT t FROM window_of),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_window AS (
  SELECT rid, t, s, array_to_string(w[s:s + t - 1], ' ') AS g FROM (
    SELECT rid, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM doc, spans WHERE len(w) >= t)),
hit AS (SELECT rid, item_id, s, t FROM doc_window JOIN window_of USING (t, g)),
hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + t)) AS p FROM hit) GROUP BY rid),
hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


@query
def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ring.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = external_shuffle.external_shuffle(docs)
    return written.select(
        "doc_id",
        external_shuffle.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op1_fuzzy_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_notices.notice_places(table(spark, sf_dir, "documents"))
    label_of = F.create_map(*[F.lit(x) for pair in fuzzy_notices.NOTICES.items() for x in pair])
    base = F.filter("places", lambda p: (p["edits"] == 0) & p["phrase"].isin(*fuzzy_notices.BASE))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: label_of[p["phrase"]]))), ",")
    closeness = F.transform("places", lambda p: 1 - p["edits"] / F.length(p["phrase"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
        F.size("places").cast("bigint").alias("n_places"),
        F.to_json("places").alias("spans"),
    )


@query
def op3_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_kernel.identify(docs)
    return found.select(
        "doc_id",
        language_kernel.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )


@query
def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg_audio.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frames"]
    names += ["bad_frames", "unchecked_frames", "seek"]
    found = mpeg_audio.probe(stored)
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), *[F.col("_report")[n].alias(n) for n in names])


@query
def op8_mincut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", F.col("html").alias("_html"))
    found = mincut_extract.extract(rows, "_html").drop("_html")
    return found.select("page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("bigint").alias("n_chars"))


#: One record in so many is damaged in the second replica of op2.
DAMAGED_ONE_IN = 97


@query
def op2_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages against a replica in which one record in 97 has a changed character and another is cut short."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = merkle_audit.archive_count(pages.count())
    draw = F.floor(merkle_audit.id_hash(F.col("page_id")) / 7) % DAMAGED_ONE_IN
    half = F.floor(F.length("html") / 2).cast("int")
    changed = F.concat(F.expr("substring(html, 1, CAST(length(html) DIV 2 AS INT))"), F.lit("#"), F.expr("substring(html, CAST(length(html) DIV 2 AS INT) + 2)"))
    damage = F.when(draw == 0, changed).when(draw == 1, F.substring("html", F.lit(1), half)).otherwise(F.col("html"))
    replica = pages.withColumn("html", damage)
    records = [merkle_audit.archive_records(x, archives) for x in (pages, replica)]
    return merkle_audit.compare_replicas(*records)


def _merkle_sql() -> str:
    def replica(side: str, body: str) -> str:
        leaf = f"""
body_{side} AS (SELECT page_id, url, h, coalesce({body}, '') AS body FROM hashed),
record_{side} AS (
  SELECT page_id, url, h % (SELECT n FROM archives) AS archive,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
         || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM body_{side}),
digest_{side} AS (SELECT archive, page_id, url, strlen(record) AS length, sha256(record) AS digest FROM record_{side}),
leaf_{side} AS (
  SELECT archive, row_number() OVER w - 1 AS record_no, page_id, CAST(sum(length) OVER u - length AS BIGINT) AS b,
         CAST(sum(length) OVER u AS BIGINT) AS e, digest
  FROM digest_{side}
  WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest),
         u AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest ROWS UNBOUNDED PRECEDING))"""
        below = f"leaf0_{side} AS (SELECT archive, record_no AS place, b, e, 1 AS n, digest FROM leaf_{side})"
        steps = [leaf, below]
        for level, up in ((1, "place // 16"), (2, "place // 16"), (3, "0")):
            steps.append(f"""leaf{level}_{side} AS (
  SELECT archive, {up} AS place, min(b) AS b, max(e) AS e, sum(n) AS n,
         sha256(string_agg((e - b) || ':' || digest, chr(10) ORDER BY place)) AS digest
  FROM leaf{level - 1}_{side} GROUP BY ALL)""")
        return ",".join(steps)

    half = "CAST(length(html) // 2 AS INTEGER)"
    damage = f"""CASE WHEN (h // 7) % 97 = 0 THEN substring(html, 1, {half}) || '#' || substring(html, {half} + 2)
              WHEN (h // 7) % 97 = 1 THEN substring(html, 1, {half}) ELSE html END"""
    return f"""
WITH archives AS (SELECT greatest(1, (count(*) + 1023) // 1024) AS n FROM pages),
hashed AS (
  SELECT page_id, url, html, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM pages),
{replica("a", "html")},
{replica("b", damage)},
bad AS (
  SELECT archive, record_no, coalesce(x.page_id, y.page_id) AS page_id, x.b AS begin_a, x.e AS end_a, y.b AS begin_b, y.e AS end_b,
         x.digest AS digest_a, y.digest AS digest_b
  FROM leaf_a x FULL JOIN leaf_b y USING (archive, record_no) WHERE x.digest IS DISTINCT FROM y.digest)
SELECT archive, CAST(ra.n AS BIGINT) AS n_records, ra.e AS n_bytes, ra.digest AS root_a, rb.digest AS root_b, record_no, page_id,
       begin_a, end_a, begin_b, end_b, digest_a, digest_b
FROM leaf3_a ra FULL JOIN leaf3_b rb USING (archive) LEFT JOIN bad USING (archive)
"""


ORACLES["op2_merkle_fixity_audit"] = _merkle_sql()


@query
def op5_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.span_report(docs, suffix_dedup.find_repeats(docs).spans())


@query
def op11_term_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return term_divergence.divergence(docs)


ORACLES["op11_term_divergence"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
occ AS (SELECT rid, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n_lang FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
of_lang AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM occ GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, n_lang FROM grp g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM cell),
scored AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (n_lang + 5) // (total_lang + 5 * v) AS q_lang
  FROM sized JOIN of_lang USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item,
         (SELECT coalesce(sum(abs(x.p - y.p)), 0) FROM scored x JOIN scored y ON x.lang = y.lang AND x.term = y.term
          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q_lang AS BIGINT) FROM scored WHERE n > 0 AND p > q_lang),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variant_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_copies.near_copies(table(spark, sf_dir, "embeddings"))


ORACLES["op13_embedding_copies"] = """
WITH RECURSIVE row_of AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
valid AS (
  SELECT rid, vec_id, x FROM row_of
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.rid, b.rid AS other, b.vec_id AS other_id FROM valid a JOIN valid b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT rid, rid AS other FROM row_of UNION SELECT reach.rid, link.other FROM reach JOIN link ON reach.other = link.rid),
component AS (SELECT reach.rid, min(o.vec_id) AS component_id FROM reach JOIN row_of o ON o.rid = reach.other GROUP BY reach.rid),
linked AS (SELECT rid, count(*) AS n FROM link GROUP BY rid)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM row_of JOIN component USING (rid) LEFT JOIN linked USING (rid)
"""

"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the least k-gram hashes of its sliding windows. With k words a
gram and w grams a window, two texts that share w + k - 1 words in a row share a
fingerprint, so a join on fingerprints finds every document that could hold a benchmark
window. Each hit is then extended to all windows around it, and those are compared word
by word.

Rows are keyed by the text itself: copies are worked on once where they meet, and null or
repeated ids do no harm. Null and empty texts have no words and no hits. Items of fewer
than ``window`` words are one window of their own length, fingerprinted at that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, bind, cut_lineage, grams, join_many, join_small, text_key, words

WINDOW = 13
GRAM = 5


def gram_hashes(of: Column, span: int, gram: int) -> Column:
    """Hash of each run of ``gram`` words; ``span`` keeps windows of different lengths apart."""
    return grams(of, gram, lambda part: F.xxhash64(F.lit(span), part), "array<bigint>")


def fingerprints(of: Column, span: int, gram: int = GRAM) -> Column:
    """Distinct least hashes of the windows of ``span`` words."""
    gram = min(gram, span)
    least = lambda hashes: grams(hashes, span - gram + 1, F.array_min, "array<bigint>")
    return F.array_distinct(bind(gram_hashes(of, span, gram), least))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item_id, span, gram): the distinct windows of every item, as joined words."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("_w"))
    span = F.least(F.size("_w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_w") - span + 1)
    parts = F.transform(starts, lambda s: F.array_join(F.slice("_w", s, span), " "))
    return items.where(F.size("_w") > 0).select("item_id", span.alias("span"), F.explode(parts).alias("gram")).distinct()


def _all_prints(of: Column, spans: list[int], gram: int) -> Column:
    return F.concat(*[fingerprints(of, span, gram) for span in spans]) if spans else F.array().cast("array<bigint>")


def _starts(of: Column, found: Column, span: int, gram: int) -> Column:
    """Starts (from 1) of the windows that contain a gram whose hash is in ``found``."""
    gram = min(gram, span)
    reach = span - gram
    last = F.size(of) - (span - 1)

    def around(hashes: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: F.array_contains(found, F.element_at(hashes, i)))
        spread = F.transform(places, lambda i: F.sequence(F.greatest(i - reach, F.lit(1)), F.least(i, last)))
        return F.array_distinct(F.flatten(spread))

    inside = bind(gram_hashes(of, span, gram), around)
    return F.when(last < 1, F.array().cast("array<int>")).otherwise(inside)


def _windows(of: Column, found: Column, spans: list[int], gram: int) -> Column:
    """(start, span, gram) of every window near a fingerprint hit; starts count from 0."""

    def of_span(span: int) -> Column:
        make = lambda s: F.struct(
            (s - 1).alias("start"), F.lit(span).alias("span"), F.array_join(F.slice(of, s, F.lit(span)), " ").alias("gram")
        )
        return F.transform(_starts(of, found, span, gram), make)

    return F.concat(*[of_span(span) for span in spans])


def window_hits(
    docs: DataFrame, text: str, windows: DataFrame, spans: list[int], gram: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """(texts, hits): key and word count of every row, and the windows found in each text.

    ``windows`` has distinct (window_id, span, gram); hits have (key, start, span, window_id).
    """
    listed = docs.select(F.col(text).alias("_text"))
    printed = cut_lineage(
        listed.select(*text_key(F.col("_text")), words(F.col("_text")).alias("_w")).select(
            *KEY, F.size("_w").cast("bigint").alias("n_words"), _all_prints(F.col("_w"), spans, gram).alias("prints")
        )
    )
    texts = printed.select(*KEY, "n_words")
    split = windows.select(F.split("gram", " ").alias("_w"), "span")
    of_span = [F.when(F.col("span") == span, fingerprints(F.col("_w"), span, gram)) for span in spans]
    known = cut_lineage(
        split.select(F.explode(F.coalesce(*of_span, F.array().cast("array<bigint>"))).alias("print")).distinct()
    )
    shared = join_small(printed.select(*KEY, F.explode("prints").alias("print")), known, ["print"], "left_semi")
    suspects = cut_lineage(shared.distinct().groupBy(*KEY).agg(F.collect_list("print").alias("found")))
    near = join_small(listed.select("_text", *text_key(F.col("_text"))), suspects, KEY, "inner")
    if not spans:
        return texts, near.select(*KEY, F.lit(0).alias("start"), F.lit(0).alias("span"), F.lit(0).cast("bigint").alias("window_id")).limit(0)
    extended = near.select(*KEY, "found", words(F.col("_text")).alias("_w")).select(
        *KEY, F.inline(_windows(F.col("_w"), F.col("found"), spans, gram))
    )
    return texts, cut_lineage(extended.join(windows, ["span", "gram"]).select(*KEY, "start", "span", "window_id").distinct())


def _covered(spans: Column) -> Column:
    """Words in the union of (start, end) spans sorted by start."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def step(seen: Column, span: Column) -> Column:
        new = F.greatest(span["end"] - F.greatest(span["start"], seen["upto"]), F.lit(0).cast("bigint"))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, start, step, lambda seen: seen["n"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Every row of ``docs``, with its columns and ``_report`` (n_words, n_hit, n_items, items, spans).

    ``items`` are the sorted ids, as strings, of the items with an occurring window;
    ``spans`` the (start, end) word ranges of the windows found. Columns _report, _k1 and _k2
    of the input give way; those of any other name stay, and those of ``benchmark`` do not matter.
    """
    docs = docs.drop("_report", *KEY)
    per_item = cut_lineage(benchmark_windows(benchmark, item_id, item_text, window))
    distinct = per_item.select("span", "gram").distinct()
    windows = cut_lineage(distinct.withColumn("window_id", F.monotonically_increasing_id()))
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``window`` values
    texts, hits = window_hits(docs, text, windows, spans, gram)
    begin = F.col("start").cast("bigint")
    ranges = (
        hits.groupBy(*KEY)
        .agg(F.sort_array(F.collect_set(F.struct(begin.alias("start"), (begin + F.col("span")).alias("end")))).alias("spans"))
        .withColumn("n_hit", _covered(F.col("spans")))
    )
    held = hits.select(*KEY, "window_id").distinct().join(windows, "window_id").join(per_item, ["span", "gram"])
    # An item without an id has windows, but no name to list.
    named = held.select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"), F.count("*").alias("n_items"))
    found = cut_lineage(ranges.join(items, KEY))
    per_text = join_many(texts.distinct(), found, KEY, "left").select(
        *KEY,
        F.struct(
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        ).alias("_report"),
    )
    return join_many(docs.select("*", *text_key(F.col(text))), per_text, KEY).drop(*KEY)


def contaminated(report: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (report["n_hit"] > 0) & (20 * report["n_hit"] >= report["n_words"])

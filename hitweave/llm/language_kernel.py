"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3) present in both,
over the root of the product of their own counts. Landmark texts give the Nyström map: a
text's kernel values with the landmarks, times the inverse root of the landmarks' kernel
matrix. One ridge regression per language on these features scores it against the rest.

Texts are scored in batches: presence rows times the landmarks' presence rows are the
kernel values, and those times one small matrix are the scores. Everything but the model,
fitted on a bounded sample, covers every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the sample that the model is fitted on, whatever the size of the corpus.
SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
#: Characters are told apart if they are among so many most frequent ones of the sample; the others are one symbol.
SYMBOLS = 62
BITS = 6
BATCH = 256
POINTS = 1 << 16
#: What characters beyond the basic plane count as; neither is a character of its own.
FAR_LETTER, FAR_OTHER = POINTS - 2, POINTS - 1


def code_points(text: str) -> np.ndarray:
    """Lower-cased characters of the basic plane; those beyond it are one letter or one other character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    far = np.flatnonzero(points >= FAR_LETTER)
    if len(far):
        points = points.copy()
        points[far] = [FAR_LETTER if chr(p).isalpha() else FAR_OTHER for p in points[far].tolist()]
    return points


def symbol_table(texts: list[str]) -> np.ndarray:
    """Code point to symbol: 0 for anything but letters, 1 for rare letters, then the frequent ones."""
    counts = np.zeros(POINTS, dtype=np.int64)
    for text in texts:
        counts += np.bincount(code_points(text), minlength=POINTS)
    letters = np.array([chr(p).isalpha() or p == FAR_LETTER for p in range(POINTS)])
    frequent = np.argsort(-(counts * letters), kind="stable")[:SYMBOLS]
    table = letters.astype(np.uint8)
    frequent = frequent[counts[frequent] * letters[frequent] > 0]
    table[frequent] = np.arange(2, 2 + len(frequent))
    return table


class Presence:
    """Which n-grams of symbols a text has, as a row of flags; the flags are cleared after use."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.flags = np.zeros((1 << BITS) + (1 << 2 * BITS) + (1 << 3 * BITS), dtype=np.uint8)

    def grams(self, text: str) -> np.ndarray | None:
        """Places of the n-grams, repeats included; None without a letter. Runs of other characters are one symbol."""
        s = self.symbols[code_points(text)]
        if not s.any():
            return None
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep].astype(np.int32)
        two = (s[:-1] << BITS) + s[1:]
        three = (two[:-1] << BITS) + s[2:]
        first, second = 1 << BITS, (1 << BITS) + (1 << 2 * BITS)
        return np.concatenate([s, two + first, three + second])

    def distinct(self, text: str) -> np.ndarray:
        found = self.grams(text)
        return np.unique(found) if found is not None else np.array([], dtype=np.int32)


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray
    vocabulary: np.ndarray  # places of the n-grams that landmarks have
    landmarks: np.ndarray  # presence rows of the landmarks over the vocabulary
    norms: np.ndarray  # 1 / root of each landmark's n-gram count
    weights: np.ndarray  # landmark kernel values to language scores

    def kernel(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        shared = rows @ self.landmarks.T
        return shared * self.norms / np.sqrt(counts)[:, None]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A row of language scores for each text; NaN without a letter."""
        presence = Presence(self.symbols)
        out = np.full((len(texts), len(self.languages)), np.nan)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            rows = np.zeros((len(part), len(self.vocabulary)), dtype=np.float32)
            counts = np.zeros(len(part))
            for i, text in enumerate(part):
                found = presence.grams(text) if text else None
                if found is not None:
                    presence.flags[found] = 1
                    rows[i] = presence.flags[self.vocabulary]
                    counts[i] = np.count_nonzero(presence.flags)
                    presence.flags[found] = 0
            known = counts > 0
            if known.any():
                out[at : at + len(part)][known] = self.kernel(rows[known], counts[known]) @ self.weights
        return out


def train(texts: list[str], labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on labelled texts, given in a fixed order; the first ones of each language are its landmarks."""
    symbols = symbol_table(texts)
    presence = Presence(symbols)
    grams = [presence.distinct(t) for t in texts]
    kept = [i for i, g in enumerate(grams) if len(g)]
    grams, labels = [grams[i] for i in kept], [labels[i] for i in kept]
    languages = sorted(set(labels))
    if not languages:
        empty = np.zeros((0, 0), dtype=np.float32)
        return Model([], symbols, np.zeros(0, dtype=np.int64), empty, np.zeros(0), np.zeros((0, 0)))
    chosen = [i for name in languages for i in [j for j, x in enumerate(labels) if x == name][:landmarks]]
    vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
    rows = np.stack([np.isin(vocabulary, g) for g in grams]).astype(np.float32)
    counts = np.array([len(g) for g in grams], dtype=np.float64)
    model = Model(languages, symbols, vocabulary, rows[chosen], 1 / np.sqrt(counts[chosen]), np.zeros((0, 0)))
    kernel = model.kernel(rows, counts).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    useful = values > 1e-6 * values.max()
    root = vectors[:, useful] / np.sqrt(values[useful])
    features = kernel @ root
    target = np.array([[float(x == name) for name in languages] for x in labels])
    # Languages weigh alike, however many of their texts were drawn.
    weight = 1 / np.array([labels.count(x) for x in labels], dtype=np.float64)
    scaled = features * weight[:, None]
    solved = np.linalg.solve(features.T @ scaled + ridge * np.eye(features.shape[1]), scaled.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> list:
    """(text, lang): up to ``per_language`` distinct texts of each language outside the held-out fifth, drawn by a hash of the text.

    The share that is drawn follows the number of distinct texts, so that a language of many
    copies is learnt from as many texts as one without.
    """
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    distinct = F.approx_count_distinct(F.xxhash64(F.col(text))).alias("n")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(distinct).collect()}
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 32)) / float(1 << 32)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 4.0 * per_language / n))])
    drawn = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"))
    thin = drawn.where(F.col("draw") < share[F.col("lang")]).dropDuplicates(["text", "lang"])
    order = Window.partitionBy("lang").orderBy("draw", "text")
    best = thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    return best.orderBy("lang", "place").select("text", "lang").collect()


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that nothing is learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    landmarks: int = LANDMARKS_PER_LANGUAGE,
) -> DataFrame:
    """Every row of ``docs`` with ``_lang`` and ``_lang_score``, predicted from the text alone.

    The model is fitted on at most ``per_language`` rows of ``labelled`` (``docs`` by default)
    for each language. Null texts and texts without a letter are ``und`` with score 0, and so
    is every text if nothing is labelled; ties go to the first language by name.
    """
    sample = labelled_sample(labelled if labelled is not None else docs, doc_id, text, lang, per_language)
    model = docs.sparkSession.sparkContext.broadcast(
        train([r["text"] for r in sample], [r["lang"] for r in sample], landmarks)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            scores = fitted.scores(batch.column("_text").to_pylist())
            known = ~np.isnan(scores).any(axis=1) if fitted.languages else np.zeros(len(scores), dtype=bool)
            best = np.argmax(np.where(known[:, None], scores, 0), axis=1) if fitted.languages else np.zeros(len(scores), dtype=int)
            names = [fitted.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            sure = [float(np.clip(scores[i, best[i]], 0, 1)) if known[i] else 0.0 for i in range(len(names))]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            columns = [*kept, pa.array(names, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != "_text"] + ["_lang", "_lang_score"])

    docs = docs.drop("_lang", "_lang_score", "_text")
    schema = docs.withColumns({"_lang": F.lit(""), "_lang_score": F.lit(0.0)}).schema
    return docs.withColumn("_text", F.col(text)).mapInArrow(run, schema)

"""Fuzzy search for short license notices.

A phrase of m characters may occur with up to k edits. Cut into k + 1 pieces, one piece is
then unchanged (pigeonhole), so plain searches for the pieces locate every candidate; each
lies within k characters of where its piece puts it. The regex library's bounded-error
matching verifies the candidates and counts their edits.

Texts are searched as their words joined by one space, so a notice may run over lines and
punctuation. A place is a run of whole words whose characters are within the bound of the
phrase. Of places of one phrase that overlap, one with more edits, or with as many (but
some) and a later start, gives way; exact places all stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phrases whose exact places are the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further short notices, reported as labels of their own.
NOTICES = {
    **BASE,
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
}
CHARACTERS_PER_EDIT = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def edits_allowed(phrase: str) -> int:
    return len(phrase) // CHARACTERS_PER_EDIT


@cache
def seeds(phrase: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 pieces, nearly equal in length."""
    marks = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(marks, marks[1:])]


@cache
def matcher(phrase: str, k: int) -> regex.Pattern:
    return regex.compile(f"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}")


def candidate_starts(joined: str, phrase: str, k: int) -> set[int]:
    """Characters where an occurrence may start, from the exact pieces."""
    found = set()
    for offset, piece in seeds(phrase, k):
        at = joined.find(piece)
        while at >= 0:
            found.update(range(max(0, at - offset - k), min(len(joined), at - offset + k) + 1))
            at = joined.find(piece, at + 1)
    return found


def phrase_places(joined: str, starts: list[int], ends: list[int], phrase: str, k: int) -> list[tuple[int, int, int]]:
    """(first word, last word, edits) of the places of one phrase that stay."""
    pattern = matcher(phrase, k)
    places = []
    for at in candidate_starts(joined, phrase, k):
        first = bisect_left(starts, at)
        if first == len(starts) or starts[first] != at:
            continue  # not the start of a word
        best = None
        low, high = bisect_left(ends, at + len(phrase) - k), bisect_right(ends, at + len(phrase) + k)
        for last in range(max(first, low), high):
            hit = pattern.fullmatch(joined, at, ends[last])
            edits = sum(hit.fuzzy_counts) if hit else k + 1
            if edits <= k and (best is None or edits < best[2]):
                best = (first, last, edits)
        if best:
            places.append(best)

    places.sort()
    reach = max((last - first for first, last, _ in places), default=0)

    def stays(i: int) -> bool:
        first, last, edits = places[i]
        low = bisect_left(places, (first - reach,))
        high = bisect_left(places, (last + 1,))
        rivals = [(b[2], b[0]) for b in places[low:high] if b[1] >= first]
        return edits == 0 or min(rivals) >= (edits, first)

    return [place for i, place in enumerate(places) if stays(i)]


def search(text: str | None, notices: Mapping[str, int]) -> tuple[int, list[tuple]]:
    """(words, places): a place is (phrase, first word, last word, start, end, edits), characters of the text."""
    lowered = (text or "").translate(UPPER)
    tokens = WORD.findall(lowered)
    joined = " ".join(tokens)
    likely = [p for p, k in notices.items() if any(piece in joined for _, piece in seeds(p, k))]
    if not likely:
        return len(tokens), []
    ends, at = [], -1
    for token in tokens:
        at += 1 + len(token)
        ends.append(at)
    starts = [end - len(token) for end, token in zip(ends, tokens)]
    found = [(p, *place) for p in likely for place in phrase_places(joined, starts, ends, p, notices[p])]
    if not found:
        return len(tokens), []
    spans = [m.span() for m in WORD.finditer(lowered)]
    return len(tokens), [(p, a, b, spans[a][0], spans[b][1], e) for p, a, b, e in sorted(found, key=lambda f: (f[1], f[0]))]


PLACE = "struct<phrase:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int>"


def notice_places(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, int] | None = None
) -> DataFrame:
    """(doc_id, n_words, places) of every row.

    ``phrases`` maps lower-case phrases of single-spaced words to the edits allowed, by
    default one for every 8 characters of :data:`NOTICES`. Null and empty texts have no
    words and no places; repeated rows are searched each for itself.
    """
    notices = dict(phrases) if phrases is not None else {p: edits_allowed(p) for p in NOTICES}
    fields = [("phrase", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    kind = pa.list_(pa.struct([*fields, ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [search(t.as_py(), notices) for t in batch.column("text")]
            places = pa.array([[dict(zip(names, place)) for place in row] for _, row in found], kind)
            columns = [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), places]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, places array<{PLACE}>")

"""Packing: every id in one piece, ids of the public tokenizer, windows at their shares."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hitweave.llm import mixture_packing as M

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    None, "", " ", "a", "Hello world, it's 2024!\n\n  done", "été über ñandú 東京 🙂🙂", "x" * 3000, "a  b\t\tc \n", "1234567890" * 50,
    "before <|endoftext|> after", "<|endoftext|><|endoftext|>", "   nbsp\x00null", "we're they'll I'd 'S", "a b " * 4000,
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    encoding = M.encoder(public_tokenizers.path(M.RANKS))
    assert M.document_ids(encoding, text).tolist() == ids_of(text)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    out = [(i, rng.choice(TEXTS) if i % 9 == 0 else "word%d " % i * rng.choice([1, 30, 200]), rng.choice("aaabc")) for i in range(n)]
    return out + [(3, out[3][1], out[3][2]), (None, "no name", None), (n, "big one " * 9000, "a")]


def check(rows, docs, length):
    want = Counter((i, zlib.crc32(np.array(ids_of(t), "<u4").tobytes()), len(ids_of(t))) for i, t, _ in docs)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= length and r.offset + r.length <= length
    assert sorted(sequences) == list(range(len(sequences)))
    fill = []
    for s in sorted(sequences):
        at = 0
        for offset, size in sorted(sequences[s]):
            assert offset == at
            at += size
        fill.append(at)
    assert all(f == length for f in fill[:-1])
    total = sum(n * c for (_, _, n), c in want.items())
    assert sum(fill) == total
    texts = {i: ids_of(t) for i, t, _ in docs}
    covered = Counter()
    for r in rows:
        ids = texts[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    copies = Counter(i for i, _, _ in docs)
    assert covered == Counter({(i, k): copies[i] for i, ids in texts.items() for k in range(len(ids))})


def shares(rows):
    by = defaultdict(Counter)
    for r in rows:
        by[r.window_id][r.source] += r.length
    return by


def test_own_shares(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, ids int").repartition(5)
    rows = M.pack(frame, length=64, window=640).collect()
    check(rows, docs, 64)
    totals = Counter()
    for r in rows:
        totals[r.source] += r.length
    by = shares(rows)
    for w in sorted(by)[:-1]:
        for source, total in totals.items():
            assert abs(by[w][source] - 640 * total / sum(totals.values())) <= 1


def test_targets(spark):
    docs = corpus(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = M.pack(frame, targets={"a": 0.5, "b": 0.3, "c": 0.2, "": 0.0}, length=128, window=1000).collect()
    check(rows, docs, 128)
    left = Counter()
    for r in rows:
        left[r.source] += r.length
    by = shares(rows)
    for w in sorted(by):
        for source, target in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            want = min(left[source], 1000 * target)
            assert abs(by[w][source] - want) <= 1
            left[source] -= by[w][source]


def test_empty(spark):
    assert M.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

"""Runs against a check of every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import runs


def brute(words):
    """All runs by comparing every word with the one a period later."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q):
                stretch = words[at : at + length]
                if not any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((at, length, q))
            at = max(end, at) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    all_runs = brute(words)
    gone = {i for s, length, q in all_runs for i in range(s + q, s + length)}
    top = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in all_runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest)]
    return (doc_id, len(all_runs), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4), *digests)


def found(texts):
    first = np.cumsum([0, *map(len, texts)])
    out = runs.runs_of(np.array([w for t in texts for w in t], np.int64), first)
    rows = zip(out.doc.tolist(), out.start.tolist(), out.length.tolist(), out.period.tolist(), strict=True)
    return sorted(rows, key=lambda r: (r[0], r[1], r[3]))


def expected(texts):
    return [(d, *r) for d, t in enumerate(texts) for r in brute(t)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_small_alphabets(texts):
    assert found(texts) == expected(texts)


def test_planted_periods_of_all_sizes():
    rng = random.Random(4)
    texts = []
    for q in range(1, 40):
        root = [rng.randrange(6) for _ in range(q)]
        for length in (4 * q - 1, 4 * q, 4 * q + 1, 7 * q + 3):
            repeated = [root[i % q] for i in range(length)]
            texts.append([rng.randrange(6) for _ in range(9)] + repeated + [rng.randrange(6) for _ in range(9)])
    # Runs inside a root that repeats, and one text that is a run from end to end.
    texts += [([1] * 7 + [2, 3] * 5 + [4]) * 6, [5, 5, 5, 6] * 50, [7] * 1000, []]
    assert found(texts) == expected(texts)


def test_neighbouring_texts_share_no_run():
    assert found([[1, 1, 1], [1, 1, 1], [1, 2, 1, 2], [1, 2, 1, 2]]) == []


def test_low_exponents_are_refused():
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(0, np.int64), np.zeros(1, np.int64), 6, 3)


def test_digest_of_any_row(spark):
    rng = random.Random(8)
    rows = [(None, None, "k", 1), (1, "", "k", 1), (2, " \n\t ", "k", 1), (None, "é É é é é é é é é", "k", 1), (3, "a a a a a a", "k", 1), (3, "a a a a a a", "k", 1)]
    rows += [(i, " ".join(rng.choice(["ab", "Ab", "c", "d\x1ce"]) for _ in range(rng.randrange(120))), "k", 1) for i in range(10, 120)]
    rows += [(i, "  ".join(f"w{rng.randrange(900)}" for _ in range(400)) + "\n", "k", 1) for i in range(200, 260)]
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0])
    table = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int").repartition(3)
    got = sorted((tuple(r) for r in runs.digest(table).collect()), key=str)
    assert got == sorted((row(r[0], r[1]) for r in rows), key=str)
    assert runs.digest(table.limit(0)).count() == 0


def test_find_passes_columns_and_long_texts(spark):
    long_text = "x " * 300_000 + "y z " * 200_000
    table = spark.createDataFrame([(1, long_text, "k", 5), (2, None, "k", 6), (3, "a b a b a b a b", "j", 7)], "doc_id long, text string, kind string, period int")
    got = sorted(map(tuple, runs.find(table).select("doc_id", "kind", "start", "length", "period").collect()))
    assert got == [(1, "k", 0, 300_000, 1), (1, "k", 300_000, 400_000, 2), (3, "j", 0, 8, 2)]

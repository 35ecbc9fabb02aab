"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import common, simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def smallest(ids, fps, radius=4):
    """The smallest id reachable from each, over all pairs."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, own in enumerate(ids):
        best[find(i)] = min([x for x in (best.get(find(i)), own) if x is not None], default=None)
    return [best[find(i)] for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x1c. ", max_size=60), min_size=1, max_size=6))
def test_fingerprints_of_any_text(texts):
    import pyarrow as pa

    data, places = common.utf8(pa.array(texts))
    assert simhash.fingerprints_of(data, places).tolist() == [fingerprint(t) for t in texts]


def test_long_text_counts_over_255():
    import pyarrow as pa

    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(3000))
    assert simhash.fingerprints_of(*common.utf8(pa.array([text])))[0] == fingerprint(text)


def test_components_equal_all_pairs(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(50)}" for _ in range(120)).split()
    rows = [(None, None, "k", 1), (3, "", "k", 1), (900, "  \n", "k", 1), (None, "lone text", "k", 1), (5, "lone text", "k", 1), (5, "lone text", "k", 1)]
    for i in range(10, 90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "k", 1))
    rows += [(i, " ".join(f"z{rng.randrange(400)}" for _ in range(30)), "k", 1) for i in range(200, 260)]
    found = simhash.assign(spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")).collect()
    fps = [fingerprint(r[1]) for r in rows]
    expected = sorted(zip([r[0] for r in rows], map(signed, fps), smallest([r[0] for r in rows], fps), strict=True), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=str) == expected


def test_chunks_and_large_groups_lose_no_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        one = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            one ^= 1 << rng.randrange(64)
        fps.add(one)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = smallest(list(range(len(fps))), fps)
    for chunk in (16, 2048):
        roots = {r.node: r.root for r in common.components(simhash.links(table, chunk=chunk)).collect()}
        label = [roots.get(signed(f), signed(f)) for f in fps]
        same = {}
        for mine, theirs in zip(label, want, strict=True):
            assert same.setdefault(theirs, mine) == mine
        assert len(set(same.values())) == len(same)
    pairs = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(fps) for b in fps[:i])
    assert simhash.links(table).count() < pairs


def test_masks_leave_an_equal_block_for_every_number():
    rng = np.random.default_rng(3)
    for n in (10, 100_000, 10_000_000, 10**10):
        chosen = simhash.masks(n)
        for _ in range(200):
            bits = rng.choice(64, 4, replace=False)
            change = sum(1 << int(b) for b in bits)
            assert any(not change & m for m in chosen)


def test_keep_one_keeps_whole_rows(spark):
    rows = [(2, "a b c d e", "en", 1), (1, "a b c d e", "de", 2), (1, "a b c d e", "de", 2), (9, "other words here now", None, 3), (None, "other words here now", "x", 4), (None, None, "n", 5)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _hash string, fp int"))
    assert kept.columns == ["doc_id", "text", "_hash", "fp"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[5]], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.assign(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200), (None, 3), (90, 91), (91, 90)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(61))
    assert (found[200], found[91]) == (200, 90)

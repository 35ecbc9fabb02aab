"""Packing against placing one piece after another, and ids against the other tokenizer library."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import packing


def one_by_one(lengths, capacity, weights, rule):
    """Vector best-fit over single pieces: demands of each open sequence."""
    limit, scale = np.array(capacity, float), np.array(weights, float) / np.array(capacity, float)
    left = []
    for length in sorted(lengths, reverse=True):
        demand = np.array([length, 1, length * length], float)
        scored = []
        for at, room in enumerate(left):
            if (room >= demand).all():
                gap = (room - demand) * scale
                value = (gap**2).sum() if rule == "norm" else -((room * scale) * (demand * scale)).sum()
                scored.append((round(value, 12), at))
        if scored:
            at = min(scored)[1]
            left[at] = left[at] - demand
        else:
            left.append(limit - demand)
    return sorted(tuple(map(int, room)) for room in left)


def residuals(plan):
    return sorted(res for res, at in plan.at.items() for _, n in plan.runs[at] for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60), st.integers(2, 6), st.integers(150, 400))
def test_counts_give_what_single_pieces_give(lengths, documents, attention):
    capacity = (16, documents, attention)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.Plan(counts, capacity, (1.0, 0.1, 0.1), "norm")
    assert residuals(plan) == one_by_one(lengths, capacity, (1.0, 0.1, 0.1), "norm")
    other = packing.Plan(counts, capacity, (1.0, 0.1, 0.1), "dot")
    assert sum(n for runs in other.runs for _, n in runs) == other.n_sequences


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity[0] and len(places) <= capacity[1]
        assert sum(n * n for _, n in places) <= capacity[2]
    return len(by)


def test_every_constraint_holds_in_spark(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 33)) for i in range(600)] + [(None, 32)] * 40
    capacity = (32, 4, 700)
    rows = [(a, min(b, 26)) for a, b in rows]
    table = spark.createDataFrame(rows, "doc_id long, length long")
    for rule in ("norm", "dot"):
        found = packing.pack(table, capacity, (1.0, 0.2, 0.2), rule).collect()
        assert sorted(((r.doc_id, r.length) for r in found), key=str) == sorted(rows, key=str)
        check_places(found, capacity)


def test_pieces_and_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcé!ß ") for _ in range(6)) for _ in range(2500))
    texts = ["", None, "Hello, world's  \n\n end", "<|endoftext|> a<|endoftext|>", "日本語   x y", "a" * 3000, long, long, "1,234.5\t\r\n z"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "tail", "clash")]
    found = packing.pack(packing.cut(spark.createDataFrame(rows, "doc_id long, text string, length string"))).collect()
    check_places(found, (1024, 1024, 1024 * 1024))
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text, _ in rows:
        ids = np.array([*(other.encode(text or "", add_special_tokens=False).ids), 2], "<u4")
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_both_libraries_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _other
    if "_other" not in globals():
        _other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist()[:-1] == _other.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(packing.cut(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_runs_of_millions_of_blanks():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for n, blank in ((packing.BLANKS - 1, " "), (1_000_000, " "), (1_000_000, "\n"), (5_000_000, " "), (5_000_000, "\n")):
        text = f"a{blank * n}b c<|endoftext|>"
        assert packing.token_ids(text).tolist() == [*other.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_lengths_beyond_seventeen_bits(spark):
    rng = random.Random(4)
    capacity = (131_072, 131_072, 131_072**2)
    rows = [(i, n) for i, n in enumerate([131_072, 131_072, 131_071, 131_070, 65_536] + [rng.randrange(1, 9) for _ in range(400)])]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity).collect()
    assert sorted((r.doc_id, r.length) for r in found) == rows
    n_sequences = check_places(found, capacity)
    assert n_sequences == len(one_by_one([n for _, n in rows], capacity, (1.0, 0.1, 0.1), "norm"))

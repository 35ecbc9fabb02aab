"""Windows of benchmark items against a word-by-word search."""

import hashlib
import random
import re

from lexweave.llm import decontam

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def expected(text, items, window=13):
    own, hit, seen = words(text), set(), set()
    for name, item in items:
        parts = words(item)
        size = min(window, len(parts))
        for start in range(len(parts) - size + 1) if size else ():
            piece = parts[start : start + size]
            for at in range(len(own) - size + 1):
                if own[at : at + size] == piece:
                    hit |= set(range(at, at + size))
                    seen.add("null" if name is None else str(name))
    names = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
    return len(own), len(hit), len(seen), names, bool(hit) and 20 * len(hit) >= len(own)


def setup(spark):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "été", "x1", "y", "zz"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))

    items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(70, None), (71, "?!"), (None, "beta y"), (72, "été"), (10, "Alpha beta zz")]
    rows = [(i, text(rng.randrange(0, 60)), "s", 1) for i in range(40)]
    rows += [(100, "start " + items[3][1] + " end " + text(900), "s", 1), (101, items[4][1], "s", 1), (101, items[4][1], "s", 1)]
    rows += [(None, None, None, None), (102, "", "s", 1), (103, text(4000), "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int")
    return rows, items, docs, spark.createDataFrame(items, "item_id long, text string")


def test_counts_match_for_one_and_many_blocks(spark):
    rows, items, docs, benchmark = setup(spark)
    want = sorted(((r[0], *expected(r[1], items)) for r in rows), key=str)
    for block in (decontam.BLOCK_BYTES, 300):
        found = decontam.digest(decontam.hits(docs, benchmark, block_bytes=block)).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=str)
        assert got == want


def test_keep_clean_returns_whole_rows(spark):
    rows, items, docs, benchmark = setup(spark)
    kept = decontam.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    want = sorted((r for r in rows if not expected(r[1], items)[-1]), key=str)
    assert sorted(map(tuple, kept.collect()), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontam.digest(decontam.hits(docs, benchmark)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = decontam.digest(decontam.hits(some, benchmark)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_one_window_of_very_many_items(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen"
    n = 60_000
    items = [(i, shared) for i in range(n)] + [(n, shared + " fourteen"), (n + 1, "alone it stands")]
    docs = spark.createDataFrame([(i, "x " + shared + (" fourteen" if i % 2 else "")) for i in range(40)] + [(99, "alone it stands")], "doc_id long, text string")
    found = decontam.digest(decontam.hits(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()
    names = [hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() for ids in (range(n + 1), [n + 1])]
    for row in found:
        alone = row.doc_id == 99
        assert (row.n_items, row.items_sha256) == ((1, names[1]) if alone else (n + 1, names[0]))
        # Two blocks, in each of which the shared window has one class and the longer item's other window one.
        assert len(row.classes) <= 4 and row.n_hit == (3 if alone else 13 + row.doc_id % 2)

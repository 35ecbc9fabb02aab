"""Links and components of n-gram sets against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import common, prefix_tree

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def similar(a, b, percent=90):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    roots, best = roots_of(len(rows), pairs), {}
    for r, root in zip(rows, roots, strict=True):
        best[root] = min([x for x in (best.get(root), r[0]) if x is not None], default=None)
    return sorted(((r[0], len(s), best[root]) for r, s, root in zip(rows, sets, roots, strict=True)), key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, root int").repartition(3)
    return sorted((tuple(r) for r in prefix_tree.assign(table, **options).collect()), key=str)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    rows = [(None, None), (3, ""), (900, "  \n"), (None, "lone text"), (5, "Lone  Text"), (5, "lone text"), (6, "lone"), (7, "LONE")]
    for size in (8, 9, 12, 20, 45, 120, 300):
        base = [f"w{rng.randrange(60)}" for _ in range(size)]
        rows += [(rng.randrange(10**6), " ".join(changed(rng, base, rng.randrange(1 + size // 25 + 2)))) for _ in range(25)]
    # A shared passage in texts that have little else in common.
    passage = [f"p{i}" for i in range(50)]
    rows += [(rng.randrange(10**6), " ".join(passage + [f"z{rng.randrange(9999)}" for _ in range(rng.randrange(1, 40))])) for _ in range(60)]
    # A chain, in which only neighbours are similar.
    chain = [f"c{i}" for i in range(200)]
    rows += [(10**6 + i, " ".join(chain[i * 3 : i * 3 + 80])) for i in range(40)]
    return rows + [(11, rows[40][1]), (None, rows[41][1]), (12, rows[60][1] + " "), rows[70], rows[70]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\t\n\x0b\x1c", max_size=40)), min_size=1, max_size=6))
def test_set_sizes_of_any_text(texts):
    grams, first = prefix_tree.ngram_sets(*common.utf8(pa.array(texts, pa.string())))
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]


def _sets(rng, n, universe, largest):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            own = set(rng.choice(out))
            for _ in range(rng.randrange(1 + len(own) // 8)):
                own ^= {rng.randrange(universe)}
        else:
            own = set(rng.sample(range(universe), rng.randrange(1, largest)))
        out.append(own or {1})
    return out


def _packed(sets):
    grams = np.array([g for s in sets for g in sorted(int(common.mix(np.array([v], np.uint64))[0]) for v in s)], np.uint64)
    return grams, np.cumsum([0, *map(len, sets)])


def test_linked_sets_share_a_key():
    rng = random.Random(3)
    for percent in (60, 80, 90, 95):
        for largest in (14, 60, 400):
            sets = _sets(rng, 90, 3 * largest, largest)
            number, key = prefix_tree.part_keys(*_packed(sets), percent, seed=largest)
            keys = [set(key[number == i].tolist()) for i in range(len(sets))]
            for i in range(len(sets)):
                for j in range(i):
                    if similar(sets[i], sets[j], percent) and sets[i] != sets[j]:
                        assert keys[i] & keys[j]


def test_tree_links_connect_what_all_pairs_do():
    rng = random.Random(7)
    for percent in (50, 80, 90, 100):
        for largest in (6, 40, 300):
            sets = _sets(rng, 80, 2 * largest, largest)
            grams, first = _packed(sets)
            links = prefix_tree.Tree(grams, first, np.arange(len(sets)), percent).links()
            assert all(similar(sets[a], sets[b], percent) for a, b in links)
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j], percent)]
            assert roots_of(len(sets), links) == roots_of(len(sets), pairs)
            assert len(links) == len(sets) - len(set(roots_of(len(sets), links)))


def test_components_equal_all_pairs(spark):
    rows = corpus(1)
    assert found(spark, rows) == expected(rows)


def test_chunks_lose_no_link(spark):
    rows = corpus(2)
    assert found(spark, rows, chunk_tokens=400, chunk_sets=7) == expected(rows)


def test_small_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), (1, "a")]) == [(1, 1, 1), (None, 0, None)]
    long_text = " ".join(f"w{i}" for i in range(200_000))
    assert found(spark, [(8, long_text), (4, long_text + " tail"), (9, "a b c d e f g h i j k")]) == [(4, 199_999, 4), (8, 199_998, 4), (9, 9, 9)]

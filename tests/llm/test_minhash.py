import random

import pytest

from docflow.llm.components import connected_components
from docflow.llm.common import Scratch
from docflow.llm.minhash import near_duplicates


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for _ in range(60):  # near copies of one text, from one edit to far too many
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append(" ".join(copy))
    rows += [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(25)]
    rows += ["a b", "A  b", "a b c d e", "a b c d e f", None, "", " \n", rows[0], rows[0].upper()]
    chain = [r.choice(words) for _ in range(60)]
    for _ in range(12):  # each is near the one before, the ends are far apart
        chain = chain[2:] + [r.choice(words), r.choice(words)]
        rows.append(" ".join(chain))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size,crowd", [(4, 24), (4, 2)])
def test_equals_brute_force(spark, size, crowd):
    rows = corpus(size + crowd)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n_shingles int").repartition(3)
    out = near_duplicates(docs, size=size, crowd=crowd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_repeated_rows_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, "q"), (9, "a b c d e"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, size=4).collect())
    assert out == [(-1, 0, None), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, 1, 9), (9, 2, 7)]
    assert near_duplicates(docs.limit(0), size=4).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in out} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}

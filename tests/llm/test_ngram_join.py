"""The n-gram join against brute force: chance overlaps, groups of near copies beyond the pairing limit, odd rows."""

import random

import numpy as np
import pytest

from passagelake.llm import ngramjoin

SCHEMA = "doc_id long, text string, v int, need int, id string, component long"


def corpus():
    rng = random.Random(12)
    few = [chr(97 + k) * 2 for k in range(7)]  # so few words that n-grams recur by chance
    rows = [(k, " ".join(rng.choices(few, k=rng.randint(1, 14)))) for k in range(150)]
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=90)
    for k in range(200, 380):  # near copies of one text, one to four words changed; more than one list takes
        t = list(base)
        for _ in range(k % 5):
            t[rng.randrange(90)] = rng.choice(words)
        rows.append((k, " ".join(t)))
    for k in range(400, 460):  # one passage, and words of their own: alike, but not enough
        own = [f"x{k}y{j}" for j in range(rng.randint(8, 22))]
        rows.append((k, " ".join(base[:60] + own)))
    for k in range(500, 540):
        t = rng.choices(words, k=rng.randint(4, 60))
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(t[: rng.randint(3, len(t))]) + (" and so on" if k % 2 else ""))]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One TWO"), (2004, "one  two"), (2005, "one"), (2006, " ".join(rng.choices(words, k=30_000)))]
    return [*rows, rows[3], (None, rows[200][1]), (2007, rows[-1][1].upper())]


def near(rows, width, num, den):
    low = lambda i: -(2**63) if i is None else i
    ids, sets = [low(i) for i, _ in rows], []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    up[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), 2**63), ids[k])
    out = [(i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted(((i, n, None if c == -(2**63) else c) for i, n, c in out), key=str)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize(("width", "num", "most", "parts"), [(5, 80, 16, 4), (5, 80, 1, 1), (2, 80, 16, 2), (3, 60, 5, 3)])
def test_components(spark, rows, width, num, most, parts):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 9) for r in rows], SCHEMA).repartition(parts)
    got = ngramjoin.jaccard_components(docs, width, num, 100, most=most).collect()
    assert sorted(map(tuple, got), key=str) == near(rows, width, num, 100)


def test_no_rows(spark):
    assert ngramjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in ngramjoin.jaccard_components(spark.createDataFrame([(1, None, 1, 1, "", 1)], SCHEMA)).collect()] == [(1, 0, 1)]


def test_longer_prefixes_where_ngrams_are_frequent():
    rare, often = np.ones(40), np.concatenate((np.ones(20), np.full(20, 500.0)))
    assert ngramjoin._chosen(rare, 20, 100, 16) == 1
    assert ngramjoin._chosen(np.concatenate((np.ones(18), np.full(2, 9.0), np.full(20, 10.0))), 20, 900, 16) > 1
    assert ngramjoin._chosen(often, 21, 100, 16) >= 1

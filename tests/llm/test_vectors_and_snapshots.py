"""Codebooks and snapshot differences against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passagelake.llm import codebooks, snapshots

VECTORS = "vec_id long, embedding array<float>, label int, n int, code string"


def vectors(n=700):
    rng = np.random.Generator(np.random.PCG64(3))
    centers = rng.normal(0, 1, (9, 32))
    rows = [(int(3 * k + 1), [float(np.float32(x)) for x in centers[k % 9] + rng.normal(0, 0.2, 32)], k % 5 if k % 11 else None) for k in range(n)]
    rows += [rows[4], rows[5], (7, rows[9][1], 1), (None, rows[3][1], 2)]  # repeats, a repeated id, no id
    rows += [(9001, None, 1), (9002, rows[0][1][:31] + [None], 1), (9003, rows[0][1][:31] + [float("nan")], None), (9004, rows[0][1][:31] + [float("-inf")], 1), (2, [], 1), (9005, [0.5] * 16, 1)]
    rows += [(9006, [-0.0] * 32, 1), (9007, [1 / 512] * 32, None), (9008, [-1 / 512] * 32, 3)]
    return rows


def coded(rows, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and len(v) == 32 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), 16, 2)
    books = x[:64].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(16)], 1)
    for _ in range(rounds):
        a = near()
        for p in range(16):
            for k in set(a[:, p].tolist()):
                mine = x[a[:, p] == k, p]
                books[p, k] = mine.sum(0) // len(mine)
    a = near()
    error = sum(((x[:, p] - books[p][a[:, p]]) ** 2).sum(-1) for p in range(16))
    by = Counter()
    for (_, _, y), e in zip(kept, error):
        by[y] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return Counter((i, bytes(c.astype(np.uint8)).hex(), int(e), by[y], digest) for (i, _, y), c, e in zip(kept, a, error))


@pytest.mark.parametrize("n", [700, 20])  # 20: fewer rows than entries
def test_vector_codes(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    want = coded(rows)
    for parts in (1, 5):
        assert Counter(map(tuple, codebooks.vector_codes(df.repartition(parts)).collect())) == want
    assert codebooks.vector_codes(df.where("vec_id > 9000 and vec_id < 9005")).count() == 0


def test_heaps_leave_settled_parts_alone(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors()], VECTORS)
    got = codebooks.compress(df, rounds=6)
    assert max(got.scanned) < 0.6 * got.n  # the last two passes
    assert Counter((r.vec_id, r.code, r.error) for r in got.rows.collect()) == Counter((i, c, e) for (i, c, e, _, _), k in coded(vectors(), 6).items() for _ in range(k))


DOCS = "doc_id long, text string, lang string, source string, k int, content string, c0 int, id long"


def later_of(rows):
    out = []
    for k, t, lang, source in rows:
        way = zlib.crc32(str(k).encode()) % 16 if k is not None else -1
        t, lang, s = (t or "") + "+" if way == 1 else t, *((source, lang) if way == 2 else (lang, None if way == 4 else source))
        out += [] if way == 0 else [(-1 - k if way in (3, 4) else k, t, lang, s)]
        out += [(-1 - k, t, lang, s)] if way == 5 else []
    return out


def difference(earlier, later, largest_first=False):
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    differ = lambda a, b: ",".join(n for n, x, y in zip(("text", "lang", "source"), a[1:], b[1:]) if x != y)
    e, l = {r[0]: r for r in earlier}, {r[0]: r for r in later}
    out = [(k, k, "update" if differ(e[k], l[k]) else "same", differ(e[k], l[k]), sha(l[k])) for k in e.keys() & l.keys()]
    by = defaultdict(lambda: ([], []))
    for side, (mine, other) in enumerate(((e, l), (l, e))):
        for k in sorted(mine.keys() - other.keys(), key=lambda k: -(2**63) if k is None else k):
            by[mine[k][1]][side].append(mine[k])
    for a, b in by.values():
        b = b[::-1] if largest_first else b
        out += [(y[0], x[0], "rekey", differ(x, y), sha(y)) for x, y in zip(a, b)]
        out += [(x[0], x[0], "delete", "", None) for x in a[len(b) :]] + [(y[0], None, "insert", "", sha(y)) for y in b[len(a) :]]
    return Counter(out)


def snapshot(n=6000):
    rng = random.Random(8)
    rows = [(k * k % 100_003 + k, "a copy held by a third" if k % 3 == 0 else f"text {rng.randrange(n)}" if k % 7 else None, "en" if k % 5 else None, f"s{k % 4}") for k in range(n)]
    rows += [(None, "no key", "en", "s1"), (-3, "", None, None), (2**62, "a copy held by a third", "fr", "s"), (-(2**62), "a copy held by a third", "fr", "s"), (200_005, "long " * 20_000, "en", "s")]
    return list({r[0]: r for r in rows}.values())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], DOCS).repartition(5)


def test_snapshot_difference(spark):
    rows = snapshot()
    docs = frame(spark, rows)
    got = Counter(map(tuple, snapshots.snapshot_difference(docs, snapshots.changed_snapshot(docs)).collect()))
    assert got == difference(rows, later_of(rows))


def test_later_keys_in_either_direction(spark):
    rng = random.Random(4)
    a = [(k, f"t{k % 3}", "en", "s") for k in rng.sample(range(50_000), 2000)]
    b = [(100_000 + k, f"t{k % 4}", "en", "s") for k in rng.sample(range(3_000_000), 2500)] + a[:5]
    for way in (False, True):
        got = Counter(map(tuple, snapshots.snapshot_difference(frame(spark, a), frame(spark, b), descending=way).collect()))
        assert got == difference(a, b, way)


def test_repeated_keys_and_empty_snapshots(spark):
    a = [(1, "x", "en", "s")] * 700 + [(2, "y", None, None)] * 2 + [(None, "z", "en", "s")] * 2
    b = [(1, "x", "en", "s")] * 650 + [(2, "y", None, None), (2, "w", None, None), (None, "z", "en", "t")]
    got = Counter((r.key, r.op, r.changed) for r in snapshots.snapshot_difference(frame(spark, a), frame(spark, b)).collect())
    assert got[1, "same", ""] == 650 and got[1, "delete", ""] == 50 and got[2, "same", ""] + got[2, "update", "text"] == 2 and sum(got.values()) == 704
    assert got[None, "update", "source"] == 1 and got[None, "delete", ""] == 1
    none = frame(spark, [])
    assert snapshots.snapshot_difference(none, none).count() == 0
    assert Counter(r.op for r in snapshots.snapshot_difference(none, frame(spark, b)).collect()) == {"insert": 653}


def test_ranks_of_a_giant_group(spark):
    rng = random.Random(2)
    at = [rng.randrange(-(2**63), 2**63) for _ in range(1500)] + rng.sample(range(-3000, 3000), 2500)
    rows = spark.createDataFrame([("g", k) for k in at] + [("h", k) for k in at[:7]], "g string, at long")
    from passagelake.llm.scratch import Scratch

    got = {(r.g, r.at): r.i for r in snapshots.ranked(rows, ["g"], [], Scratch(spark, "test"), "r").collect()}
    assert got == {(g, k): i for g, ks in (("g", at), ("h", at[:7])) for i, k in enumerate(sorted(ks))}

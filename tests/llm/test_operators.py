"""Each operator against brute force on small documents with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from passagelake.llm import decontaminate, editwalk, families, graph, lines, minhash, mixing, order, paragraphs, repeats, tokens, toxicity
from passagelake.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig binary, id int, part string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=60)) + ".\nA shared line of text here\n" + " ".join(rng.choices(words, k=30)) + "." for _ in range(6)]
    rows = []
    for k in range(36):
        t = base[k % 6].split(" ")
        for _ in range(k // 12):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k * 3 + 1, " ".join(t), f"s{k % 4}" if k % 9 else None))
    rows += [(500, None, "s1"), (501, "", "s2"), (502, " \n\t", None), (503, "x", "s1"), (504, "One two", "s1"), (505, "one TWO", "s3")]
    rows += [(506, " ".join(rng.choices(words, k=9000)), "s0"), (507, "aaaa" * 400, "s0"), (508, "aaaa" * 300, "s2")]
    rows += [rows[3], (None, base[1], "s1")]
    return [(i, t, "en", s, None, b"x", 1, "p") for i, t, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(i):
    return -(2**63) if i is None else i


def test_repeats(docs, empty, rows):
    seen, want = {}, Counter()
    for i, t in sorted({(low(r[0]), r[1] or "") for r in rows}):
        b = t.encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < low(r[0]):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[r[0], len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()] += 1
    for part_bytes in (repeats.PART_BYTES, 3000):  # one part, and several that exchange chunks and segments
        assert Counter(map(tuple, repeats.remove_repeats(docs, digest=True, part_bytes=part_bytes).collect())) == want
    for hot in (1, 3):  # minimisers that more parts report go string by string
        assert Counter(map(tuple, repeats.remove_repeats(docs, digest=True, part_bytes=3000, hot=hot).collect())) == want
    assert repeats.remove_repeats(empty).count() == 0


def _near(rows, width, num, den):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[low(r[0])] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]) and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    return sets, up


def test_near_duplicates(docs, empty, rows):
    for width, num in ((3, 85), (5, 80)):
        sets, up = _near(rows, width, num, 100)
        for r in minhash.near_duplicates(docs, width, num, 100).collect():
            i = low(r.doc_id)
            assert (r.n_shingles, low(r.component_id), r.kept) == (len(sets[i]), up[i], up[i] == i)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.unique_documents(empty).count() == 0


def test_rows_of_one_id_go_by_their_texts(spark):
    x, y = " ".join(f"x{k}" for k in range(40)), " ".join(f"y{k}" for k in range(50))
    rows = [(3, x, "a"), (5, y, "b"), (5, x + " more", "c"), (5, x + " more", "d"), (None, None, "e"), (None, None, "f"), (None, y, "g"), (5, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_row.x` string").withColumnRenamed("_row.x", "row")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == {(3, 36, 3, True): 1, (5, 46, None, False): 1, (5, 37, 3, False): 2, (None, 0, None, True): 2, (None, 46, None, True): 1, (5, 0, 5, True): 1}
    kept = minhash.unique_documents(docs)
    assert kept.columns == docs.columns and {r.row for r in kept.collect()} == {"a", "e", "f", "g", "h"}
    alone = minhash.unique_documents(docs.where("row in ('c', 'd', 'b')"))  # a copy goes, another text of the same id stays
    assert {r.row for r in alone.collect()} in ({"b", "c"}, {"b", "d"})


@pytest.mark.parametrize("shared", [34, 56])
def test_twins_among_unlike_siblings(spark, shared):
    """Documents that share ``shared`` of 120 words in a row; among them pairs that are near-duplicates."""
    rng = random.Random(shared)
    base, rows, twins = [f"w{k}" for k in range(shared)], [], []
    for k in range(160):
        t = base + [f"n{k}x{j}" for j in range(120 - shared)]
        rows.append((2 * k, " ".join(t), "en", "s", 0, b"", 1, ""))
        if k % 4 == 0:
            t[rng.randrange(shared, 118)] = "other"
            rows.append((2 * k + 1, " ".join(t), "en", "s", 0, b"", 1, ""))
            twins.append(2 * k)
    seen = []
    for parts in (1, 7):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        assert all(got[k + 1] == k for k in twins) and all(got[k] == k for k in got if k - 1 not in twins or k % 2 == 0)
        seen.append(got)
    assert seen[0] == seen[1]


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(families, "FAMILY_BLOCK", 4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(25):
        t = list(base)
        t[k * 3 : k * 3 + 2] = [f"n{k}", f"m{k}"]
        rows.append((k, " ".join(t), "en", "s", 0, b"", 1, ""))
    sets, up = _near(rows, 3, 85, 100)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, 100).collect()}
    assert got == up


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(15)] + [(7, 7)]
    up = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        got = {r.id: r.component for r in graph.components(df, Scratch(spark, "t"), "c").collect()}
        assert got == {k: v for k, v in up.items() if k != v}


def test_lines(docs, empty, rows):
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for r in sorted(rows, key=lambda r: low(r[0])):
        for x in (r[1] or "").split("\n"):
            first.setdefault(x.strip(space).translate(lower), low(r[0]))
    want = Counter()
    for r in rows:
        have = (r[1] or "").split("\n")
        kept = [x for x in have if len(k := x.strip(space).translate(lower)) < 10 or first[k] == low(r[0])]
        want[r[0], len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    for batches in (1, 9):
        assert Counter(map(tuple, lines.drop_repeated_lines(docs, batches=batches, digest=True).collect())) == want
    assert lines.drop_repeated_lines(empty).count() == 0


def test_line_runs_are_kept_between_calls(spark, tmp_path):
    text = lambda k: f"line number {k} of all\nwhat every call says again\nline number {k + 1} of all"
    df = lambda ids: spark.createDataFrame([(k, text(k)) for k in ids], "doc_id long, text string")
    for call, ids in enumerate((range(0, 6), range(6, 12), range(12, 14))):
        runs = lines.LineRuns(spark, str(tmp_path / "runs"))
        assert runs.buckets == 4 and sum(map(len, runs.levels)) == (0, 1, 1)[call]
        got = {r.doc_id: bytes(r.kept).decode() for r in lines.drop_repeated_lines(df(ids), batches=1, runs=runs).collect()}
        assert got == {k: text(0) if k == 0 else f"line number {k + 1} of all" for k in ids}
        runs.close()
    runs = lines.LineRuns(spark, str(tmp_path / "runs"))
    assert [len(x) for x in runs.levels] == [1, 1]  # two runs of the first level became one of the second
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    with lines._sorted_scans(spark):
        plan = runs.unknown(spark.range(9).selectExpr("id as h1", "id as h2").repartition(4, "h1", "h2"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.close()
    assert plan.count("LeftAnti") == 2 and plan.count("Exchange") == 1  # that of the batch alone


def test_edit_fingerprints(docs, empty, rows):
    got = editwalk.edit_fingerprints(docs).collect()
    assert len(got) == len(rows)
    text = {low(r[0]): r[1] or "" for r in rows}
    inner = [i for i in sorted(text) if low(rows[3][0]) != i]  # the row that is there twice follows itself
    follow = dict(zip(sorted(text), [*sorted(text)[1:], sorted(text)[0]]))
    by = defaultdict(list)
    for r in got:
        by[low(r.doc_id)].append(r)
    for i in inner:
        t, n = text[i], text[follow[i]]
        half = len(t) // 2
        assert (by[i][0].n_chars, by[i][0].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())
    prints = {}
    for r in got:
        assert prints.setdefault(text[low(r.doc_id)], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
    long = [r for r in got if r.n_chars > 300 and r.doc_id not in (507, 508)]
    assert np.mean([r.near_edited for r in long]) > 0.3
    assert editwalk.edit_fingerprints(empty).count() == 0
    comp = {low(r.doc_id): low(r.component_id) for r in editwalk.near_by_edits(docs).collect()}
    assert comp[low(rows[0][0])] == comp[low(rows[6][0])] and comp[501] == 501


def test_edited_versions_are_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(families, "FAMILY_BLOCK", 64)
    rng = random.Random(6)
    base = rng.choices("abcdefghijklmnop ", k=3000)
    rows = []
    for k in range(250):
        t = list(base)
        for _ in range(14):
            t[rng.randrange(len(t))] = rng.choice("qrstuvwxyz")
        rows.append((k, "".join(t), "en", "s", 0, b"", 1, ""))
    fp = editwalk.fingerprints([np.array(list(map(ord, r[1])), np.uint32) for r in rows])
    least = float(np.median([np.sort(editwalk.likeness(x, fp))[-3] for x in fp]))  # few pairs are this near
    up = np.arange(len(rows))
    near = [np.flatnonzero(editwalk.likeness(x, fp) >= least) for x in fp]
    for _ in rows:
        up = np.array([up[x].min() for x in near])
    got = {r.doc_id: r.component_id for r in editwalk.near_by_edits(spark.createDataFrame(rows, SCHEMA), least).collect()}
    assert got == dict(enumerate(up.tolist()))


def test_pretokens_and_edits_equal_the_pattern():
    rng = random.Random(1)
    alphabet = ["a", "b", "'", "s", "re", "ll", "t", " ", "  ", "\n", "\t", "1", "23", "!!", "é", " ", "中", "'s", "ve", " ", "😀"]
    coder, pattern, enc = tokens.Coder(), regex.compile(tokens.PATTERN), tokens.encoding()
    for _ in range(600):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        cp = tokens.code_points(text)
        start = tokens.pretoken_starts(cp, np.zeros(1, np.int64)) if text else np.zeros(0, np.int64)
        assert start.tolist() == [m.start() for m in pattern.finditer(text)]
        tree = tokens.SegmentTree(np.diff(np.append(start, len(cp))), coder.counted(text, cp, start) if text else np.zeros(0))
        for _ in range(3):
            at, drop, put = rng.randint(0, len(text)), rng.randint(0, 5), "".join(rng.choices(alphabet, k=rng.randint(0, 3)))
            after = text[:at] + put + text[at + drop :]
            text, _ = tokens.edit(coder, tree, text, at, drop, put)
            assert text == after and tree.total == (len(text), len(enc.encode_ordinary(text))) and len(tree) == len(pattern.findall(text))


def test_token_counts(docs, empty, rows):
    enc = tokens.encoding()
    text = {r[0]: r[1] or "" for r in rows}
    for r in tokens.token_counts(docs).collect():
        t = text[r.doc_id]
        assert (r.n_chars, r.n_tokens) == (len(t), len(enc.encode_ordinary(t)))
        for at, drop, put in tokens.redactions(t):
            t = t[:at] + put + t[at + drop :]
        assert (r.n_chars_edited, r.n_tokens_edited) == (len(t), len(enc.encode_ordinary(t)))
        assert r.n_pretokens < 100 or r.n_reencoded < r.n_pretokens / 2
    assert tokens.token_counts(empty).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 1025):
        assert sorted(order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def test_training_order_round_trip(docs, empty, rows, tmp_path, spark):
    records = order.training_order(docs, key=4, length=64, per_shard=40)
    got = records.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    stream = np.frombuffer(b"".join(r.record[: 2 * r.n_tokens] for r in sorted(got, key=lambda r: r.sequence)), np.uint16)
    ends = np.flatnonzero(stream == order.END)
    enc = tokens.encoding()
    back = Counter(enc.decode([int(x) for x in stream[a:b]]) for a, b in zip(np.append(0, ends[:-1] + 1), ends))
    assert back == Counter(r[1] or "" for r in rows)
    stride = order.write_shards(records, str(tmp_path / "shards"), 64)
    by = {r.slot: r.record for r in got}
    files = sorted((tmp_path / "shards").glob("part-*"))
    assert [f.stat().st_size // stride for f in files] == [40] * (len(got) // 40) + [len(got) % 40] * bool(len(got) % 40)
    for place, ids in order.read_shard(spark, str(files[1]), stride, 7).collect():
        assert place >= 7 and by[40 + place] == ids.tobytes()
    assert order.order_digest(empty).count() == 0
    written = order.shards_in_order(docs.repartition(5), str(tmp_path / "again"), 64, 40, key=4).collect()
    assert {(r.slot, r.sha256) for r in written} == {(r.slot, hashlib.sha256(r.record).hexdigest()) for r in got} and len(written) == len(got)
    assert all(r.slot == 40 * r.shard + r.place for r in written)
    assert order.shards_in_order(empty, str(tmp_path / "none")).count() == 0
    few = order.order_digest(docs.repartition(3), length=64).collect()
    assert {(r.slot, r.sha256) for r in few} == {(r.slot, r.sha256) for r in order.order_digest(docs.coalesce(1), length=64).collect()}


def test_ids_stay_where_they_lie_at_any_size(docs, spark):
    """op6: a table of starts over the broadcast threshold had all ids shuffled once more."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = order.order_digest(docs, length=64)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        many = {(r.slot, r.sha256) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert many == {(r.slot, r.sha256) for r in order.order_digest(docs, length=64).collect()}


def test_words_that_recur_send_no_segments():
    """op2: among texts of few words nearly every short gram occurs twice, and nearly every segment travelled."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words, 30_000)) for _ in range(2)]
    a, b = (repeats._Part(pa.table({"id": pa.array([k], pa.int64()), "text": [t]}), 50) for k, t in enumerate(texts))
    assert np.isin(a.gram, b.gram).mean() < 0.05


def test_mixing(docs, empty, rows, spark):
    got = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    src = {r[0]: r[3] for r in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = src[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in size if s is not None)) + [None]
    cap, want, open_ = {s: 2.0 * size[s] for s in names}, {}, set(names)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        level = (1.5 * sum(size.values()) - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap[s]}
        if not over:
            break
        want |= {s: cap[s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    # The schedule by brute force: every slot's point falls to the source whose share holds it.
    block, aim = max(16, sum(size.values()) >> 20), [int(want[s] + 0.5) for s in names]
    edge = [int(x / sum(aim) * 2**32) for x in np.cumsum([0, *aim])]
    slots = defaultdict(list)
    for k in range(-(-sum(aim) // block)):
        slots[names[np.searchsorted(edge, k * 2654435769 % 2**32, "right") - 1]].append(k)
    after = -(-sum(aim) // block)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and taken[s] == min(int(want[s] + 0.5), 2 * size[s])
        missing = max(0, -(-taken[s] // block) - len(slots[s]))
        slots[s] += range(after, after + missing)
        after += missing
        mine = [r for r in got if src[r.doc_id] == s and r.size]
        assert {r.first_slot for r in mine} <= {*slots[s], None} and (not slots[s] or slots[s][0] in {r.first_slot for r in mine})
    again = mixing.mixed(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mixed(empty).count() == 0
    none = spark.createDataFrame([(1, None, "s"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mixed(none).collect()] == [(0, 0), (0, 0)]
    # Sources far smaller than a block meet their targets too, and repeated rows of one id stay rows.
    tiny = [(k, "one two three", f"s{k % 300:03}") for k in range(300)] + [(k, "w " * 4000, "big") for k in (1000, 1000, 1001)]
    sums = mixing.mixed(spark.createDataFrame(tiny, "doc_id long, text string, source string")).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target * (300 if r.source_size == 3 else 1)) <= 1 for r in sums) and len(sums) >= 2
    odd = docs.select(*docs.columns, docs["n_chars"].alias("a.b"), docs["id"].alias("_row"))
    kept = mixing.mixed_documents(odd)
    assert kept.columns == odd.columns and max(Counter(r.doc_id for r in kept.collect() if r.doc_id != rows[3][0]).values()) <= 2


def test_decontamination(spark, empty):
    item = "A train leaves Boston at 5 pm and travels 120 km in 2 hours before it meets the second train near Albany today"
    changed = item.replace("120", "450").replace("Boston", "Denver").replace(" 2 ", " 9 ")
    odd = item.replace("120", "450") + " . then"
    texts = [f"Before it. {item} After it.", f"Other words. {changed}", "nothing of the kind is here at all, not one window", None, "", odd, item.upper()]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, b"", 1, "") for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny"), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[0, 7] == "verbatim" and got[1, 7] == "reparameterised" and got[5, 7] == "reparameterised"
    assert {d for d, _ in got} <= {0, 1, 5, 6}
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and {2, 3, 4} <= {r.doc_id for r in kept.collect()}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    twice = item.replace("Boston at 5 pm and travels 120 km in 2", "Boston at 5 pm and travels 5 km in 5")
    ask = spark.createDataFrame([(1, twice)], "item_id long, text string")
    assert decontaminate.contaminated(docs.where("doc_id = 0"), ask).count() == 0  # one value cannot become three


def test_decontamination_equals_brute_force(spark):
    """Items in all their places, by a search of plain Python: verbatim ones, and shares of windows at the threshold."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    bench = [(k, " ".join(rng.choices(words, k=rng.choice((2, 4, 5, 9, 14, 30))))) for k in range(25)]
    texts = []
    for k in range(80):
        t = rng.choices(words, k=60)
        for _ in range(k % 3):
            item = rng.choice(bench)[1].split()
            if k % 2:
                item[rng.randrange(len(item))] = "other"
            t[rng.randrange(60) : 0] = item
        texts.append((k // 2, " ".join(t)))  # two rows of each id
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    want = set()
    for i, t in texts:
        for j, b in bench:
            w, v = b.split(), t.split()
            n = min(len(w), 5)
            held = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if 100 * len(windows(w) & held) >= 80 * len(windows(w)):
                want.add((i, j))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    ask = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated(docs, ask).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.kind == "verbatim" and 0.8 <= r.share <= 1 for r in got) and want
    kept = Counter(tuple(r) for r in decontaminate.clean_documents(docs.withColumn("row", docs["doc_id"]), ask).select("doc_id", "text").collect())
    assert kept == Counter((i, t) for i, t in texts if not any(100 * len(windows(b.split()) & {tuple(t.split()[k : k + min(5, len(b.split()))]) for k in range(len(t.split()))}) >= 80 * len(windows(b.split())) for _, b in bench))


def test_items_with_other_values(spark):
    tom = "Tom has 12 apples. Tom buys 7 more apples from Sara. How many apples does Tom have now?"
    tank = "A large water tank holds 250 litres and a pump fills it at 3 litres every minute until the gauge on its side shows full"
    trip = "The old bus that leaves Boston in the morning reaches the sea after a slow ride of 90 km and then returns to Boston empty"
    walk = "The runner who trains at dawn covers a loop of 5 km and then another path of 8 km before the sun is above the hills"
    whom = "The bright young lawyer named Anna told the quiet judge that nobody had seen the painting before the museum of art closed"
    bench = {1: tom, 2: tank, 3: trip, 4: walk, 5: whom}
    texts = [
        (1, tom.replace("Tom", "Ann")), (2, tank.replace("250", "1,250").replace("at 3", "at 2.5")), (3, trip.replace("Boston", "New York")),
        (4, walk.replace("5 km", "6km").replace("8 km", "9km")), (4, walk.replace("5 km", "6 miles").replace("8 km", "9 miles")),
        (5, whom.replace("Anna", "McKay")), (5, whom.replace("Anna", "Élodie")),
    ]
    docs = spark.createDataFrame([(k, "Some text. " + t, "en", "s", 0, b"", 1, "") for k, (_, t) in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()}
    assert got == {(k, i, "reparameterised") for k, (i, _) in enumerate(texts)}


def test_verbatim_items_without_literal_windows_and_beside_likenesses(spark):
    sums = "Compute 12 + 7 * 3 - 4 and 9"
    item = "a basket holds 5 red apples and a crate holds 5 red apples so count all of the fruit"
    wrong = item.replace("holds 5", "holds 8", 1).replace("crate holds 5", "crate holds 6")
    texts = [f"So: {sums} now", f"{wrong}. {wrong}. {item}. {wrong}", wrong, "Compute 12 + 8 * 3 - 4 and 9"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, b"", 1, "") for k, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(1, sums), (2, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, 1, "verbatim"), (1, 2, "verbatim")}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {2, 3}


def test_paragraphs(docs, empty, spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    say = lambda n: " ".join(" ".join(rng.choices(words, k=8)) + "." for _ in range(n))
    passage = say(12)
    rows = [(k, say(6) + (" " + passage + " " if k in (2, 9, 11) else " ") + say(6), "en", "s", 0, b"", 1, "") for k in range(14)]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {2, 9, 11} and {r.doc_id for r in got if r.removed} == {9, 11} and {r.kept_doc_id for r in got} == {2}
    text = {r[0]: r[1].encode() for r in rows}
    assert all(text[r.doc_id][r.begin : r.finish].decode() in passage for r in got)
    assert paragraphs.repeated_paragraphs(docs).count() > 0
    assert paragraphs.repeated_paragraphs(empty).count() == 0


def test_paragraph_variants_are_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(families, "FAMILY_BLOCK", 16)
    rng = random.Random(4)
    rows, sets = [], {}
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(60)]
        for v in range(12):
            t = list(base)
            for _ in range(v and 1 + v % 2):
                t[rng.randrange(60)] = f"n{rng.randrange(10**9)}"
            i = f * 100 + v
            rows.append((i, " ".join(t), "en", "s", 0, b"", 1, ""))
            sets[i] = {tuple(t[k : k + 5]) for k in range(56)}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = {i: i for i in sets}
    for _ in range(12):
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    want = {i: up[i] for i in up if list(up.values()).count(up[i]) > 1}
    got = {r.doc_id: r.kept_doc_id for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA)).collect() if r.n_words == 60}
    assert got == want


def test_short_repeated_paragraphs_by_parameters(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    stock = {n: " ".join(word() for _ in range(n)) for n in (1, 3, 4, 5, 7, 8, 20)}
    rows = []
    for k in range(28):
        lines = [" ".join(word() for _ in range(9)) for _ in range(4)]
        lines.insert(rng.randrange(5), list(stock.values())[k % 7])
        rows.append((k, "\n".join(lines), "en", "s", 0, b"", 1, ""))
    rows += [(40, None, "", "", 0, b"", 1, ""), (41, "", "", "", 0, b"", 1, ""), (None, stock[20] + "\nx", "", "", 0, b"", 1, ""), (0, rows[0][1], "", "", 0, b"", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for least, passage in ((1, 1), (4, 1), (8, 9), (8, 24)):
        want = set()
        for k in range(28):
            n = list(stock)[k % 7]
            if n >= least and n >= passage:
                at = rows[k][1].encode().index(stock[n].encode())
                want.add((k, at, at + len(stock[n]), n, None if n == 20 else k % 7, n == 20 or k >= 7))
        if passage <= 20:
            want.add((None, 0, len(stock[20]), 20, None, False))
        got = paragraphs.repeated_paragraphs(docs, least, passage).collect()
        assert {(r.doc_id, r.begin, r.finish, r.n_words, r.kept_doc_id, r.removed) for r in got} == want, (least, passage)
    with pytest.raises(ValueError):
        paragraphs.repeated_paragraphs(docs, 0)


def test_hot_seeds_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = " ".join(word() for _ in range(40))
    rows = [(k, " ".join([word() for _ in range(9)] + ([line] if k % 2 else []) + [word() for _ in range(9)]), "en", "s", 0, b"", 1, "") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for hot in (0, 1000):  # no key is hot, every shared one is
        monkeypatch.setattr(paragraphs, "HOT", hot)
        seen.append({tuple(r) for r in paragraphs.repeated_paragraphs(docs).collect()})
    assert seen[0] == seen[1]
    words = Counter()
    for r in seen[0]:
        words[r[0]] += r[4]
    assert words == {k: 40 for k in range(1, 60, 2)} and {r[0] for r in seen[0] if not r[7] and r[6] == 1} == {1}


@pytest.mark.parametrize("run", [24, 10, 3])
def test_passages_within_lines(spark, run):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, want = [], {}
    for k in range(60):
        n = run - 1 if k % 6 == 5 else run if k % 6 == 4 else rng.randint(51, 60)
        passage = [word() + ("." if rng.random() < 0.06 * (k % 3) else "") for _ in range(n)]
        for i in (2 * k, 2 * k + 1):
            a, b = ([word() for _ in range(rng.randint(30, 50))] for _ in range(2))
            text = " ".join(a + passage + b)
            rows.append((i, text, "en", "s", 0, b"", 1, ""))
            at = len(" ".join(a)) + 1
            if n >= run:
                want[i] = (at, at + len(" ".join(passage)), n, 2 * k, i > 2 * k)
    rows.append((200, rows[8][1], "en", "s", 0, b"", 1, ""))
    got = defaultdict(list)
    for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA), run=run).collect():
        got[r.doc_id].append(r)
    del got[200], got[8], want[8]
    assert set(want) <= set(got) and all(k in want or k // 2 % 6 == 5 for k in got)
    for i, (a, b, n, one, removed) in want.items():
        assert (min(r.begin for r in got[i]), max(r.finish for r in got[i]), sum(r.n_words for r in got[i])) == (a, b, n)
        assert {(r.kept_doc_id, r.removed) for r in got[i]} == {(one, removed)}


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(500):
        t, bad = rng.choices(words, k=rng.randint(20, 90)), k % 4 == 0
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["vilest", "grunk", "zzmor" + rng.choice(words)])
        rows.append((k, " ".join(t), "en", "s", 0, b"", 1, ""))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, "", "", 0, b"", 1, ""), (901, "", "", "", 0, b"", 1, ""), (None, "grunk vilest", "", "", 0, b"", 1, "")]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1}
    truth = {k: y for k, _, y in labels}
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert np.mean(right) > 0.9 and all(r.score == 0 for r in got if r.doc_id in (900, 901))
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    none = toxicity.toxicity(docs, lab.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    scored = toxicity.score(docs, None)
    assert scored.columns == [*docs.columns, "score"]
    odd = docs.withColumn("score", docs["doc_id"] * 1.0)
    with pytest.raises(ValueError):
        toxicity.score(odd, None)
    model = toxicity.fit(odd, lab)
    kept = toxicity.clean_documents(odd, model).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in got if r.score < 0.7} and all(r.score == r.doc_id for r in kept if r.doc_id is not None)
    long = spark.createDataFrame([(k, ("x y z " * 9000) + ("grunk vilest zzmor " * 3 if k % 4 == 0 else "")) for k in range(0, 8)], "doc_id long, text string")
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in toxicity.score(long, model).collect())  # the end of a long text counts
    assert toxicity.fit(long, lab) is None  # none is short enough to learn from

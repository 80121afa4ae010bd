"""The pipeline's stages: what each keeps, held against brute force over its own input."""

from collections import Counter

import numpy as np

import corpus_pipeline as cp


def test_stages_and_run(spark, tmp_path):
    d = str(tmp_path)
    item = "the quick answer to this long question is found on page nine of the small green book"
    texts = [f"document number w{k} " + " ".join(f"t{k}x{j}" for j in range(60)) for k in range(30)]
    texts += [texts[0], texts[1].replace("t1x30", "other"), "intro. " + item + " end", None, ""]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = {r[0] for r in rows}
    for name, gone in (("toxicity", set()), ("minhash_near_dedup", {30, 31}), ("benchmark_decontamination", {32})):
        docs = dict(cp.STAGES)[name](spark, docs, d)
        left -= gone
        assert {r.doc_id for r in docs.collect()} == left and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = dict(cp.STAGES)["source_mixing"](spark, docs, d)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= left and max(times.values()) <= 2
    out = cp.run(spark, d).collect()
    assert out and sorted(r.slot for r in out) == list(range(len(out)))
    # The records hold the ids of the mixed documents, each text as often as the mix has it.
    from passagelake.llm import order, tokens

    stream = np.frombuffer(b"".join(bytes(r.record[: 2 * r.n_tokens]) for r in sorted(out, key=lambda r: r.sequence)), np.uint16)
    ends, enc, text = np.flatnonzero(stream == order.END), tokens.encoding(), {r[0]: r[1] or "" for r in rows}
    back = Counter(enc.decode(stream[a:b].tolist()) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True))
    assert back == sum((Counter({text[k]: n}) for k, n in times.items()), Counter())


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, columns that clash with inner names, and no rows at all."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "an item that no document of these holds in any place")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    x = " ".join(f"x{k}" for k in range(30))
    rows = [(1, x), (1, "quite another text with one id"), (None, x + " again"), (None, None), (2, ""), (2, "words " * 30)]
    names = ["score", "_gone", "row", "th", "id", "a.b"]
    full = spark.createDataFrame([(i, t, "en", None, None, *[float(k)] * 6) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` double" for n in names))
    for docs, left in ((full, {1, 2, 3, 4, 5}), (full.limit(0), set())):
        columns = docs.columns
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, d)
            if name != "training_order":
                assert docs.columns == columns and {r.score for r in docs.collect()} == left | ({0.0} if name == "toxicity" and left else set())
        assert (docs.count() > 0) == bool(left)


def test_sql_of_the_subpackage(spark):
    import glob
    import os

    import duckdb

    from passagelake.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        return
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.oracle_sql().items():
        a, b = queries.queries()[name](spark, data), con.sql(sql)
        assert sorted(a.columns) == sorted(b.columns)
        assert Counter(map(tuple, a.select(sorted(a.columns)).collect())) == Counter(b.select(*sorted(b.columns)).fetchall())

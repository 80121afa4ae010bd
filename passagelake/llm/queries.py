"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, decontaminate, editwalk, lines, minhash, mixing, ngramjoin, order, paragraphs, repeats, snapshots, tokens, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), 50, digest=True)


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.order_digest(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_read(spark, sf_dir, "documents"), digest=True)


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editwalk.edit_fingerprints(_read(spark, sf_dir, "documents"))


def near_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of operator 9: classes of documents by banded and verified fingerprints."""
    return editwalk.near_by_edits(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.vector_codes(_read(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_read(spark, sf_dir, "documents"), width=5, num=80, den=100)


def op13_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return snapshots.snapshot_difference(docs, snapshots.changed_snapshot(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_repeat_removal, op3_minhash_near_duplicates, op4_benchmark_decontamination, op5_source_mixing,
            op6_training_order, op7_line_dedup, op8_paragraph_dedup, op9_edit_fingerprints, op10_toxicity, near_by_edits, op11_vector_codes, op12_ngram_join,
            op13_snapshot_difference,
        )
    }


# Targets by sorted limits; the schedule's points, a source's slots by rank, those that make up what is missing, and the stream they read.
_OP5 = r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS is_null,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s0 AS (SELECT src, is_null, sum(size)::BIGINT AS source_size FROM rows GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY is_null, src) - 1 AS rank, sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / w AS fill,
              coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
              sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM s2),
s4 AS (SELECT *, (1.5 * total - cap_before) / w_left AS level FROM s3),
s5 AS (SELECT *, (SELECT struct_pack(fill, rank, level) FROM s4 WHERE fill >= level ORDER BY fill, rank LIMIT 1) AS stop FROM s4),
s6 AS (SELECT src, is_null, rank, source_size, total, greatest(16, total // 1048576)::BIGINT AS block,
              (CASE WHEN stop IS NULL OR fill < stop.fill THEN cap ELSE least(cap, stop.level * w) END)::DOUBLE AS target FROM s5),
s7 AS (SELECT *, sum(round(target)::BIGINT) OVER (ORDER BY rank)::BIGINT AS upto, sum(round(target)::BIGINT) OVER ()::BIGINT AS aims FROM s6),
s8 AS (SELECT *, floor((upto - round(target)::BIGINT) / greatest(aims, 1) * 4294967296)::BIGINT AS x0, floor(upto / greatest(aims, 1) * 4294967296)::BIGINT AS x1 FROM s7),
points AS (SELECT slot, slot * 2654435769 % 4294967296 AS x FROM (SELECT unnest(range((aims + block - 1) // block)) AS slot FROM (SELECT DISTINCT aims, block FROM s7))),
slots AS (SELECT rank, slot, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth FROM points JOIN s8 ON x >= x0 AND x < x1),
s9 AS (SELECT s8.*, least(round(target)::BIGINT, 2 * source_size)::BIGINT AS give, coalesce(n, 0) AS n FROM s8 LEFT JOIN (SELECT rank, count(*) AS n FROM slots GROUP BY rank) USING (rank)),
s10 AS (SELECT *, greatest(0, (give + block - 1) // block - n) AS more FROM s9),
s11 AS (SELECT *, coalesce((SELECT max(slot) + 1 FROM slots), 0) - n + sum(more) OVER (ORDER BY rank) - more AS later FROM s10),
p AS (SELECT r.*, rank, block, source_size, target, give, n, later,
             sum(size) OVER (PARTITION BY r.src, r.is_null ORDER BY draw, size ROWS UNBOUNDED PRECEDING) - size AS begin
      FROM rows r JOIN s11 USING (src, is_null))
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE (give // source_size) * size + greatest(0, least(size, give % source_size - begin)) END::BIGINT AS taken,
       CASE WHEN size > 0 AND begin < give AND begin // block >= n THEN (later + begin // block)::BIGINT ELSE slots.slot END AS first_slot
FROM p LEFT JOIN slots ON size > 0 AND begin < give AND slots.rank = p.rank AND nth = begin // block
"""

# Lines of a text, their keys, and the smallest document that holds each key.
_OP7 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


# Lloyd's rounds over all parts and entries, no bounds: four components a part, as the vectors of the table have.
_DISTANCE = "(x0 - e0) * (x0 - e0) + (x1 - e1) * (x1 - e1) + (x2 - e2) * (x2 - e2) + (x3 - e3) * (x3 - e3)"


def _assigned(n: int) -> str:
    """The parts with their nearest entries of round ``n``, and the entries of the next."""
    means = ", ".join(f"CASE WHEN g.n IS NULL THEN e{j} ELSE (s{j} - ((s{j} % g.n) + g.n) % g.n) // g.n END::BIGINT AS e{j}" for j in range(4))
    return f"""
a{n} AS (SELECT vec_id, label, part, x0, x1, x2, x3, min(struct_pack(d := {_DISTANCE}, k := k)) AS best FROM x JOIN b{n} USING (part) GROUP BY ALL),
b{n + 1} AS (SELECT part, k, {means} FROM b{n} LEFT JOIN
  (SELECT part, best.k AS k, count(*)::BIGINT AS n, {", ".join(f"sum(x{j})::BIGINT AS s{j}" for j in range(4))} FROM a{n} GROUP BY ALL) g USING (part, k))"""


_OP11 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, part, {", ".join(f"v[4 * part + {j + 1}] AS x{j}" for j in range(4))} FROM kept, range(16) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, {", ".join(f"x{j} AS e{j}" for j in range(4))} FROM x QUALIFY k < 64),
{_assigned(0)}, {_assigned(1)}, {_assigned(2)},
books AS (SELECT sha256(string_agg(concat_ws(',', e0, e1, e2, e3), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b2),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""

# The later snapshot by crc32, bit by bit; pairs by key, then ranks within equal texts.
_OP13 = r"""
WITH way AS (
  SELECT doc_id::BIGINT AS k, text, lang, source, coalesce(xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(8 * len(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE -1 END::BIGINT),
    lambda c, b: CASE WHEN xor(c, greatest(b, 0)) & 1 = 1 THEN xor(xor(c, greatest(b, 0)) >> 1, 3988292384) ELSE xor(c, greatest(b, 0)) >> 1 END)) % 16, -1) AS way
  FROM documents),
later AS (
  SELECT CASE WHEN way IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN way = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN way = 2 THEN source ELSE lang END AS lang, CASE WHEN way = 2 THEN lang WHEN way <> 4 THEN source END AS source
  FROM way WHERE way <> 0
  UNION ALL SELECT -1 - k, text, lang, source FROM way WHERE way = 5),
e AS (SELECT k, text, lang, source, true AS here FROM way), l AS (SELECT *, true AS here FROM later),
met AS (SELECT e, l FROM e FULL JOIN l ON e.k IS NOT DISTINCT FROM l.k),
e1 AS (SELECT e, coalesce(e.text, '~null') AS t, row_number() OVER (PARTITION BY coalesce(e.text, '~null') ORDER BY e.k NULLS FIRST) AS i FROM met WHERE l.here IS NULL),
l1 AS (SELECT l, coalesce(l.text, '~null') AS t, row_number() OVER (PARTITION BY coalesce(l.text, '~null') ORDER BY l.k NULLS FIRST) AS i FROM met WHERE e.here IS NULL),
pairs AS (
  SELECT e, l, true AS by_key FROM met WHERE e.here AND l.here
  UNION ALL SELECT e, l, false FROM e1 FULL JOIN l1 USING (t, i)),
c AS (SELECT *, e.here AND l.here AS pair, concat_ws(',', CASE WHEN e.text IS DISTINCT FROM l.text THEN 'text' END, CASE WHEN e.lang IS DISTINCT FROM l.lang THEN 'lang' END,
                CASE WHEN e.source IS DISTINCT FROM l.source THEN 'source' END) AS differ FROM pairs)
SELECT CASE WHEN l.here THEN l.k ELSE e.k END AS key, e.k AS old_key,
       CASE WHEN l.here IS NULL THEN 'delete' WHEN e.here IS NULL THEN 'insert' WHEN NOT by_key THEN 'rekey' WHEN differ = '' THEN 'same' ELSE 'update' END AS op,
       CASE WHEN pair THEN differ ELSE '' END AS changed,
       CASE WHEN l.here THEN sha256(coalesce(l.text, '~') || chr(10) || coalesce(l.lang, '~') || chr(10) || coalesce(l.source, '~')) END AS row_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables; the other operators are tested against brute force, exact round trips or held-out labels."""
    return {"op5_source_mixing": _OP5, "op7_line_dedup": _OP7, "op11_vector_codes": _OP11, "op13_snapshot_difference": _OP13}

"""The registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import answers, chunking, conversation, dense, embedding, impacts, memory, ranking
from ..sources.shared import Folder, spread, state_of
from ..sources.store import PassageStore
from ..streaming import windows

K = 10
WEIGHTS = {"lexical": 0.7, "vector": 0.3}

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows where SQL can express them."""

    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sql_words(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
    found = f"regexp_extract_all(strip_accents(replace(lower(coalesce({text}, '')), 'ß', 'ss')), '[a-z0-9]+(?:[''\\-_][a-z0-9]+)*')"
    return f"list_filter({found}, lambda w: NOT list_contains([{stop}], w) AND (length(w) >= 2 OR regexp_matches(w, '^[0-9]$')))"


# -- text and identity ---------------------------------------------------------------------------------

_ID = "sha256(source || chr(0) || text)[1:32]"


@query("content_ids", f"SELECT doc_id, {_ID} AS id FROM documents")
def content_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.content_id(F.col("source"), F.col("text")).alias("id"))


@query("dedup_insert_if_absent", f"SELECT id, min(doc_id) AS doc_id FROM (SELECT {_ID} AS id, doc_id FROM documents WHERE doc_id % 3 <> 0) WHERE id NOT IN (SELECT {_ID} FROM documents WHERE doc_id % 3 = 0) GROUP BY id")
def dedup_insert_if_absent(spark, d):
    """The rows of a second batch that insert-if-absent adds to a first one; one for each content."""
    docs = content_ids(spark, d)
    have, new = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    return new.groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(have.select("id"), "id", "left_anti")


@query("tokenize_counts", f"SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct, coalesce(t[1], '') AS first_term FROM (SELECT doc_id, {_sql_words('text')} AS t FROM documents)")
def tokenize_counts(spark, d):
    t = read(spark, d, "documents").select("doc_id", tx.any_words(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.get("t", 0), F.lit("")).alias("first_term"))


@query("term_frequencies", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_sql_words('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequencies(spark, d):
    return _index(spark, d).postings.select(F.col("key").alias("doc_id"), "term", "tf")


_TERMS = f"t AS (SELECT doc_id AS key, {_sql_words('text')} AS terms FROM documents)"
_IDF = f"""{_TERMS},
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM t) GROUP BY term),
raw AS (SELECT term, df, ln(((SELECT count(*) FROM t) - df + 0.5) / (df + 0.5)) AS raw FROM df),
fl AS (SELECT 0.25 * avg(raw) AS f FROM raw),
idf AS (SELECT term, df, CASE WHEN raw > 0 THEN raw WHEN f > 0 THEN f ELSE 0.25 END AS idf FROM raw, fl)"""


@query("doc_frequency_idf", f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_frequency_idf(spark, d):
    return _index(spark, d).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("corpus_lexical_stats", f"WITH {_TERMS} SELECT count(*) AS n_passages, sum(len(terms))::BIGINT AS n_postings, round(avg(len(terms)), 6) AS average_length, (SELECT count(DISTINCT u) FROM (SELECT unnest(terms) AS u FROM t)) AS vocabulary FROM t")
def corpus_lexical_stats(spark, d):
    i = _index(spark, d)
    one = i.lengths.select(F.col("n").alias("n_passages"), F.round("avgdl", 6).alias("average_length"))
    return one.crossJoin(i.postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_postings"))).crossJoin(i.idf.agg(F.count("*").alias("vocabulary")))  # one row each


@query("sentence_split_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S')))::BIGINT AS n_sentences FROM documents")
def sentence_split_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("hard_cut_windows", "SELECT doc_id, i AS start, md5(substr(text, i + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS i FROM documents)")
def hard_cut_windows(spark, d):
    cut = read(spark, d, "documents").select("doc_id", F.posexplode(tx.hard_cut(F.col("text"), 1000, 200)).alias("n", "w"))
    return cut.select("doc_id", (F.col("n") * F.lit(800).cast("long")).alias("start"), F.md5("w").alias("digest"))


@query("token_estimates", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents")
def token_estimates(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("n_tokens"))


@query("structural_filter", r"SELECT page_id, count(*) FILTER (WHERE regexp_matches(l, '^\s*(#{1,6}\s|```|-{3,}|={3,}|>)')) AS n_structural, count(*) AS n_lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l FROM pages) GROUP BY page_id")
def structural_filter(spark, d):
    lines = read(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("l"))
    return lines.groupBy("page_id").agg(F.count_if(tx.structural(F.col("l"))).alias("n_structural"), F.count("*").alias("n_lines"))


_NAMES = ["readme.md", ".env.local", "config.env", "environment.md", "id_rsa", "server.PEM", "secrets.yaml", "notes.txt", "Token", "key.asc", "envoy.yaml"]


_SENSITIVE_SQL = "(lower(name) IN ('.netrc','.pgpass','.npmrc','.pypirc','.git-credentials','credentials','token','tokens','env') OR contains(lower(name), '.env') OR regexp_matches(lower(name), '^(id_|secret|credential|private_key|keystore)') OR regexp_matches(lower(name), '\\.(pem|key|p12|pfx|jks|keystore|kdbx|gpg|asc)$'))"


@query("sensitive_paths", f"SELECT name, {_SENSITIVE_SQL} AS sensitive FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS name)")
def sensitive_paths(spark, d):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", tx.sensitive_name(F.col("name")).alias("sensitive"))


@query("sample_queries", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: length(w) > 6)[1:4], ' ') AS query FROM documents")
def sample_queries(spark, d):
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: F.length(x) > 6)
    return read(spark, d, "documents").select("doc_id", F.array_join(F.slice(w, 1, 4), " ").alias("query"))


@query("chunk_documents")
def chunk_documents(spark, d):
    c = chunking.chunks(spread(read(spark, d, "documents")))
    return c.select("doc_id", "chunk_id", "ordinal", F.length("text").cast("long").alias("n_chars"))


@query("hashing_embeddings")
def hashing_embeddings(spark, d):
    e = embedding.hashed(spread(read(spark, d, "documents")))
    return e.select("doc_id", F.size("embedding").cast("long").alias("dim"), F.round(vec.norm(F.col("embedding")), 3).alias("norm"))


# -- ranking -----------------------------------------------------------------------------------------------


_INDEXES: dict[tuple[str, str], tuple[str, Folder, ranking.LexicalIndex]] = {}
_IMPACTS: dict[str, impacts.ImpactIndex] = {}


def _index(spark, d) -> ranking.LexicalIndex:
    """The lexical index of a folder's documents, written to the shared folder once for each state of their files.

    Texts are cut where they are read, and kept as blocks of whole documents.
    """
    name, now = (spark.sparkContext.applicationId, d), state_of(spark, f"{d}/documents.parquet")
    state, folder, _ = _INDEXES.get(name, (None, None, None))
    if state != now or not folder.holds("floor"):
        folder = Folder(spark, "lexical", free=True)
        _INDEXES[name] = now, folder, ranking.LexicalIndex.of_texts(read(spark, d, "documents"), keep=folder.keep)
    return _INDEXES[name][2]


def _impacts(spark, d) -> impacts.ImpactIndex:
    """The same postings by impact, beside the index they come from."""
    index, folder = _index(spark, d), _INDEXES[spark.sparkContext.applicationId, d][1]
    if folder.root not in _IMPACTS or not folder.holds("impacts/blocks"):
        _IMPACTS[folder.root] = impacts.ImpactIndex.build(index, f"{folder.root}/impacts")
    return _IMPACTS[folder.root]


def _lexical(spark, d, **kw) -> DataFrame:
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _index(spark, d).scores(ranking.query_terms(asked), keep=Folder(spark, "asked").keep, **kw)


def _vector(spark, d, k: int) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    asked = asked.join(v, asked["query_id"] == v["key"]).select("query_id", F.col("embedding").alias("query_vector"))
    return ranking.cosine_topk(v, asked, k)


def _bm25_sql(b: str = "0.75") -> str:
    return f"""{_IDF},
q AS (SELECT item_id AS query_id, unnest(list_distinct({_sql_words('text')})) AS term FROM benchmark),
avgdl AS (SELECT avg(len(terms)) AS a FROM t),
tf AS (SELECT key, term, len(terms) AS dl, count(*) AS tf FROM (SELECT key, terms, unnest(terms) AS term FROM t) GROUP BY ALL),
lexical AS (SELECT query_id, key, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / a))), 9) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term), avgdl GROUP BY query_id, key)"""


_VECTOR_SQL = """e AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings),
vector AS (SELECT item_id AS query_id, e.key, round(coalesce(list_dot_product(e.v, x.v) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(x.v, x.v)), 0), 0), 9) AS score
  FROM benchmark JOIN e x ON item_id = x.key, e)"""


def _top_sql(name: str, k: int) -> str:
    return f"SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM {name} WHERE score > 0 QUALIFY rank <= {k}"


_OUT = "SELECT query_id, rank, key, round(score, 6) AS score FROM"


def _shown(top: DataFrame) -> DataFrame:
    return top.select("query_id", "rank", "key", F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {_bm25_sql()} {_OUT} ({_top_sql('lexical', K)})")
def bm25_topk(spark, d):
    return _shown(ranking.topk(_lexical(spark, d, best=K), K))


_SHORT = r"array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: length(w) > 6)[1:4], ' ')"
_SHORT_SQL = _bm25_sql().replace("FROM benchmark)", f"FROM (SELECT item_id, {_SHORT} AS text FROM benchmark))")


@query("bm25_topk_pruned", f"WITH {_SHORT_SQL} {_OUT} ({_top_sql('lexical', K)})")
def bm25_topk_pruned(spark, d):
    """Each item's first four long words as a query, answered from postings by impact."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: F.length(x) > 6)
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 4), " ").alias("query"))
    return _shown(_impacts(spark, d).topk(ranking.query_terms(asked), K, Folder(spark, "pruned", free=True).keep))


@query("bm25_score_all", f"WITH {_bm25_sql()} SELECT query_id, key, round(score, 4) AS score FROM lexical")
def bm25_score_all(spark, d):
    return _lexical(spark, d).select("query_id", "key", F.round("score", 4).alias("score"))


@query("bm25_b0", f"WITH {_bm25_sql('0')} {_OUT} ({_top_sql('lexical', K)})")
def bm25_b0(spark, d):
    return _shown(ranking.topk(_lexical(spark, d, b=0.0, best=K), K))


@query("cosine_topk", f"WITH {_VECTOR_SQL} {_OUT} ({_top_sql('vector', K)})")
def cosine_topk(spark, d):
    return _shown(_vector(spark, d, K))


_NEAREST_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS key, round(coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0), 9) AS score FROM e a, e b)"""


@query("nearest_vectors", f"{_NEAREST_SQL} {_OUT} ({_top_sql('near', K)})")
def nearest_vectors(spark, d):
    """Every vector as a query against all vectors, neither side on the driver."""
    v = read(spark, d, "embeddings")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _shown(dense.nearest(v.select(F.col("vec_id").alias("key"), "embedding"), asked, K, Folder(spark, "nearest").keep))


@query("normalize_vectors", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(v[1] / n, 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(v, v)) AS n FROM embeddings)")
def normalize_vectors(spark, d):
    v = read(spark, d, "embeddings").where(vec.finite(F.col("embedding"))).select("vec_id", vec.normalised(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("u", 0), 6).alias("first"))


_POOL = 4 * K


def _ranked(spark, d) -> DataFrame:
    lexical, vector = ranking.topk(_lexical(spark, d, best=_POOL), _POOL), _vector(spark, d, _POOL)
    return Folder(spark, "ranked").keep(lexical.withColumn("list", F.lit("lexical")).unionByName(vector.withColumn("list", F.lit("vector"))), "ranked")


_RANKED = f"""{_bm25_sql()}, {_VECTOR_SQL},
ranked AS (SELECT *, 'lexical' AS list, 0.7 AS w0 FROM ({_top_sql('lexical', _POOL)}) UNION ALL SELECT *, 'vector', 0.3 FROM ({_top_sql('vector', _POOL)})),
weighed AS (SELECT r.*, w0 / total AS w FROM ranked r JOIN (SELECT query_id, sum(w0) AS total FROM (SELECT DISTINCT query_id, list, w0 FROM ranked) GROUP BY 1) USING (query_id))"""
_VALUE = {
    "rrf": "61.0 / (61 + rank - 1)",
    "weighted": "score",
    "dbsf": "CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) WHEN max(score) OVER l > 0 THEN 1.0 ELSE 0.0 END",
}


def _fused_sql(how: str) -> str:
    return f"""WITH {_RANKED}, parts AS (SELECT query_id, key, list, w * ({_VALUE[how]}) AS value FROM weighed WINDOW l AS (PARTITION BY query_id, list)),
fused AS (SELECT query_id, key, coalesce(max(value) FILTER (WHERE list = 'lexical'), 0)::DOUBLE AS lexical_part, coalesce(max(value) FILTER (WHERE list = 'vector'), 0)::DOUBLE AS vector_part FROM parts GROUP BY ALL)
SELECT query_id, rank, key, round(score, 6) AS score, round(lexical_part, 6) AS lexical_part, round(vector_part, 6) AS vector_part
FROM (SELECT *, round(lexical_part + vector_part, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical_part + vector_part, 9) DESC, key) AS rank FROM fused WHERE round(lexical_part + vector_part, 9) > 0) WHERE rank <= {K}"""


def _fused(spark, d, how: str) -> DataFrame:
    top = ranking.topk(ranking.fused(_ranked(spark, d), WEIGHTS, how), K)
    return top.select("query_id", "rank", "key", *[F.round(c, 6).alias(c) for c in ("score", "lexical_part", "vector_part")])


for _how in _VALUE:
    query(f"{_how}_hybrid", _fused_sql(_how))(partial(_fused, how=_how))


@query("rrf_single_list_weights", f"WITH {_bm25_sql()} SELECT query_id, key, round(61.0 / (61 + rank - 1), 6) AS score FROM ({_top_sql('lexical', K)})")
def rrf_single_list_weights(spark, d):
    """With hits of one retriever only, its weight is 1."""
    one = ranking.topk(_lexical(spark, d, best=K), K).withColumn("list", F.lit("lexical"))
    return ranking.fused(one, WEIGHTS).select("query_id", "key", F.round("score", 6).alias("score"))


_RERANK = f"""WITH {_bm25_sql()}, top AS ({_top_sql('lexical', _POOL)}),
pairs AS (SELECT top.query_id, top.key, list_distinct({_sql_words('b.text')}) AS q, list_distinct(t.terms) AS x FROM top JOIN benchmark b ON b.item_id = top.query_id JOIN t ON t.key = top.key),
reranked AS (SELECT query_id, key, round(CASE WHEN len(q) = 0 THEN 0 ELSE 2.0 * len(list_intersect(q, x)) / len(q) + CASE WHEN len(x) > 0 THEN 1.0 * len(list_intersect(q, x)) / len(x) ELSE 0 END END, 9) AS score FROM pairs)"""


@query("rerank_overlap", f"{_RERANK} {_OUT} ({_top_sql('reranked', K)})")
def rerank_overlap(spark, d):
    pool = Folder(spark, "pool").keep(ranking.topk(_lexical(spark, d, best=_POOL), _POOL).select("query_id", "key"), "pool")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = ranking.overlap_scores(pool, ranking.query_terms(asked), _index(spark, d).postings)
    return _shown(ranking.topk(scored, K))


@query("search_source_filter", f"WITH {_bm25_sql()} SELECT query_id, key, round(score, 6) AS score, source FROM ({_top_sql('lexical', _POOL)}) JOIN documents ON doc_id = key WHERE contains(source, 'src1')")
def search_source_filter(spark, d):
    """The filter comes after the cut to the pool, so it can leave fewer rows."""
    pool = ranking.topk(_lexical(spark, d, best=_POOL), _POOL)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "source")
    return pool.join(docs, "key").where(F.col("source").contains("src1")).select("query_id", "key", F.round("score", 6).alias("score"), "source")


@query("search_min_score", f"WITH {_bm25_sql()} {_OUT} ({_top_sql('lexical', K)}) WHERE score >= 12")
def search_min_score(spark, d):
    return _shown(ranking.topk(_lexical(spark, d, best=K), K).where("score >= 12"))


_RELEVANT = "relevant AS (SELECT b.item_id AS query_id, l.doc_id AS key FROM benchmark b JOIN labels l ON l.quality = 1 AND l.doc_id % 5 = b.item_id % 5)"
_RELEVANT_OF_FIVE = "relevant AS (SELECT b.item_id AS query_id, l.doc_id AS key FROM benchmark b JOIN labels l ON l.quality = 1 AND l.doc_id // 5 = b.item_id)"
_METRICS = f"""top AS ({_top_sql('lexical', 2 * K)}), {_RELEVANT},
hits AS (SELECT top.*, r.key IS NOT NULL AS hit FROM top LEFT JOIN relevant r USING (query_id, key)),
per AS (SELECT query_id, count(DISTINCT key) FILTER (WHERE hit AND rank <= {K}) AS found, min(rank) FILTER (WHERE hit) AS best FROM hits GROUP BY 1),
size AS (SELECT query_id, count(DISTINCT key) AS n FROM relevant GROUP BY 1),
metrics AS (SELECT query_id, coalesce(found, 0) / n AS recall, coalesce(found, 0) / {K}.0 AS precision, coalesce(1.0 / best, 0) AS reciprocal_rank, (coalesce(found, 0) > 0)::INT::DOUBLE AS hit FROM size LEFT JOIN per USING (query_id))"""


def _measured(spark, d) -> DataFrame:
    """Metrics of each item, to which all good documents of its remainder by five are relevant."""
    good = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 5).alias("group"))
    groups = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("group"))
    return ranking.retrieval_metrics(ranking.topk(_lexical(spark, d, best=2 * K), 2 * K), good, K, groups)


def _relevant(spark, d) -> DataFrame:
    """Stated relevance: of each item the good ones among five documents."""
    good = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"), F.floor(F.col("doc_id") / 5).alias("query_id"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(good, "query_id")


@query("eval_metrics", f"WITH {_bm25_sql()}, {_METRICS} SELECT query_id, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("recall", "precision", "reciprocal_rank", "hit")) + " FROM metrics")
def eval_metrics(spark, d):
    m = _measured(spark, d)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "hit")])


@query("eval_summary", f"WITH {_bm25_sql()}, {_METRICS} SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}" for c in ("recall", "precision", "reciprocal_rank", "hit")) + " FROM metrics")
def eval_summary(spark, d):
    m = _measured(spark, d)
    return m.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "hit")])


_MODES = f"""WITH {_RANKED}, {_RELEVANT_OF_FIVE},
parts AS (SELECT query_id, key, list, w * ({_VALUE['rrf']}) AS value FROM weighed),
hybrid AS (SELECT query_id, key, round(coalesce(max(value) FILTER (WHERE list = 'lexical'), 0) + coalesce(max(value) FILTER (WHERE list = 'vector'), 0), 9)::DOUBLE AS score FROM parts GROUP BY ALL),
tops AS (SELECT 'lexical' AS mode, * FROM ({_top_sql('lexical', 2 * K)}) UNION ALL SELECT 'vector', * FROM ({_top_sql('vector', 2 * K)}) UNION ALL SELECT 'hybrid', * FROM ({_top_sql('hybrid', 2 * K)})),
asked AS (SELECT mode, query_id, count(DISTINCT key) AS n FROM relevant, (SELECT unnest(['hybrid', 'lexical', 'vector']) AS mode) GROUP BY ALL),
per AS (SELECT mode, query_id, count(DISTINCT key) FILTER (WHERE rank <= {K}) AS found, min(rank) AS best FROM tops JOIN relevant USING (query_id, key) GROUP BY ALL),
modes AS (SELECT mode, round(avg(coalesce(found, 0) / n), 6)::DOUBLE AS recall, round(avg(coalesce(1.0 / best, 0)), 6)::DOUBLE AS reciprocal_rank FROM asked LEFT JOIN per USING (mode, query_id) GROUP BY mode)"""


@query("mode_verdict", f"{_MODES} SELECT m.mode, m.recall, m.reciprocal_rank, (SELECT coalesce(bool_and(h.recall >= o.recall AND h.reciprocal_rank >= o.reciprocal_rank), false) FROM modes h, modes o WHERE h.mode = 'hybrid') AS hybrid_wins FROM modes m")
def mode_verdict(spark, d):
    """Recall and reciprocal rank of each mode, and whether hybrid has at least every other one's."""
    ranked, relevant = _ranked(spark, d), _relevant(spark, d)
    tops = {n: ranked.where(F.col("list") == n).where(F.col("rank") <= 2 * K) for n in ("lexical", "vector")}
    tops["hybrid"] = ranking.topk(ranking.fused(ranked, WEIGHTS, "rrf"), 2 * K)
    each = [ranking.retrieval_metrics(t.select("query_id", "key", "rank"), relevant, K).agg(F.lit(n).alias("mode"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "reciprocal_rank")]) for n, t in sorted(tops.items())]
    modes = Folder(spark, "modes").keep(each[0].unionAll(each[1]).unionAll(each[2]).where("recall is not null"), "modes")
    return modes.crossJoin(ranking.hybrid_wins(modes))  # three rows and one


@query("engine_search", f"""WITH docs AS (SELECT DISTINCT {_ID} AS id, source, text FROM documents WHERE regexp_matches(text, '\\S')),
passages AS (SELECT sha256(id || chr(0) || '0' || chr(0) || text)[1:32] AS doc_id, source, text FROM docs),
{_bm25_sql().replace('FROM documents)', 'FROM passages)')}
SELECT query_id, rank, key AS chunk_id, source, round(round(score, 8), 6) AS score FROM ({_top_sql('lexical', K)}) JOIN passages ON doc_id = key""")
def engine_search(spark, d):
    """The engine's lexical search over a store of whole documents, all items of the benchmark asked at once."""
    store = PassageStore(spark, f"{Folder(spark, 'engine').root}/passages", chunking.ChunkOptions(size=1 << 30, overlap=0, least=0), "hashing:16")
    store.add(read(spark, d, "documents").select("source", "text"))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Engine(store).search(asked, K, "lexical").select("query_id", "rank", "chunk_id", "source", F.round("score", 6).alias("score"))


# -- answers ---------------------------------------------------------------------------------------------------

_SENT = f"""WITH {_bm25_sql()}, top AS ({_top_sql('lexical', 3)}),
p AS (SELECT top.query_id, top.rank - 1 AS evidence, d.text, list_distinct({_sql_words('b.text')}) AS q, t.terms FROM top JOIN documents d ON d.doc_id = top.key JOIN t ON t.key = top.key JOIN benchmark b ON b.item_id = top.query_id),
s0 AS (SELECT query_id, evidence, len(list_intersect(q, terms)) / len(q) AS coverage, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ss FROM p),
s1 AS (SELECT query_id, evidence, coverage, unnest(ss) AS sentence, unnest(range(len(ss))) AS position FROM s0),
s2 AS (SELECT *, round(1.0 / (1 + evidence) + coverage - position * 0.02, 9) AS score, left(regexp_replace(lower(sentence), '[^\\w\\x80-\\x{{10FFFF}}]+', '', 'g'), 120) AS k FROM s1 WHERE length(sentence) >= 20 AND NOT regexp_matches(sentence, '^\\s*(#{{1,6}}\\s|```|-{{3,}}|={{3,}}|>)')),
s3 AS (SELECT * FROM s2 WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, evidence, position) = 1),
s4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence, position) AS n FROM s3 QUALIFY n <= 6),
s5 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY evidence) AS citation FROM s4)"""


def _sentences(spark, d) -> DataFrame:
    top = Folder(spark, "top").keep(ranking.topk(_lexical(spark, d, best=3), 3).select("query_id", "key", (F.col("rank") - 1).alias("evidence")), "top")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    # The few found go to the texts, which stay where they are; their terms are cut anew.
    p = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").join(top, "key").join(asked, "query_id")
    cover = ranking.overlap_score(tx.any_words(F.col("query")), tx.any_words(F.col("text")), 1.0, 0.0)
    p = p.withColumn("coverage", F.round(cover, ranking.DIGITS))
    split = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？;；\n])\s+"), tx.strip), lambda s: s != "")
    s = p.select("query_id", "evidence", "coverage", F.posexplode(split).alias("position", "sentence")).where((F.length("sentence") >= 20) & ~tx.structural(F.col("sentence")))
    s = s.withColumn("score", F.round(1.0 / (1 + F.col("evidence")) + F.col("coverage") - F.col("position") * 0.02, 9))
    s = s.withColumn("k", F.substring(F.regexp_replace(F.lower("sentence"), r"[^\w\x80-\x{10FFFF}]+", ""), 1, 120)).where("k <> ''")
    first = Window.partitionBy("query_id", "k").orderBy(F.col("score").desc(), "evidence", "position")
    s = s.withColumn("f", F.row_number().over(first)).where("f = 1")
    place = Window.partitionBy("query_id").orderBy("evidence", "position")
    s = s.withColumn("n", F.row_number().over(place).cast("long")).where("n <= 6")
    return s.withColumn("citation", F.dense_rank().over(Window.partitionBy("query_id").orderBy("evidence")).cast("long"))


@query("answer_sentences", f"{_SENT} SELECT query_id, n, evidence, position::BIGINT AS position, round(score, 6) AS score, citation, sentence FROM s5")
def answer_sentences(spark, d):
    return _sentences(spark, d).select("query_id", "n", "evidence", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"), "citation", "sentence")


@query("cited_answers", f"{_SENT} SELECT query_id, string_agg(sentence || ' [' || citation || ']', ' ' ORDER BY n) AS answer FROM s5 GROUP BY query_id")
def cited_answers(spark, d):
    s = _sentences(spark, d).select("query_id", F.struct("n", F.format_string("%s [%d]", "sentence", "citation").alias("t")).alias("x"))
    return s.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("answer"))


# -- tables, listings, lookups ---------------------------------------------------------------------------------


@query("list_sources", "SELECT source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, max(doc_id) AS newest FROM documents GROUP BY source")
def list_sources(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.max("doc_id").alias("newest"))


@query("find_latest_by_source", "SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def find_latest_by_source(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("lang", "doc_id").alias("lang"))


@query("multi_get_ordered", "SELECT p.pos, d.doc_id, d.lang FROM (SELECT unnest([7, 3, 999999, 7, 11]) AS doc_id, unnest(range(5)) AS pos) p JOIN documents d USING (doc_id)")
def multi_get_ordered(spark, d):
    """Rows for ids in the caller's order; unknown ids are missing, repeated ones repeat."""
    ids = spark.createDataFrame([(k, i) for k, i in enumerate([7, 3, 999999, 7, 11])], "pos long, doc_id long")
    return ids.join(read(spark, d, "documents"), "doc_id").select("pos", "doc_id", "lang").orderBy("pos")


@query("unique_basename_lookup", "SELECT url, base, n = 1 AS unique_name FROM (SELECT url, base, count(*) OVER (PARTITION BY base) AS n FROM (SELECT url, string_split(url, '/')[-1] AS base FROM pages))")
def unique_basename_lookup(spark, d):
    p = read(spark, d, "pages").select("url", F.element_at(F.split("url", "/"), -1).alias("base"))
    return p.withColumn("unique_name", F.count("*").over(Window.partitionBy("base")) == 1)


@query("delete_anti_join", "SELECT doc_id, lang FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_anti_join(spark, d):
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return read(spark, d, "documents").join(gone, "source", "left_anti").select("doc_id", "lang")


@query("store_after_changes", f"""WITH d AS (SELECT {_ID} AS id, source, text, min(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS added, min(doc_id) % 5 = 0 AS gone FROM documents GROUP BY ALL)
SELECT id, source, added, length(text)::BIGINT AS n_chars FROM d WHERE NOT gone""")
def store_after_changes(spark, d):
    """A passage store's documents after an insert, a second one that knows half of its rows, and a deletion."""
    docs = read(spark, d, "documents")
    store = PassageStore(spark, f"{Folder(spark, 'store').root}/passages", embedder="hashing:16")
    store.add(docs.where("doc_id % 2 = 0").select("source", "text"))
    store.add(docs.select("source", "text"))
    ids = docs.groupBy(tx.content_id(F.col("source"), F.col("text")).alias("id")).agg(F.min("doc_id").alias("m"))
    store.delete(ids.where("m % 5 = 0"))
    return store.documents(columns=["id", "source", "added", F.length("text").cast("long").alias("n_chars")])


@query("upsert_vectors", "SELECT vec_id, label + (CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END)::INT AS label FROM embeddings")
def upsert_vectors(spark, d):
    old = read(spark, d, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 4 = 0").withColumn("label", F.col("label") + 100)
    return old.join(new, "vec_id", "left_anti").unionByName(new)


@query("corpus_stats", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS dim")
def corpus_stats(spark, d):
    docs = read(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"))
    return docs.crossJoin(read(spark, d, "embeddings").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("long").alias("dim")))


@query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS spread, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(x, 6).alias(n) for n, x in (("mean", F.avg(v)), ("low", F.min(v)), ("high", F.max(v)), ("spread", F.stddev_pop(v)), ("p95", F.percentile(v, 0.95)))])


# -- conversations -----------------------------------------------------------------------------------------------

_COST = r"(ceil((length(text) - len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]'))) / 4) + len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]')) + 4)::BIGINT"


@query("session_listing", "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_listing(spark, d):
    return conversation.session_listing(read(spark, d, "conversations"))


@query("session_tail", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def session_tail(spark, d):
    return conversation.tail(read(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


@query("message_cost", f"SELECT conv_id, turn, {_COST} AS cost FROM conversations")
def message_cost(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.message_tokens(F.col("text")).alias("cost"))


@query("compaction_tail", f"SELECT conv_id, turn, role, cost, so_far::BIGINT AS cost_so_far FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT *, {_COST} AS cost FROM conversations)) WHERE total <= 120 OR so_far <= 84 OR n = 1")
def compaction_tail(spark, d):
    return conversation.compaction_tail(read(spark, d, "conversations"), 120)


@query("last_user_turn_results", "SELECT c.conv_id, turn, role FROM conversations c JOIN (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS u FROM conversations GROUP BY 1) m ON c.conv_id = m.conv_id AND turn > u")
def last_user_turn_results(spark, d):
    return conversation.after_last_user(read(spark, d, "conversations"))


@query("render_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def render_transcript(spark, d):
    return conversation.transcript(read(spark, d, "conversations"))


def _tokens_sql(x: str) -> str:
    cjk = rf"len(regexp_extract_all({x}, '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}\x{{3400}}-\x{{4DBF}}]'))"
    return f"(ceil((length({x}) - {cjk}) / 4) + {cjk})::BIGINT"


@query("conversation_windows", rf"""WITH m AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT *, {_COST} AS cost FROM conversations)),
k AS (SELECT *, total <= 120 OR so_far <= 84 OR n = 1 AS kept FROM m),
room AS (SELECT conv_id, 120 - sum(cost) FILTER (WHERE kept) - 9 AS room, min(turn) FILTER (WHERE kept) AS first FROM k GROUP BY conv_id),
flat AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM k WHERE NOT kept AND role <> 'system'),
lines AS (SELECT *, {_tokens_sql("('- ' || line)")} AS cost FROM (SELECT conv_id, turn, role || ': ' || CASE WHEN length(f) <= 120 THEN f ELSE regexp_replace(left(f, 120), ' [^ ]*$', '') || '…' END AS line FROM flat WHERE f <> '')),
summed AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM lines JOIN room USING (conv_id) WHERE room >= 1),
judged AS (SELECT *, count(*) FILTER (WHERE upto > room) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS misfits, room - (upto - cost) AS rest FROM summed),
cut AS (SELECT *, CASE WHEN misfits = 0 THEN line ELSE regexp_replace(left(line, greatest(1, 4 * rest)::INT), ' [^ ]*$', '') || '…' END AS said FROM judged WHERE misfits <= 1)
SELECT conv_id, turn, role, text FROM k WHERE kept
UNION ALL SELECT conv_id, first - 1, 'system', 'Summary of earlier conversation:' || chr(10) || string_agg('- ' || said, chr(10) ORDER BY turn) FROM cut WHERE misfits = 0 OR {_tokens_sql("('- ' || said)")} <= rest GROUP BY conv_id, first""")
def conversation_windows(spark, d):
    """The newest messages within 120 tokens, and a digest of what went before within the rest."""
    return memory.windows(read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), 120, 0.7)


@query("conversation_windows_stream", _SQL["conversation_windows"])
def conversation_windows_stream(spark, d):
    """The same windows from a stream of the table's files: keyed state, a window for each conversation that a batch changes."""
    table = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/conversations.parque[t]")
    at = Folder(spark, "windows").root
    windows.remember(arriving, f"{at}/windows", f"{at}/checkpoint", 120, 0.7).awaitTermination()
    return windows.latest(spark, f"{at}/windows", table.schema["conv_id"].dataType.simpleString())


# -- authored tables: scripts, code, headings and tool results that the driver's tables do not hold ----------------------


def _values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL, texts and numbers written out."""

    def one(x) -> str:
        return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


_SCRIPTS = [(1, "数据库迁移"), (2, "ＦＵＬＬ width Ω"), (3, "我的 data_base isn't 7 x"), (4, "Zoë's naïve—café"), (5, "カメラ and 한국"), (6, None)]
_SCRIPT_TERMS = [
    *[(1, k, t) for k, t in enumerate(["数", "据", "库", "迁", "移", "数据", "据库", "库迁", "迁移"])],
    *[(2, k, t) for k, t in enumerate(["full", "width"])],
    *[(3, k, t) for k, t in enumerate(["我的", "data_base", "isn't", "7"])],
    *[(4, k, t) for k, t in enumerate(["zoe's", "naive", "cafe"])],
    *[(5, k, t) for k, t in enumerate(["カ", "メ", "ラ", "カメ", "メラ", "한", "국", "한국"])],
]


@query("terms_of_scripts", _values(_SCRIPT_TERMS, "id, n, term"))
def terms_of_scripts(spark, d):
    t = spark.createDataFrame(_SCRIPTS, "id int, t string").select("id", F.posexplode(tx.any_words(F.col("t"))).alias("n", "term"))
    return t.select("id", "n", "term")


_ZH = [(1, "数据库迁移需要备份"), (2, "索引提高查询速度"), (3, "mixed 数据 and words"), (4, "nothing of the kind")]


@query("bm25_of_scripts", _values([("a", 1, 1), ("a", 2, 3), ("b", 1, 2)], "query_id, rank, key"))
def bm25_of_scripts(spark, d):
    """Which of authored documents hold a CJK query's characters and pairs, the most of them first."""
    docs, asked = spark.createDataFrame(_ZH, "doc_id long, text string"), spark.createDataFrame([("a", "数据库"), ("b", "查询速度")], "query_id string, query string")
    return ranking.topk(ranking.bm25(docs, asked), K).select("query_id", "rank", "key")


_CUT = [
    ("sentences", "One two three. Four five six. Seven eight nine. Ten."),
    ("headings", "# A\ntext here\n# B\nmore of it"),
    ("paragraphs", "para one is here\n\npara two is there\n\nend"),
    ("uncut", "x" * 70),
    ("fence", "```\ncode\n" + "y" * 40 + "\n```\nafter it"),
    ("open fence", "before it\n```\nz = 1"),
    ("clauses", "一二三四五六七八九十一二三，四五六七八九十一二三四五六七八，九十"),
    ("short tail", "Twenty characters ok.\n# T\nabc"),
    ("empty", "  \n"),
]
_CUT_ROWS = [
    ("sentences", 0, "One two three. Four five six."), ("sentences", 1, "Four five six. Seven eight nine."), ("sentences", 2, "Seven eight nine. Ten."),
    ("headings", 0, "# A\ntext here"), ("headings", 1, "# B\nmore of it"),
    ("paragraphs", 0, "para one is here"), ("paragraphs", 1, "para two is there end"),
    ("uncut", 0, "x" * 30), ("uncut", 1, "x" * 30), ("uncut", 2, "x" * 30), ("uncut", 3, "x" * 10),
    ("fence", 0, "```\ncode\n" + "y" * 40 + "\n```"), ("fence", 1, "after it"),
    ("open fence", 0, "before it"), ("open fence", 1, "```\nz = 1"),
    ("clauses", 0, "一二三四五六七八九十一二三，"), ("clauses", 1, "四五六七八九十一二三四五六七八， 九十"),
    ("short tail", 0, "Twenty characters ok."), ("short tail", 1, "# T\nabc"),
]


@query("chunk_cases", _values(_CUT_ROWS, "source, ordinal, text"))
def chunk_cases(spark, d):
    """Authored texts cut at 30 characters with 10 carried over, pieces under 5 joined; expected pieces made by hand."""
    docs = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(_CUT)], "doc_id long, source string, text string")
    return chunking.chunks(docs, chunking.ChunkOptions(30, 10, 5)).select("source", "ordinal", "text")


@query("document_previews", r"SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE regexp_replace(left(f, 120), ' [^ ]*$', '') || '…' END AS preview, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 79)) || '…' END AS clip FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM documents)")
def document_previews(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.first_clause(F.col("text"), 120).alias("preview"), tx.clipped(F.col("text"), 80).alias("clip"))


_SUFFIXES = [(".md", "text/markdown"), ("PY", "text/x-python"), (".yml", "application/x-yaml"), (".rs", "text/plain"), ("", "text/plain"), (".sql", "text/x-sql")]


@query("mime_types", _values(_SUFFIXES, "suffix, mime"))
def mime_types(spark, d):
    return spark.createDataFrame([(s,) for s, _ in _SUFFIXES], "suffix string").select("suffix", tx.mime_type(F.col("suffix")).alias("mime"))


_BASE = "string_split(url, '/')[-1]"
_MIME = "CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.MIME_TYPES.items()) + " ELSE 'text/plain' END"


@query("page_names", f"SELECT page_id, {_BASE} AS name, {_MIME} AS mime, {_SENSITIVE_SQL.replace('name', _BASE)} AS sensitive FROM pages")
def page_names(spark, d):
    """Types and credential-like names of the pages' files."""
    name = F.element_at(F.split("url", "/"), -1)
    return read(spark, d, "pages").select("page_id", name.alias("name"), tx.mime_type(F.regexp_extract("url", r"\.([^./]+)$", 1)).alias("mime"), tx.sensitive_name(name).alias("sensitive"))


_TOLD = [
    (1, "search", '{"results": [{"source": "b", "ordinal": 2, "text": " two ", "score": 0.5}, {"source": "a", "ordinal": "1", "content": "one", "score": "0.5"}, {"source": "c", "text": "  ", "score": 9}]}'),
    (1, "other", '{"results": [{"source": "x", "text": "not asked", "score": 1}]}'),
    (1, "search", "no json"),
    (2, "search", '{"results": [{"text": "bare"}, {"source": "n", "text": "bad", "score": "high"}, {"source": "i", "text": "far", "score": "1e999"}]}'),
]


@query("evidence_rows", _values([(1, 0, "a", 1, "one", 0.5), (1, 1, "b", 2, "two", 0.5), (2, 0, "unknown", 0, "bare", 0.0)], "query_id, rank, source, ordinal, text, score").replace("SELECT *", "SELECT query_id, rank, source, ordinal, text, score::DOUBLE AS score"))
def evidence_rows(spark, d):
    return answers.parsed_evidence(spark.createDataFrame(_TOLD, "query_id int, name string, content string")).select("query_id", "rank", "source", "ordinal", "text", "score")


_TALK = [
    (1, 0, "user", "Find the notes on tides please", None, None),
    (1, 1, "assistant", "", None, [("search", '{"query": "tides"}')]),
    (1, 2, "tool", "gates close two hours before high tide", "search", None),
    (1, 3, "assistant", "They close two hours before", None, None),
    (1, 4, "user", "And when do they open", None, None),
    (2, 0, "user", "short", None, None),
]
_TALK_ROWS = [
    (1, 3, "system", memory.HEAD + "- assistant requested tools: search({\"query\": \"tides\"})\n- tool search returned: gates close two hours before high tide\n- assistant: They close two hours…"),
    (1, 4, "user", "And when do they open"),
    (2, 0, "user", "short"),
]


@query("memory_windows", _values(_TALK_ROWS, "conv_id, turn, role, text"))
def memory_windows(spark, d):
    """The newest message within 58 tokens, and a digest in which findings and requests come before talk."""
    m = spark.createDataFrame(_TALK, f"conv_id int, turn int, role string, text string, name string, calls {memory.CALLS}")
    return memory.windows(m, 58, 0.2)


@query("message_cost_with_calls", _values([(1, 0, 12), (1, 1, 17), (1, 2, 14), (1, 3, 11), (1, 4, 10), (2, 0, 6)], "conv_id, turn, cost"))
def message_cost_with_calls(spark, d):
    m = spark.createDataFrame(_TALK, f"conv_id int, turn int, role string, text string, name string, calls {memory.CALLS}")
    return memory.with_costs(m).select("conv_id", "turn", "cost")


@query("fusion_provenance", f"WITH {_RANKED} SELECT query_id, key, arg_max(list, w0) AS from_list FROM ranked GROUP BY query_id, key")
def fusion_provenance(spark, d):
    return ranking.provenance(_ranked(spark, d), WEIGHTS)


@query("hybrid_verdict", "SELECT true AS hybrid_wins")
def hybrid_verdict(spark, d):
    m = spark.createDataFrame([("hybrid", 0.9, 0.8), ("lexical", 0.9, 0.7), ("vector", 0.5, 0.8)], "mode string, recall double, reciprocal_rank double")
    return ranking.hybrid_wins(m)


@query("newest_documents", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100")
def newest_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.col("doc_id").desc()).limit(100)


@query("usage_totals", "SELECT role, count(*) AS n, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY role")
def usage_totals(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@query("duplicate_ranks", _values([(1, "x", 0.5), (1, "y", round(0.5 * 61 / 63, 6))], "query_id, key, score").replace("SELECT *", "SELECT query_id, key, score::DOUBLE AS score"))
def duplicate_ranks(spark, d):
    """A key that a list repeats counts once, and yet takes up a rank."""
    r = spark.createDataFrame([(1, "a", 1, "x", 3.0), (1, "a", 2, "x", 2.0), (1, "a", 3, "y", 1.0), (1, "b", 1, "z", 0.0)], "query_id int, list string, rank long, key string, score double")
    return ranking.fused(r, {"a": 0.5, "b": 0.5}).where("key <> 'z'").select("query_id", "key", F.round("score", 6).alias("score"))

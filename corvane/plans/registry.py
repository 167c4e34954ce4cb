"""Queries over the standard tables and the SQL that must give the same rows.

Scores are rounded to six digits on both sides; rows are ordered by the unrounded
ones, with ties by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A
from ..functions import text as T
from ..functions import vectors as V
from ..operators import ann, cache, chunking, context, conversation, embed, evaluate, incremental, knn, prompts, retrieval
from ..sources import synthetic, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Every twentieth vector is a query against all.
EVERY = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("query_id"), "embedding")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# Pieces of SQL.

_V = "v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT node_id AS query_id, e AS qe FROM v WHERE node_id % 20 = 0)"
_DOT, _NORM = "list_dot_product(qe, e)", "sqrt(list_dot_product({0}, {0}))"
_COS = f"(list_dot_product(qe, e) / ({_NORM.format('qe')} * {_NORM.format('e')}))"
_L2 = "sqrt(list_sum(list_transform(list_zip(qe, e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _topk(score: str, distance: str, k: int, where: str = "") -> str:
    return f"""WITH {_V}, s AS (SELECT query_id, node_id, {score} AS score FROM q CROSS JOIN v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, node_id, round(score, 6) + 0.0 AS score, round({distance}, 6) + 0.0 AS distance FROM r WHERE rank <= {k} {where}"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "rank", "node_id", r6("score").alias("score"), r6("distance").alias("distance"))


_TOP5 = f"""{_V}, s AS (SELECT query_id, node_id, label, {_COS} AS score FROM q CROSS JOIN v),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 5)"""
_NORMAL = r"trim(regexp_replace(text, '[\s\x0B\x1C-\x1F]+', ' ', 'g'))"
_CHUNKS = f"""t AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
    w AS (SELECT doc_id, t, unnest(range(0, length(t), 462)) AS start FROM t WHERE length(t) > 0),
    chunks AS (SELECT doc_id, substr(t, start + 1, 512) AS text, start, least(start + 512, length(t)) AS "end", start // 462 AS "index" FROM w),
    ids AS (SELECT doc_id || '_chunk_' || "index" || '_' || left(md5(text), 7) AS chunk_id, * FROM chunks)"""


def top5(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return knn.knn_join(asked(v), v, 5)


# Nearest neighbours and vector functions.


@query(_topk(_COS, "1 - score", 5))
def knn_cosine_topk(spark, sf_dir):
    return _rounded(top5(spark, sf_dir))


@query(_topk(_DOT, "-score", 10))
def knn_dot_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(knn.knn_join(asked(v), v, 10, "dot"))


@query(_topk(f"-{_L2}", "-score", 10))
def knn_euclidean_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(knn.knn_join(asked(v), v, 10, "euclidean"))


@query(_topk(_COS, "1 - score", 7))
def knn_blas_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(knn.knn_join(asked(v), v, 7, "cosine", strategy="blas"))


@query(_topk(_COS, "1 - score", 10, "AND score >= 0.3"))
def knn_min_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(retrieval.min_score(knn.knn_join(asked(v), v, 10), 0.3))


@query(f"WITH {_V} SELECT query_id, node_id, round(1 - {_COS}, 6) + 0.0 AS cosine_distance, round({_DOT}, 6) + 0.0 AS dot, round({_L2}, 6) + 0.0 AS euclidean FROM q JOIN v ON v.node_id = q.query_id + 1")
def pairwise_distances(spark, sf_dir):
    v = vectors(spark, sf_dir)
    pairs = asked(v).withColumnRenamed("embedding", "qv").join(v, F.col("node_id") == F.col("query_id") + 1)
    return pairs.select("query_id", "node_id", r6(V.cosine_distance("qv", "embedding")).alias("cosine_distance"), r6(V.dot("qv", "embedding")).alias("dot"), r6(V.euclidean_distance("qv", "embedding")).alias("euclidean"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 3 / (3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) + 0.0) AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return v.select("vec_id", F.transform(V.normalize("v"), lambda x: F.round(x, 6) + F.lit(0.0)).alias("unit"))


@query("""WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, len(embedding) AS d FROM embeddings),
    x AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT count(*) AS num_embeddings, max(d)::INT AS dimension, round(avg(n), 6) AS mean_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm,
      round(any_value(m), 6) + 0.0 AS mean_value, round(any_value(s), 6) AS std_value FROM n, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM x)""")
def embedding_stats(spark, sf_dir):
    s = knn.embedding_statistics(table(spark, sf_dir, "embeddings"))
    return s.select("num_embeddings", "dimension", *[r6(c).alias(c) for c in ("mean_norm", "min_norm", "max_norm", "mean_value", "std_value")])


@query("""WITH e AS (SELECT CASE vec_id % 7 WHEN 0 THEN embedding[1:8] WHEN 1 THEN list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN 'nan'::FLOAT ELSE x END) ELSE embedding END AS embedding FROM embeddings)
    SELECT count(*) AS num_rows, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, sum((len(list_filter(embedding, lambda x: isnan(x))) > 0)::INT)::BIGINT AS bad_vectors FROM e""")
def vector_dim_check(spark, sf_dir):
    part = F.col("vec_id") % 7
    worse = F.transform("embedding", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x).cast("float"))
    e = table(spark, sf_dir, "embeddings").select(F.when(part == 0, F.slice("embedding", 1, 8)).when(part == 1, worse).otherwise(F.col("embedding")).alias("embedding"))
    return tables.validation(e)


@query("SELECT count(*) AS num_vectors, 64 AS dimension, 'cosine' AS metric, sum(len(embedding) * 4 + length('{\"label\":\"' || label || '\"}'))::BIGINT AS memory_bytes FROM embeddings")
def store_stats(spark, sf_dir):
    v = vectors(spark, sf_dir).select("node_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    return knn.store_statistics(v, 64, "cosine")


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT label, i::INT AS position, round(avg(x), 6) + 0.0 AS value FROM x GROUP BY label, i""")
def centroid_by_label(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("label", (F.col("i") + 1).alias("position")).agg(r6(F.avg(F.col("x").cast("double"))).alias("value"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, e), 6) AS score, list_dot_product(e, e) BETWEEN -1.000001 AND 1.000001 AS valid, round(1 - list_dot_product(e, e), 5) + 0.0 AS distance FROM v")
def score_ranges(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("s", V.dot("embedding", "embedding"))
    return v.select("vec_id", r6("s").alias("score"), V.valid_score("s", "cosine").alias("valid"), (F.round(V.score_to_distance("s", "cosine"), 5) + F.lit(0.0)).alias("distance"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0.0) AS vector, label FROM embeddings WHERE vec_id IN (3, 5, 8)")
def vector_lookup(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(3, 5, 8)).select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + F.lit(0.0)).alias("vector"), "label")


@query(f"WITH {_TOP5} SELECT query_id, rank::INT AS rank, node_id, round(score, 6) + 0.0 AS score, label FROM top")
def result_metadata_join(spark, sf_dir):
    found = retrieval.with_metadata(top5(spark, sf_dir), vectors(spark, sf_dir), "label")
    return found.select("query_id", "rank", "node_id", r6("score").alias("score"), "label")


@query(f"""WITH {_TOP5} SELECT query_id, '{{"query":"q' || query_id || '","num_results":' || count(*) || ',"results":[' || string_agg('{{"rank":' || rank || ',"node_id":' || node_id || '}}', ',' ORDER BY rank) || ']}}' AS json FROM top GROUP BY query_id""")
def query_to_json(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = asked(v).select("query_id", F.concat(F.lit("q"), "query_id").alias("query"))
    return retrieval.results_to_json(q, top5(spark, sf_dir), "query", "rank", "node_id")


# Evaluation.

_COARSE = _COS.replace("qe", "qe[1:24]").replace(", e)", ", e[1:24])").replace("(e, ", "(e[1:24], ")
_LISTS = f"""{_V}, s AS (SELECT query_id, node_id, {_COS} AS c, {_COARSE} AS g FROM q CROSS JOIN v),
    a AS (SELECT query_id, list(node_id ORDER BY c DESC, node_id)[1:10] AS t FROM s GROUP BY query_id),
    b AS (SELECT query_id, list(node_id ORDER BY g DESC, node_id)[1:10] AS f FROM s GROUP BY query_id),
    l AS (SELECT query_id, t, f, len(list_intersect(t, f)) AS n, len(list_intersect(t[1:5], f[1:5])) AS n5 FROM a JOIN b USING (query_id))"""


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """True neighbours, and those by the first 24 coordinates."""
    v = vectors(spark, sf_dir)
    short = v.withColumn("embedding", F.slice("embedding", 1, 24))
    return knn.knn_join(asked(v), v, 10), knn.knn_join(asked(short), short, 10)


@query(f"WITH {_LISTS} SELECT query_id, round(n5 / 5.0, 6) AS recall, round(n5 / 5.0, 6) AS precision FROM l")
def recall_at_k(spark, sf_dir):
    truth, found = _lists(spark, sf_dir)
    return evaluate.recall_table(truth, found, 5).select("query_id", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query(f"WITH {_LISTS} SELECT query_id, round(len(list_intersect(t, f[1:3])) / 3.0, 6) AS precision FROM l")
def precision_at_k(spark, sf_dir):
    truth, found = _lists(spark, sf_dir)
    return evaluate.recall_table(truth, found.where("rank <= 3"), 10).select("query_id", r6("precision").alias("precision"))


@query(f"WITH {_LISTS}, r AS (SELECT n / 10.0 AS r FROM l) SELECT round(avg(r), 6) AS recall_mean, round(stddev_pop(r), 6) AS recall_std, round(min(r), 6) AS recall_min, round(max(r), 6) AS recall_max, round(median(r), 6) AS recall_median FROM r")
def recall_stats(spark, sf_dir):
    truth, found = _lists(spark, sf_dir)
    s = evaluate.recall_statistics(evaluate.recall_table(truth, found, 10))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(f"WITH {_LISTS} SELECT query_id, n::INT AS shared, list_sort(list_filter(t, lambda x: NOT list_contains(f, x))) AS missed FROM l")
def result_intersection(spark, sf_dir):
    truth, found = _lists(spark, sf_dir)
    both = evaluate.ranked_lists(truth, "t").join(evaluate.ranked_lists(found, "f"), "query_id")
    return both.select("query_id", evaluate.intersection("t", "f").alias("shared"), F.array_sort(F.array_except("t", "f")).alias("missed"))


# Text, chunks and formats.


@query(f'WITH {_CHUNKS} SELECT chunk_id, doc_id, text, start::INT AS start, "end"::INT AS "end", "index"::INT AS "index" FROM ids')
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(documents(spark, sf_dir))


@query(f'WITH {_CHUNKS} SELECT chunk_id, doc_id, left(md5(text), 7) AS hash FROM ids')
def chunk_ids(spark, sf_dir):
    c = chunking.chunk_documents(documents(spark, sf_dir))
    return c.select("chunk_id", "doc_id", F.substring(F.md5("text"), 1, 7).alias("hash"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS num_chunks, sum(length(text))::BIGINT AS total_chars, round(avg(length(text)), 6) AS avg_chunk_size, min(length(text))::INT AS min_chunk_size, max(length(text))::INT AS max_chunk_size FROM ids")
def chunk_stats(spark, sf_dir):
    s = chunking.chunk_statistics(chunking.chunk_documents(documents(spark, sf_dir)))
    return s.withColumn("avg_chunk_size", r6("avg_chunk_size"))


@query("SELECT count(*) AS num_documents, sum(n_chars)::BIGINT AS total_chars, round(avg(n_chars), 6) AS avg_size, min(n_chars) AS min_size, max(n_chars) AS max_size FROM documents")
def doc_stats(spark, sf_dir):
    return chunking.document_statistics(documents(spark, sf_dir), "n_chars").withColumn("avg_size", r6("avg_size"))


@query("SELECT lang, count(*) AS num_documents, sum(n_chars)::BIGINT AS total_chars, round(avg(n_chars), 6) AS avg_size, min(n_chars) AS min_size, max(n_chars) AS max_size FROM documents GROUP BY lang")
def doc_stats_by_lang(spark, sf_dir):
    return chunking.document_statistics(documents(spark, sf_dir), "n_chars", ("lang",)).withColumn("avg_size", r6("avg_size"))


@query(f"SELECT doc_id, {_NORMAL} AS text, length({_NORMAL})::INT AS chars, (length({_NORMAL}) // 4)::BIGINT AS tokens FROM documents")
def normalize_text(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("text"))
    return t.select("doc_id", "text", F.length("text").alias("chars"), T.estimated_tokens("text").alias("tokens"))


@query(f"WITH {_CHUNKS} SELECT doc_id, \"index\"::INT AS \"index\", length(text)::INT AS chars, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS preview FROM ids WHERE \"index\" < 2")
def chunk_preview(spark, sf_dir):
    return chunking.chunk_preview(chunking.chunk_documents(documents(spark, sf_dir)), 2, 60)


_NAMES = "['.txt', '.PDF', '.docx', '.doc', '.md', '.markdown', '.xyz'][(doc_id % 7 + 1)::INT]"


@query(f"""WITH p AS (SELECT doc_id, '/a b/My file ' || doc_id || {_NAMES} AS path FROM documents), s AS (SELECT *, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS s FROM p)
    SELECT doc_id, CASE s WHEN 'txt' THEN 'txt' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'docx' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' END AS format,
      replace(split_part(path, '/', 3), ' ', '_') AS name, s IN ('txt', 'md', 'markdown') AS wanted FROM s""")
def format_detect(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".txt", ".PDF", ".docx", ".doc", ".md", ".markdown", ".xyz")])
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/a b/My file "), "doc_id", F.get(ends, (F.col("doc_id") % 7).cast("int"))).alias("path"))
    return d.select("doc_id", T.detect_format("path").alias("format"), T.document_id("path").alias("name"), T.suffix("path").isin("txt", "md", "markdown").alias("wanted"))


@query("SELECT doc_id, sha256(text) AS hash, left(md5(text), 7) AS short FROM documents")
def content_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("hash"), F.substring(F.md5("text"), 1, 7).alias("short"))


_LETTERS = r"regexp_replace(coalesce(text, ''), '[^a-zA-Z,\n ]', '', 'g')"


def _letters() -> F.Column:
    """The whole text without what markdown could read as marks."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z,\n ]", "")


@query(f"""SELECT doc_id, trim(regexp_replace('# Title ' || lang || ' text ' || {_LETTERS} || ' strong ' || doc_id || ' ' || doc_id || ' link one two [CODE] x = **' || {_LETTERS} || '** [/CODE] end ' || {_LETTERS}, '\\s+', ' ', 'g')) AS text FROM documents""")
def markdown_to_text(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), _letters().alias("a"), F.col("doc_id").cast("string").alias("n"))
    md = F.concat(F.lit("### Title "), "lang", F.lit("\n\ntext "), "a", F.lit("\n\n~~strong~~ **"), "n", F.lit("** `"), "n", F.lit("`\n- [link](http://x.y/z)\n1. one\n> two\n\n---\n```py\nx = **"), "a", F.lit("**\n```\nend "), "a")
    return d.select("doc_id", T.markdown_to_text(md).alias("text"))


@query(f"""WITH l AS (SELECT doc_id, lang, string_split({_LETTERS}, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, lang FROM l)
    SELECT doc_id, i::INT AS position, CASE WHEN i % 8 < 1 THEN 1 ELSE i % 8 END::INT AS level, line[1:40].trim() || 'x' AS header FROM x WHERE i % 8 < 7""")
def markdown_headers(spark, sf_dir):
    # Every line becomes a header, with marks by its number; seven marks make none.
    lines = F.split(_letters(), "\n")
    marked = F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), (i + 1) % 8)), F.lit(" "), F.trim(F.substring(x, 1, 40)), F.lit("x")))
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(T.markdown_headers(F.array_join(marked, "\n"))).alias("k", "h"))
    place = F.col("k") + 1 + F.floor((F.col("k") + 1) / 7)
    return d.select("doc_id", place.cast("int").alias("position"), F.col("h.level").cast("int").alias("level"), F.col("h.text").alias("header"))


@query(f"SELECT doc_id, 'head' || chr(10) || 'A ' || doc_id || chr(10) || trim({_LETTERS.replace(chr(92) + 'n', '')}) || CASE WHEN trim({_LETTERS.replace(chr(92) + 'n', '')}) = '' THEN '2' ELSE ' 2' END || chr(10) || 'end | of' AS text FROM documents")
def markdown_tables(spark, sf_dir):
    cell = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z, ]", "")
    md = F.concat(F.lit("head\n| A | "), F.col("doc_id").cast("string"), F.lit(" |\n|---|:--:|\n| "), cell, F.lit(" | 2 |\nend | of"))
    return documents(spark, sf_dir).select("doc_id", T.markdown_tables(md).alias("text"))


# Incremental processing.

_PART = """m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'old' ELSE sha256(text) END AS h, CASE WHEN doc_id % 7 = 3 THEN 256 ELSE 512 END AS size FROM documents WHERE doc_id % 3 != 0),
    d AS (SELECT documents.doc_id, CASE WHEN m.doc_id IS NULL THEN 'new' WHEN m.h != sha256(text) THEN 'changed' WHEN m.size != 512 THEN 'parameters' ELSE 'unchanged' END AS reason FROM documents LEFT JOIN m USING (doc_id))"""


def _manifest(d: DataFrame) -> DataFrame:
    m = incremental.manifest_of(d.where("doc_id % 3 != 0"), 512, 50)
    return m.withColumn("source_hash", F.when(F.col("doc_id") % 5 == 1, "old").otherwise(F.col("source_hash"))).withColumn("chunk_size", F.when(F.col("doc_id") % 7 == 3, 256).otherwise(F.col("chunk_size")))


@query(f"WITH {_PART} SELECT doc_id, reason, reason != 'unchanged' AS rechunk FROM d")
def rechunk_decision(spark, sf_dir):
    d = documents(spark, sf_dir)
    return incremental.rechunk_decisions(d, _manifest(d), 512, 50)


def _chunk_state(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = chunking.chunk_documents(documents(spark, sf_dir))
    have = c.where("doc_id % 4 != 0").select("chunk_id", F.length("text").alias("size"))
    return c, have


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id FROM ids WHERE doc_id % 4 = 0")
def chunks_missing_embeddings(spark, sf_dir):
    c, have = _chunk_state(spark, sf_dir)
    return incremental.missing_embeddings(c, have).select("chunk_id", "doc_id")


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id % 4 != 0 AS found FROM ids WHERE \"index\" = 0 UNION ALL SELECT 'nothing', false")
def chunk_lookup_found_missing(spark, sf_dir):
    c, have = _chunk_state(spark, sf_dir)
    wanted = c.where("index = 0").select("chunk_id").unionByName(spark.sql("SELECT 'nothing' AS chunk_id"))
    found, missing = incremental.lookup(wanted, have)
    return found.select("chunk_id", F.lit(True).alias("found")).unionByName(missing.withColumn("found", F.lit(False)))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -label - 1 ELSE label END::INT AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def embedding_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", (-F.col("label") - 1).cast("int"))
    return incremental.upsert(e.where("vec_id % 2 = 0"), new.unionByName(new), "vec_id")


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_id, length(text)::INT AS size, 'kept' AS what FROM ids WHERE doc_id % 4 != 0 AND \"index\" > 0 UNION ALL SELECT chunk_id, NULL, length(text)::INT, 'orphan' FROM ids WHERE doc_id % 4 != 0 AND \"index\" = 0")
def rebuild_index_join(spark, sf_dir):
    c, have = _chunk_state(spark, sf_dir)
    c = c.where("index > 0")
    kept = incremental.with_chunks(have, c).select("chunk_id", "doc_id", "size", F.lit("kept").alias("what"))
    lost = incremental.orphans(have, c).select("chunk_id", F.lit(None).cast("long").alias("doc_id"), "size", F.lit("orphan").alias("what"))
    return kept.unionByName(lost)


@query(f"WITH {_PART}, {_CHUNKS} SELECT (SELECT count(*) FROM d) AS total_documents, (SELECT count(*) FROM d WHERE reason = 'new') AS new_documents, (SELECT count(*) FROM d WHERE reason IN ('changed', 'parameters')) AS updated_documents, count(*) AS new_chunks, count(*) FILTER (doc_id % 4 = 0) AS new_embeddings FROM ids JOIN d USING (doc_id) WHERE reason != 'unchanged'")
def ingest_counters(spark, sf_dir):
    d = documents(spark, sf_dir)
    m = _manifest(d)
    made = chunking.chunk_documents(incremental.changed_documents(d, m, 512, 50))
    _, have = _chunk_state(spark, sf_dir)
    return incremental.ingest_counters(incremental.rechunk_decisions(d, m, 512, 50), made, incremental.missing_embeddings(made, have))


# Contexts, citations, confidence.

_RAG = f"""{_TOP5}, f AS (SELECT query_id, rank, top.node_id, score, coalesce({_NORMAL.replace('text', 'd.text')}, '') AS text, 'doc' || top.node_id AS doc_id FROM top LEFT JOIN documents d ON d.doc_id = top.node_id),
    c AS (SELECT *, '[' || rank || '] ' || text AS cited_text FROM f), u AS (SELECT *, sum(length(cited_text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM c),
    src AS (SELECT * FROM u WHERE used <= 4000), ans AS (SELECT query_id, 'It is so [1] and [' || (query_id % 4) || '], see [9] [1].' AS answer FROM q)"""


def _results(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("node_id"), T.normalize_text("text").alias("text"))
    found = top5(spark, sf_dir).join(d, "node_id", "left")
    return found.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("doc_id", F.concat(F.lit("doc"), "node_id"))


def _answers(spark, sf_dir) -> DataFrame:
    q = asked(vectors(spark, sf_dir)).select("query_id")
    return q.withColumn("answer", F.concat(F.lit("It is so [1] and ["), F.col("query_id") % 4, F.lit("], see [9] [1].")))


@query(f"WITH {_RAG} SELECT query_id, string_agg(cited_text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS num_sources FROM src GROUP BY query_id")
def context_budget(spark, sf_dir):
    return context.contexts(_results(spark, sf_dir))


_CITES = r"""a AS (SELECT doc_id, regexp_replace(text, '( \w+){2}', '\1 [' || doc_id % 13 || '] [12' || doc_id % 3 || ']' || '\1', 'g') || ' [x] [] [7' AS answer FROM documents WHERE text IS NOT NULL),
    found AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[([0-9]{1,9})\]', 1), lambda x: x::INT))) AS cited FROM a)"""


def _cited_texts(spark, sf_dir) -> DataFrame:
    """Whole texts with citations put among their words."""
    d = documents(spark, sf_dir).where("text is not null")
    marks = F.concat(F.lit("$1 ["), F.col("doc_id") % 13, F.lit("] [12"), F.col("doc_id") % 3, F.lit("]$1"))
    return d.select("doc_id", F.concat(F.regexp_replace("text", F.lit(r"( \w+){2}"), marks), F.lit(" [x] [] [7")).alias("answer"))


@query(f"WITH {_CITES} SELECT doc_id, cited FROM found")
def citation_extract(spark, sf_dir):
    return _cited_texts(spark, sf_dir).select("doc_id", F.array_sort(A.citations("answer")).alias("cited"))


@query(f"WITH {_CITES} SELECT doc_id, unnest(list_filter(cited, lambda x: x < 1 OR x > 5)) AS n, 'citation [' || n || '] has no source; there are 5' AS warning FROM found")
def citation_validate(spark, sf_dir):
    both = F.arrays_zip(A.invalid_citations("answer", F.lit(5)).alias("n"), A.citation_warnings("answer", F.lit(5)).alias("warning"))
    return _cited_texts(spark, sf_dir).select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.n", "x.warning")


@query(f"WITH {_RAG} SELECT query_id, rank::INT AS citation_num, node_id, rank IN (1, query_id % 4) AS cited FROM src")
def mark_cited(spark, sf_dir):
    s = context.mark_cited(context.sources(_results(spark, sf_dir)), _answers(spark, sf_dir))
    return s.select("query_id", "citation_num", "node_id", "cited")


@query(f"WITH {_RAG} SELECT query_id, count(*) AS num_sources, sum((rank IN (1, query_id % 4))::INT)::BIGINT AS num_cited, round(100.0 * sum((rank IN (1, query_id % 4))::INT) / count(*), 6) AS citation_rate, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM src GROUP BY query_id")
def source_stats(spark, sf_dir):
    s = context.mark_cited(context.sources(_results(spark, sf_dir)), _answers(spark, sf_dir))
    s = context.source_statistics(s, "query_id")
    return s.select("query_id", "num_sources", "num_cited", *[r6(c).alias(c) for c in ("citation_rate", "avg_score", "min_score", "max_score")])


@query(f"""WITH {_RAG} SELECT query_id, string_agg(CASE WHEN rank IN (1, query_id % 4) THEN '✓' ELSE ' ' END || ' [' || rank || '] ' || doc_id || ' (score ' || printf('%.2f', score) || '): ' || CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END, chr(10) ORDER BY rank) AS display FROM src GROUP BY query_id""")
def format_sources(spark, sf_dir):
    s = context.mark_cited(context.sources(_results(spark, sf_dir)), _answers(spark, sf_dir))
    return context.format_sources(s, length=40)


_CONF = f"""{_TOP5}, agg AS (SELECT query_id, avg(score) AS m, stddev_pop(score) AS s, avg((score >= 0.5)::INT) AS h, count(*) AS n FROM top GROUP BY query_id),
    conf AS (SELECT query_id, least(greatest(0.4 * m + 0.3 * (CASE WHEN n <= 1 THEN 1 ELSE 1 - least(s / 0.5, 1) END) + 0.2 * h + 0.1 * least(n / 10.0, 1), 0), 1) AS c FROM agg)"""


@query(f"WITH {_CONF} SELECT query_id, round(c, 6) AS confidence, CASE WHEN c < 0.5 THEN 'Low' WHEN c < 0.75 THEN 'Medium' ELSE 'High' END AS level FROM conf")
def confidence(spark, sf_dir):
    return context.confidence(top5(spark, sf_dir)).withColumn("confidence", r6("confidence"))


@query("SELECT vec_id, (vec_id % 101) / 100.0 AS confidence, CASE WHEN (vec_id % 101) < 50 THEN 'Low' WHEN (vec_id % 101) < 75 THEN 'Medium' ELSE 'High' END AS level FROM embeddings")
def confidence_level(spark, sf_dir):
    c = (F.col("vec_id") % 101) / 100.0
    return table(spark, sf_dir, "embeddings").select("vec_id", c.alias("confidence"), A.confidence_level(c).alias("level"))


_QA = prompts.TEMPLATES["qa"].replace("'", "''")


@query(f"WITH {_RAG}, x AS (SELECT query_id, string_agg(cited_text, chr(10) || chr(10) ORDER BY rank) AS context FROM src GROUP BY query_id) SELECT query_id, replace(replace('{_QA}', '{{{{ context }}}}', context), '{{{{ query }}}}', 'what is ' || query_id) AS prompt FROM x")
def prompt_qa(spark, sf_dir):
    c = context.contexts(_results(spark, sf_dir)).withColumn("query", F.concat(F.lit("what is "), "query_id"))
    return c.select("query_id", prompts.prompt("qa").alias("prompt"))


@query("SELECT doc_id, sha256('main' || chr(31) || 5 || chr(31) || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'default') || chr(31) || lower(trim('  What Is ' || doc_id || ' ')) || chr(31) || '0.70' || chr(31) || 'qa' || chr(31) || '-') AS key FROM documents")
def cache_key(spark, sf_dir):
    d = documents(spark, sf_dir)
    model = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return d.select("doc_id", T.cache_key(F.concat(F.lit("  What Is "), "doc_id", F.lit(" ")), F.lit("main"), F.lit(5), model, F.lit(0.7), F.lit("qa")).alias("key"))


@query(f"""WITH {_CONF} SELECT query_id, CASE WHEN c < 0.5 THEN 'Low' WHEN c < 0.75 THEN 'Medium' ELSE 'High' END || ' confidence (' || printf('%.0f', c * 100) || '%, 5 sources): ' ||
    CASE WHEN c < 0.5 THEN 'the sources match the question poorly or disagree; check the answer' WHEN c < 0.75 THEN 'the sources match the question in part' ELSE 'the sources match the question well and agree' END AS explanation FROM conf""")
def confidence_explanation(spark, sf_dir):
    return context.confidence(top5(spark, sf_dir)).select("query_id", A.confidence_explanation("confidence", F.lit(5)).alias("explanation"))


@query("SELECT vec_id, label, (vec_id % 2)::INT AS batch, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) AS place, (SELECT count(*) FROM embeddings) AS num_vectors FROM embeddings")
def store_append(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("metadata", F.create_map(F.lit("vec_id"), F.col("vec_id").cast("string"), F.lit("label"), F.col("label").cast("string")))
    s = knn.create_vector_store(spark, 64)
    s.add_table(e.where("vec_id % 2 = 0"), metadata="metadata", order="vec_id")
    first = len(s)
    s.add_table(e.where("vec_id % 2 = 1"), metadata="metadata", order="vec_id")
    rows = s.rows.select(F.col("metadata.vec_id").cast("long").alias("vec_id"), F.col("metadata.label").cast("int").alias("label"), (F.col("node_id") >= first).cast("int").alias("batch"), "node_id")
    place = F.row_number().over(Window.partitionBy("batch").orderBy("node_id"))
    return rows.withColumn("place", place).drop("node_id").join(s.statistics().select("num_vectors"))


# Conversations.

_CONV = """m AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS pair, length(text) // 4 AS tok FROM conversations),
    t AS (SELECT conv_id, pair, sum(tok) AS tok FROM m GROUP BY ALL),
    k AS (SELECT conv_id, pair, row_number() OVER w AS n, sum(tok) OVER w AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pair DESC))"""


@query(f"WITH {_CONV} SELECT m.conv_id, m.turn, m.role FROM m JOIN k USING (conv_id, pair) WHERE n <= 3 AND (s <= 150 OR n = 1)")
def conversation_prune(spark, sf_dir):
    return conversation.prune(table(spark, sf_dir, "conversations"), 3, 150).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS num_messages, (count(*) // 2)::BIGINT AS num_turns, sum(length(text) // 4)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id")
def conversation_stats(spark, sf_dir):
    return conversation.statistics(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def formatted_history(spark, sf_dir):
    return conversation.formatted_history(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::BIGINT AS pair FROM conversations")
def turn_pairs(spark, sf_dir):
    return conversation.with_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "pair")


# Synthetic data, embeddings, pages, events.


@query("SELECT i AS node_id, 'bench_doc_' || i // 10 AS doc_id, 'bench_doc_' || i // 10 || '_chunk_' || i % 10 AS chunk_id, i::INT AS \"index\" FROM range(1000) r(i)")
def synthetic_metadata(spark, sf_dir):
    return synthetic.labelled(spark.range(1000).toDF("node_id")).drop("text")


@query("""WITH w AS (SELECT item_id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x != '') AS ws FROM benchmark),
    h AS (SELECT item_id, ('0x' || left(md5(unnest(ws)), 8))::BIGINT AS h FROM w),
    s AS (SELECT item_id, h % 64 AS p, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM h GROUP BY ALL),
    n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM s GROUP BY item_id)
    SELECT item_id, p::INT AS position, round(v / n, 5) + 0.0 AS value FROM s JOIN n USING (item_id) WHERE v != 0""")
def hash_embedding(spark, sf_dir):
    e = embed.HashEmbedder(64).embed(table(spark, sf_dir, "benchmark"))
    x = e.select("item_id", F.posexplode("embedding").alias("position", "v")).where("v != 0")
    return x.select("item_id", "position", (F.round(F.col("v").cast("double"), 5) + F.lit(0.0)).alias("value"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1).replace(' ', '_') AS name, length(html)::INT AS chars FROM pages")
def page_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.document_id("url").alias("name"), F.length("html").alias("chars"))


_PAGE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_a}', '{_b}')"


@query(f"SELECT page_id, trim(regexp_replace({_PAGE}, '\\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    from ..streaming.ingest import event_windows as windows

    return windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_type, i, t0 AS stored, false AS hit FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.event_type, e.i, CASE WHEN e.t0 - f.stored <= 86400000000 THEN f.stored ELSE e.t0 END, e.t0 - f.stored <= 86400000000
      FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
    SELECT user_id, sum(hit::INT)::BIGINT AS hits, (count(*) - sum(hit::INT))::BIGINT AS misses, count(*) AS total, round(avg(hit::INT), 6) AS hit_rate FROM f GROUP BY user_id""")
def cache_ttl_replay(spark, sf_dir):
    r = cache.ttl_hits(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 86400)
    return r.withColumn("hit_rate", r6("hit_rate"))


# Without SQL: they are tested against brute force.


@query()
def lru_cache_replay(spark, sf_dir):
    return cache.replay(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 2, 86400)


@query()
def hnsw_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ann.HNSWIndex.build(v, ef_construction=100).search(asked(v), 5, 50)


@query("SELECT count(*) AS num_queries, true AS found_all_ranks, true AS recall_of_95_percent FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_recall(spark, sf_dir):
    return _recall(spark, sf_dir, hnsw_search(spark, sf_dir))


@query("SELECT count(*) AS num_queries, true AS found_all_ranks, true AS recall_of_95_percent FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf_dir):
    return _recall(spark, sf_dir, ivf_search(spark, sf_dir))


def _recall(spark, sf_dir, found: DataFrame) -> DataFrame:
    """Recall of ``found`` against exact search; that it is high enough is what the SQL states."""
    each = evaluate.recall_table(top5(spark, sf_dir), found, 5)
    ranks = found.groupBy("query_id").agg((F.sort_array(F.collect_list("rank")) == F.array(*map(F.lit, range(1, 6)))).alias("whole"))
    return each.join(ranks, "query_id", "left").agg(F.count(F.lit(1)).alias("num_queries"), F.coalesce(F.every("whole"), F.lit(False)).alias("found_all_ranks"), (F.avg("recall") >= 0.95).alias("recall_of_95_percent"))


@query()
def hnsw_graph_stats(spark, sf_dir):
    return ann.HNSWIndex.build(vectors(spark, sf_dir), ef_construction=100).statistics()


@query("SELECT vec_id AS node_id, false AS linked_with_itself, false AS crowded, false AS alone, true AS known_ends FROM embeddings")
def hnsw_invariants(spark, sf_dir):
    """For every node: no link to itself, at most 32 links on the lowest layer and 16 above, at least one, all to nodes of the table."""
    v = vectors(spark, sf_dir)
    graphs = ann.HNSWIndex.build(v, ef_construction=100).graphs
    links = ann.hnsw_edges(graphs).join(v.select(F.col("node_id").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    layers = links.groupBy(F.col("src").alias("node_id"), "layer").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("src") == F.col("dst"))).alias("itself"), F.every(F.coalesce("known", F.lit(False))).alias("known"))
    per = layers.groupBy("node_id").agg(F.max("itself").alias("itself"), F.max(F.col("n") > F.when(F.col("layer") == 0, 32).otherwise(16)).alias("crowded"), F.every("known").alias("known"), F.max("layer").alias("x"))
    rows = ann.hnsw_nodes(graphs).select("node_id").join(per, "node_id", "left")
    return rows.select("node_id", F.coalesce("itself", F.lit(False)).alias("linked_with_itself"), F.coalesce("crowded", F.lit(False)).alias("crowded"), F.col("x").isNull().alias("alone"), F.coalesce("known", F.lit(True)).alias("known_ends"))


@query()
def ivf_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ann.ivf_search(v, asked(v), 5)


@query()
def random_vectors(spark, sf_dir):
    return synthetic.random_vectors(spark, 1000, 64, seed=42)


@query()
def noisy_queries(spark, sf_dir):
    return synthetic.queries(spark, 100, 64, seed=43, dataset=synthetic.random_vectors(spark, 1000, 64, seed=42), noise=0.1)

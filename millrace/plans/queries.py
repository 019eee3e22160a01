"""Queries of the core operators over whole tables, with SQL for DuckDB where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import validate, vector
from millrace.functions.text import WS_RE2, estimated_tokens, is_blank
from millrace.operators import chunk, embed, metrics, parse, registry, search
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vector_of(rows: DataFrame, id: str, value: int) -> list[float]:
    return rows.where(F.col(id) == value).select("embedding").first()[0]


def _first_vector(rows: DataFrame) -> list[float]:
    """The usable vector of the smallest id: the question of the searches over stored documents."""
    return rows.where(vector.state(F.col("embedding"), 64) == "ok").orderBy("id").select("embedding").first()[0]


# ---- search ----

_SCORES = """WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS cosine_similarity FROM embeddings CROSS JOIN q)
"""
_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_STORED = f"""WITH ok AS (SELECT id, content, embedding::DOUBLE[] AS e FROM stored_documents WHERE {_OK}),
q AS (SELECT e AS qv FROM ok ORDER BY id LIMIT 1),
s AS (SELECT id, content, round(list_cosine_similarity(e, qv), 6) AS cosine_similarity FROM ok CROSS JOIN q),
hits AS (SELECT id, content, cosine_similarity FROM s WHERE cosine_similarity >= 0.3 ORDER BY cosine_similarity DESC, id DESC LIMIT 25),
ranked AS (SELECT (row_number() OVER (ORDER BY cosine_similarity DESC, id DESC))::INT AS rank, * FROM hits WHERE content <> '')
"""


@_query(_SCORES + "SELECT id, cosine_similarity FROM s WHERE cosine_similarity >= 0.3 ORDER BY cosine_similarity DESC, id DESC LIMIT 25")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search.top_k(rows, _vector_of(rows, "vec_id", 0), id="vec_id")


@_query(_SCORES + "SELECT count(*) AS hits FROM s WHERE cosine_similarity >= 0.1")
def cosine_threshold_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search.scored(rows, _vector_of(rows, "vec_id", 0), id="vec_id").where(vector.at_least(F.col("cosine_similarity"), 0.1)).agg(F.count("*").alias("hits"))


@_query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine_similarity
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY cosine_similarity DESC, id))::INT AS rank, id, cosine_similarity FROM p)
SELECT * FROM r WHERE rank <= 5""")
def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search.batch_top_k(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, 64, id="vec_id")


@_query("""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings CROSS JOIN q ORDER BY distance, id LIMIT 25""")
def euclidean_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search.nearest_euclidean(rows, _vector_of(rows, "vec_id", 0), id="vec_id")


@_query(_STORED + "SELECT rank, id, cosine_similarity, content FROM ranked")
def content_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stored_documents")
    return search.with_contents(search.top_k(rows, _first_vector(rows)), rows)


@_query(_STORED + "SELECT string_agg(printf('[Doc %d] (CosSim: %.4f)', rank, cosine_similarity) || chr(10) || content, chr(10) ORDER BY rank) AS context FROM ranked")
def context_build(spark: SparkSession, folder: str) -> DataFrame:
    return search.context(content_lookup(spark, folder))


@_query(_STORED + """SELECT 'Answer using only context below. If unsure, say ''I don''t know''.' || chr(10) || 'Question: What failed?' || chr(10) || 'Context (ranked by relevance):' || chr(10)
|| string_agg(printf('[Doc %d] (CosSim: %.4f)', rank, cosine_similarity) || chr(10) || content, chr(10) ORDER BY rank) || chr(10) AS prompt FROM ranked""")
def prompt_build(spark: SparkSession, folder: str) -> DataFrame:
    return search.prompt("What failed?", context_build(spark, folder))


@_query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 200")
def page_scan(spark: SparkSession, folder: str) -> DataFrame:
    limit, offset = validate.limit_offset(100, 200)
    return search.page(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id", limit, offset)


@_query("SELECT id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS preview FROM stored_documents WHERE content IS NOT NULL")
def content_preview(spark: SparkSession, folder: str) -> DataFrame:
    return search.preview(table(spark, folder, "stored_documents"))


# ---- vectors ----


@_query("""WITH n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM stored_documents WHERE embedding IS NOT NULL AND len(embedding) > 0
UNION ALL SELECT 0 FROM stored_documents WHERE len(embedding) = 0)
SELECT round(avg(n) FILTER (NOT isnan(n)), 4) AS avg_norm, count(*) FILTER (n = 0) AS zero_vectors, count(*) AS vectors FROM n""")
def embedding_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.embedding_metrics(table(spark, folder, "stored_documents"))


@_query("""SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'width'
WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'ok' END AS state, count(*) AS n
FROM stored_documents GROUP BY 1""")
def embedding_validity(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.embedding_states(table(spark, folder, "stored_documents"), 64)


@_query("""WITH v AS (SELECT id, list_transform(embedding, lambda x: round_even(x * 1000::FLOAT, 0) + 0.0) AS s FROM stored_documents
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)
SELECT min(id) AS id, count(*) AS copies FROM v GROUP BY s""")
def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return search.distinct_vectors(table(spark, folder, "stored_documents"))


@_query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isnan(x) THEN 0 ELSE round_even(x::DOUBLE * 100, 0)::INT END) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE len(v) END AS width, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE list_sum(v)::DOUBLE END AS total FROM t""")
def parse_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as text and back; every tenth text is spoilt."""
    ints = F.transform("embedding", lambda x: F.rint(x.cast("double") * 100).cast("int").cast("string"))
    text = F.concat(F.lit("["), F.array_join(ints, ", "), F.when(F.col("vec_id") % 10 == 0, ", x]").otherwise("]"))
    back = table(spark, folder, "embeddings").select("vec_id", vector.parsed(text).alias("v"))
    return back.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("width"), F.aggregate(vector.doubles(F.col("v")), F.lit(0.0), lambda s, x: s + x).alias("total"))


# ---- contents and chunks ----


@_query(f"""SELECT file_path, count(*) AS items, count(*) FILTER (content IS NULL OR regexp_replace(content, '{WS_RE2}+', '', 'g') = '') AS blank,
coalesce(sum(length(content) // 4), 0)::BIGINT AS tokens FROM queue_items GROUP BY file_path""")
def content_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.content_sizes(table(spark, folder, "queue_items"))


@_query(f"SELECT id, content FROM queue_items WHERE regexp_replace(content, '{WS_RE2}+', '', 'g') <> ''")
def nonblank_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queue_items").where(~is_blank(F.col("content"))).select("id", "content")


@_query("SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


_NOT = WS_RE2.replace("[", "[^", 1)


def _bound(t: str, n: str, e: int) -> str:
    """SQL of the boundary nearest to e characters in a text t of n characters."""
    fw = f"substring({t}, {e + 1}, least(50, greatest({n} - {e}, 0))::BIGINT)"
    bw = f"reverse(substring({t}, {max(e - 49, 1) + 1}, {e - max(e - 49, 1) + 1}))"
    fo, bo = (f"length(regexp_extract({x}, '^{_NOT}*'))" for x in (fw, bw))
    return f"CASE WHEN {e} >= {n} THEN {n} WHEN {fo} < length({fw}) AND ({bo} = length({bw}) OR {fo} <= {bo}) THEN {e} + {fo} WHEN {bo} < length({bw}) THEN {e} - {bo} ELSE {e} END"


_CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_replace(text, '{WS_RE2}+', '', 'g') <> ''),
c AS (
  SELECT doc_id, text, n, 0 AS i, 0::BIGINT AS s, (CASE WHEN n // 4 <= 500 THEN n ELSE {_bound('text', 'n', 2000)} END)::BIGINT AS e FROM d
  UNION ALL
  SELECT doc_id, text, n, i + 1, s2, (s2 + {_bound('substring(text, s2 + 1)', '(n - s2)', 2000)})::BIGINT
  FROM (SELECT *, greatest(s + 1, e - ({_bound('substring(text, s + 1, e - s)', '(e - s)', 128)}))::BIGINT AS s2 FROM c WHERE e < n)),
p AS (SELECT doc_id, i, CASE WHEN n // 4 <= 500 THEN text ELSE regexp_replace(substring(text, s + 1, e - s), '^{WS_RE2}+|{WS_RE2}+$', '', 'g') END AS content FROM c),
q AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, content FROM p WHERE content <> '')
"""


@_query(_CHUNKS + "SELECT doc_id AS id, chunk_index, content FROM q")
def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.chunked(table(spark, folder, "documents"))


@_query(_CHUNKS + "SELECT chunk_index, count(*) AS chunks, sum(length(content))::BIGINT AS characters, max(length(content) // 4)::INT AS most_tokens FROM q GROUP BY chunk_index")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk.chunked(table(spark, folder, "documents"))
    size = F.char_length("content")
    return rows.groupBy("chunk_index").agg(F.count("*").alias("chunks"), F.sum(size).alias("characters"), F.max(estimated_tokens(F.col("content"))).alias("most_tokens"))


# ---- parsers ----


@_query("""WITH c AS (SELECT *, c_custkey // 20 AS file, (row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1)::INT AS i FROM customer)
SELECT 'customer/' || file || '.csv' AS file_path, i AS chunk_index, '{"id": "' || c_custkey || '", "label": "' || c_mktsegment || ', ' || c_nationkey || '"'
|| CASE WHEN c_custkey % 7 = 3 THEN '' ELSE ', "label_1": "' || c_name || '", "note": "n' || c_nationkey || '"' END || CASE WHEN c_custkey % 7 = 5 THEN ', "extra_col_4": "more"' ELSE '' END || '}' AS content,
'id,label,label_1,note,customer/' || file || '.csv' AS tags FROM c""")
def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as CSV files of 20 rows with a header that names a column twice, quoted cells with commas, short and long rows."""
    key = F.col("c_custkey")
    more = F.when(key % 7 == 3, "").otherwise(F.concat(F.lit(","), "c_name", F.lit(",n"), "c_nationkey", F.when(key % 7 == 5, ",more").otherwise("")))
    line = F.concat(key, F.lit(',"'), "c_mktsegment", F.lit(", "), "c_nationkey", F.lit('"'), more)
    lines = table(spark, folder, "customer").groupBy(F.floor(key / 20).alias("file")).agg(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))).alias("lines"))  # 20 rows at most
    data = F.concat(F.lit("id,label,label,note\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    files = lines.select(F.concat(F.lit("customer/"), "file", F.lit(".csv")).alias("path"), data.alias("data"))
    return parse.parsed(files).select("file_path", "chunk_index", "content", F.array_join("tags", ",").alias("tags"))


@_query("""SELECT 'events/' || event_id || '.json' AS file_path, 0 AS chunk_index, props AS content, 'events/' || event_id || '.json,' || array_to_string(json_keys(props), ',') AS tags FROM events""")
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's properties as a JSON file; keys as tags."""
    files = table(spark, folder, "events").select(F.concat(F.lit("events/"), "event_id", F.lit(".json")).alias("path"), F.col("props").alias("data"))
    return parse.parsed(files).select("file_path", "chunk_index", "content", F.array_join("tags", ",").alias("tags"))


@_query("SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events")
def json_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"))


@_query()
def python_records(spark: SparkSession, folder: str) -> DataFrame:
    """The functions that stored JSON records of kind function hold, parsed as Python files again."""
    source = F.get_json_object("content", "$.source_segment")
    files = table(spark, folder, "stored_documents").select(F.concat("file_path", F.lit("#"), F.col("id").cast("string"), F.lit(".py")).alias("path"), source.alias("data"))
    return parse.parsed(files.where("data is not null"))


_ELEMENT = """SELECT 'part/' || k || '.py' AS file_path, {0} AS chunk_index, '{{"type": "{1}", {2}, "parent_path": ["__main__"{3}], "source_segment": "{4}", "line_number": {5}{6}}}' AS content, '{1},part/' || k || '.py' AS tags FROM p WHERE k % 10 <> 0"""


@_query("WITH p AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part) "
    + " UNION ALL ".join((
        _ELEMENT.format(0, "import", '"names": [{"name": "os", "asname": "system"}]', "", "import os as system", 1, ""),
        _ELEMENT.format(1, "import", """"names": [{"name": "item' || k || '", "asname": null}]""", "", "from store import item' || k || '", 2, ', "module": "store"'),
        _ELEMENT.format(2, "class", """"name": "Part' || k || '", "full_name": "__main__.Part' || k || '\"""", "", """class Part' || k || ':\\n    \\"\\"\\"' || n || '\\"\\"\\"\\n\\n    def size(self):\\n        return ' || s || '""", 5, """, "docstring": "' || n || '\""""),
        _ELEMENT.format(3, "function", """"name": "size", "full_name": "__main__.Part' || k || '.size\"""", """, "Part' || k || '\"""", "def size(self):\\n        return ' || s || '", 8, ', "docstring": null'),
        _ELEMENT.format(4, "async_function", '"name": "load", "full_name": "__main__.load"', "", "async def load(path):\\n    return path", 12, ', "docstring": null'),
        "SELECT 'part/' || k || '.py', 0, 'def broken' || k || '(:' || chr(10), 'py_syntax_error,part/' || k || '.py' FROM p WHERE k % 10 = 0",
    )))
def python_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as a Python module with imports, a class, its method and an async function; every tenth has a syntax error."""
    k, n, s = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string")
    lines = ("import os as system\nfrom store import item", k, "\n\n\nclass Part", k, ':\n    """', n, '"""\n\n    def size(self):\n        return ', s, "\n\n\nasync def load(path):\n    return path\n")
    source = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("def broken"), k, F.lit("(:\n"))).otherwise(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines)))
    files = table(spark, folder, "part").select(F.concat(F.lit("part/"), k, F.lit(".py")).alias("path"), source.alias("data"))
    return parse.parsed(files).select("file_path", "chunk_index", "content", F.array_join("tags", ",").alias("tags"))


@_query(_CHUNKS + f"""SELECT 'doc/' || doc_id || '.txt' AS file_path, chunk_index, regexp_replace(content, '^{WS_RE2}+|{WS_RE2}+$', '', 'g') AS content,
'txt_chunk,doc/' || doc_id || '.txt,chunk_' || chunk_index AS tags FROM q""")
def text_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every corpus text as a text file."""
    files = table(spark, folder, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("data"))
    return parse.parsed(files).select("file_path", "chunk_index", "content", F.array_join("tags", ",").alias("tags"))


@_query(f"""SELECT id, CASE WHEN regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 'ok' ELSE 'zero' END AS embed_state, CASE WHEN regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
FROM queue_items WHERE regexp_replace(content, '{WS_RE2}+', '', 'g') <> ''""")
def embedded_items(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items embedded by the stand-in model; vectors of unit length, those of texts without words zero, blank items left out."""
    rows = embed.embedded(table(spark, folder, "queue_items").select("id", "content"), embed.HashingEmbedder(64), embed.Settings(dim=64))
    return rows.select("id", "embed_state", F.round(vector.norm(F.col("embedding")), 4).alias("norm"))


# ---- names, tags, contents ----

_EXT = "lower(regexp_extract(filepath, '[^/.][^/]*\\.([^./]*)$', 1))"
_BASE = "regexp_extract(filepath, '([^/]*)$', 1)"


@_query(f"SELECT {_EXT} AS kind, count(*) AS files, sum(size)::BIGINT AS bytes FROM file_registry GROUP BY 1")
def file_kind(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "file_registry")
    return rows.groupBy(validate.extension(F.col("filepath")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@_query(f"""SELECT record_no, CASE WHEN {_EXT} IN ('exe', 'bat', 'cmd', 'com', 'pif', 'scr', 'vbs', 'vbe', 'js', 'jse') THEN 'dangerous' WHEN size > 104857600 THEN 'too_large' WHEN size < 10 THEN 'too_small'
WHEN regexp_matches(filepath, '(^|/)(\\.[^/]+|__pycache__|node_modules)/') OR {_BASE} LIKE '.%' THEN 'hidden' WHEN {_EXT} NOT IN ('py', 'txt', 'csv', 'json') THEN 'unsupported' ELSE 'ok' END AS state,
CASE WHEN regexp_matches(filepath, '(?i)\\.\\./|^/etc/|^/proc/|^/sys/') THEN 'pattern' WHEN {_EXT} NOT IN ('py', 'txt', 'csv', 'json') THEN 'extension' WHEN regexp_matches(filepath, '^/(etc|proc|sys|root|usr/bin|usr/sbin|bin|sbin)') THEN 'system_dir' ELSE 'ok' END AS path_state
FROM file_registry""")
def file_checks(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("filepath")
    return table(spark, folder, "file_registry").select("record_no", validate.file_state(p, F.col("size")).alias("state"), validate.path_state(p).alias("path_state"))


@_query("""SELECT doc_id, regexp_replace(regexp_replace(source || ' / ' || coalesce(lang, '?'), '[<>:"/\\\\|?*]', '_', 'g'), '[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}]', '', 'g').trim() AS display_name,
regexp_replace(regexp_replace(source || ' / ' || coalesce(lang, '?'), '[^\\p{L}\\p{N}_\\-.]', '_', 'g'), '^\\.', '_') AS storage_name FROM documents WHERE source IS NOT NULL""")
def sanitize_name(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("source", F.lit(" / "), F.coalesce("lang", F.lit("?")))
    rows = table(spark, folder, "documents").where("source is not null")
    return rows.select("doc_id", validate.display_name(name).alias("display_name"), validate.storage_name(name).alias("storage_name"))


@_query("""WITH t AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM stored_documents WHERE tags IS NOT NULL),
a AS (SELECT id, regexp_replace(trim(tag), '[<>"'']', '', 'g')[1:100] AS x, min(i) AS i FROM t WHERE tag IS NOT NULL GROUP BY 1, 2),
b AS (SELECT id, regexp_replace(tag, '[^\\p{L}\\p{N}_\\-.]', '_', 'g')[1:100] AS x, min(i) AS i FROM t WHERE tag IS NOT NULL GROUP BY 1, 2),
la AS (SELECT id, string_agg(x, '|' ORDER BY i) AS listed FROM a WHERE x <> '' GROUP BY id), lb AS (SELECT id, string_agg(x, '|' ORDER BY i) AS stored FROM b WHERE x <> '' GROUP BY id)
SELECT d.id, coalesce(listed, '') AS listed, coalesce(stored, '') AS stored FROM stored_documents d LEFT JOIN la ON la.id = d.id LEFT JOIN lb ON lb.id = d.id WHERE tags IS NOT NULL""")
def sanitize_tags(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("tags")
    rows = table(spark, folder, "stored_documents").where("tags is not null")
    return rows.select("id", F.array_join(validate.listed_tags(t), "|").alias("listed"), F.array_join(validate.storage_tags(t), "|").alias("stored"))


@_query("SELECT record_no, replace(replace(replace(filepath, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern FROM file_registry")
def like_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_registry").select("record_no", validate.escaped_like(F.col("filepath")).alias("pattern"))


@_query("""SELECT regexp_matches(text, '(?i)<script[^>]*>') AS script_tag, regexp_matches(text, '(?i)javascript:') AS javascript_url, regexp_matches(text, '(?i)vbscript:') AS vbscript_url,
regexp_matches(text, '(?i)on\\w+\\s*=') AS event_handler, regexp_matches(text, '(?i)eval\\s*\\(') AS eval_call, regexp_matches(text, '(?i)exec\\s*\\(') AS exec_call, count(*) AS n FROM documents GROUP BY ALL""")
def suspicious_content(spark: SparkSession, folder: str) -> DataFrame:
    flags = [c.alias(name) for name, c in validate.suspicious(F.col("text")).items()]
    return table(spark, folder, "documents").groupBy(*flags).agg(F.count("*").alias("n"))


@_query("""SELECT CASE WHEN content IS NULL THEN 'null' WHEN content = '' THEN 'empty' WHEN length(content) > 2000 THEN 'too_long' ELSE 'ok' END AS state, count(*) AS n,
sum(length(replace(content, chr(0), '')))::BIGINT AS characters FROM queue_items GROUP BY 1""")
def content_check(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    return table(spark, folder, "queue_items").groupBy(validate.content_state(c, 2000).alias("state")).agg(F.count("*").alias("n"), F.sum(F.char_length(validate.without_nul(c))).alias("characters"))


@_query("""WITH s AS (SELECT doc_id, replace(source, '-', '_') AS s FROM documents)
SELECT doc_id, CASE WHEN s IS NULL OR NOT regexp_matches(s, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'invalid' WHEN length(s) > 63 THEN 'too_long'
WHEN lower(s) IN ('select', 'insert', 'update', 'delete', 'drop', 'create', 'alter', 'grant', 'revoke', 'union', 'join', 'where') THEN 'keyword' ELSE 'ok' END AS state FROM s""")
def identifier_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", validate.identifier_state(F.replace("source", F.lit("-"), F.lit("_"))).alias("state"))


@_query("SELECT record_no, CASE WHEN length(filepath) > 30 THEN '...' || right(filepath, 27) ELSE filepath END AS shown FROM file_registry")
def short_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_registry").select("record_no", validate.short_path(F.col("filepath"), 30).alias("shown"))


@_query("SELECT record_no, '/data/' || ltrim(filepath, '/') AS path FROM file_registry")
def normal_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Registered paths below a folder that is written in a roundabout way, brought into normal form."""
    return table(spark, folder, "file_registry").select("record_no", validate.normal_path(F.concat(F.lit("/../data/./x/y/../..//"), "filepath")).alias("path"))


@_query("SELECT doc_id, CASE WHEN length(text) > 30 THEN substring(text, 1, 27) || '...' ELSE text END AS shown FROM documents")
def short_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", validate.short_text(F.col("text")).alias("shown"))


@_query("""SELECT id, coalesce(length(content) >= 10 AND (doc = 0 OR (regexp_matches(substring(content, 1, 1024), '[,\\t;|]') AND contains(substring(content, 1, 1024), chr(10)))), false) AS valid
FROM (SELECT id, content, id % 2 AS doc FROM stored_documents)""")
def file_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Stored contents as text files and, every other one, as CSV files: which would be taken."""
    rows, path = table(spark, folder, "stored_documents"), F.when(F.col("id") % 2 == 0, "a.txt").otherwise("a.CSV")
    return rows.select("id", validate.is_valid_file(path, F.char_length("content"), F.col("content")).alias("valid"))


@_query("""SELECT event_id, CASE WHEN s < 60 THEN printf('%.0fs', s::DOUBLE) WHEN s < 3600 THEN printf('%.1fm', s / 60.0) ELSE printf('%.1fh', s / 3600.0) END AS remaining
FROM (SELECT event_id, ((event_id * 37) % 20000)::DOUBLE * 3 + 1 AS s FROM events)""")
def remaining_text(spark: SparkSession, folder: str) -> DataFrame:
    seconds = ((F.col("event_id") * 37) % 20000).cast("double") * 3 + 1
    return table(spark, folder, "events").select("event_id", validate.remaining_text(seconds).alias("remaining"))


# ---- registry ----

_SUM = f"nullif(lower(regexp_replace(checksum, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')), '')"
_CHANGES = f"""WITH o AS (SELECT filepath, size AS old_size, mtime AS old_mtime, {_SUM} AS old_sum FROM file_registry WHERE batch_no = 0 QUALIFY row_number() OVER (PARTITION BY filepath ORDER BY record_no DESC) = 1),
l AS (SELECT filepath, size, mtime, {_SUM} AS sum FROM file_registry WHERE batch_no > 0 QUALIFY row_number() OVER (PARTITION BY filepath ORDER BY record_no DESC) = 1),
c AS (SELECT coalesce(l.filepath, o.filepath) AS filepath, CASE WHEN l.filepath IS NULL THEN 'file_not_found' WHEN o.filepath IS NULL THEN 'new_file' WHEN size IS NULL OR mtime IS NULL OR old_size IS NULL OR old_mtime IS NULL THEN 'error_checking'
WHEN size <> old_size THEN 'size_changed' WHEN abs(mtime - old_mtime) > 1.0 THEN 'time_changed' WHEN size > 0 AND sum <> old_sum THEN 'content_changed' ELSE 'already_processed' END AS reason FROM l FULL JOIN o ON l.filepath = o.filepath)
"""
_LATEST = "WITH r AS (SELECT * FROM file_registry QUALIFY row_number() OVER (PARTITION BY filepath ORDER BY record_no DESC) = 1) "
_STATS = """SELECT count(*) AS total_files, coalesce(sum(records_count), 0)::BIGINT AS total_records, round(coalesce(sum(size), 0) / 1048576.0, 6)::DOUBLE AS total_size_mb, round(coalesce(sum(records_count), 0) / count(*), 6)::DOUBLE AS avg_records_per_file"""


def _states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A listing made of what the batches after the history registered last, and the history's registry."""
    rows = table(spark, folder, "file_registry")
    old, new = registry.latest(rows.where("batch_no = 0")), registry.latest(rows.where("batch_no > 0"))
    gone = old.join(new, "filepath", "left_anti").select("filepath", F.lit(False).alias("found"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"), F.lit(None).cast("string").alias("checksum"))
    return new.select("filepath", F.lit(True).alias("found"), "size", "mtime", "checksum").unionByName(gone), old


@_query(_CHANGES + "SELECT filepath, reason NOT IN ('file_not_found', 'already_processed') AS should_process, reason FROM c")
def change_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return registry.changes(*_states(spark, folder))


@_query(_CHANGES + f"""SELECT filepath, {_EXT} IN ('py', 'txt', 'csv', 'json') AND reason <> 'file_not_found' AS ready, CASE WHEN reason = 'file_not_found' THEN 'File does not exist'
WHEN {_EXT} NOT IN ('py', 'txt', 'csv', 'json') THEN 'Unsupported file type: ' || {_EXT} WHEN reason <> 'already_processed' THEN 'Ready for processing (new/changed file)' ELSE 'Ready for processing (will reprocess)' END AS message FROM c""")
def file_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return registry.verdicts(registry.changes(*_states(spark, folder)))


@_query(_CHANGES + """SELECT count(*) AS total_files, count(*) FILTER (reason NOT IN ('file_not_found', 'already_processed')) AS files_to_process, count(*) FILTER (reason IN ('file_not_found', 'already_processed')) AS files_skipped,
count(*) FILTER (reason = 'new_file') AS new_files, count(*) FILTER (reason = 'size_changed') AS size_changed, count(*) FILTER (reason = 'time_changed') AS time_changed, count(*) FILTER (reason = 'content_changed') AS content_changed,
count(*) FILTER (reason = 'already_processed') AS already_processed, count(*) FILTER (reason IN ('file_not_found', 'error_checking')) AS error_files FROM c""")
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return registry.change_counts(registry.changes(*_states(spark, folder)))


@_query(_LATEST + "SELECT filepath, record_no, size FROM r")
def registry_latest(spark: SparkSession, folder: str) -> DataFrame:
    return registry.latest(table(spark, folder, "file_registry")).select("filepath", "record_no", "size")


@_query(_LATEST + _STATS + """, min(records_count) AS min_records_per_file, max(records_count) AS max_records_per_file, count(*) FILTER (records_count = 0) AS files_with_no_records,
max(processed_at) AS most_recent_processing, min(processed_at) AS oldest_processing FROM r""")
def registry_stats(spark: SparkSession, folder: str) -> DataFrame:
    return registry.stats(registry.latest(table(spark, folder, "file_registry")))


@_query("SELECT DISTINCT filepath FROM file_registry WHERE filepath NOT IN (SELECT file_path FROM stored_documents WHERE file_path IS NOT NULL AND batch_no = 0)")
def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Registered files of which no row was stored in the history."""
    stored = table(spark, folder, "stored_documents").where("batch_no = 0").select(F.col("file_path").alias("filepath"))
    return registry.missing(registry.latest(table(spark, folder, "file_registry")), stored).select("filepath")


@_query("SELECT DISTINCT filepath FROM file_registry WHERE filepath IN (SELECT file_path FROM stored_documents WHERE batch_no = 0)")
def kept_files(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "stored_documents").where("batch_no = 0").select(F.col("file_path").alias("filepath"))
    return registry.kept(registry.latest(table(spark, folder, "file_registry")), stored).select("filepath")


@_query(_LATEST + "SELECT filepath, processed_at, records_count FROM r WHERE processed_at IS NOT NULL ORDER BY processed_at DESC, filepath LIMIT 5")
def recent_files(spark: SparkSession, folder: str) -> DataFrame:
    return registry.recent(registry.latest(table(spark, folder, "file_registry")))


# ---- metrics ----


@_query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, round(sum(value), 6) AS total_value FROM r WHERE i <= 100 GROUP BY 1""")
def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.timing_summary(table(spark, folder, "events"), "event_type", "ts", "event_id", "value")


@_query("SELECT user_id AS key, count(*) AS n, max(ts) AS last_time, count(*) > 10 AS warn FROM events WHERE event_type = 'error' GROUP BY 1")
def error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.error_counts(table(spark, folder, "events").where("event_type = 'error'"), "user_id", "ts")


@_query("""WITH s AS (SELECT DISTINCT id, file_path, coalesce(strlen(content), 0) + coalesce(list_sum(list_transform(tags, lambda t: strlen(t))), 0) + coalesce(strlen(file_path), 0) AS size FROM queue_items)
SELECT file_path, count(*) AS items, sum(size)::BIGINT AS bytes, max(size)::BIGINT AS largest FROM s GROUP BY 1""")
def queue_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.queue_sizes(table(spark, folder, "queue_items"))


@_query("""WITH h AS (SELECT floor(enqueued_at / 3600)::BIGINT AS hour, count(*) AS queued, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM queue_items WHERE enqueued_at IS NOT NULL GROUP BY 1)
SELECT hour, queued, bytes, (sum(queued) OVER w)::BIGINT AS queued_so_far, (sum(bytes) OVER w)::BIGINT AS bytes_so_far FROM h WINDOW w AS (ORDER BY hour)""")
def queue_history(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.queue_history(table(spark, folder, "queue_items"))


@_query(_LATEST + "SELECT regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM r GROUP BY 1")
def folder_stats(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.folder_stats(registry.latest(table(spark, folder, "file_registry")))


@_query("SELECT count(*) AS n FROM stored_documents")
def doc_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stored_documents").agg(F.count("*").alias("n"))

"""The queries of problems 1 to 8, over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import WS_RE2
from millrace.llm import batches, knn, leaks, mixing, neardup, records, split, truncation
from millrace.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.forced_cuts(table(spark, folder, "queue_items")).select("id", F.col("run_start").alias("hard_run"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_items(table(spark, folder, "queue_items"))


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item amount to: its characters, whether they cover it with the overlap asked for, and whether each is
    within the limit."""
    pieces = split.split_items(table(spark, folder, "queue_items")).groupBy("item_id").agg(
        F.max("end").cast("long").alias("characters"), (F.sum(F.col("end") - F.col("start")) - 128 * (F.count("*") - 1) == F.max("end")).alias("covered"), (F.max(F.char_length("text")) < 2004).alias("within")
    )
    return pieces


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return records.record_copies(table(spark, folder, "stored_documents"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.collapse_records(table(spark, folder, "stored_documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return batches.repeats(table(spark, folder, "stored_documents"), table(spark, folder, "file_registry"), width=3, similarity=0.5, bands=64, rows_per_band=3)


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    return batches.repeated_files(table(spark, folder, "file_registry"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return knn.similar_pairs(table(spark, folder, "stored_documents"))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return knn.nearest(table(spark, folder, "stored_documents"), F.col("id") % 50 == 0)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(table(spark, folder, "stored_documents"), width=3, similarity=0.5, bands=64, rows_per_band=3)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Of each test item the number of documents that hold a passage of it."""
    found = leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shortfalls(table(spark, folder, "documents"), table(spark, folder, "mix_plan")).where("misses").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_plan"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.actual_shares(table(spark, folder, "documents"), table(spark, folder, "mix_plan"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(table(spark, folder, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage, p2_found, p2_records, p3_found, p3_files, p4_found, p4_neighbours, p5_found, p6_found, p6_items, p7_found, p7_mix, p7_shares, p8_found, p8_rates)}

_PASSAGES = r"""WITH i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, least(len(w), 12) AS n, array_to_string(w[p : p + least(len(w), 12) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(len(w), 12) + 2)) AS r(p) WHERE len(w) > 0),
d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM ig) AS l, unnest(range(1, len(w) - n + 2)) AS r(p)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))
"""

#: White space and punctuation dropped, case folded.
_IGNORED = "[\\p{P}" + WS_RE2[1:-1] + "]+"
_NAME = "regexp_replace(lower(<x>), '[^\\p{L}\\p{N}.\\[\\]]', '', 'g')"


def _plain(x: str) -> str:
    return f"replace(lower(regexp_replace({x}, '{_IGNORED}', '', 'g')), 'ß', 'ss')"


#: The canonical form c of each row with a letter or digit: the sorted leaves of a JSON object with their paths, the sorted fields of
#: `name: value` lines, or the plain text.
_CANONICAL = f"""d AS (SELECT id, content, batch_no, ltrim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) AS head FROM stored_documents WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]')),
k AS (SELECT *, regexp_matches(head, '^[\\[{{]') AND json_valid(head) AS json,
  list_filter(regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '{WS_RE2}+', '', 'g') <> '') AS lines FROM d),
leaf AS (SELECT k.id, array_to_string(list_sort(list({_NAME.replace("<x>", "t.fullkey")} || chr(31) || {_plain("coalesce(CASE WHEN t.type = 'VARCHAR' THEN t.atom->>'$' ELSE t.atom::VARCHAR END, t.type)")})), chr(30)) AS c
  FROM k, json_tree(CASE WHEN k.json THEN k.head ELSE '0' END) AS t WHERE k.json AND t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY k.id),
line AS (SELECT id, array_to_string(list_sort(list_transform(lines, lambda x: '.' || {_NAME.replace("<x>", "regexp_extract(x, '^([^:：]*)[:：](.*)$', 1)")} || chr(31) || {_plain("regexp_extract(x, '^([^:：]*)[:：](.*)$', 2)")})), chr(30)) AS c
  FROM k WHERE NOT json AND len(lines) > 0 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^[^:：]*[\\p{{L}}\\p{{N}}][^:：]*[:：]'))) = 0),
c AS (SELECT k.id, k.content, k.batch_no, coalesce(leaf.c, line.c, {_plain("k.content")}) AS c FROM k LEFT JOIN leaf USING (id) LEFT JOIN line USING (id)),
copies AS (SELECT * FROM (SELECT min(id) OVER (PARTITION BY c) AS keep_id, id AS copy_id FROM c) WHERE keep_id <> copy_id)
"""

#: All pairs of records with a similarity of at least 0.5 on word triples.
_SIMILAR = """w AS (SELECT id, list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM (SELECT min(id) AS id, arg_min(content, id) AS content FROM c GROUP BY c)),
t AS (SELECT DISTINCT id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(p)),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
s AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
similar_pairs AS (SELECT a, b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * k >= x.n + y.n - k)
"""

#: The smallest id that each id of the links reaches.
_REACHED = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS g FROM both_ways UNION SELECT l.b, reach.g FROM reach JOIN both_ways l ON l.a = reach.id),
groups AS (SELECT min(g) AS group_id, id FROM reach GROUP BY id HAVING min(g) <> id)
"""

_FILES = f"""SELECT DISTINCT first_key, record_no AS later_key FROM (SELECT record_no, coalesce(batch_no, 0) AS b, lower(regexp_replace(checksum, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')) AS c FROM file_registry) AS s
JOIN (SELECT lower(regexp_replace(checksum, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')) AS c, min(record_no) AS first_key FROM file_registry GROUP BY 1) AS f ON s.c = f.c WHERE s.c <> '' AND b >= 1 AND record_no > first_key"""

_COSINES = """WITH ok AS (SELECT id, embedding::DOUBLE[] AS e FROM stored_documents WHERE embedding IS NOT NULL AND len(embedding) = 64
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM ok a JOIN ok b ON a.id <> b.id WHERE {}),
r AS (SELECT id, neighbour_id, (row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id))::INT AS rank, cosine FROM p)
"""

#: SQL states what a query finds, not how. The tokens of problem 7 are replaced by characters, which give the same list.
ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""WITH o AS (SELECT DISTINCT id, content FROM queue_items WHERE regexp_replace(content, '{WS_RE2}+', '', 'g') <> '' AND length(content) // 4 > 500),
t AS (SELECT id, content, regexp_split_to_array(content, '{WS_RE2}') AS parts FROM o),
u AS (SELECT id, content, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM t),
r AS (SELECT id, content, length(part) AS n, sum(length(part) + 1) OVER (PARTITION BY id, content ORDER BY i) - length(part) - 1 AS start FROM u),
h AS (SELECT id, content, start FROM r WHERE n > 2000)
SELECT DISTINCT id, start::BIGINT AS hard_run FROM h UNION SELECT id, -1::BIGINT FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = o.id AND h.content = o.content)""",
    "p1_coverage": f"SELECT DISTINCT id AS item_id, length(content) AS characters, true AS covered, true AS within FROM queue_items WHERE regexp_replace(content, '{WS_RE2}+', '', 'g') <> ''",
    "p2_found": "WITH " + _CANONICAL + "SELECT keep_id, copy_id FROM copies",
    "p2_records": "WITH " + _CANONICAL + "SELECT min(id) AS keep_id, count(*) AS copies, count(DISTINCT content) AS forms FROM c GROUP BY c",
    "p3_files": _FILES,
    "p3_found": "WITH RECURSIVE " + _CANONICAL + ", " + _SIMILAR + ", links AS (SELECT a, b FROM similar_pairs UNION SELECT keep_id, copy_id FROM copies), " + _REACHED
    + "SELECT 'document' AS record_type, group_id AS first_key, id AS later_key FROM groups JOIN stored_documents USING (id) WHERE batch_no >= 1 UNION ALL SELECT 'file', first_key, later_key FROM (" + _FILES + ")",
    "p5_found": "WITH RECURSIVE " + _CANONICAL + ", " + _SIMILAR + ", links AS (SELECT a, b FROM similar_pairs), " + _REACHED + "SELECT group_id, id FROM groups",
    "p4_found": _COSINES.format("true") + "SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM r WHERE rank <= 5 AND cosine >= 0.9",
    "p4_neighbours": _COSINES.format("a.id % 50 = 0") + "SELECT * FROM r WHERE rank <= 5",
    "p6_items": _PASSAGES + "SELECT item_id, count(*) AS documents FROM f GROUP BY 1",
    "p6_found": _PASSAGES + "SELECT doc_id, item_id FROM f",
    "p7_found": """WITH p AS (SELECT min(source) AS name, lower(trim(source)) AS k, max(target_share) AS s, max(max_repeats) AS r FROM mix_plan WHERE target_share > 0 GROUP BY 2),
t AS (SELECT lower(trim(source)) AS k, sum(length(text)) AS n FROM documents GROUP BY 1), j AS (SELECT name, s, r, coalesce(n, 0) AS n FROM p LEFT JOIN t ON t.k = p.k)
SELECT name AS source FROM j WHERE n * r < s * (SELECT sum(n) FROM j)""",
}

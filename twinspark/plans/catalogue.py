"""Named queries of the engine's own operators over the driver tables, each with the SQL that checks it.

The tables hold no source code, so a document stands for a unit of code: its text is the body,
source/lang its path, doc_id its line; visibility, nesting and class kind are functions of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import findings, graph, pairs, tables
from ..operators.components import components
from ..streaming import debounce
from . import extract

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark, sf_dir: str) -> DataFrame:
    """Documents as units of code, without their texts but for `source`."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        k, F.concat_ws("/", "source", "lang").alias("filepath"), F.concat(F.lit("unit_"), F.col("lang"), F.lit("_"), (k % 7).cast("string")).alias("name"),
        k.cast("int").alias("lineno"), (k + F.size(F.split("text", "\n")) - 1).cast("int").alias("end_lineno"), F.col("lang").alias("language"), F.col("text").alias("source"),
        X.structural_hash("text").alias("ast_hash"), F.element_at(F.array(*map(F.lit, ("public", "private", "internal", "protected"))), (k % 4 + 1).cast("int")).alias("visibility"),
        (k % 10 == 7).alias("is_nested"), F.when(k % 5 == 0, "interface").when(k % 5 == 1, "class").alias("class_type"), F.when(k % 3 == 0, F.concat(F.lit("C"), (k % 6).cast("string"))).alias("class_name"),
        (F.size(F.split("text", "\n")) <= 1).alias("is_trivial"),
    )


U = """units AS (SELECT doc_id, source || '/' || lang AS filepath, 'unit_' || lang || '_' || (doc_id % 7)::VARCHAR AS name, doc_id::INT AS lineno,
  (doc_id + len(string_split(text, chr(10))) - 1)::INT AS end_lineno, lang AS language, text AS source, substr(sha256(text), 1, 16) AS ast_hash,
  ['public', 'private', 'internal', 'protected'][(doc_id % 4 + 1)::BIGINT] AS visibility, doc_id % 10 = 7 AS is_nested,
  CASE WHEN doc_id % 5 = 0 THEN 'interface' WHEN doc_id % 5 = 1 THEN 'class' END AS class_type, CASE WHEN doc_id % 3 = 0 THEN 'C' || (doc_id % 6)::VARCHAR END AS class_name,
  len(string_split(text, chr(10))) <= 1 AS is_trivial FROM documents WHERE text IS NOT NULL)"""
PAIRS = "p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM units a JOIN units b ON a.ast_hash = b.ast_hash AND a.doc_id < b.doc_id)"


def exact(spark, sf_dir: str) -> DataFrame:
    return pairs.equal_pairs(units(spark, sf_dir), "ast_hash", "doc_id").select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))


def matches(spark, sf_dir: str) -> DataFrame:
    """Pairs with both units as structs `source` and `existing`."""
    u = units(spark, sf_dir).drop("source").withColumn("source", F.lit(""))
    s = u.select(F.col("ast_hash").alias("h"), F.struct(*u.columns).alias("source"))
    e = u.select(F.col("ast_hash").alias("h"), F.struct(*u.columns).alias("existing"))
    return s.join(e, "h").where("source.doc_id < existing.doc_id").withColumn("match_type", F.lit("exact_structure"))


# scalar functions


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS ast_hash FROM documents WHERE text IS NOT NULL")
def unit_hash(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "ast_hash")


@query(r"SELECT p_partkey, array_to_string([t FOR t IN regexp_split_to_array(lower(regexp_replace(regexp_replace(p_name || 'ItemHTTPCode', '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_\s]+') IF t <> ''], ',') AS tokens FROM part")
def name_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.name_tokens(F.concat("p_name", F.lit("ItemHTTPCode"))), ",").alias("tokens"))


@query(r"""SELECT event_id, CAST(len(regexp_extract_all(props, '"(?:[^"\\]|\\.)*"')) AS BIGINT) AS n, coalesce(regexp_extract_all(props, '"(?:[^"\\]|\\.)*"')[1], '') AS first FROM events""")
def string_literals(spark, sf_dir):
    found = X.string_literals(F.regexp_replace("props", "['`]", ""))
    return table(spark, sf_dir, "events").select("event_id", F.size(found).cast("long").alias("n"), F.coalesce(F.get(found, 0), F.lit("")).alias("first"))


@query(f"WITH {U}, {PAIRS}, q AS (SELECT doc_id, filepath || ':' || name || ':' || lineno::VARCHAR AS q, filepath || ':' || name AS s FROM units) SELECT a, b, least(x.q, y.q) || '||' || greatest(x.q, y.q) AS finding_id, least(x.s, y.s) || '||' || greatest(x.s, y.s) AS stable_key FROM p JOIN q x ON a = x.doc_id JOIN q y ON b = y.doc_id")
def finding_ids(spark, sf_dir):
    m = matches(spark, sf_dir)
    q = lambda f: X.qualified_name(f"{f}.filepath", f"{f}.name", f"{f}.lineno")
    m = m.select(F.col("source.doc_id").alias("a"), F.col("existing.doc_id").alias("b"), q("source").alias("x"), q("existing").alias("y"))
    return m.select("a", "b", X.finding_id("x", "y").alias("finding_id"), X.stable_key("x", "y").alias("stable_key"))


@query(r"SELECT page_id, nullif(regexp_extract('apps/' || regexp_replace(url, '^https?://', ''), '^((?:services|apps|packages|microservices)/[^/]+)/', 1), '') AS service, array_to_string(list_slice(string_split(url, '/'), -4, -1), '/') AS short FROM pages")
def service_of_url(spark, sf_dir):
    path = F.concat(F.lit("apps/"), F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", X.service(path).alias("service"), X.short_path("url").alias("short"))


@query(f"WITH {U} SELECT doc_id, language || '|' || (doc_id % 5)::VARCHAR || '|' || CASE WHEN is_nested THEN 'R' ELSE 'N' END || '|' || least(end_lineno - lineno + 1, 20)::VARCHAR AS signature FROM units")
def signature_key(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", X.signature_key("language", F.col("doc_id") % 5, "is_nested", F.col("end_lineno") - F.col("lineno") + 1).alias("signature"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, left(array_to_string(list_slice(string_split(text, chr(10)), 1, 4), chr(10)), 300) AS preview FROM documents WHERE text IS NOT NULL")
def line_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), X.preview("text").alias("preview"))


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 4) AS likeness FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def name_likeness(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y")), 4).alias("likeness"))


# filters and search


@query(f"WITH {U} SELECT doc_id FROM units WHERE end_lineno - lineno + 1 BETWEEN 3 AND 500")
def length_filter(spark, sf_dir):
    return units(spark, sf_dir).where((F.col("end_lineno") - F.col("lineno") + 1).between(3, 500)).select("doc_id")


@query("SELECT page_id FROM pages WHERE NOT (list_contains(string_split(url, '/'), 'p1') OR regexp_matches(regexp_extract(url, '[^/]*$'), '^.*[05]$'))")
def ignore_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~X.ignored("url", ["p1", "*[05]"])).select("page_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel') ORDER BY CASE WHEN contains(lower(p_name), 'a') THEN 0 ELSE 1 END, p_partkey LIMIT 20")
def search_like(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hit = F.lower("p_name").contains("a")
    return p.where(hit | F.lower("p_type").contains("steel")).orderBy(F.when(hit, 0).otherwise(1), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("WITH s AS (SELECT p_partkey, (3 * (contains(lower(p_name), '1'))::INT + 2 * (contains(lower(p_type), 'brass'))::INT + (contains(lower(p_brand), '2'))::INT)::BIGINT AS score FROM part) SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def search_scored(spark, sf_dir):
    has = lambda c, x: F.lower(c).contains(x).cast("long")
    s = table(spark, sf_dir, "part").select("p_partkey", (3 * has("p_name", "1") + 2 * has("p_type", "brass") + has("p_brand", "2")).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@query(f"WITH {U} SELECT filepath, name, min(lineno) AS lineno FROM units GROUP BY filepath, name")
def lookup_first(spark, sf_dir):
    return tables.latest(units(spark, sf_dir).select("filepath", "name", "lineno"), ["filepath", "name"], ["lineno"])


# equal structure


@query(f"WITH {U} SELECT ast_hash, count(*) AS copies, min(doc_id) AS first FROM units GROUP BY ast_hash HAVING count(*) > 1")
def tier1_groups(spark, sf_dir):
    return pairs.equal_groups(units(spark, sf_dir), "ast_hash", "doc_id")


@query(f"WITH {U} SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY ast_hash) AS first FROM units) WHERE doc_id <> first")
def tier1_links(spark, sf_dir):
    return pairs.equal_links(units(spark, sf_dir), "ast_hash", "doc_id").select("doc_id", "first")


@query(f"WITH {U}, {PAIRS} SELECT a, b, 1.0::DOUBLE AS score FROM p")
def tier1_pairs(spark, sf_dir):
    return exact(spark, sf_dir).withColumn("score", F.lit(1.0))


@query("WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.k = b.k AND a.doc_id < b.doc_id")
def tier1_normalised(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.structural_hash(X.normalised("text")).alias("k"))
    return pairs.equal_pairs(d, "k", "doc_id").select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))


@query(f"WITH {U} SELECT doc_id, count(*) OVER (PARTITION BY ast_hash) AS copies, CASE WHEN count(*) OVER (PARTITION BY ast_hash) >= 3 THEN 'extract' ELSE 'review' END AS severity FROM units")
def copies(spark, sf_dir):
    u = units(spark, sf_dir).select("doc_id", "ast_hash")
    n = u.groupBy("ast_hash").agg(F.count("*").alias("copies"))
    return u.join(n, "ast_hash").select("doc_id", "copies", pairs.severity(F.col("copies")).alias("severity"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON substr(sha256(b.text), 1, 16) = substr(sha256(d.text), 1, 16)")
def tier1_probe(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", X.structural_hash("text").alias("h"))
    return b.join(table(spark, sf_dir, "documents").select("doc_id", X.structural_hash("text").alias("h")), "h").select("item_id", "doc_id")


# vectors

DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.35")
def cosine_pairs(spark, sf_dir):
    p = pairs.close_pairs(table(spark, sf_dir, "embeddings"), 0.35)
    return p.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"), F.round("cosine", 4).alias("cosine"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.25 + 0.01 * least(a.label, b.label)")
def cosine_per_label(spark, sf_dir):
    p = pairs.close_pairs(table(spark, sf_dir, "embeddings"), F.lit(0.25) + F.lit(0.01) * F.col("label"))
    return p.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"), F.round("cosine", 4).alias("cosine"))


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS hit_id, {DOT} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, hit_id) AS rank FROM s WHERE c >= 0.1) SELECT query_id, hit_id, round(c, 4) AS cosine, rank::INT AS rank FROM r WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return pairs.nearest(v.where("vec_id % 50 = 0"), v, 5, 0.1).withColumn("cosine", F.round("cosine", 4))


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS hit_id, {DOT} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 6) DESC, hit_id) AS rank FROM s WHERE c >= 0.21 AND c < 0.35) SELECT query_id, hit_id, round(c, 4) AS cosine FROM r WHERE rank = 1")
def probe_band(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    hits = pairs.nearest(v.where("vec_id % 50 = 0"), v, 1 << 30, 0.21).where("cosine < 0.35")
    return tables.latest(hits.drop("rank"), ["query_id"], [F.round("cosine", 6).desc(), "hit_id"]).withColumn("cosine", F.round("cosine", 4))


# meaning of pairs

STRUCTS = f"WITH {U}, m AS (SELECT s, e FROM units s JOIN units e ON s.ast_hash = e.ast_hash AND s.doc_id < e.doc_id)"
PENALTY = "CASE WHEN coalesce(((s.class_type = 'interface' AND e.class_type = 'class') OR (e.class_type = 'interface' AND s.class_type = 'class')) AND s.name = e.name, FALSE) THEN 0.0::DOUBLE WHEN e.is_nested THEN 0.0::DOUBLE WHEN e.visibility = 'private' THEN 0.6::DOUBLE WHEN e.visibility = 'internal' AND regexp_replace(s.filepath, '/?[^/]*$', '') = regexp_replace(e.filepath, '/?[^/]*$', '') THEN 0.9::DOUBLE WHEN e.visibility = 'internal' THEN 0.7::DOUBLE WHEN e.visibility = 'protected' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"{STRUCTS} SELECT s.doc_id AS a, e.doc_id AS b, {PENALTY} AS penalty FROM m")
def scope_penalty(spark, sf_dir):
    return matches(spark, sf_dir).select(F.col("source.doc_id").alias("a"), F.col("existing.doc_id").alias("b"), pairs.scope_penalty().alias("penalty"))


@query(f"""{STRUCTS} SELECT s.doc_id AS a, e.doc_id AS b, CASE WHEN {PENALTY} = 0 THEN 'scope' WHEN s.is_trivial AND e.is_trivial THEN 'trivial'
  WHEN coalesce(s.name = e.name AND s.class_name <> e.class_name AND (coalesce(s.class_type = 'interface', FALSE) OR coalesce(e.class_type = 'interface', FALSE) OR s.filepath = e.filepath), FALSE) THEN 'observer'
  WHEN s.filepath = e.filepath AND s.name <> e.name AND s.end_lineno - s.lineno < 15 AND e.end_lineno - e.lineno < 15 THEN 'same_file_short'
  WHEN s.name <> e.name AND NOT (s.end_lineno - s.lineno >= 25 AND e.end_lineno - e.lineno >= 25) THEN 'same_verb' END AS reason FROM m""")
def pair_filters(spark, sf_dir):
    return matches(spark, sf_dir).select(F.col("source.doc_id").alias("a"), F.col("existing.doc_id").alias("b"), pairs.drop_reason().alias("reason"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN (a.vec_id + b.vec_id) % 10 >= 8 THEN 'type3' ELSE 'type4' END AS clone_type FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.45")
def clone_type(spark, sf_dir):
    p = pairs.close_pairs(table(spark, sf_dir, "embeddings"), 0.45).select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"))
    return p.select("a", "b", pairs.clone_type(F.lit("embedding_semantic"), (F.col("a") + F.col("b")) % 10 / 10).alias("clone_type"))


@query("WITH l(l) AS (VALUES ('python'), ('javascript'), ('typescript'), ('c'), ('cpp'), ('go')) SELECT a.l AS a, b.l AS b, CASE WHEN a.l = b.l THEN 'direct_import' WHEN a.l || b.l IN ('javascripttypescript', 'typescriptjavascript', 'ccpp', 'cppc') THEN 'compatible_import' ELSE 'reference_only' END AS reuse, CASE WHEN 'python' = a.l AND b.l = 'python' THEN 0.94 WHEN a.l = 'go' OR b.l = 'go' THEN 0.81 WHEN a.l IN ('typescript', 'c', 'cpp') OR b.l IN ('typescript', 'c', 'cpp') THEN 0.83 ELSE 0.85 END::DOUBLE AS threshold FROM l a, l b")
def reuse_class(spark, sf_dir):
    names = F.array(*map(F.lit, ("python", "javascript", "typescript", "c", "cpp", "go")))
    d = spark.range(1).select(F.explode(names).alias("a")).select("a", F.explode(names).alias("b"))
    return d.select("a", "b", X.reuse_class("a", "b").alias("reuse"), pairs.language_threshold(F.col("a"), F.col("b")).alias("threshold"))


@query(f"WITH {U}, {PAIRS}, t2 AS (SELECT a.doc_id AS a, b.doc_id AS b FROM units a JOIN units b ON a.name = b.name AND a.filepath = b.filepath AND a.doc_id < b.doc_id) SELECT a, b, 'exact_structure' AS match_type FROM p UNION ALL SELECT a, b, 'embedding_semantic' FROM t2 WHERE (a, b) NOT IN (SELECT (a, b) FROM p)")
def merged_matches(spark, sf_dir):
    t1 = exact(spark, sf_dir)
    u = units(spark, sf_dir).select("doc_id", F.concat_ws(":", "filepath", "name").alias("k"))
    t2 = pairs.equal_pairs(u, "k", "doc_id").select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))
    return t1.withColumn("match_type", F.lit("exact_structure")).unionByName(t2.join(t1, ["a", "b"], "left_anti").withColumn("match_type", F.lit("embedding_semantic")))


# grouping

EDGES = f"e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} >= 0.4)"
REACH = f"WITH RECURSIVE {EDGES}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, up) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.up = s.a), c AS (SELECT node, min(up) AS component FROM r GROUP BY node)"


def close(spark, sf_dir: str) -> DataFrame:
    return pairs.close_links(table(spark, sf_dir, "embeddings"), 0.4).withColumn("score", F.round("score", 4))


@query(f"{REACH} SELECT node, component FROM c")
def connected(spark, sf_dir):
    return components(close(spark, sf_dir))


@query(f"{REACH}, m AS (SELECT component, count(*) AS size FROM c GROUP BY component), n AS (SELECT component, count(*) AS match_count FROM e JOIN c ON e.a = c.node GROUP BY component) SELECT m.component, size, match_count, CASE WHEN size >= 3 THEN 'group' ELSE 'pair' END AS kind FROM m JOIN n ON m.component = n.component")
def finding_groups(spark, sf_dir):
    return findings.groups(close(spark, sf_dir)).drop("score")


@query("WITH f AS (SELECT l_orderkey AS finding, list_sort(list(DISTINCT l_suppkey)) AS members FROM lineitem GROUP BY l_orderkey), u AS (SELECT finding, len(members) AS n, unnest(members) AS u FROM f), i AS (SELECT x.finding FROM u x JOIN u y ON x.u = y.u AND x.n < y.n GROUP BY x.finding, y.finding, x.n HAVING count(*) = x.n) SELECT finding, array_to_string(members, ',') AS members FROM f WHERE finding NOT IN (SELECT finding FROM i)")
def subset_suppression(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("members"))
    return findings.subset_suppressed(f).select("finding", F.array_join("members", ",").alias("members"))


@query("SELECT unit, finding FROM (SELECT l_partkey AS unit, l_orderkey AS finding, row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_discount) DESC, l_orderkey) AS r FROM lineitem GROUP BY l_partkey, l_orderkey) WHERE r = 1")
def unit_assignment(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit"), F.col("l_orderkey").alias("finding")).agg(F.max("l_discount").alias("score"))
    return findings.assigned(m).select("unit", "finding")


@query("WITH m AS (SELECT l_suppkey AS component, l_partkey AS unit, max(l_discount) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, unit) AS rank FROM m) SELECT component, unit, rank::INT AS rank FROM r WHERE rank <= 15")
def group_cap(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("unit")).agg(F.max("l_discount").alias("score"))
    return findings.capped(m).select("component", "unit", "rank")


@query("WITH r AS (SELECT o_orderkey AS finding, o_custkey % 500 AS file, CASE WHEN o_orderpriority = '1-URGENT' THEN 'extract' ELSE 'review' END AS severity FROM orders), w AS (SELECT file FROM r WHERE severity = 'review' GROUP BY file HAVING count(DISTINCT finding) >= 2) SELECT finding, file, CASE WHEN severity = 'review' AND file IN (SELECT file FROM w) THEN 'extract' ELSE severity END AS severity FROM r")
def file_elevation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding"), (F.col("o_custkey") % 500).alias("file"), F.when(F.col("o_orderpriority") == "1-URGENT", "extract").otherwise("review").alias("severity"))
    return findings.elevated(o).select("finding", "file", "severity")


# statistics and health


@query("SELECT lang, count(*) AS units, count(DISTINCT source) AS files FROM documents GROUP BY lang")
def index_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("units"), F.countDistinct("source").alias("files"))


@query("SELECT lang, source, count(*) AS units FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def index_stats_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([[], [F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("units")).select("lang", "source", "units")


@query(f"WITH {U}, g AS (SELECT count(*) AS c FROM units GROUP BY ast_hash HAVING count(*) > 1), t AS (SELECT (SELECT count(*) FROM units) AS total, count(*) FILTER (c >= 3) AS extract, count(*) FILTER (c = 2) AS review FROM g), s AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(100 - (5 * extract + 2 * review) / greatest(total / 50.0::DOUBLE, 1.0::DOUBLE), 0))) AS sc FROM t) SELECT total, extract, review, sc::BIGINT AS score, CASE WHEN sc >= 90 THEN 'A' WHEN sc >= 75 THEN 'B' WHEN sc >= 60 THEN 'C' WHEN sc >= 40 THEN 'D' ELSE 'F' END AS grade FROM s")
def health_score(spark, sf_dir):
    u = units(spark, sf_dir)
    g = u.groupBy("ast_hash").agg(F.count("*").alias("c"))
    return findings.health(g.agg(F.sum("c").alias("total"), F.count_if(F.col("c") >= 3).alias("extract"), F.count_if(F.col("c") == 2).alias("review")))


@query(f"WITH {U}, {PAIRS} SELECT filepath, count(*) AS n FROM (SELECT unnest([x.filepath, y.filepath]) AS filepath FROM p JOIN units x ON a = x.doc_id JOIN units y ON b = y.doc_id) GROUP BY filepath ORDER BY n DESC, filepath LIMIT 5")
def hotspots(spark, sf_dir):
    m = matches(spark, sf_dir).select(F.explode(F.array("source.filepath", "existing.filepath")).alias("filepath"))
    return m.groupBy("filepath").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filepath").limit(5)


@query(f"WITH {U}, t AS (SELECT name, count(*) AS copies FROM units GROUP BY name ORDER BY copies DESC, name LIMIT 8) SELECT * FROM t WHERE copies >= 3")
def top_targets(spark, sf_dir):
    return units(spark, sf_dir).groupBy("name").agg(F.count("*").alias("copies")).orderBy(F.desc("copies"), "name").limit(8).where("copies >= 3")


@query(f"WITH {U}, {PAIRS} SELECT count(*) AS matches, count(*) FILTER (x.language <> y.language) AS cross_language, count(*) FILTER (x.filepath = y.filepath) AS same_file FROM p JOIN units x ON a = x.doc_id JOIN units y ON b = y.doc_id")
def scan_event(spark, sf_dir):
    return matches(spark, sf_dir).agg(F.count("*").alias("matches"), F.count_if(F.col("source.language") != F.col("existing.language")).alias("cross_language"), F.count_if(F.col("source.filepath") == F.col("existing.filepath")).alias("same_file"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS delta FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 30")
def health_trend(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("day")).limit(31).select("day", "n", (F.col("n") - F.lag("n").over(W.orderBy("day"))).alias("delta")).orderBy(F.desc("day")).limit(30)


# suppression and keyed tables


def _findings(spark, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    q = lambda f: X.qualified_name(f"{f}.filepath", f"{f}.name", f"{f}.lineno")
    m = m.select(q("source").alias("a"), q("existing").alias("b"), F.col("source.ast_hash").alias("a_hash"), F.col("existing.ast_hash").alias("b_hash"), (F.col("source.doc_id") % 4).alias("k"))
    return m.withColumn("finding_id", X.finding_id("a", "b")).withColumn("stable", X.stable_key("a", "b"))


FOUND = f"WITH {U}, {PAIRS}, q AS (SELECT doc_id, ast_hash, filepath || ':' || name || ':' || lineno::VARCHAR AS q, filepath || ':' || name AS s FROM units), f AS (SELECT least(x.q, y.q) || '||' || greatest(x.q, y.q) AS finding_id, x.s AS xs, y.s AS ys, a % 4 AS k, x.ast_hash AS h FROM p JOIN q x ON a = x.doc_id JOIN q y ON b = y.doc_id)"


@query(f"{FOUND}, ends AS (SELECT xs AS s FROM f WHERE k = 0 UNION SELECT ys FROM f WHERE k = 0) SELECT finding_id FROM f WHERE k = 2 OR k = 3 AND xs NOT IN (SELECT s FROM ends) AND ys NOT IN (SELECT s FROM ends)")
def suppressed_findings(spark, sf_dir):
    f = _findings(spark, sf_dir)
    verdict = F.when(F.col("k") == 0, "dismissed").otherwise("intentional")
    stored = F.when(F.col("k") == 2, "changed").otherwise(F.left("a_hash", F.lit(8)))
    listed = f.where("k <= 2").select(F.col("finding_id").alias("id"), verdict.alias("verdict"), stored.alias("source_hash"), F.left("b_hash", F.lit(8)).alias("existing_hash"), F.lit(0).alias("ord"))
    return findings.unsuppressed(f, listed).select("finding_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tables.upserted(d, d.where("doc_id % 5 = 0").withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 4 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents")
def incremental_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    now = d.where("doc_id % 10 <> 4").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return tables.changed(d.where("doc_id % 10 <> 3"), now, "doc_id", ["n_chars"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def needs_embedding(spark, sf_dir):
    return tables.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


# module graph

CALLS = "e AS (SELECT DISTINCT c.source AS src, d.dst FROM documents c JOIN (SELECT n, max_by(source, (doc_id, source)) AS dst FROM (SELECT doc_id, source, 'f' || (doc_id % 97)::VARCHAR AS n FROM documents) GROUP BY n) d ON 'f' || (c.doc_id % 89)::VARCHAR = d.n WHERE c.source <> d.dst)"


def edges(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = lambda k: F.concat(F.lit("f"), (F.col("doc_id") % k).cast("string")).alias("name")
    return graph.call_edges(d.select(F.col("source").alias("file"), name(89)), d.select(F.col("source").alias("file"), name(97), F.col("doc_id").alias("ord")))


@query(f"WITH {CALLS} SELECT src, dst FROM e")
def module_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {CALLS}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), d1 AS (SELECT b AS node FROM u WHERE a = 'src1'), d2 AS (SELECT b AS node FROM u WHERE a IN (SELECT node FROM d1)), r AS (SELECT 'src1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node")
def related_depth2(spark, sf_dir):
    return graph.within(edges(spark, sf_dir), spark.range(1).select(F.lit("src1").alias("node")))


@query(f"WITH {CALLS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), near AS (SELECT dst AS node FROM e WHERE src = 'src1' UNION SELECT src FROM e WHERE dst = 'src1' UNION SELECT 'src1') SELECT node, CASE WHEN node IN (SELECT node FROM near) THEN CASE WHEN length(node) = 4 THEN 1 ELSE 2 END ELSE 3 END::INT AS tier FROM n")
def relevance_tier(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    related = graph.within(e, spark.range(1).select(F.lit("src1").alias("node")), 1)
    return graph.relevance(nodes, related, nodes.select("node", F.length("node").alias("domain")), 4)


HITS = ", ".join(f"({i}, '{d}', '{w}')" for i, (d, ws) in enumerate(graph.DOMAINS.items()) for w in ws)


@query(f"WITH w AS (SELECT DISTINCT conv_id AS module, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), t(rank, domain, hit) AS (VALUES {HITS}), h AS (SELECT module, rank, domain, count(*) AS n FROM w JOIN t ON word = hit GROUP BY ALL), b AS (SELECT module, max_by(domain, (n, -rank)) AS domain FROM h GROUP BY module) SELECT m.module, coalesce(domain, 'general') AS domain FROM (SELECT DISTINCT module FROM w) m LEFT JOIN b ON m.module = b.module")
def domain_cluster(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("module"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return graph.domain_of(w)


# evaluation


@query("WITH p AS (SELECT d.n_chars > 1000 AS p, l.quality = 1 AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn FROM p) SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 4) AS accuracy FROM c")
def eval_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return findings.metrics(d.agg(*findings.confusion(F.col("n_chars") > 1000, F.col("quality") == 1)))


@query("WITH p AS (SELECT d.n_chars > t.t AS p, l.quality = 1 AS y, t.t AS threshold FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES (250), (500), (1000), (2000), (4000)) t(t)), c AS (SELECT threshold::BIGINT AS threshold, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM p GROUP BY threshold) SELECT threshold, tp, fp, tn, fn, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c")
def threshold_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("*", F.explode(F.array(*[F.lit(t).cast("long") for t in (250, 500, 1000, 2000, 4000)])).alias("threshold"))
    return findings.metrics(d.groupBy("threshold").agg(*findings.confusion(F.col("n_chars") > F.col("threshold"), F.col("quality") == 1))).select("threshold", "tp", "fp", "tn", "fn", "f1")


@query("SELECT d.lang, GROUPING(d.lang)::BIGINT AS total, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.lang)")
def eval_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.rollup("lang").agg(F.grouping("lang").cast("long").alias("total"), F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def model_pivot(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").pivot("quality", [0, 1]).agg(F.count("doc_id")).select("lang", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))


@query(f"WITH {U}, {PAIRS} SELECT count(*) AS unexpected FROM p WHERE a NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unexpected_matches(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("a"))
    return exact(spark, sf_dir).join(good, "a", "left_anti").agg(F.count("*").alias("unexpected"))


@query("SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 6 AND r % 2 = 1 AND next_turn IS NOT NULL")
def sampled_pairs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.row_number().over(w).cast("long").alias("r"))
    return d.where("r <= 6 AND r % 2 = 1 AND next_turn IS NOT NULL")


@query("(SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20) UNION ALL (SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20) UNION ALL (SELECT doc_id, lang FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 20)")
def stratified_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a, b, c = (d.where(F.col("lang") == x).orderBy("doc_id").limit(20) for x in ("en", "fr", "de"))
    return a.unionByName(b).unionByName(c)


# event time


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s")
def debounce_trailing(spark, sf_dir):
    return debounce.trailing(table(spark, sf_dir, "events"), "user_id", gap="30 minutes")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return debounce.tumbling(table(spark, sf_dir, "events"), "event_type")


@query()
def extract_units(spark, sf_dir):
    """Functions of two snippets that are renamed copies, by the parser: one hash."""
    files = [("a.py", "def add(a, b):\n    return a + b\n"), ("b.py", "class K:\n    def total(self, x, y):\n        return x + y\n\ndef plus(p, q):\n    '''doc'''\n    return p + q\n")]
    return extract.extracted(spark.createDataFrame(files, "filepath string, content string"))

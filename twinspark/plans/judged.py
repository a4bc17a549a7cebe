"""Queries of likeness, guesses, sections and upkeep: tables of cases whose every branch fires, and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import likeness, tables
from ..streaming import debounce
from .cases import FOUND, expected, found
from .catalogue import query, table

WIDE = "(b " + " ".join(["x"] * 60) + ")"
TREES = [
    (1, "(f (p v0 v1) (b v0))", "(f (p v0 v1) (b v0))", 1.0), (2, "(f (p v0 v1) (b v0))", "(f (p v0 v1) (b v1))", 0.833333), (3, "(f (p v0) (b v0))", "(f (b v0))", 0.6),
    (4, "(f a b c)", "(g (h a b) c)", 0.6), (5, "", "(f a)", 0.0), (6, "(f a)", "(f a b c d e f g h i)", 0.14), (7, WIDE, WIDE + " y", 0.983871),
    (8, None, "(f a)", 0.0), (9, "(f (a", "(f (a))", 1.0), (10, "v0", "v1", 0.0),
]


@query(expected("id, likeness", [(r[0], r[3]) for r in TREES]).replace("SELECT *", "SELECT id, likeness::DOUBLE AS likeness"))
def structure_cases(spark, sf_dir):
    d = spark.createDataFrame([r[:3] for r in TREES], "id int, a string, b string")
    return d.select("id", F.round(likeness.structure_likeness("a", "b"), 6).alias("likeness"))


NAMES = [("getuser", "get_user", 0.9333), ("load_config", "load_settings", 0.5833), ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("", "", 1.0)]


@query(expected("a, b, ratio", NAMES).replace("SELECT *", "SELECT a, b, ratio::DOUBLE AS ratio"))
def name_ratios(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in NAMES], "a string, b string").select("a", "b", F.round(likeness.sequence_ratio("a", "b"), 4).alias("ratio"))


UNIT = "struct<name: string, filepath: string, lineno: int, end_lineno: int, language: string, param_count: int, has_return: boolean, calls: array<string>, visibility: string, is_nested: boolean, class_name: string, ast_hash: string, cluster: string>"
JUDGED = [
    (1, ("getuser", "services/a/x.py", 1, 10, "python", 2, True, ["q", "r"], "private", True, "K", "h", "c"), ("get_user", "services/b/x.py", 5, 9, "python", 3, True, ["r", "s"], None, None, "K", "h", "c")),
    (2, ("abc", "x.py", 1, 4, "python", 0, False, None, "public", False, None, "", None), ("xyz", "x.py", 9, 12, "go", 0, False, [], "public", False, "", "", "")),
]
FEATURES = "id, source_line_count, source_call_count, existing_visibility, existing_is_nested, source_has_class, same_language, same_file, same_class, same_cluster, crosses_service_boundary, ast_hash_match, name_similarity, param_count_diff, shared_calls_ratio, line_count_ratio"


@query(
    expected(FEATURES, [(1, 10, 2, "public", False, True, True, False, True, True, True, True, 0.9333, 1, 0.3333, 0.5), (2, 4, 0, "public", False, False, False, True, False, False, False, False, 0.0, 0, 0.0, 1.0)])
    .replace("SELECT *", "SELECT * REPLACE (name_similarity::DOUBLE AS name_similarity, shared_calls_ratio::DOUBLE AS shared_calls_ratio, line_count_ratio::DOUBLE AS line_count_ratio)")
)
def feedback_features(spark, sf_dir):
    d = spark.createDataFrame(JUDGED, f"id int, source {UNIT}, existing {UNIT}")
    return d.select("id", *likeness.feedback_features()).select(*FEATURES.split(", "))


@query("WITH e AS (SELECT vec_id // 8 AS unit, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE vec_id % 3 <> 0), m AS (SELECT unit, k, avg(x) AS x FROM e GROUP BY ALL), l AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM m GROUP BY unit) SELECT unit, k::INTEGER AS k, round(x / norm, 6) AS x FROM m JOIN l USING (unit)")
def pooled_vectors(spark, sf_dir):
    """Eight vectors in a row stand for a unit's tokens, every third one for padding."""
    d = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("unit"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 3 != 0).cast("int").alias("m"))
    g = d.groupBy("unit").agg(F.collect_list(F.struct("v", "m")).alias("t"))
    return g.select("unit", F.posexplode(likeness.mean_pooled(F.col("t.v"), F.col("t.m"))).alias("k", "x")).select("unit", (F.col("k") + 1).alias("k"), F.round("x", 6).alias("x"))


@query("SELECT count(*) AS count, max(len(embedding)) AS dimensions, round(count(*) * max(len(embedding)) * 4 / 1048576, 1) AS storage_mb FROM embeddings")
def vector_storage(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("count"), F.max(F.size("embedding")).cast("long").alias("dimensions"))
    return d.withColumn("storage_mb", likeness.storage_mb(F.col("count"), F.col("dimensions")))


SNIPPETS = [
    (1, "x", "a/b.CJS", "javascript"), (2, "x", "a.hpp", "cpp"), (3, "def f(self):\n    import os", "a/.py", "python"), (4, "const f = () => console.log(1)", None, "javascript"),
    (5, "package main\nfunc f() { if err != nil { fmt.Println() } }", "x.txt", "go"), (6, "#include <stdio.h>\nprintf(malloc(1))", None, "c"), (7, "#include <vector>\nstd::vector<int> v;", "", "cpp"),
    (8, "zzz", None, "python"), (9, "pub fn f() { let mut x = 1; match x {} }", None, "rust"), (10, "puts 1\nclass A\nend", None, "ruby"), (11, "public class A { private int x; }", None, "java"), (12, "interface A { x: string }", None, "typescript"),
]


@query(expected("id, language", [(r[0], r[3]) for r in SNIPPETS]))
def guessed_languages(spark, sf_dir):
    return spark.createDataFrame([r[:3] for r in SNIPPETS], "id int, code string, path string").select("id", X.guessed_language("code", "path").alias("language"))


CALLED = [("while", 9, "no"), ("_f", 1, "no"), ("_f", 2, "yes"), ("f", 1, "yes"), ("This", 3, "yes"), ("undefined", 3, "no")]


@query(expected("name, lines, kept", CALLED))
def name_gate(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in CALLED], "name string, lines int").select("name", "lines", F.when(X.names_a_function("name", "lines"), "yes").otherwise("no").alias("kept"))


REMOTES = [("git@github.com:a/b.git", "github", "a", "b"), ("https://github.com/a/b", "github", "a", "b"), ("git@gitlab.example.org:g/s/b.git", "gitlab", "g", "s/b"), ("http://gitlab.com/a/b.git", "gitlab", "a", "b"), ("https://example.org/a/b", None, None, None)]


@query(expected("url, host, owner, repo", REMOTES))
def remotes(spark, sf_dir):
    return spark.createDataFrame([r[:1] for r in REMOTES], "url string").select("url", X.remote_parts("url").alias("p")).select("url", "p.*")


GATES = [("public", "public", "public", "code"), ("public", "private", "private", "features"), ("private", "public", "public", "features"), ("public", "unknown", "private", "features")]


@query(expected("consent, visibility, usual, sent", GATES))
def consent_gates(spark, sf_dir):
    d = spark.createDataFrame([r[:2] for r in GATES], "consent string, visibility string")
    return d.select("consent", "visibility", X.default_consent("visibility").alias("usual"), F.when(X.sends_code("consent", "visibility"), "code").otherwise("features").alias("sent"))


@query("SELECT CASE WHEN l_linenumber = 1 THEN 'type1' WHEN l_linenumber = 2 THEN 'type2' WHEN l_discount >= 0.05 THEN 'type3' ELSE 'type4' END AS clone_type, count(*) AS n FROM lineitem GROUP BY 1")
def labelled_types(spark, sf_dir):
    """Lines stand for labelled pairs: the line number is the syntactic type, ten times the discount the likeness."""
    d = table(spark, sf_dir, "lineitem").select(X.labelled_type("l_linenumber", F.col("l_discount") * 10).alias("clone_type"))
    return d.groupBy("clone_type").agg(F.count("*").alias("n"))


SECTIONS = [
    (1, "reference_only", "extract", "go", "python", "cross_language"), (2, "cross_service_reference", "extract", "go", "go", "extract"), (3, "cross_service_reference", "review", "go", "c", "cross_language"),
    (4, "cross_service_reference", "review", None, None, "review"), (5, "direct_import", "extract", "go", "go", "extract"), (6, "compatible_import", "review", "c", "cpp", "review"),
]


@query(expected("id, section", [(r[0], r[5]) for r in SECTIONS]))
def finding_sections(spark, sf_dir):
    d = spark.createDataFrame([r[:5] for r in SECTIONS], "id int, reuse string, severity string, a string, b string")
    return d.select("id", X.section("reuse", "severity", "a", "b").alias("section"))


@query(f"{FOUND} SELECT lang AS name, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, count(DISTINCT doc_id) AS size FROM f WHERE copies >= 3 GROUP BY lang")
def editor_clusters(spark, sf_dir):
    g = found(spark, sf_dir).where("copies >= 3").groupBy(F.col("lang").alias("name"))
    return g.agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"), F.count("*").alias("size"))


@query(f"{FOUND} SELECT finding, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, count(*) AS matches FROM f WHERE doc_id <> finding GROUP BY finding HAVING count(*) >= 2")
def representative_clusters(spark, sf_dir):
    """Findings whose representative has two or more matches: one mark in an editor."""
    g = found(spark, sf_dir).where("doc_id <> finding").groupBy("finding")
    return g.agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"), F.count("*").alias("matches")).where("matches >= 2")


@query(f"{FOUND}, l AS (SELECT finding FROM f GROUP BY finding HAVING count(DISTINCT file) > 1) SELECT lang AS file, count(DISTINCT finding) AS findings, count(*) AS units FROM f WHERE finding IN (SELECT finding FROM l) GROUP BY lang")
def language_lens(spark, sf_dir):
    """Findings across languages by file; sources stand for languages, languages for files."""
    f = found(spark, sf_dir).select("finding", F.col("file").alias("language"), F.col("lang").alias("file"))
    across = f.groupBy("finding").agg(F.count_distinct("language").alias("n")).where("n > 1").select("finding")
    return f.join(across, "finding", "left_semi").groupBy("file").agg(F.count_distinct("finding").alias("findings"), F.count("*").alias("units"))


WORDS = "d AS (SELECT doc_id, lang, source, text FROM documents WHERE lang IS NOT NULL), w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM d), k AS (SELECT lang, array_to_string(list_slice(list_sort(list(word)), 1, 10), ',') AS keywords FROM w WHERE length(word) >= 3 GROUP BY lang)"


@query(f"WITH {WORDS}, c AS (SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS files, count(*) AS functions FROM d GROUP BY lang) SELECT c.*, coalesce(keywords, '') AS keywords FROM c LEFT JOIN k USING (lang)")
def cluster_listing(spark, sf_dir):
    """Clusters (here: languages) with their files, number of functions and first ten keywords."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    c = d.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("files"), F.count("*").alias("functions"))
    # words are made distinct before they are collected, as many as the vocabulary has
    k = d.select("lang", F.explode(X.keywords("text")).alias("word")).distinct().groupBy("lang").agg(F.array_join(F.slice(F.array_sort(F.collect_list("word")), 1, 10), ",").alias("keywords"))
    return c.join(k, "lang", "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS ord FROM lineitem")
def order_index(spark, sf_dir):
    return tables.numbered(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey", "l_orderkey", "l_linenumber"]).drop("l_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'sent' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def uploaded_orders(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.marked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), sent, ["o_orderkey"], "o_orderstatus", F.lit("sent"))


@query("WITH RECURSIVE e AS (SELECT user_id, ts FROM events), k AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT e.user_id, min(e.ts) FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 12 HOUR GROUP BY e.user_id) SELECT * FROM k")
def debounce_leading(spark, sf_dir):
    return debounce.leading(table(spark, sf_dir, "events"), "user_id", gap_ms=12 * 3600 * 1000)

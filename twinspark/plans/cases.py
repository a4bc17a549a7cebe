"""Further queries: rules over tables of cases that make every branch fire, and the remaining reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import findings, graph, pairs, tables
from .catalogue import query, table


def quoted(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of the results that the cases have to give."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


SERVICES = [("services/pay/a.py", "services/pay"), ("./apps/web/src/x.ts", "apps/web"), ("x/services/pay/a.py", None), ("services/a.py", None), ("packages\\core\\a.js", "packages/core"), ("src/apps.py", None)]


@query(expected("path, service", SERVICES))
def service_cases(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in SERVICES], "path string").select("path", X.service("path").alias("service"))


BOUNDARIES = [("services/pay/a.py", "services/pay"), ("x/apps/web/packages/ui/b.ts", "apps/web,packages/ui"), ("src/a.py", ""), ("services", "")]


@query(expected("path, boundaries", BOUNDARIES))
def service_boundaries(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in BOUNDARIES], "path string").select("path", F.array_join(X.boundaries("path"), ",").alias("boundaries"))


IGNORE = ["docs_src/", "snapshots", "gen/*.py", "*.tmp.py", "tests/data"]
IGNORED = [("docs_src/a.py", "yes"), ("x/docs_src/a.py", "yes"), ("a/snapshots/b.py", "yes"), ("a/snapshots.py", "no"), ("gen/a.py", "yes"), ("x/gen/a.py", "no"), ("x/y.tmp.py", "yes"), ("tests/data_a/x.py", "yes"), ("src/a.py", "no")]


@query(expected("path, ignored", IGNORED))
def ignore_cases(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in IGNORED], "path string").select("path", F.when(X.ignored("path", IGNORE), "yes").otherwise("no").alias("ignored"))


FOLDERS = [(1, "src/a/x.py,src/a/y.py,src/b/z.py", "src/"), (2, "a/x.py,b/y.py", ""), (3, "a/b/x.py,a/b/c/y.py", "a/b/"), (4, "x.py,a/y.py", "")]


@query(expected("id, paths, folder", FOLDERS))
def common_folders(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in FOLDERS], "id int, paths string").select("id", "paths", X.common_folder(F.split("paths", ",")).alias("folder"))


BODIES = [
    (1, "def f(x):\n    return x + 1", "yes"), (2, "def f(x):\n    y = x + 1\n    return y * 2", "no"), (3, "def f():\n    from utils import find\n    return find()", "yes"),
    (4, "def f(x):\n    import re\n    return bool(re.match(x))", "no"), (5, "function f(x) {\n  if (!x) return;\n  go(x);\n}", "yes"), (6, "def f(a):\n    # note\n    x = a\n    y = x\n    if y: return\n    go(y)", "no"), (7, "", "yes"),
]


@query(expected("id, trivial", [(r[0], r[2]) for r in BODIES]))
def trivial_functions(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in BODIES], "id int, source string").select("id", F.when(pairs.is_trivial(F.col("source")), "yes").otherwise("no").alias("trivial"))


UNIT = {"filepath": "a/x.py", "name": "f", "lineno": 1, "end_lineno": 40, "language": "python", "source": "x", "class_type": None, "class_name": None, "is_nested": False, "visibility": "public", "is_trivial": False}
UNIT_TYPE = "struct<filepath: string, name: string, lineno: int, end_lineno: int, language: string, source: string, class_type: string, class_name: string, is_nested: boolean, visibility: string, is_trivial: boolean>"
PANEL = {"language": "typescript", "end_lineno": 12, "source": "<div className='a'/>"}
REASONS = [
    ("nested", {}, {"is_nested": True}, "scope"),
    ("interface", {"class_type": "interface"}, {"class_type": "class"}, "scope"),
    ("routes", {"filepath": "a/route.ts", "name": "GET"}, {"filepath": "b/route.ts", "name": "GET"}, "required_export"),
    ("pages", {"filepath": "a/page.tsx", "name": "P", "end_lineno": 5}, {"filepath": "b/page.tsx", "name": "Q", "end_lineno": 5}, "page_export"),
    ("trivial", {"is_trivial": True}, {"is_trivial": True}, "trivial"),
    ("one trivial", {"is_trivial": True}, {}, None),
    ("health", {"filepath": "services/a/m.py", "name": "health"}, {"filepath": "services/b/m.py", "name": "healthcheck"}, "per_service"),
    ("constructors", {"name": "__init__", "class_name": "A"}, {"name": "__init__", "class_name": "B"}, "constructor"),
    ("observers", {"name": "on_a", "class_name": "A"}, {"name": "on_b", "class_name": "A"}, "observer"),
    ("same file", {"name": "alpha", "end_lineno": 9}, {"name": "beta", "end_lineno": 9}, "same_file_short"),
    ("one verb", {"name": "list_jobs"}, {"name": "list_users", "filepath": "b/y.py", "end_lineno": 20}, "same_verb"),
    ("one verb, long", {"name": "compute_hash"}, {"name": "compute_digest", "filepath": "b/y.py"}, None),
    ("same words", {"name": "get_user", "end_lineno": 9}, {"name": "getUser", "filepath": "b/y.py", "end_lineno": 9}, None),
    ("start and stop", {"name": "start_job", "end_lineno": 9}, {"name": "stop_job", "filepath": "b/y.py", "end_lineno": 9}, "crud_pair"),
    ("longer noun", {"name": "get_job", "end_lineno": 9}, {"name": "set_job_mode", "filepath": "b/y.py", "end_lineno": 9}, "crud_pair"),
    ("read and write", {"name": "read_row", "end_lineno": 9}, {"name": "write_row", "filepath": "b/y.py", "end_lineno": 9}, None),
    ("markup", {"name": "Panel", "filepath": "a/p.tsx", **PANEL}, {"name": "Tip", "filepath": "b/t.tsx", **PANEL}, "markup_wrapper"),
    ("copies", {}, {"filepath": "b/y.py"}, None),
]


@query(expected("case_name, reason", [(r[0], r[3]) for r in REASONS]))
def filter_reasons(spark, sf_dir):
    rows = [(k, UNIT | a, UNIT | b, "exact_structure") for k, a, b, _ in REASONS]
    d = spark.createDataFrame(rows, f"case_name string, source {UNIT_TYPE}, existing {UNIT_TYPE}, match_type string")
    return d.select("case_name", pairs.drop_reason().alias("reason"))


LISTED = [(0, "a:f:1||b:g:2", "dismissed", "", ""), (1, "c:f:1||d:g:2", "intentional", "aaaaaaaa", "bbbbbbbb"), (2, "e:f:1||a:f:3", "intentional", "aaaaaaaa", "bbbbbbbb"), (3, "h:f:1||i:g:2", "intentional", "aaaaaaaa", ""), (4, "c:f:1||d:g:2", "dismissed", "", "")]
JUDGED = [("a:f:1||b:g:2", "x", "y", "covered"), ("c:f:1||d:g:2", "bbbbbbbb1", "aaaaaaaa2", "covered"), ("e:f:1||a:f:3", "changed", "bbbbbbbb", "kept"), ("h:f:1||i:g:2", "x", "y", "covered"), ("a:f:9||z:g:2", "x", "y", "covered"), ("y:f:1||z:g:2", "x", "y", "kept"), ("c:f:5||z:g:2", "x", "y", "covered")]


@query(expected("finding_id", [("e:f:1||a:f:3",), ("y:f:1||z:g:2",)]))
def suppression_cases(spark, sf_dir):
    listed = spark.createDataFrame(LISTED, "ord int, id string, verdict string, source_hash string, existing_hash string")
    return findings.unsuppressed(spark.createDataFrame([r[:3] for r in JUDGED], "finding_id string, a_hash string, b_hash string"), listed).select("finding_id")


@query(expected("id, verdict", [("a:f:1||b:g:2", "dismissed"), ("c:f:1||d:g:2", "dismissed")]))
def pruned_entries(spark, sf_dir):
    listed = spark.createDataFrame([r[1:3] for r in LISTED], "id string, verdict string")
    return findings.pruned(listed.where("id NOT LIKE 'c:%' OR verdict = 'dismissed'"), spark.createDataFrame([("b:g:7||a:f:4",), ("c:f:1||d:g:2",), ("h:f:2||i:g:2",)], "finding_id string"))


MERGED = [(1, "a,b,c", 0.9, "group", None), (2, "a,b,c,d", 0.95, "group", "a,b,c,d"), (3, "x,y", 0.8, "pair", "x,y"), (4, "p,q,r", 0.7, "group", "p,q,r,s"), (5, "q,r,s", 0.6, "pair", "q,r,s"), (6, "p,q,r,s", 0.5, "group", None)]


@query(expected("finding, members", [(r[0], r[4]) for r in MERGED if r[4]]))
def merged_findings(spark, sf_dir):
    d = spark.createDataFrame([r[:4] for r in MERGED], "finding int, members string, score double, kind string").withColumn("members", F.split("members", ","))
    return findings.merged_overlaps(d).select("finding", F.array_join("members", ",").alias("members"))


PARTS = [("a/b.py:f:12", "a/b.py", "f", "12"), ("c:/x.py:g:deadbeef", "c:/x.py", "g", "deadbeef")]


@query(expected("end_id, path, name, mark", PARTS))
def finding_parts(spark, sf_dir):
    return spark.createDataFrame([r[:1] for r in PARTS], "end_id string").select("end_id", X.end_parts("end_id").alias("p")).select("end_id", "p.*")


# groups and their members

ASSIGNED = "m AS (SELECT l_partkey AS unit, l_orderkey AS finding, max(l_discount) AS score FROM lineitem GROUP BY ALL), s AS (SELECT finding, CASE WHEN count(*) >= 3 THEN 'group' ELSE 'pair' END AS kind FROM m GROUP BY finding), a AS (SELECT unit, finding, row_number() OVER (PARTITION BY unit ORDER BY score DESC, finding) AS r FROM m)"


@query(f"WITH {ASSIGNED} SELECT a.finding, CASE WHEN kind = 'group' AND count(*) >= 3 THEN 'group' ELSE 'pair' END AS kind, count(*) AS size, array_to_string(list_sort(list(unit)), ',') AS units FROM a JOIN s ON a.finding = s.finding WHERE r = 1 GROUP BY a.finding, kind HAVING count(*) >= 2")
def rebuilt_findings(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit"), F.col("l_orderkey").alias("finding")).agg(F.max("l_discount").alias("score"))
    kinds = m.groupBy("finding").agg(F.when(F.count("*") >= 3, "group").otherwise("pair").alias("kind"))
    return findings.rebuilt(m.join(kinds, "finding")).withColumn("units", F.array_join("units", ","))


STAR = "g AS (SELECT doc_id, first_value(doc_id) OVER w AS a, lang, first_value(lang) OVER w AS lang_a, source, first_value(source) OVER w AS source_a FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), e AS (SELECT a, doc_id AS b, CASE WHEN source <> source_a THEN 'cross_service_reference' WHEN lang IS NOT DISTINCT FROM lang_a THEN 'direct_import' ELSE 'reference_only' END AS reuse, (doc_id % 97) / 100.0::DOUBLE AS score FROM g WHERE a <> doc_id)"


@query(f"""WITH {STAR}, c AS (SELECT reuse, a AS component, array_to_string(list_sort(list_append(list(b), a)), ',') AS members, count(*) AS match_count, arg_max(b, (score, -b)) AS b, max(score) AS score FROM e WHERE reuse <> 'cross_service_reference' GROUP BY reuse, a)
SELECT reuse, component, members, match_count, component AS a, b, score FROM c UNION ALL SELECT reuse, a, array_to_string([a, b], ','), 1, a, b, score FROM e WHERE reuse = 'cross_service_reference'""")
def described_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "source", X.structural_hash("text").alias("h"))
    first = d.groupBy("h").agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("first"))
    e = d.join(first, "h").where(F.col("doc_id") != F.col("first.doc_id"))
    reuse = F.when(F.col("source") != F.col("first.source"), "cross_service_reference").when(F.col("lang").eqNullSafe(F.col("first.lang")), "direct_import").otherwise("reference_only")
    e = e.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"), ((F.col("doc_id") % 97) / F.lit(100.0)).alias("score"), reuse.alias("reuse"))
    return findings.described(e).withColumn("members", F.array_join("members", ","))


@query("WITH d AS (SELECT source AS file, 'f' || (doc_id % 97) AS name, 'f' || (doc_id % 89) AS call, lang FROM documents), n AS (SELECT file, list_sort(list(DISTINCT name)) AS names, list(DISTINCT call) AS calls, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS imports FROM d GROUP BY file) SELECT file, array_to_string(names, ',') AS names, array_to_string(list_sort(list_filter(calls, lambda c: NOT list_contains(names, c))), ',') AS external_calls, coalesce(array_to_string(imports, ','), '') AS imports FROM n")
def module_rollup(spark, sf_dir):
    name = lambda k: F.concat(F.lit("f"), (F.col("doc_id") % k).cast("string"))
    u = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), name(97).alias("name"), F.array(name(89)).alias("calls"), F.array_compact(F.array("lang")).alias("imports"))
    return graph.rolled_up(u).select("file", *[F.array_join(c, ",").alias(c) for c in ("names", "external_calls", "imports")])


# reports

FOUND = "WITH u AS (SELECT doc_id, source AS file, lang, text, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS finding FROM documents WHERE text IS NOT NULL), f AS (SELECT * FROM u WHERE copies > 1)"


def found(spark, sf_dir) -> DataFrame:
    """A row a copy: finding (least id of its text), copies, doc_id, file, lang."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("source").alias("file"), "lang", X.structural_hash("text").alias("h"))
    g = d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("finding")).where("copies > 1")
    return d.join(g, "h").drop("h")


@query(f"{FOUND} SELECT finding, to_json({{'finding': finding, 'copies': count(*), 'severity': CASE WHEN count(*) >= 3 THEN 'extract' ELSE 'review' END, 'units': list(doc_id ORDER BY doc_id)}})::VARCHAR AS json FROM f GROUP BY finding")
def finding_json(spark, sf_dir):
    g = found(spark, sf_dir).groupBy("finding").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("doc_id")).alias("units"))
    return g.select("finding", F.to_json(F.struct("finding", "copies", pairs.severity(F.col("copies")).alias("severity"), "units")).alias("json"))


@query(f"{FOUND}, g AS (SELECT finding, count(*) AS copies, max(doc_id) AS last FROM f GROUP BY finding) SELECT CASE WHEN copies >= 3 THEN 'extract' ELSE 'review' END AS severity, finding, copies, row_number() OVER (PARTITION BY copies >= 3 ORDER BY copies DESC, last DESC, finding)::INT AS number FROM g")
def section_numbers(spark, sf_dir):
    g = found(spark, sf_dir).groupBy("finding").agg(F.count("*").alias("copies"), F.max("doc_id").alias("last")).withColumn("severity", pairs.severity(F.col("copies")))
    # a window a section of a report; its rows are findings, not units
    return g.select("severity", "finding", "copies", F.row_number().over(W.partitionBy("severity").orderBy(F.desc("copies"), F.desc("last"), "finding")).alias("number"))


@query(f"{FOUND} SELECT file, count(*) AS n FROM f WHERE copies >= 3 GROUP BY file ORDER BY n DESC, file LIMIT 1")
def worst_file(spark, sf_dir):
    return found(spark, sf_dir).where("copies >= 3").groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(1)


@query(f"{FOUND}, g AS (SELECT DISTINCT finding, copies, CASE WHEN copies >= 3 THEN 2 ELSE 1 END AS rank FROM f) SELECT finding, copies FROM g ORDER BY rank DESC, copies DESC, finding LIMIT 15")
def first_duplicates(spark, sf_dir):
    g = found(spark, sf_dir).select("finding", "copies").distinct()
    return g.orderBy(F.desc(F.when(F.col("copies") >= 3, 2).otherwise(1)), F.desc("copies"), "finding").limit(15)


GATE = [("extract", "review", "yes"), ("review", "extract", "no"), ("review", "review", "yes"), ("extract", "nonsense", "yes"), ("review", "nonsense", "no"), ("info", "review", "no")]


@query(expected("severity, bar, fails", GATE))
def severity_gate(spark, sf_dir):
    d = spark.createDataFrame([r[:2] for r in GATE], "severity string, bar string")
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in findings.SEVERITIES.items() for x in kv]), F.col(c)), F.lit(None))
    return d.select("severity", "bar", F.when(F.coalesce(rank("severity"), F.lit(0)) >= F.coalesce(rank("bar"), F.lit(findings.SEVERITIES["extract"])), "yes").otherwise("no").alias("fails"))


@query(f"{FOUND} SELECT coalesce(bool_or(copies >= 3), false) AS fail FROM f")
def gate_over_findings(spark, sf_dir):
    s = found(spark, sf_dir).select(pairs.severity(F.col("copies")).alias("severity"))
    return findings.should_fail(s, F.lit("extract"))


@query("SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def language_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"))


@query("SELECT CASE WHEN grouping(role) = 1 THEN 'total' ELSE 'verdict' END AS kind, role, count(*) AS n FROM conversations GROUP BY GROUPING SETS ((role), ())")
def verdict_stats(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").rollup("role").agg(F.count("*").alias("n"), F.grouping("role").alias("g"))
    return d.select(F.when(F.col("g") == 1, "total").otherwise("verdict").alias("kind"), "role", "n")


# labelled pairs, quotas, keyed tables

BEST = "best AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_discount) AS score FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL), lab AS (SELECT l_orderkey AS a, l_partkey AS b, bool_or(l_linenumber <= 2) AS is_clone FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)"


@query(f"WITH {BEST} SELECT CASE WHEN lab.a IS NULL THEN 'unexpected' WHEN is_clone AND score IS NOT NULL THEN 'tp' WHEN is_clone THEN 'fn' WHEN score IS NOT NULL THEN 'fp' ELSE 'tn' END AS outcome, count(*) AS n, round(avg(score), 6) AS mean_score FROM lab FULL JOIN best ON lab.a = best.a AND lab.b = best.b GROUP BY 1")
def labelled_outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_discount", "l_linenumber")
    best = li.where("l_discount >= 0.05").groupBy("a", "b").agg(F.max("l_discount").alias("score"))
    labelled = li.where("l_linenumber <= 4").groupBy("a", "b").agg(F.bool_or(F.col("l_linenumber") <= 2).alias("is_clone"))
    outcome = F.when(F.col("is_clone").isNull(), "unexpected").when(F.col("is_clone") & F.col("score").isNotNull(), "tp").when(F.col("is_clone"), "fn").when(F.col("score").isNotNull(), "fp").otherwise("tn")
    return labelled.join(best, ["a", "b"], "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 5")
def type_quota(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return d.withColumn("r", F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))).where("r <= 5").drop("r")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, 'pos' AS side FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1, 2 LIMIT 80) UNION ALL SELECT * FROM (SELECT l_orderkey, l_linenumber, 'neg' FROM lineitem WHERE l_returnflag <> 'R' ORDER BY 1, 2 LIMIT 20)")
def budget_split(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    side = lambda p, name, n: d.where(p).orderBy("l_orderkey", "l_linenumber").limit(n).select("l_orderkey", "l_linenumber", F.lit(name).alias("side"))
    return side("l_returnflag = 'R'", "pos", 80).unionByName(side("l_returnflag <> 'R'", "neg", 20))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def unresolved(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    resolved = o.where("o_orderstatus = 'F'").select("o_custkey").union(o.where("o_totalprice > 100000").select("o_custkey")).select(F.col("o_custkey").alias("c_custkey"))
    return tables.removed(table(spark, sf_dir, "customer").select("c_custkey"), resolved, ["c_custkey"])


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT min(label) FROM embeddings) UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label IN (SELECT min(label) FROM embeddings)")
def replaced_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    gone = d.join(d.agg(F.min("label").alias("label")), "label").select("vec_id", "label")
    return tables.removed(d, gone, ["vec_id"]).unionByName(gone.withColumn("vec_id", F.col("vec_id") + 1000000))


@query("SELECT doc_id, source FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z]+'), 'the') ORDER BY doc_id LIMIT 25")
def callers_of(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), "the"))
    return d.select("doc_id", "source").orderBy("doc_id").limit(25)


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL AND event_type <> 'view' ORDER BY ts, event_id LIMIT 500")
def oldest_pending(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value IS NOT NULL AND event_type <> 'view'").orderBy("ts", "event_id").limit(500).select("event_id", "event_type")

import random

from pyspark.sql import functions as F

from twinspark.functions import text as X
from twinspark.operators import findings, pairs
from twinspark.operators.components import components
from twinspark.sources import files
from twinspark.streaming import debounce


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_components_of_random_graphs_and_a_chain(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(edges)


def test_health_and_metrics(spark):
    h = {r.total: (r.score, r.grade) for r in findings.health(spark.createDataFrame([(50, 0, 1), (51, 0, 20), (10, 30, 0)], "total long, extract long, review long")).collect()}
    assert h[50] == (98, "A") and h[51][1] == "C" and h[10] == (0, "F")
    m = findings.metrics(spark.createDataFrame([(0, 0, 5, 0)], "tp long, fp long, tn long, fn long")).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def unit(**k):
    return {"filepath": "a/x.py", "name": "f", "lineno": 1, "end_lineno": 40, "language": "python", "source": "x", "class_type": None, "class_name": None, "is_nested": False, "visibility": "public", "is_trivial": False} | k


TYPE = "struct<filepath: string, name: string, lineno: int, end_lineno: int, language: string, source: string, class_type: string, class_name: string, is_nested: boolean, visibility: string, is_trivial: boolean>"


def test_pair_rules(spark):
    cases = [
        (unit(), unit(name="f"), None), (unit(), unit(is_nested=True), "scope"), (unit(name="__init__"), unit(), "constructor"),
        (unit(name="__init__", class_name="A"), unit(name="__init__", class_name="A"), None), (unit(filepath="app/route.ts", name="GET"), unit(filepath="b/route.ts", name="POST"), "required_export"),
        (unit(filepath="services/a/m.py", name="health"), unit(filepath="services/b/m.py", name="healthcheck"), "per_service"),
        (unit(class_name="A"), unit(class_name="B"), "observer"), (unit(name="get_user", end_lineno=9), unit(name="get_order", filepath="b.py"), "same_verb"),
        (unit(name="create_user", end_lineno=9), unit(name="delete_user", filepath="b.py", end_lineno=9), "crud_pair"), (unit(is_trivial=True), unit(is_trivial=True, filepath="b.py"), "trivial"),
    ]
    d = spark.createDataFrame([(k, a, b, "exact_structure") for k, (a, b, _) in enumerate(cases)], f"k int, source {TYPE}, existing {TYPE}, match_type string")
    got = {r.k: r.why for r in d.select("k", pairs.drop_reason().alias("why")).collect()}
    assert got == {k: why for k, (_, _, why) in enumerate(cases)}


def test_scope_penalty(spark):
    cases = [("private", "b/y.py", 0.6), ("internal", "a/y.py", 0.9), ("internal", "b/y.py", 0.7), ("protected", "a/y.py", 0.75), ("public", "a/y.py", 1.0)]
    d = spark.createDataFrame([(k, unit(), unit(visibility=v, filepath=p)) for k, (v, p, _) in enumerate(cases)], f"k int, source {TYPE}, existing {TYPE}")
    assert {r.k: r.p for r in d.select("k", pairs.scope_penalty().alias("p")).collect()} == {k: c[2] for k, c in enumerate(cases)}


def test_overlap_chain_merges(spark):
    f = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["x", "y"])], "finding int, members array<string>").withColumn("kind", F.lit("group")).withColumn("score", F.col("finding") * -1.0)
    got = {r.finding: r.members for r in findings.merged_overlaps(f).collect()}
    assert got == {1: ["a", "b", "c", "d"], 3: ["x", "y"]}


def test_elevation(spark):
    d = spark.createDataFrame([(1, "f", "review"), (2, "f", "review"), (3, "g", "review")], "finding int, file string, severity string")
    assert {r.finding: r.severity for r in findings.elevated(d).collect()} == {1: "extract", 2: "extract", 3: "review"}


def test_names_and_paths(spark):
    r = spark.range(1).select(X.name_tokens(F.lit("getHTTPUserName_v2")).alias("t"), X.service(F.lit("./services/pay/x/a.py")).alias("s"), X.language_of(F.lit("a/b.h")).alias("l"), X.finding_id(F.lit("b"), F.lit("a")).alias("i")).first()
    assert (r.t, r.s, r.l, r.i) == (["get", "http", "user", "name", "v2"], "services/pay", "c", "a||b")


def test_discovery(spark):
    paths = ["src/a.py", "src/.git/b.py", "node_modules/c.js", "tests/test_a.py", "src/x.min.js", "readme.md"]
    got = files.discovered(spark.createDataFrame([(p,) for p in paths], "path string")).select("path").collect()
    assert [r.path for r in got] == ["src/a.py"]
    below = spark.createDataFrame([("/home/u/.work/build/src/a.py",), ("/home/u/.work/build/specs/b.py",), ("/home/u/.work/build/conftest.py",), ("/home/u/.work/build/vendor/c.go",), ("/home/u/.work/build/d.go",)], "path string")
    assert [r.path[-8:] for r in files.discovered(below, root="/home/u/.work/build").collect()] == ["src/a.py", "ild/d.go"]
    assert [r.path[-8:] for r in files.discovered(below, root="/home/u/.work/build/", languages=["go"], ignore=["d.*"]).collect()] == []


def test_source_tree(spark, tmp_path):
    for p in ("build/src/a.py", "build/tests/b.py", "build/.x/c.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("def f(): pass")
    got = files.source_tree(spark, str(tmp_path / "build")).collect()
    assert [(r.filepath, r.language, r.size_bytes) for r in got] == [("src/a.py", "python", 13)]


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = debounce.tumbling(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(str(tmp_path / "in"))
    q = debounce.tumbling(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("tumbled").collect()) == sorted(batch.collect())


def vectors_of(spark, n=300):
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)], k % 7 if k % 11 else None) for k in range(n)]
    rows += [(n + k, [*rows[k][1]], 3) for k in range(40)] + [(None, rows[0][1], 1), (n + 50, None, 1), (n + 51, [1.0, None], 1), (n + 52, [], 1), (n + 53, [float("nan")] * 8, 1), (5, rows[9][1], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_pairs(rows, bar):
    import numpy as np

    out = []
    for a, x, la in rows:
        for b, y, lb in rows:
            if a is not None and b is not None and a < b and x is not None and y is not None and len(x) == len(y) and None not in x + y:
                t = bar(la, lb)
                s = 0.0
                for u, v in zip(x, y, strict=True):
                    s += float(np.float32(u)) * float(np.float32(v))
                if t is not None and not s < t:
                    out.append((a, b, f"{s:.12g}"))
    return sorted(out)


def test_close_pairs_against_all_pairs_over_any_grid(spark):
    rows, d = vectors_of(spark)
    for blocks in (None, 1, 3):
        got = sorted((r.a_vec_id, r.b_vec_id, f"{r.cosine:.12g}") for r in pairs.close_pairs(d, 0.6, blocks=blocks).collect())
        assert got == plain_pairs(rows, lambda x, y: 0.6)
    got = sorted((r.a_vec_id, r.b_vec_id, f"{r.cosine:.12g}") for r in pairs.close_pairs(d, F.lit(0.5) + F.lit(0.05) * F.col("label"), blocks=3).collect())
    assert got == plain_pairs(rows, lambda x, y: None if x is y is None else 0.5 + 0.05 * min(z for z in (x, y) if z is not None))


def test_links_of_cells_keep_components_and_counts(spark):
    rows, d = vectors_of(spark)
    rows, d = rows[:340], d.where("vec_id < 340 AND size(embedding) = 8").dropDuplicates(["vec_id"])
    rows = [(r.vec_id, list(r.embedding), r.label) for r in d.collect()]
    want = plain_pairs(rows, lambda x, y: 0.9)
    links = pairs.close_links(d, 0.9, blocks=3)
    assert links.count() <= 3 * len(rows)
    top = roots([(a, b) for a, b, _ in want])
    assert {r.node: r.component for r in components(links).collect()} == top
    g = {r.component: (r.size, r.match_count) for r in findings.groups(links).collect()}
    assert g == {c: (sum(t == c for t in top.values()), sum(top[a] == c for a, _, _ in want)) for c in set(top.values())}


def test_blocks_grow_with_the_input():
    assert [pairs.block_count(n) for n in (0, 500, 2000, 51_282, 390_000, 10**7)] == [1, 1, 2, 8, 12, 306]

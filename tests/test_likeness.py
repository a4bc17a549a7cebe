import random
from functools import cache

from pyspark.sql import functions as F

from twinspark.operators import likeness, tables
from twinspark.streaming import debounce


def grown(rnd, size):
    """A random tree as (label, children)."""
    kids = []
    size -= 1
    while size > 0:
        n = rnd.randint(1, size)
        kids.append(grown(rnd, n))
        size -= n
    return rnd.choice("abc"), tuple(kids)


def told(t):
    return f"({t[0]}{''.join(' ' + told(c) for c in t[1])})"


@cache
def apart(f, g):
    """Edit distance of two forests, by the definition."""
    if not f or not g:
        return sum(1 + apart(t[1], ()) for t in f) + sum(1 + apart((), t[1]) for t in g)
    (x, xs), (y, ys) = f[-1], g[-1]
    return min(apart(f[:-1] + xs, g) + 1, apart(f, g[:-1] + ys) + 1, apart(f[:-1], g[:-1]) + apart(xs, ys) + (x != y))


def test_tree_distance_is_the_least_number_of_edits():
    rnd = random.Random(5)
    for _ in range(150):
        a, b = grown(rnd, rnd.randint(1, 9)), grown(rnd, rnd.randint(1, 9))
        assert likeness.tree_distance(likeness.parsed(told(a)), likeness.parsed(told(b))) == apart((a,), (b,))


def test_odd_trees():
    assert likeness.parsed("") == (["empty"], [0]) and likeness.parsed(")") == ([""], [0])
    assert likeness.parsed("(a(b c) d") == (["c", "b", "d", "a"], [0, 0, 2, 0])
    assert likeness.parsed("(a) (b)") == (["a"], [0])


def held_back(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


def test_leading_edges(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, 10_000_000 + rnd.randint(0, 40) * 100_000) for k in (1, 2, None) for _ in range(60)] + [(1, None)]
    d = spark.createDataFrame(rows, "k int, us long").select("k", F.timestamp_micros("us").alias("ts"))
    want = sorted((str(k), t) for k in (1, 2, None) for t in held_back([t for j, t in rows if j == k and t is not None], 500_000))
    got = lambda df: sorted((str(r.k), r.us) for r in df.select("k", F.unix_micros("ts").alias("us")).collect())
    assert got(debounce.leading(d, "k")) == want
    d.where("k IS NOT NULL").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = debounce.leading(stream, "k").writeStream.outputMode("append").format("memory").queryName("led").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("led")) == [x for x in want if x[0] != "None"]


def test_numbers_and_marks(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.lit("old").alias("s"))
    assert all(r.v == r.ord for r in tables.numbered(d, ["v"]).collect())
    assert tables.numbered(d.limit(0), ["v"]).count() == 0
    got = tables.marked(d, spark.createDataFrame([(5,), (5,), (2000,)], "v long"), ["v"], "s", F.lit("new"))
    assert [r.v for r in got.where("s = 'new'").collect()] == [5] and got.count() == 1000


def test_ratios_of_nothing(spark):
    d = spark.sql("SELECT array('a') AS a, CAST(NULL AS array<string>) AS b, 0 AS z, array(array(1d, 2d)) AS h, array(0) AS m")
    r = d.select(likeness.shared_ratio(F.col("a"), F.col("b")).alias("s"), likeness.shared_ratio(F.col("b"), F.col("b")).alias("n"), likeness.size_ratio(F.col("z"), F.col("z")).alias("q"), likeness.mean_pooled(F.col("h"), F.col("m")).alias("p")).first()
    assert (r.s, r.n, r.q, r.p) == (0.0, 0.0, 1.0, [0.0, 0.0])

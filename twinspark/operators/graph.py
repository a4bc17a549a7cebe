"""Module graph: rollup, domains, edges, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of each domain, in order of precedence.
DOMAINS = {
    "auth": "auth login logout password token session jwt oauth credential permission role user signup register verify hash".split(),
    "database": "db database model schema migration query repository repo orm sql table record entity persist store crud".split(),
    "api": "api route router endpoint handler controller request response middleware http rest graphql webhook view".split(),
    "util": "util utils helper helpers common shared lib tool tools misc support".split(),
    "test": "test tests spec specs fixture mock assert conftest factory".split(),
    "config": "config configuration settings env environment setup init bootstrap".split(),
    "data": "data transform pipeline etl process parse parser serializer deserializer convert format validate validation schema".split(),
    "ui": "component widget view template render display page screen layout style theme".split(),
    "network": "client server socket connection transport protocol proxy fetch download upload".split(),
    "file": "file path directory folder io read write stream buffer fs".split(),
}


def domain_of(words: DataFrame, module: str = "module", word: str = "word", domains=DOMAINS) -> DataFrame:
    """words(module, word): the domain with most distinct words hit, the first in order on ties, general without any."""
    spark = words.sparkSession
    table = spark.createDataFrame([(i, d, w) for i, (d, ws) in enumerate(domains.items()) for w in ws], "rank int, domain string, hit string")
    hits = words.select(module, word).distinct().join(table, F.col(word) == F.col("hit")).groupBy(module, "rank", "domain").agg(F.count("*").alias("n"))
    best = hits.groupBy(module).agg(F.max_by("domain", F.struct(F.col("n"), -F.col("rank"))).alias("domain"))
    return words.select(module).distinct().join(best, module, "left").select(module, F.coalesce("domain", F.lit("general")).alias("domain"))


def call_edges(calls: DataFrame, defined: DataFrame) -> DataFrame:
    """calls(file, name), defined(file, name, ord) -> distinct edges (src, dst); the last definition of a name wins."""
    last = defined.groupBy("name").agg(F.max_by("file", F.struct("ord", "file")).alias("dst"))
    return calls.join(last, "name").where("file <> dst").select(F.col("file").alias("src"), "dst").distinct()


def within(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """start(node): nodes reached over at most `depth` undirected edges, with the least depth."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    reached = start.select(F.col("node"), F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        step = reached.where(F.col("depth") == k - 1).join(e, "node").select(F.col("to").alias("node"), F.lit(k).alias("depth"))
        reached = reached.union(step).groupBy("node").agg(F.min("depth").alias("depth"))
    return reached


def relevance(nodes: DataFrame, related: DataFrame, domains: DataFrame, own: str) -> DataFrame:
    """Tier 1: related and of the same domain; 2: related; 3: all others."""
    d = nodes.join(related.select("node", F.lit(True).alias("near")), "node", "left").join(domains, "node", "left")
    near = F.coalesce("near", F.lit(False))
    return d.select("node", F.when(near & (F.col("domain") == own), 1).when(near, 2).otherwise(3).alias("tier"))


def rolled_up(units: DataFrame, file: str = "file", name: str = "name", calls: str = "calls", imports: str = "imports") -> DataFrame:
    """units(file, name, calls, imports), a row a function -> a row a module: names, calls of other modules' functions, imports."""
    own = units.groupBy(file).agg(F.array_sort(F.collect_set(name)).alias("names"))
    every = lambda c: units.select(file, F.explode(c).alias("x")).groupBy(file).agg(F.array_sort(F.collect_set("x")).alias(c))
    none = F.array().cast("array<string>")
    d = own.join(every(calls), file, "left").join(every(imports), file, "left")
    return d.select(file, "names", F.array_except(F.coalesce(calls, none), "names").alias("external_calls"), F.coalesce(imports, none).alias("imports"))

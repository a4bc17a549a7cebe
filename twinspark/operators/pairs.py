"""Candidate pairs: equal structure, close vectors; and what is made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

#: Least cosine by language, and for others.
THRESHOLDS = {"python": 0.94, "java": 0.81, "javascript": 0.85, "typescript": 0.83, "go": 0.81, "rust": 0.83, "c": 0.83, "cpp": 0.83, "ruby": 0.85}
FALLBACK = 0.85
ABSTRACT, CONCRETE = ("interface", "protocol", "abstract", "trait"), ("class", "impl")
CONSTRUCTORS = ("__init__", "constructor", "__new__", "new", "init", "initialize")
HEALTH_NAMES = ("health", "healthcheck", "health_check", "readiness", "liveness")
LIFE_NAMES = ("lifespan", "startup", "shutdown")
CRUD = ("get", "set", "create", "update", "delete", "remove", "list", "fetch", "insert", "upsert", "patch", "find", "search", "reset", "activate", "deactivate", "enable", "disable", "start", "stop")
HTTP_NAMES = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
ROUTES = ("route.ts", "route.js", "route.tsx")
PAGES = {"page.tsx": ("default", "generateMetadata", "generateStaticParams"), "page.jsx": ("default", "generateMetadata", "generateStaticParams"), "page.ts": ("default", "generateMetadata", "generateStaticParams"), "layout.tsx": ("default", "generateMetadata"), "layout.jsx": ("default", "generateMetadata"), "loading.tsx": ("default",), "error.tsx": ("default",), "not-found.tsx": ("default",)}
PAGE_FILE = r"/(?:(?:page|layout|loading)\.(?:tsx|jsx|ts|js)|(?:error|not-found)\.(?:tsx|jsx))$"


def equal_groups(units: DataFrame, key: str, order: str) -> DataFrame:
    """Groups of two or more units with one key: count and first unit. Scales with the input."""
    return units.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("copies"), F.min(order).alias("first")).where("copies > 1")


def equal_links(units: DataFrame, key: str, order: str) -> DataFrame:
    """Each unit but the first of its group, linked with the first: the groups' links without all pairs."""
    groups = equal_groups(units, key, order)
    return units.join(groups, key).where(F.col(order) != F.col("first"))


def equal_pairs(units: DataFrame, key: str, order: str, keep: list[str] = ()) -> DataFrame:
    """All ordered pairs inside groups of one key, the reference semantics; quadratic in a group by its nature."""
    cols = [order, *keep]
    a = units.where(F.col(key) != "").select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = units.where(F.col(key) != "").select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, key).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors a block, about, from BLOCK * CELLS of them on; before, blocks on a side of the grid and least vectors a block.
BLOCK, CELLS, LEAST_BLOCK = 32_768, 8, 1024
#: Rows of a block that meet the other block at once; bytes of their products.
TILE = 1 << 25


def block_count(n: int) -> int:
    return max(1, min(CELLS, -(-n // LEAST_BLOCK)), -(-n // BLOCK))


def close_in(a: np.ndarray, b: np.ndarray, bar_a: np.ndarray, bar_b: np.ndarray):
    """(i, j, cosine) in pieces, of rows a[i] and b[j] (float64) whose product reaches the lesser of their bars.

    Products in float32 select candidates, with a margin above their rounding; each candidate's
    product is then summed in float64, coordinate by coordinate, as `dot` does. NaN counts as reaching any bar.
    """
    with np.errstate(all="ignore"):
        fa, fb = a.astype(np.float32), b.astype(np.float32)
        size = lambda x: np.sqrt((x * x).sum(axis=1))
        sa, sb = size(a), size(b)
        most, ta, tb = sb.max(initial=0.0), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        least, barless = bar_b.min(initial=np.inf), np.isinf(bar_a).any() and np.isinf(bar_b).any()
        width = max(1, TILE // 4 // max(1, len(b)))
        for at in range(0, len(a), width):
            part = slice(at, at + width)
            margin = (a.shape[1] + 8) * 2.0**-22 * sa[part] * most + 1e-30
            floor = np.minimum(bar_a[part], least) - margin
            i, j = np.nonzero(~((fa[part] @ fb.T) < floor.astype(np.float32)[:, None]))
            if barless:
                has = np.minimum(bar_a[part][i], bar_b[j]) < np.inf
                i, j = i[has], j[has]
            for k in range(0, len(i), 1 << 18):
                x, y = i[k : k + (1 << 18)] + at, j[k : k + (1 << 18)]
                total = np.zeros(len(x))
                for c in range(a.shape[1]):
                    total += ta[c][x] * tb[c][y]
                hit = ~(total < np.minimum(bar_a[x], bar_b[y]))
                yield x[hit], y[hit], total[hit]


def _cell(reduce):
    """Works on the rows of one cell: (side, key, bar, vector)."""

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        vectors = t.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        side, key, bar = (t.column(c).to_numpy() for c in ("side", "key", "bar"))
        n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(n)])
        for d in np.unique(n):
            rows = np.flatnonzero(n == d)
            m = values[starts[rows][:, None] + np.arange(d)]
            l, r = (np.flatnonzero(side[rows] == s) for s in (0, 1))
            lone = not side.any()  # a cell of a block with itself
            r = l if lone else r
            yield from reduce(key[rows[l]], key[rows[r]], lone, close_in(m[l], m[r], bar[rows[l]], bar[rows[r]]))

    return run


def _listed(left, right, lone, found):
    for i, j, cosine in found:
        x, y = left[i], right[j]
        keep = x < y if lone else x != y
        x, y = x[keep], y[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(cosine[keep])], names=["a", "b", "cosine"])


def _forest(left, right, lone, found):
    """A row for each key with a pair: the least key that the cell's pairs connect it with, pairs it is the lesser key of, their greatest cosine."""
    keys, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = at[: len(left)], at[len(left) :]
    label, links, best = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.full(len(keys), -np.inf)
    seen = np.zeros(len(keys), bool)
    for i, j, cosine in found:
        x, y = left[i], right[j]
        keep = x < y if lone else x != y
        x, y, cosine = np.minimum(x, y)[keep], np.maximum(x, y)[keep], cosine[keep]
        seen[x] = seen[y] = True
        links += np.bincount(x, minlength=len(keys))
        np.maximum.at(best, x, cosine)
        while (p := label[x] != label[y]).any():
            x, y = x[p], y[p]
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    rows = np.flatnonzero(seen)
    score = pa.array(best[rows], mask=best[rows] == -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(keys[label[rows]]), pa.array(links[rows]), score], names=["a", "b", "links", "score"])


def _over_grid(vectors: DataFrame, bar: Column | float, reduce, schema: str, key: str, vector: str, blocks: int | None) -> DataFrame:
    bar = bar if isinstance(bar, Column) else F.lit(float(bar))
    v = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    v = v.select(F.col(key).cast("long").alias("key"), F.coalesce(bar.cast("double"), F.lit(float("inf"))).alias("bar"), F.col(vector).cast("array<double>" if dict(vectors.dtypes)[vector] != "array<float>" else "array<float>").alias("vector"))
    blocks = blocks or block_count(v.count())
    v = v.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    # the cell of blocks i <= j has the number j * (j + 1) / 2 + i; a block is the left side of its row, the right of its column
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = v.select("key", "bar", "vector", "block", other).select("key", "bar", "vector", (F.col("block") > F.col("other")).cast("int").alias("side"), (F.expr("greatest(block, other) * (greatest(block, other) + 1) div 2").cast("int") + low).cast("int").alias("cell"))
    return cells.repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).select("side", "key", "bar", "vector").mapInArrow(_cell(reduce), schema)


def close_pairs(vectors: DataFrame, threshold: Column | float, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """Pairs (a_key, b_key, cosine) of unit vectors whose cosine reaches the threshold, exact, by a grid of blocks.

    A threshold that is a column holds for one vector; the lesser of two counts (null: the other's). Every vector is
    sent to the cells of its block's row and column; a task multiplies the blocks of one cell. Blocks hold some 30,000
    vectors, so tasks grow with the square of the input and none of them with the input. Keys are whole numbers.
    """
    p = _over_grid(vectors, threshold, _listed, "a long, b long, cosine double", key, vector, blocks)
    return p.withColumnsRenamed({"a": f"a_{key}", "b": f"b_{key}"})


def close_links(vectors: DataFrame, threshold: Column | float, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(a, b, links, score): what connects the pairs of close_pairs, a row at most for each vector and cell instead of one a pair.

    b is the least vector that a is connected with inside a cell (a itself, if it is that); links counts the cell's
    pairs of which a is the lesser key, and score is their greatest cosine. No link between components is lost.
    """
    return _over_grid(vectors, threshold, _forest, "a long, b long, links long, score double", key, vector, blocks)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float, key: str = "vec_id", vector: str = "embedding", blocks: int = 8) -> DataFrame:
    """The k vectors of greatest cosine for each query, other than itself; ties by key."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    v = vectors.select(F.col(key).alias("hit_id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    p = q.join(v, "block").where("query_id <> hit_id").withColumn("cosine", dot(F.col("q"), F.col("v"))).where(F.col("cosine") >= least)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("cosine", 6).desc(), "hit_id"))
    return p.select("query_id", "hit_id", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def language_threshold(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])
    return F.least(F.coalesce(table[a], F.lit(FALLBACK)), F.coalesce(table[b], F.lit(FALLBACK)))


def scope_penalty(source: str = "source", existing: str = "existing") -> Column:
    """Factor on a match's score by what the existing unit lets others use."""
    s, e = (lambda c: F.col(f"{source}.{c}")), (lambda c: F.col(f"{existing}.{c}"))
    kinds = (s("class_type").isin(*ABSTRACT) & e("class_type").isin(*CONCRETE)) | (e("class_type").isin(*ABSTRACT) & s("class_type").isin(*CONCRETE))
    near = X.parent(s("filepath")) == X.parent(e("filepath"))
    return (
        F.when(kinds & (s("name") == e("name")), 0.0).when(e("is_nested"), 0.0).when(e("visibility") == "private", 0.6)
        .when((e("visibility") == "internal") & near, 0.9).when(e("visibility") == "internal", 0.7)
        .when(e("visibility") == "protected", 0.75).otherwise(1.0)
    )


def drop_reason(source: str = "source", existing: str = "existing", batch: bool = True) -> Column:
    """The first rule by which a pair is meant, not copied; null if none."""
    s, e = (lambda c: F.col(f"{source}.{c}")), (lambda c: F.col(f"{existing}.{c}"))
    lines = lambda f: f("end_lineno") - f("lineno") + 1
    base = lambda f: F.substring_index(F.regexp_replace(f("filepath"), r"\\", "/"), "/", -1)
    tokens = lambda f: X.name_tokens(f("name"))

    def required(f):
        hit = base(f).isin(*ROUTES) & f("name").isin(*HTTP_NAMES)
        for file, names in PAGES.items():
            hit = hit | ((base(f) == file) & f("name").isin(*names))
        return hit

    def page(f):
        return F.concat(F.lit("/"), f("filepath")).rlike(PAGE_FILE) & ((lines(f) <= 6) | ((f("visibility") == "public") & f("name").isin("default", "Default")))

    same_file, same_name, same_class = s("filepath") == e("filepath"), s("name") == e("name"), s("class_name") == e("class_name")
    a_new, b_new = s("name").isin(*CONSTRUCTORS), e("name").isin(*CONSTRUCTORS)
    apart = X.service(s("filepath")) != X.service(e("filepath"))
    short, long_ = (lines(s) <= 15) & (lines(e) <= 15), (lines(s) > 25) & (lines(e) > 25)
    abstract = s("class_type").isin(*ABSTRACT) | e("class_type").isin(*ABSTRACT)
    ta, tb = tokens(s), tokens(e)
    na, nb = F.slice(ta, F.lit(2), F.greatest(F.size(ta), F.lit(1))), F.slice(tb, F.lit(2), F.greatest(F.size(tb), F.lit(1)))
    least = F.least(F.size(na), F.size(nb))
    verbs = F.get(ta, 0).isin(*CRUD) & F.get(tb, 0).isin(*CRUD) & (F.get(ta, 0) != F.get(tb, 0))
    markup = lambda f: (f("source").contains("className") | f("source").contains("cn(")) & f("source").contains("<")
    web = s("language").isin("javascript", "typescript") & e("language").isin("javascript", "typescript")
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = (
        F.when(yes(scope_penalty(source, existing) == 0.0), "scope").when(yes(required(s) & required(e)), "required_export").when(yes(page(s) & page(e)), "page_export")
        .when(yes(s("is_trivial") & e("is_trivial")), "trivial")
        .when(yes(apart & ((F.lower(s("name")).isin(*HEALTH_NAMES) & F.lower(e("name")).isin(*HEALTH_NAMES)) | (same_name & s("name").isin(*LIFE_NAMES) & short))), "per_service")
        .when(yes((a_new != b_new) | (a_new & b_new & ~yes(same_class))), "constructor")
        .when(yes(same_name & (s("class_name") != e("class_name")) & (yes(abstract) | same_file)), "observer")
        .when(yes(same_class & same_file & ~same_name & (F.get(ta, 0) == "on") & (F.get(tb, 0) == "on")), "observer")
    )
    if batch:
        out = (
            out.when(yes(same_file & (F.col("match_type") == "exact_structure") & ~same_name & short), "same_file_short")
            .when(yes(~same_name & (F.size(ta) > 1) & (F.size(tb) > 1) & (F.get(ta, 0) == F.get(tb, 0)) & (ta != tb) & ~long_), "same_verb")
            .when(yes(verbs & (least > 0) & (F.slice(na, F.lit(1), F.greatest(least, F.lit(1))) == F.slice(nb, F.lit(1), F.greatest(least, F.lit(1)))) & ~long_), "crud_pair")
            .when(yes(web & ~same_name & markup(s) & markup(e) & (same_file | short)), "markup_wrapper")
        )
    return out


def clone_type(match_type: Column, structure: Column, cut: float = 0.80) -> Column:
    return F.when(match_type == "exact_structure", "type1_type2").when(structure >= cut, "type3").otherwise("type4")


def severity(copies: Column) -> Column:
    """Three copies or more are to be extracted, two reviewed."""
    return F.when(copies >= 3, "extract").otherwise("review")


def overlap_pairs(units: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs of units by multiset Jaccard of tokens, sum of least counts over sum of greatest."""
    counts = units.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))
    sizes = units.select(F.col(key).alias("k"), F.size(tokens).alias("n"))
    a = counts.select(F.col(key).alias("a"), "token", F.col("c").alias("ca"))
    b = counts.select(F.col(key).alias("b"), "token", F.col("c").alias("cb"))
    common = a.join(b, "token").where("a < b").groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("common"))
    p = common.join(sizes.withColumnsRenamed({"k": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"k": "b", "n": "nb"}), "b")
    j = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return p.select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= least)


#: How comments, headers and ends of blocks begin or look.
COMMENT = r"^(?://|#|/\*|\*)"
HEADER = r"^(?:def |async def |function |async function |func |fn |export |export async |public |private |protected )"
CLOSING = ("}", "};", ")", ");", "end", "})", "});")


def is_trivial(source: Column) -> Column:
    """Whether a function's body is one statement, a bare delegate, or a guard with one call."""
    lines = F.filter(F.transform(F.split(source, r"\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\t", " "))), lambda x: (x != "") & ~x.rlike(COMMENT))
    body = F.filter(lines, lambda x: ~x.rlike(HEADER) & ~x.isin(*CLOSING) & ~F.endswith(x, F.lit("{")))

    def judged(b: Column) -> Column:
        returns = F.filter(b, lambda x: F.startswith(x, F.lit("return ")))
        delegate = (F.size(returns) == 1) & F.coalesce(F.trim(F.substring(F.get(returns, 0), 8, 1 << 20)).rlike(r"^[^(]*\(\)$"), F.lit(False)) & ~F.exists(b, lambda x: ~x.rlike("^(?:return |from |import |\"\"\"|\x27\x27\x27)"))
        guard = F.exists(b, lambda x: (x == "return") | (F.contains(x, F.lit("return")) & F.contains(x, F.lit("if ")))) & (F.size(F.filter(b, lambda x: ~x.rlike("^(?:if |return|else|elif)"))) <= 1)
        return (F.size(b) <= 1) | ((F.size(b) <= 3) & (delegate | guard))

    return F.get(F.transform(F.array(body), judged), 0)

"""Near-duplicates of documents by HyperMinHash.

A document's set holds the hashes of its distinct word shingles. Each of BANDS * ROWS buckets keeps a
compressed register of its least hash: the count of leading zeros and MANTISSA bits after them.
Documents of equal sets are one class; class representatives that agree in a band of registers are
candidates; candidates whose collision-corrected estimate can reach the threshold are verified on full
sets, and components of the verified links are returned.

No bucket's pairs are all emitted. Representatives that share a band with another one are the
members; a group of true copies may hold a third of them, and thousands may share a long passage. So
members meet on items instead of in their bands: items are put in one order for all, those that fewest
members hold first. Sets that reach the threshold share one of the first n - ceil(t * n) + 1 items of
each, and from the first that they share on enough items must follow in both (prefix and position
bounds, both exact). What many documents have in common comes last in that order and joins nobody.

On each such item the most central member (that of most common items) is the pivot, and the others are
compared with it alone: one pair a member and pivot, which makes one component of a group of copies.
Members of other components than an item's largest one get a pivot of their own in the next round.
When a round adds next to nothing, what is left is settled in full: members outside the largest component
of an item against all of that item's members, so that no link between components is left out.

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
a text of fewer words than a shingle has its whole sequence as one; rows of equal sets are one class. Each
row is a node of its own: rows that repeat an id with other texts are linked by their texts alone, in any
order of rows. A component is named by its least id; one without any id has component null. The stage keeps
the first row of each component by id (nulls last), text hash and row hash, and every row without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import dropped, written
from .batches import mixed, parts, small_batches, word_hashes
from .common import WORD, let, read

BANDS, ROWS, MANTISSA = 25, 5, 10
BUCKETS = BANDS * ROWS
EMPTY = -1
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    w, at = word_hashes(data, offsets)
    n = np.diff(at)
    full = np.maximum(n - width + 1, 0)
    h = np.full(max(len(w) - width + 1, 0), 17, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    out, counts = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        if full[i]:
            own = np.sort(h[at[i] : at[i] + full[i]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n[i]:
            own = np.full(1, 29, np.uint64)
            for x in w[at[i] : at[i + 1]]:
                own = mixed(own * np.uint64(0x9E3779B97F4A7C15) + x)
        else:
            continue
        out.append(own)
        counts[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, BUCKETS) int16: leading zeros and mantissa of each bucket's least hash, EMPTY without one."""
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = ((h >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = mixed(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)
    low = np.full((len(at) - 1) * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, docs * BUCKETS + bucket.astype(np.int64), value)
    none = low == np.iinfo(np.uint64).max
    low = np.where(none, np.uint64(1), np.maximum(low, np.uint64(1)))
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bits used, at most one too many
    exponent -= (np.uint64(1) << (exponent - 1).astype(np.uint64)) > low
    shift = exponent - 1 - MANTISSA
    tail = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    code = np.minimum(63 - exponent, 31) << MANTISSA | tail.astype(np.int64)
    return np.where(none, EMPTY, code).astype(np.int16).reshape(-1, BUCKETS)


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1)):
                h, at = shingles(data, offsets, width)
                docs = np.repeat(np.arange(j - i), np.diff(at))
                sums = np.zeros((2, j - i), np.uint64)
                for k, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
                    np.add.at(sums[k], docs, mixed(h ^ np.uint64(salt)))
                regs = registers(h, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, regs.size + 1, BUCKETS, dtype=np.int32)), pa.array(regs.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(at)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), flat], names=["doc_id", "th", "n", "s1", "s2", "regs"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1)):
                h, at = shingles(data, offsets, width)
                items = pa.LargeListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), items], names=["rep", "regs", "items"])

    return run


def band_keys(regs: Column) -> Column:
    """Hashes of each band that has a register."""
    bands = [F.slice(regs, k * ROWS + 1, ROWS) for k in range(BANDS)]
    return F.array_compact(F.array(*[F.when(F.array_max(b) != EMPTY, F.xxhash64(F.lit(k), b)) for k, b in enumerate(bands)]))


def chance(na: Column, nb: Column) -> Column:
    """Probability that registers of different least hashes agree, for sets of na and nb items.

    The least of a bucket's na / BUCKETS hashes has k leading zeros with the probability that it lies between
    2^-k-1 and 2^-k; two of equal count agree in all mantissa bits once in 2^MANTISSA.
    """

    def between(n, k):
        r = F.greatest(n / BUCKETS, F.lit(1.0))
        return F.exp(-r * F.pow(F.lit(0.5), k + 1)) - F.exp(-r * F.pow(F.lit(0.5), k))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0.0), lambda s, k: s + between(na, k) * between(nb, k)) / 2**MANTISSA


def may_reach(a: Column, b: Column, na: Column, nb: Column, threshold: float) -> Column:
    """Whether the Jaccard index estimated from registers may be the threshold.

    The part of equal registers among those that either has, corrected for agreement by chance.
    """
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1)))
    both = F.struct(F.aggregate(pairs, F.lit(0), lambda s, x: s + x).alias("s"), chance(na, nb).alias("c"))

    def enough(v):  # s = 1000 * equal + used
        equal, used = F.floor(v["s"] / 1000), v["s"] % 1000
        estimate = (equal / used - v["c"]) / (1 - v["c"])
        return estimate >= threshold - SLACK * F.sqrt(threshold * (1 - threshold) / used)

    return let(both, enough)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs(a, b): first by estimate, then on full sets."""
    p = written(pairs)
    for e in "ab":
        p = p.join(sets.select(F.col("rep").alias(e), F.col("n").alias(f"n{e}"), F.col("regs").alias(f"r{e}")), e)
    p = p.where(may_reach(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb"), percent / 100)).select("a", "b", "na", "nb")
    for e in "ab":
        p = p.join(sets.select(F.col("rep").alias(e), F.col("items").alias(f"i{e}")), e)
    common = F.size(F.array_intersect("ia", "ib"))
    return written(p.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb") - common).alias("all")).where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("all")).select("a", "b"))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each item that a set can first share with a set linked with it: item, rep, n, at (its place), centre."""
    items = sets.select("rep", F.explode("items").alias("item"))
    held = items.groupBy("item").agg(F.count("*").alias("held")).where("held > 1")
    shared = items.join(held, "item").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).alias("shared"))
    s = shared.join(sets.select("rep", "n"), "rep")
    alone = F.col("n") - F.size("shared")  # items of no other set come first
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - alone
    s = s.select("rep", "n", alone.alias("alone"), (F.aggregate("shared", F.lit(0.0), lambda a, x: a + F.log(x["held"])) / F.col("n")).alias("centre"), F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int")).alias("first"))
    return s.select("rep", "n", "alone", "centre", F.posexplode("first").alias("i", "x")).select(F.col("x.item").alias("item"), "rep", "n", (F.col("alone") + F.col("i")).cast("int").alias("at"), "centre")


def fit(x, y, percent: int) -> Column:
    """Whether sets of x.n and y.n items whose first common item is at x.at and y.at can be linked."""
    sizes = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
    return sizes & (F.least(x("n") - x("at"), y("n") - y("at")) * (100 + percent) >= (x("n") + y("n")) * percent)


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all sets(rep, n, regs, items) that have a link."""
    rows = written(prefixes(sets, percent))
    own = lambda c: F.col(c)
    pivot = F.max_by(F.struct("rep", "n", "at"), F.struct("centre", "rep")).alias("p")
    met = rows.join(rows.groupBy("item").agg(pivot, F.count("*").alias("m")).where("m > 1").drop("m"), "item")
    links = verified(met.where((F.col("rep") != F.col("p.rep")) & fit(own, lambda c: F.col(f"p.{c}"), percent)).select(*ordered(F.col("rep"), F.col("p.rep"))).distinct(), sets, percent)
    n = more = links.count()
    parts_ = components(links)
    while True:
        last = more * 100 <= n  # the latest round added next to nothing
        # rows of items that several components share, with the largest of these
        r = rows.join(parts_.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        sizes = r.groupBy("item", "component").agg(F.count("*").alias("c"))
        main = sizes.groupBy("item").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
        mixed_ = written(r.join(main, "item"))
        beyond = mixed_.where("component <> main")
        if last:
            x, y = beyond.alias("x"), mixed_.alias("y")
            once = (F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
            meet = (F.col("x.item") == F.col("y.item")) & (F.col("x.component") != F.col("y.component")) & once
            pairs = x.join(y, meet & fit(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)).select(*ordered(F.col("x.rep"), F.col("y.rep"))).distinct()
        else:
            pivots = beyond.groupBy("item").agg(F.max_by(F.struct("rep", "n", "at", "component"), F.struct("centre", "rep")).alias("p"))
            other = mixed_.join(pivots, "item").where(F.col("component") != F.col("p.component"))
            pairs = other.where(fit(own, lambda c: F.col(f"p.{c}"), percent)).select(*ordered(F.col("rep"), F.col("p.rep"))).distinct()
        found = verified(pairs, sets, percent)
        more = found.count()
        if more:
            n, links = n + more, links.union(found)
            parts_ = components(links)
        if last:
            return parts_


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """Per row: doc_id, th (hash of its text), n_shingles, component_id, first (whether id and text are the first of the component)."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("th"))
    sigs = written(d.mapInArrow(_signatures(width), "doc_id long, th long, n long, s1 long, s2 long, regs array<short>"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = sigs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(place).alias("place"), F.first("regs").alias("regs"))
    classes = written(classes.select("s1", "s2", "n", "place", "regs", F.monotonically_increasing_id().alias("rep")))
    keys = classes.select("rep", F.explode(band_keys(F.col("regs"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = keys.join(shared, "key", "left_semi").select("rep").distinct()
    # a null id may share its key with a real one here: rows of one text have one set
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("id")
    wanted = classes.join(members, "rep", "left_semi").select(key("place.doc_id"), F.col("place.th").alias("th"), "rep", "regs")
    texts = d.select(key("doc_id"), "th", "text").join(wanted, ["id", "th"])
    # written first: an executor that joins texts has no memory to spare for workers and their batches
    texts = written(texts.groupBy("id", "th", "rep").agg(F.first("text").alias("text"), F.first("regs").alias("regs")))
    sets = written(texts.select("rep", "text", "regs").mapInArrow(_sets(width), "rep long, regs array<short>, items array<long>").select("rep", F.size("items").cast("long").alias("n"), "regs", "items"))
    dropped(texts)
    parts_ = linked(sets, percent)
    dropped(sets)

    labels = classes.select("s1", "s2", "n", "place", "rep").join(parts_.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lows = labels.groupBy("component").agg(F.min("place").alias("low"))
    named = labels.join(lows, "component").select("s1", "s2", "n", "low")
    out = sigs.select("doc_id", "th", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    first = F.col("low.doc_id").eqNullSafe(F.col("doc_id")) & F.col("low").isNotNull() & (F.col("low.th") == F.col("th"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"), F.coalesce(first, F.lit(True)).alias("first"))


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    g = grouped(read(spark, sf_dir))
    return g.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the first: five-word shingles, similarity 0.8 or more."""
    first = grouped(docs, width=5, percent=80).where("n_shingles > 0 AND first").select(F.col("doc_id").alias("id"), "th").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.rlike(WORD).alias("words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = d["id"].eqNullSafe(first["id"]) & (d["th"] == first["th"])
    kept = d.where("words").join(first, same, "left_semi").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return kept.union(d.where("NOT words").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

"""Suffix-array dedup: removal of bytes covered by strings of LENGTH bytes that occur more than once.

1. Anchors. In every window of LENGTH bytes the K-gram of least hash (the rightmost of equal ones) is the
   window's anchor; equal windows have equal anchors at equal offsets. Windows of one anchor are neighbours,
   so an anchor is a row: its K-gram's hash, and the stretch of text that its windows cover.
2. Anchors whose K-gram occurs once in the corpus have no repeats. Of the others, equal stretches are
   collapsed to one with a count; a count over one settles all windows of it.
3. A window lies less than STEP places before one of a few longer grams, LENGTH - STEP + 1 bytes at a fixed
   distance from the anchor. Where such a gram occurs once among the stretches of the K-gram, its windows have
   no repeats; stretches are cut to what is left.
4. K-grams with several distinct stretches are sorted out by suffix arrays: stretches are dealt out by the hash
   of their K-gram, each shard's suffix array is induced (SA-IS: suffixes are classified, leftmost
   smaller substrings sorted recursively, the rest induced linearly), and permuted common prefixes tell the
   windows that start another suffix of the shard too. Each window of the corpus is in one stretch only.
5. A K-gram with more distinct stretches than a shard holds is split by the longest gram there is, the window.

Defined results: a null text is empty; a text shorter than LENGTH bytes loses nothing; rows that repeat an
id are told apart by a hash of their text, and exact repeats of a row lose what they share with each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written
from .batches import mixed, parts, prefix_hash, span_hash
from .common import read

LENGTH, K = 200, 32
#: Bytes that a shard's suffix array is made of, about, and distinct stretches of one K-gram that it takes at most.
SHARD, MOST = 1 << 20, 30_000
#: Windows that share a longer gram.
STEP = 21


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] at each i."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K):
    """Per anchor: document, first and last window start in it, the anchor's distance from the first, hash of the K-gram, hash of the stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    h = span_hash(s, at, at + k)
    low = np.uint64((1 << 31) - 1)
    coded = (h & ~low) | (low - at.astype(np.uint64))
    anchor = (low - (sliding_min(coded, length - k + 1) & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(doc[: len(anchor)] == doc[length - 1 : length - 1 + len(anchor)])
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a, d = anchor[start], doc[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    first_at, last_at, a, d = start[new], start[last], a[new], d[new]
    stretch = span_hash(s, first_at, last_at + length) ^ mixed((a - first_at).astype(np.uint64))
    return d, first_at - offsets[d], last_at - offsets[d], a - first_at, h[a], stretch


def _anchored(batches):
    for batch in batches:
        for i, j, data, offsets in parts(batch.column(1)):
            d, first, last, at, h, stretch = anchors(data, offsets)
            keys = batch.column(0).slice(i, j - i).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([keys, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(at.astype(np.int16)), pa.array(h.view(np.int64)), pa.array(stretch.view(np.int64))], names=["key", "first", "last", "at", "h", "stretch"])


def repeated_starts(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch the places where a string of `length` bytes starts that also starts elsewhere in the shard."""
    from .suffixes import permuted_lcp, suffix_array

    sizes = np.array([len(x) for x in stretches])
    flat = np.frombuffer(b"".join(x + b"\0" for x in stretches), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    flat[ends] = 1  # parts the stretches
    s = np.append(flat, 0)
    sa = suffix_array(s, 258)
    long_ = permuted_lcp(s, sa)[sa] >= length
    again = np.zeros(len(s), bool)
    again[sa[long_ | np.append(long_[1:], False)]] = True
    starts = ends - sizes
    # a string that runs over a stretch's end is none
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    again = again[:-1] & (np.arange(len(flat)) + length <= ends[owner])
    at = np.flatnonzero(again)
    cut = np.searchsorted(at, np.append(starts, len(flat)))
    return [at[cut[k] : cut[k + 1]] - starts[k] for k in range(len(stretches))]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of successive integers."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    return list(zip(starts[new].tolist(), starts[np.append(new[1:] - 1, len(starts) - 1)].tolist(), strict=True))


RUNS = "h long, stretch long, runs array<struct<first: int, last: int>>"
RUN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _sorted_out(batches):
    """Rows (h, stretch, bytes), all of an h in a row: shards of whole groups."""

    def flush(rows):
        found = [runs(x) for x in repeated_starts([r[2] for r in rows], LENGTH)]
        keep = [(r[0], r[1], [{"first": a, "last": b} for a, b in f]) for r, f in zip(rows, found, strict=True) if f]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keep], pa.int64()), pa.array([x[1] for x in keep], pa.int64()), pa.array([x[2] for x in keep], RUN_TYPE)], names=["h", "stretch", "runs"])

    rows, size, last = [], 0, None
    for batch in batches:
        for h, stretch, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD and h != last:
                yield flush(rows)
                rows, size = [], 0
            rows.append((h, stretch, x))
            size, last = size + len(x), h
    if rows:
        yield flush(rows)


def _windows(batches):
    """Rows (h, stretch, bytes) -> a row a window: its hashes."""
    for batch in batches:
        for h, stretch, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = prefix_hash(np.frombuffer(x, np.uint8))
            at = np.arange(len(x) - LENGTH + 1)
            w = span_hash(s, at, at + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h)), pa.array(np.full(len(at), stretch)), pa.array(at.astype(np.int32)), pa.array(w)], names=["h", "stretch", "at", "w"])


def _bytes_of(batches):
    """Rows (text, wanted: array of (h, stretch, first, last, at)) -> (h, stretch, at, bytes)."""
    for batch in batches:
        for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            columns = [pa.array([w[c] for w in wanted], t) for c, t in (("h", pa.int64()), ("stretch", pa.int64()), ("at", pa.int16()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([raw[w["first"] : w["last"] + LENGTH] for w in wanted], pa.binary())], names=["h", "stretch", "at", "x"])


def _longer(batches):
    """Rows (h, stretch, at, bytes) -> a row a longer gram: the windows that hold it, and its hash with its distance from the anchor."""
    for batch in batches:
        for i, j, data, offsets in parts(batch.column(3)):
            s = prefix_hash(data)
            at = batch.column(2).slice(i, j - i).to_numpy().astype(np.int64)
            end = np.diff(offsets) - LENGTH  # the last window
            low, high = (at - end) // STEP, at // STEP
            row = np.repeat(np.arange(j - i), high - low + 1)
            step = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1) - low, high - low + 1)
            start = at[row] - STEP * step
            g = span_hash(s, offsets[row] + start, offsets[row] + start + LENGTH - STEP + 1) ^ mixed(step.astype(np.uint64))
            keys = [batch.column(c).slice(i, j - i).take(pa.array(row)) for c in (0, 1)]
            span = [pa.array(x.astype(np.int32)) for x in (np.maximum(start - STEP + 1, 0), np.minimum(start, end[row]))]
            yield pa.RecordBatch.from_arrays([*keys, *span, pa.array(g.view(np.int64))], names=["h", "stretch", "low", "high", "g"])


def _cut(batches):
    """Rows (doc_id, text, starts: array of (first, last)) -> digest of what is left."""
    for batch in batches:
        out = []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, spans = text.encode(), []
            for a, b in sorted((x["first"], x["last"] + LENGTH) for x in starts or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"first": a, "last": b} for a, b in spans]))
        n, gone, k, sha, spans = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, RUN_TYPE)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges, end excluded)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two hashes of row and text: equal keys are equal rows
    d = d.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "doc_id", "text")
    key = ["k1", "k2"]
    anchored = d.select(F.struct(*key).alias("key"), "text").mapInArrow(_anchored, "key struct<k1: long, k2: long>, first int, last int, at short, h long, stretch long")
    all_ = written(anchored.select("key.*", "first", "last", "at", "h", "stretch"))
    # written, so that the join can split a frequent K-gram
    groups = written(all_.groupBy("h").agg(F.count("*").alias("n"), (F.min("stretch") < F.max("stretch")).alias("several")).where("n > 1").select("h", "several"))
    able = written(all_.join(groups, "h"))
    dropped(all_, groups)
    # one row a distinct stretch, with a place where it stands
    place = F.min(F.struct(*key, "first", "last", "at")).alias("place")
    distinct = able.where("several").groupBy("h", "stretch").agg(F.count("*").alias("m"), place)
    distinct = written(distinct.select("h", "stretch", "m", "place.*"))
    wanted = distinct.groupBy(*key).agg(F.collect_list(F.struct("h", "stretch", "first", "last", "at")).alias("wanted"))
    texts = written(d.dropDuplicates(key).join(wanted, key).select("text", "wanted").mapInArrow(_bytes_of, "h long, stretch long, at short, x binary"))
    longer = written(texts.mapInArrow(_longer, "h long, stretch long, low int, high int, g long"))
    twice = longer.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g")
    left = longer.join(twice, ["h", "g"], "left_semi").groupBy("h", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cut = written(texts.join(left, ["h", "stretch"]).select("h", "stretch", "low", F.substring("x", F.col("low") + 1, F.col("high") - F.col("low") + LENGTH).alias("x")))
    dropped(texts, longer)
    large = cut.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > MOST).select("h")
    few, many = cut.join(large, "h", "left_anti"), cut.join(large, "h", "left_semi")
    shards = few.repartition("h").sortWithinPartitions("h", "stretch").select("h", "stretch", "x").mapInArrow(_sorted_out, RUNS)
    windows = many.select("h", "stretch", "x").mapInArrow(_windows, "h long, stretch long, at int, w long")
    again = windows.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "w")
    counted = windows.join(again, ["h", "w"]).groupBy("h", "stretch").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("runs"))
    found = written(shards.unionByName(counted).join(cut.select("h", "stretch", "low"), ["h", "stretch"]))
    dropped(cut)
    whole = able.join(distinct.where("m > 1").select("h", "stretch"), ["h", "stretch"], "left_semi").unionByName(able.where(~F.col("several"))).select(*key, "first", "last")
    partly = able.where("several").join(found, ["h", "stretch"]).select(*key, (F.col("first") + F.col("low")).alias("first"), F.explode("runs").alias("r")).select(*key, (F.col("first") + F.col("r.first")).alias("first"), (F.col("first") + F.col("r.last")).alias("last"))
    starts = whole.union(partly).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    return d.join(starts, key, "left").select("doc_id", "text", "starts").mapInArrow(_cut, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: int, last: int>>")


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated(read(spark, sf_dir)).drop("spans")

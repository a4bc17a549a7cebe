"""Quality rules by cross-document line frequency.

Every line is normalised (lower case, runs of white space as one space, trimmed) and hashed; distinct
documents are counted per host and hash; lines above the limits are removed, and documents that
are depleted by this are rejected. A document also has to pass base rules on its own words.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null host is
a host of its own; rows that repeat id, host and text are one document for the counts, and each
keeps its own row in the result; lines without a word are never counted or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, read, words

#: A line is boilerplate of its host in more than this many of its documents ...
MAX_DOCS = 30
#: ... a document is depleted if fewer words stay than this, or a smaller part of them.
MIN_WORDS, MIN_PART = 20, 0.5
#: Base rules: fewest words, words in a repeated window, most percent of such words.
BASE_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30


def repeat_words(h: Column, width: int = WINDOW) -> Column:
    """h: array of word hashes -> number of words inside windows of `width` words found twice or more.

    Windows are hashed; an array without a repeated hash (one pass over a hash set) is done. Only
    the others sort (hash, position), keep those equal to a neighbour, and sum the covered words.
    """

    def counted(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, covered))

    def covered(p: Column) -> Column:
        twice = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["g"] == x["g"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # a start adds the words of its window that lie beyond the end of the one before
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + F.lit(width) - F.greatest(F.lit(0), a["end"] - s)).alias("n"), (s + width).alias("end")), lambda a: a["n"])

    def pairs_at(step: int):  # a lambda's parameters are the element and its index: step is bound outside
        return lambda half: F.transform(half, lambda x, i: F.xxhash64(x, F.get(half, i + step)))

    def windows(h: Column) -> Column:
        grams = h
        for k in range(width.bit_length() - 1):  # of 2, 4, 8 words, each from two of half as many
            grams = let(grams, pairs_at(1 << k))
        return F.when(F.size(h) < width, F.lit(0)).otherwise(let(F.slice(grams, F.lit(1), F.greatest(F.size(h) - width + 1, F.lit(0))), counted))

    return let(h, windows).cast("long")


def line_hashes(text: Column) -> Column:
    """array<struct<h long, n int>>: hash of each normalised line that has a word, and its words."""
    plain = F.regexp_replace(F.lower(text), r"\x20{2,}|\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*", " ")
    lines = F.array_remove(F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x)), "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_part: float = MIN_PART) -> DataFrame:
    """Per document: id, the base figures, words on removed lines, base_failed and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    d = d.withColumn("key", F.xxhash64(F.struct("doc_id", "host", "t")))
    real = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    base = d.select(
        "doc_id", "key",
        let(F.transform(words(F.col("t")), lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).cast("long").alias("n"), repeat_words(h).alias("r"))).alias("w"),
        F.length(F.regexp_replace(F.replace(F.col("t"), F.lit(" "), F.lit("")), r"[\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(real, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    # a row for each distinct line of a document, with its words there
    lines = d.select("host", "key", F.explode(line_hashes(F.col("t"))).alias("l")).select("host", "key", "l.h", "l.n").groupBy("host", "h", "key").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    often = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select(F.col("host").alias("o_host"), F.col("h").alias("o_h"))
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h"))).groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("gone"))
    copies = d.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    out = base.join(gone, "key", "left").join(copies, "key", "left")
    n, lost = F.col("w.n"), F.coalesce((F.col("gone") / F.coalesce(F.col("copies"), F.lit(1))).cast("long"), F.lit(0))
    failed = (n < BASE_WORDS) | (F.lit(100) * F.col("w.r") > F.lit(REPEAT_PERCENT) * n)
    left = n - lost
    return out.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), failed.alias("base_failed"), (~failed & (left >= min_words) & (left >= F.lit(min_part) * n)).alias("kept"), lost.alias("n_boilerplate_words"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, host, t, w, [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS real FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tw) GROUP BY doc_id),
ln AS (SELECT doc_id, host, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, host, unnest(real) AS l FROM k)),
oft AS (SELECT host, l FROM ln GROUP BY host, l HAVING count(DISTINCT doc_id) > 30),
gone AS (SELECT ln.doc_id, sum(n) AS gone FROM ln JOIN oft ON ln.host IS NOT DISTINCT FROM oft.host AND ln.l = oft.l GROUP BY ln.doc_id),
b AS (SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(real) - len(list_distinct(real)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_boilerplate_words
  FROM k LEFT JOIN rw ON k.doc_id = rw.doc_id LEFT JOIN gone ON k.doc_id = gone.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_boilerplate_words >= 20 AND n_words - n_boilerplate_words >= 0.5 * n_words AS kept, n_boilerplate_words FROM f
"""

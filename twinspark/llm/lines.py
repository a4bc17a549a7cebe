"""Line dedup by a deletion-neighbourhood join.

Lines of all documents are normalised (lower case, runs of white space as one space, trimmed). Equal
lines are collapsed to their earliest place. Lines within one edit of each other (a character put in,
taken out or changed) share a variant: each line emits itself and all strings that lack one of its
characters, as hashed keys that also name the place of the edit; lines of one key are then
all within one edit, so keeping the least place of each key loses no pair. Every candidate is verified
by edit distance against the earlier line, and a line with an earlier partner is removed.

Variants are emitted only by lines that can have a partner: two lines within one edit of each other have the
same first half or the same last half (lengths by the shorter one), and agree before and after the block
of BLOCK characters that the edit is in; both are hashed and counted first, and only blocks that another
line shares all the rest of emit their variants, so a line of n characters costs n * n / BLOCK steps at most.

Lines travel as two hashes, never as texts, but for those that can have a partner.

Lines shorter than LEAST normalised characters have no part in the one-edit join: an edit of a short line
is another line. Their exact repeats are removed from `exact` characters on; the query and the stage take 1,
that is every line with a word, the functions' default is LEAST.

Defined results: null text stays null; lines shorter than `exact` normalised characters, and lines without
a word, are never removed; the order of lines is that of (id, line number), a null id standing for 2^62 plus a
quarter of its text's hash; rows of equal id and text are one document, whose first place of a line stays in
each of them; rows of one id with other texts keep what they share. Columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import WORD, let, read

LEAST, BLOCK = 20, 64


def row_key(id_col: str, text_col: str) -> list[Column]:
    """id and th of a row: its id, or what stands for a null one, and a hash of its text."""
    th = F.xxhash64(F.col(f"`{text_col}`"))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.shiftrightunsigned(th, 2) + F.lit(1 << 62)).alias("id"), th.alias("th")]


def normal(text: Column) -> Column:
    """The normalised lines of a text."""
    plain = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))


def hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2"))


def placed(docs: DataFrame, id_col: str, text_col: str, exact: int) -> DataFrame:
    """A row a line: id, th (hash of the text), number k, hashes h and h2, whether it is the first of its kind in the row, hashes of its halves (null if short)."""

    def own(lines):
        def rows(all_h):
            same = F.size(F.array_distinct(all_h)) == F.size(all_h)
            return F.transform(lines, lambda x, k: F.when(F.length(x) >= max(exact, 1), F.struct(k.alias("k"), hashed(x).alias("x"), (same | (F.array_position(all_h, F.get(all_h, k)) == k + 1)).alias("first"), F.when(F.length(x) >= LEAST, halves(x)).alias("halves"))))

        return let(F.transform(lines, lambda x: F.xxhash64(x)), rows)

    d = docs.select(*row_key(id_col, text_col), F.explode(F.array_compact(let(normal(F.col(f"`{text_col}`")), own))).alias("l"))
    return d.select("id", "th", "l.k", "l.x.h", "l.x.h2", "l.first", "l.halves")


def halves(line: Column) -> Column:
    """Hashes of the first and last halves that a partner within one edit can share."""

    def keys(n):
        def ends(q):
            return F.array(F.xxhash64(F.lit("first"), q, F.substring(line, F.lit(1), q)), F.xxhash64(F.lit("last"), q, F.substring(line, n - q + 1, q)))

        return F.flatten(F.transform(F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int"))), ends))

    return let(F.length(line), keys)


def blocks(line: Column) -> Column:
    """array<struct<key, own, x>>: what stands before and after each block of BLOCK characters, hashed with its place, and the block.

    A line is cut once as it is, for partners as long or shorter, and once (own) with blocks that lack a
    character, for partners that have one more.
    """

    def cut(n, s, own):
        lack = BLOCK - 1 if own else BLOCK
        return F.struct(F.xxhash64(s, F.substring(line, F.lit(1), s), F.substring(line, s + lack + 1, n)).alias("key"), F.lit(own).alias("own"), F.substring(line, s + 1, F.lit(lack)).alias("x"))

    def starts(n):
        return F.sequence(F.lit(0), n, F.lit(BLOCK))

    return let(F.length(line), lambda n: F.concat(F.transform(starts(n - 1), lambda s: cut(n, s, False)), F.transform(starts(n), lambda s: cut(n, s, True))))


def variants(key: Column, own: Column, x: Column) -> Column:
    """Hashed keys of the block's strings that lack one character, with its place; of an own block, itself at every place."""
    lacking = F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0))), lambda i: F.xxhash64(key, i, F.concat(F.substring(x, F.lit(1), i), F.substring(x, i + 2, F.lit(BLOCK)))))
    itself = F.transform(F.sequence(F.lit(0), F.length(x)), lambda i: F.xxhash64(key, i, x))
    return F.when(own, itself).otherwise(lacking)


def near(docs: DataFrame, kinds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, h2): kinds(h, h2, first) within one edit of a kind with an earlier place."""
    d = docs.select(row_key(id_col, text_col)[0], F.col(f"`{text_col}`").alias("text"))
    d = d.join(kinds.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    d = d.select("id", F.posexplode(normal(F.col("text"))).alias("k", "line")).select(F.col("id").alias("first"), "k", "line", hashed(F.col("line")).alias("x"))
    texts = d.select("first", "k", "line", "x.h", "x.h2").join(kinds, ["first", "h", "h2"]).groupBy("h", "h2", "line").agg(F.min(F.struct("first", "k")).alias("place"))
    texts = written(texts)
    cut = texts.select("h", "h2", "place", F.explode(blocks(F.col("line"))).alias("b")).select("h", "h2", "place", "b.key", "b.own", "b.x")
    shared = cut.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key")
    keyed = cut.join(shared, "key", "left_semi").select("h", "h2", "place", F.explode(variants(F.col("key"), F.col("own"), F.col("x"))).alias("key"))
    least = keyed.groupBy("key").agg(F.min(F.struct("place", "h", "h2")).alias("least"), F.count("*").alias("m")).where("m > 1").select("key", "least")
    earlier = keyed.join(least, "key").where(F.col("least.place") < F.col("place")).groupBy("h", "h2").agg(F.min("least").alias("least"))
    before = texts.select(F.col("h").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("before"))
    pairs = earlier.join(texts, ["h", "h2"]).join(before, (F.col("least.h") == F.col("e1")) & (F.col("least.h2") == F.col("e2")))
    return pairs.where(F.levenshtein("line", "before", 1) >= 0).select("h", "h2", F.lit(True).alias("near"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: int = LEAST) -> DataFrame:
    """(id, th, gone, n_near): numbers of each document's lines to remove, and how many have an edit between."""
    lines = written(placed(docs, id_col, text_col, exact))
    once = lines.where("first")
    halved = once.select("h", "h2", F.explode("halves").alias("half"))
    shared = halved.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("half")
    able = halved.join(shared, "half", "left_semi").select("h", "h2").distinct()
    kinds = written(once.groupBy("h", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    close = written(near(docs, kinds.join(able, ["h", "h2"], "left_semi").select("h", "h2", F.col("first")), id_col, text_col))
    marked = kinds.join(close, ["h", "h2"], "left").where("n > 1 OR near").select("h", "h2", F.col("first").alias("at"), F.coalesce("near", F.lit(False)).alias("near"))
    again = lines.where(~F.col("first")).select("id", "th", "k", F.lit(False).alias("near"))
    gone = once.select("id", "th", "k", "h", "h2").join(marked, ["h", "h2"]).where((F.col("id") != F.col("at")) | F.col("near")).select("id", "th", "k", "near")
    return gone.union(again).groupBy("id", "th").agg(F.collect_set("k").alias("gone"), F.count_if("near").alias("n_near"))


def marked(docs: DataFrame, id_col: str, text_col: str, exact: int) -> DataFrame:
    """Per row: row (docs' columns), text (without the removed lines), n_lines, n_removed, n_near: numbers of lines."""
    gone = removals(docs, id_col, text_col, exact)
    d = docs.select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, ["id", "th"], "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return d.select("row", kept.alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: int = LEAST) -> DataFrame:
    """docs with text_col without the removed lines."""
    return marked(docs, id_col, text_col, exact).select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def op2_lines(spark, sf_dir: str) -> DataFrame:
    d = marked(read(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", 1)
    return d.select("row.doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that has no word left, and had lines removed, goes. A column n_chars is counted again."""
    d = marked(docs, "doc_id", "text", 1).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": counted}
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

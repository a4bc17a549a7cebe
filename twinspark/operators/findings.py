"""From pairs to findings: groups, subset suppression, assignment, elevation, suppression lists, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..storage import written
from .components import components

MAX_GROUP = 15
SEVERITIES = {"extract": 2, "review": 1}


def groups(matches: DataFrame) -> DataFrame:
    """matches(a, b, score) -> components with members, number of matches and best match.

    A column links, if there, is the number of matches that a row stands for; score may be null where it is 0.
    """
    links = F.sum("links") if "links" in matches.columns else F.count("*")
    matches = written(matches)
    c = components(matches.select("a", "b"))
    m = matches.join(c.withColumnRenamed("node", "a"), "a")
    members = c.groupBy("component").agg(F.count("*").alias("size"))
    best = m.groupBy("component").agg(links.alias("match_count"), F.max("score").alias("score"))
    return members.join(best, "component").withColumn("kind", F.when(F.col("size") >= 3, "group").otherwise("pair"))


def capped(members: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """members(component, unit, score): the best `most` units of each component."""
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc("score"), "unit"))
    return members.withColumn("rank", rank).where(F.col("rank") <= most)


def subset_suppressed(findings: DataFrame) -> DataFrame:
    """findings(finding, members): those whose members are not a strict subset of another's."""
    # a set that holds all members of another holds its rarest one, so equal sets meet once and only there
    sets = findings.select("members").distinct()
    m = sets.select("members", F.explode(F.array_distinct("members")).alias("u"))
    rare = m.join(m.groupBy("u").agg(F.count("*").alias("c")), "u").groupBy("members").agg(F.min(F.struct("c", "u"))["u"].alias("u"))
    bits = F.aggregate("members", F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    inner = rare.select("members", "u", bits.alias("bits"), F.size(F.array_distinct("members")).alias("n"))
    outer = m.select(F.col("members").alias("other"), F.col("u").alias("v"), bits.alias("other_bits"), F.size(F.array_distinct("members")).alias("m"))
    holds = (F.col("n") < F.col("m")) & (F.col("bits").bitwiseAND(F.bitwise_not("other_bits")) == 0) & (F.size(F.array_except("members", "other")) == 0)
    inside = inner.join(outer, (F.col("u") == F.col("v")) & holds, "left_semi").select("members")
    return findings.join(inside, "members", "left_anti").select(*findings.columns)


def merged_overlaps(findings: DataFrame, group_least: float = 0.60, other_least: float = 0.70) -> DataFrame:
    """findings(finding, members, score, kind): overlapping ones merged in order within each block that shares members.

    Of two that overlap enough the one of higher score stays, then the one of more members, then the earlier; it takes
    the members of both. Groups merge with groups from a lower overlap on. Blocks are connected by shared members
    and worked one by one, as the outcome of a merge depends on those before it.
    """
    m = findings.select("finding", F.explode("members").alias("u"))
    first = m.groupBy("u").agg(F.min("finding").alias("a"))
    c = components(m.join(first, "u").select("a", F.col("finding").alias("b")).where("a <> b"))
    blocks = findings.join(c.withColumnRenamed("node", "finding"), "finding", "left").withColumn("block", F.coalesce("component", "finding")).drop("component")

    def merged(pdf):
        live = [{"finding": r.finding, "members": set(r.members), "score": r.score, "kind": r.kind} for r in pdf.sort_values("finding").itertuples()]
        at = 0
        while at < len(live):
            x, k = live[at], at + 1
            while k < len(live):
                y = live[k]
                bar = group_least if x["kind"] == y["kind"] == "group" else other_least
                both = x["members"] | y["members"]
                if not both or len(x["members"] & y["members"]) < bar * len(both):
                    k += 1
                    continue
                later = (y["score"], len(y["members"])) > (x["score"], len(x["members"]))
                (y if later else x)["members"] = both
                del live[at if later else k]
                if later:
                    break
            else:
                at += 1
        out = pdf.iloc[[list(pdf["finding"]).index(x["finding"]) for x in live]].drop(columns="block")
        return out.assign(members=[sorted(x["members"]) for x in live])

    return blocks.groupBy("block").applyInPandas(merged, findings.schema)


def rebuilt(members: DataFrame) -> DataFrame:
    """members(unit, finding, score, kind): findings of the units that are assigned to them.

    Groups of three or more stay, of two become pairs, others go; a pair needs both of its units.
    """
    kept = assigned(members).groupBy("finding", "kind").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("unit")).alias("units"))
    return kept.where("size >= 2").select("finding", F.when((F.col("kind") == "group") & (F.col("size") >= 3), "group").otherwise("pair").alias("kind"), "size", "units")


def described(matches: DataFrame, apart: str = "cross_service_reference") -> DataFrame:
    """matches(a, b, score, reuse): a row a component of each reuse kind with members, number of matches and best match.

    Matches of the kind `apart` are never grouped: each is a finding of its own.
    """
    alone = matches.where(F.col("reuse") == apart).select("reuse", F.least("a", "b").alias("component"), F.array_sort(F.array("a", "b")).alias("members"), F.lit(1).cast("long").alias("match_count"), "a", "b", "score")
    kinds = matches.where(F.col("reuse") != apart)
    ends = lambda c: F.struct("reuse", F.col(c).alias("unit"))
    c = components(kinds.select(ends("a").alias("a"), ends("b").alias("b")))
    c = c.select(F.col("node.reuse").alias("reuse"), F.col("node.unit").alias("unit"), F.col("component.unit").alias("component"))
    members = c.groupBy("reuse", "component").agg(F.array_sort(F.collect_list("unit")).alias("members"))
    best = F.max_by(F.struct("a", "b", "score"), F.struct("score", -F.col("a"), -F.col("b"))).alias("best")
    m = kinds.join(c.withColumnRenamed("unit", "a"), ["reuse", "a"]).groupBy("reuse", "component").agg(F.count("*").alias("match_count"), best)
    return members.join(m, ["reuse", "component"]).select("reuse", "component", "members", "match_count", "best.*").unionByName(alone)


def assigned(members: DataFrame) -> DataFrame:
    """members(unit, finding, score): each unit in its best finding, the first on ties."""
    rank = F.row_number().over(W.partitionBy("unit").orderBy(F.desc("score"), "finding"))
    return members.withColumn("rank", rank).where("rank = 1").drop("rank")


def elevated(rows: DataFrame, finding: str = "finding", file: str = "file", severity: str = "severity") -> DataFrame:
    """rows(finding, file, severity): review findings of a file that two or more of them touch become extract."""
    review = rows.where(F.col(severity) == "review").select(finding, file).distinct()
    crowded = review.groupBy(file).agg(F.count("*").alias("n")).where("n >= 2")
    raised = review.join(crowded, file).select(finding).distinct().withColumn("raised", F.lit(True))
    return rows.join(raised, finding, "left").withColumn(severity, F.when(F.col("raised"), "extract").otherwise(F.col(severity))).drop("raised")


def unsuppressed(findings: DataFrame, listed: DataFrame) -> DataFrame:
    """findings(finding_id, a_hash, b_hash) less those that the list covers.

    listed(ord, id, verdict, source_hash, existing_hash): the first entry of a finding's id decides. Dismissed ones are
    covered, intentional ones while both stored hashes are as the first eight characters of the finding's, in either
    order, or if one is missing. A finding without an entry is covered if it shares an end, its mark aside,
    with a dismissed one.
    """
    entry = listed.groupBy(F.col("id").alias("finding_id")).agg(F.min_by(F.struct("verdict", "source_hash", "existing_hash"), "ord").alias("entry"))
    cut = lambda c: F.regexp_replace(c, r":[^:]*$", "")
    ends = lambda c: F.transform(F.split(c, r"\|\|"), cut)
    dismissed = listed.where((F.col("verdict") == "dismissed") & (F.size(ends("id")) == 2)).select(F.explode(ends("id")).alias("end")).distinct()
    touched = findings.where(F.size(ends("finding_id")) == 2).select("finding_id", F.explode(ends("finding_id")).alias("end")).join(dismissed, "end", "left_semi").select("finding_id").distinct()
    s, e = F.coalesce("entry.source_hash", F.lit("")), F.coalesce("entry.existing_hash", F.lit(""))
    a, b = F.left("a_hash", F.lit(8)), F.left("b_hash", F.lit(8))
    same = ((a == s) & (b == e)) | ((a == e) & (b == s))
    covered = (F.coalesce("entry.verdict", F.lit("intentional")) == "dismissed") | (s == "") | (e == "") | same
    d = findings.join(entry, "finding_id", "left").join(touched.withColumn("near", F.lit(True)), "finding_id", "left")
    return d.where(~F.when(F.col("entry").isNotNull(), covered).otherwise(F.coalesce("near", F.lit(False)))).select(*findings.columns)


def pruned(listed: DataFrame, live: DataFrame) -> DataFrame:
    """Entries of listed(id, verdict) that still stand for a live(finding_id): by id, dismissed ones by stable key as well."""
    cut = lambda c: F.array_join(F.array_sort(F.transform(F.split(c, r"\|\|"), lambda x: F.regexp_replace(x, r":[^:]*$", ""))), "||")
    by_id = listed.join(live.select(F.col("finding_id").alias("id")), "id", "left_semi")
    keyed = listed.where("verdict = 'dismissed'").withColumn("stable", cut("id")).join(live.select(cut("finding_id").alias("stable")), "stable", "left_semi")
    return by_id.unionByName(keyed.select(*listed.columns)).distinct()


def should_fail(severities: DataFrame, bar: Column, severity: str = "severity") -> DataFrame:
    """Whether any severity reaches the bar (extract over review); an unknown bar asks for extract."""
    rank = lambda c: F.when(c == "extract", 2).when(c == "review", 1)
    return severities.agg(F.coalesce(F.bool_or(F.coalesce(rank(F.col(severity)), F.lit(0)) >= F.coalesce(rank(bar), F.lit(2))), F.lit(False)).alias("fail"))


def health(totals: DataFrame) -> DataFrame:
    """totals(total, extract, review) -> score 0..100 and grade; null counts are 0."""
    totals = totals.fillna(0, ["total", "extract", "review"])
    scale = F.greatest(F.col("total") / 50, F.lit(1.0))
    raw = 100 - (5 * F.col("extract") + 2 * F.col("review")) / scale
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(raw, 0)))
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return totals.select("*", score.cast("long").alias("score"), grade.alias("grade"))


def metrics(counts: DataFrame) -> DataFrame:
    """counts(..., tp, fp, tn, fn) with precision, recall, f1 and accuracy; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = counts.select("*", F.round(ratio(tp, tp + fp), 4).alias("precision"), F.round(ratio(tp, tp + fn), 4).alias("recall"))
    return d.select("*", F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), F.round(ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"))


def confusion(predicted: Column, truth: Column) -> list[Column]:
    return [F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & ~truth).alias("tn"), F.count_if(~predicted & truth).alias("fn")]


def suggestion(a: str = "source", b: str = "existing") -> Column:
    """Kind of advice for a pair: same file, other service, parameterised copy, or the reuse class."""
    s, e = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    plain = lambda f: F.split(F.trim(X.without_literals(f("source"))), r"\s+")
    variant = (plain(s) == plain(e)) & (X.string_literals(s("source")) != X.string_literals(e("source")))
    reuse = X.reuse_class(s("language"), e("language"))
    return F.when(s("filepath") == e("filepath"), "same_file_refactor").when(F.coalesce(X.service(s("filepath")) != X.service(e("filepath")), F.lit(False)), "cross_service_reference").when(variant & (reuse != "reference_only"), "extract_utility").otherwise(reuse)

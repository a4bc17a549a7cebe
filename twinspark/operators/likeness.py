"""Likeness of two units: structure trees, names, calls, lines, pooled vectors, and the features of a judged pair."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X

#: Trees of more tokens are compared as multisets; sizes further apart than HALF count as HALF_WEIGHT of their ratio.
MOST_TOKENS, HALF, HALF_WEIGHT = 60, 0.5, 0.7
LEAST = 1e-9


def parsed(tokens: str) -> tuple[list[str], list[int]]:
    """Labels of the first tree of "(label child (label ...) ...)" in postorder, and each node's leftmost leaf; open brackets close at the end."""
    labels, left, opened = [], [], []

    def close(label: str, first: int):
        left.append(first)
        labels.append(label)

    for x in re.findall(r"\([^ ()]*|\)|[^ )]+", tokens):
        if x[0] == "(":
            opened.append((x[1:], len(labels)))
        elif x == ")":
            close(*(opened.pop() if opened else ("", len(labels))))
        else:
            close(x, len(labels))
        if not opened:
            break
    while opened:
        close(*opened.pop())
    return (labels, left) if labels else (["empty"], [0])


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Least number of deleted, inserted and renamed nodes between two parsed trees (Zhang and Shasha)."""
    (la, fa), (lb, fb) = a, b
    tree = [[0] * len(lb) for _ in la]
    # the highest node of each leftmost leaf starts a forest of its own
    for i in sorted({f: k for k, f in enumerate(fa)}.values()):
        for j in sorted({f: k for k, f in enumerate(fb)}.values()):
            forest = [list(range(j - fb[j] + 2))]
            for x in range(fa[i], i + 1):
                row = [len(forest)]
                for y in range(fb[j], j + 1):
                    whole = fa[x] == fa[i] and fb[y] == fb[j]
                    kept = forest[-1][y - fb[j]] + (la[x] != lb[y]) if whole else forest[fa[x] - fa[i]][fb[y] - fb[j]] + tree[x][y]
                    row.append(min(forest[-1][len(row)] + 1, row[-1] + 1, kept))
                    if whole:
                        tree[x][y] = row[-1]
                forest.append(row)
    return tree[-1][-1]


def _compared(a: str, b: str) -> float:
    if max(a.count(" "), b.count(" ")) >= MOST_TOKENS:
        x, y = Counter(a.split()), Counter(b.split())
        return (x & y).total() / max((x | y).total(), 1)
    p, q = parsed(a.strip()), parsed(b.strip())
    return max(0.0, 1.0 - tree_distance(p, q) / max(len(p[0]), len(q[0])))


@F.pandas_udf(DoubleType())
def _trees(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _compared(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters of two strings by their size, longest blocks first; null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def structure_likeness(a: Column | str, b: Column | str) -> Column:
    """Likeness of two structure strings: 0 without one, 1 if equal, by sizes if far apart, by multisets of tokens if long, else by tree distance.

    Only strings that the first three rules leave open are sent to Python.
    """
    a, b = X.col(a), X.col(b)
    n = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    ratio = F.least(n(a), n(b)) / F.greatest(n(a), n(b))
    quick = F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(ratio < HALF, ratio * HALF_WEIGHT)
    return F.coalesce(quick, _trees(F.when(quick.isNull(), a), F.when(quick.isNull(), b)))


def shared_ratio(a: Column, b: Column) -> Column:
    """Common members of two arrays by all of them; null arrays are empty, and two empty ones share 0."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def size_ratio(a: Column, b: Column) -> Column:
    """The lesser by the greater; 1 if there is none above 0."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def mean_pooled(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors that the mask keeps, at unit length; all zeros if it keeps none."""
    rows = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m != 0, h)), lambda h: h.isNotNull())
    zeros = F.transform(F.get(hidden, 0), lambda _: F.lit(0.0))
    total = F.aggregate(rows, zeros, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(rows).cast("double"), F.lit(LEAST)))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / F.greatest(norm, F.lit(LEAST)))


def storage_mb(rows: Column, dimensions: Column) -> Column:
    """MB of single-precision vectors, one decimal."""
    return F.round(rows * dimensions * 4 / F.lit(1 << 20), 1)


def feedback_features(a: str = "source", b: str = "existing") -> list[Column]:
    """Features of a judged pair of units, structs of the columns `a` and `b`, that hold neither names nor code.

    Units have name, filepath, lineno, end_lineno, language, param_count, has_return, calls, visibility, is_nested, class_name,
    ast_hash and cluster (null or empty: none).
    """
    s, e = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    lines = lambda f: f("end_lineno") - f("lineno") + 1
    calls = lambda f: F.size(F.array_distinct(F.coalesce(f("calls"), F.array().cast("array<string>"))))
    named = lambda f, c: F.coalesce(f(c), F.lit("")) != ""
    both = lambda c: named(s, c) & s(c).eqNullSafe(e(c))
    own = [
        x.alias(f"{side}_{name}")
        for side, f in ((a, s), (b, e))
        for name, x in (
            ("language", f("language")), ("param_count", f("param_count")), ("has_return", f("has_return")), ("line_count", lines(f)), ("call_count", calls(f)),
            ("visibility", F.coalesce(f("visibility"), F.lit("public"))), ("is_nested", F.coalesce(f("is_nested"), F.lit(False))), ("has_class", named(f, "class_name")),
        )
    ]
    return own + [
        (s("language") == e("language")).alias("same_language"), (s("filepath") == e("filepath")).alias("same_file"), both("class_name").alias("same_class"),
        both("cluster").alias("same_cluster"), F.coalesce(X.service(s("filepath")) != X.service(e("filepath")), F.lit(False)).alias("crosses_service_boundary"),
        both("ast_hash").alias("ast_hash_match"), F.round(sequence_ratio(s("name"), e("name")), 4).alias("name_similarity"),
        F.abs(s("param_count") - e("param_count")).alias("param_count_diff"), F.round(shared_ratio(s("calls"), e("calls")), 4).alias("shared_calls_ratio"),
        F.round(size_ratio(lines(s), lines(e)), 4).alias("line_count_ratio"),
    ]

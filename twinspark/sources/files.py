"""File sources and sinks: source trees, benchmark pair files, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: What a scan leaves out.
EXCLUDED_FOLDERS = [".git", "__pycache__", ".venv", "venv", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", "target", "vendor", ".next", ".nuxt", "coverage", ".cache"]
EXCLUDED_NAMES = ["*.min.js", "*.bundle.js", "*.generated.*", "*_pb2.py", "*.pb.go"]
TEST_NAMES = ["test_*.py", "*_test.py", "conftest.py", "*.spec.ts", "*.test.ts", "*.spec.tsx", "*.test.tsx", "*.spec.js", "*.test.js", "*.spec.jsx", "*.test.jsx"]
TEST_FOLDERS = ["tests", "test", "__tests__", "spec", "specs"]


def discovered(paths: DataFrame, path: str = "path", root: str = "", languages: list[str] | None = None, ignore: list[str] = (), tests: bool = False) -> DataFrame:
    """Paths of known languages outside excluded, hidden, ignored and (unless asked for) test places; rules see them below root."""
    below = F.expr(f"ltrim('/', substring(`{path}`, {len(root) + 1}))") if root else F.col(path)
    parts, name = F.split(below, "/"), F.substring_index(below, "/", -1)
    globs = lambda xs: name.rlike("|".join("^" + X.glob_pattern(x) for x in xs))
    hidden = F.exists(parts, lambda x: F.startswith(x, F.lit(".")) & (x != ".") | F.endswith(x, F.lit(".egg-info")))
    language = X.language_of(below)
    keep = language.isNotNull() & ~hidden & ~F.arrays_overlap(parts, F.lit(EXCLUDED_FOLDERS)) & ~globs(EXCLUDED_NAMES) & ~X.ignored(below, list(ignore))
    if languages:
        keep = keep & language.isin(*languages)
    if not tests:
        keep = keep & ~F.arrays_overlap(parts, F.lit(TEST_FOLDERS)) & ~globs(TEST_NAMES)
    return paths.where(keep).withColumn("language", language)


def source_tree(spark: SparkSession, root: str, **how) -> DataFrame:
    """filepath (below root), language, content, size_bytes, mtime of a tree's source files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "content", "length", "modificationTime")
    below = top.withColumn("path", F.expr(f"ltrim('/', substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/'))}))"))
    return discovered(below, **how).select(F.col("path").alias("filepath"), "language", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def pair_files(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Files of two snippets parted by empty lines."""
    parts = F.split(F.trim("value"), r"\n\s*\n\s*\n+", 2)
    return spark.read.text(path, wholetext=True).select(F.get(parts, 0).alias("code_a"), F.get(parts, 1).alias("code_b")).where((F.length("code_a") >= least) & (F.length("code_b") >= least))


def json_lines(rows: DataFrame, path: str, order: str, limit: int = 100_000) -> None:
    """The newest rows as JSON lines."""
    rows.orderBy(F.desc(order)).limit(limit).write.mode("overwrite").json(path)

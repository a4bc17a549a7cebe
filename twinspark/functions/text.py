"""Scalar text functions on columns: names, paths, ids, literals, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SERVICE_ROOTS = ("services", "apps", "packages", "microservices")
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp"}
RUNTIMES = (("javascript", "typescript"), ("c", "cpp"))
STRING_LITERAL = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_tokens(name: Column | str) -> Column:
    """camelCase, PascalCase and snake_case names as lower-case tokens."""
    parted = F.regexp_replace(F.regexp_replace(col(name), r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.array_remove(F.split(F.lower(parted), r"[_\s]+"), "")


def string_literals(source: Column | str) -> Column:
    return F.regexp_extract_all(col(source), F.lit(STRING_LITERAL), F.lit(0))


def without_literals(source: Column | str) -> Column:
    return F.regexp_replace(col(source), STRING_LITERAL, '""')


def qualified_name(path: Column | str, name: Column | str, line: Column | str) -> Column:
    return F.concat_ws(":", col(path), col(name), col(line).cast("string"))


def structural_hash(tokens: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a normalised token string."""
    return F.substring(F.sha2(col(tokens).cast("binary"), 256), 1, 16)


def normalised(source: Column | str) -> Column:
    """Case and spacing folded: the renamed-clone form of plain text."""
    return F.trim(F.regexp_replace(F.lower(col(source)), r"[ \t\n\r\f]+", " "))


def signature_key(language: Column | str, params: Column | str, returns: Column | str, calls: Column) -> Column:
    return F.concat_ws("|", col(language), col(params).cast("string"), F.when(col(returns), "R").otherwise("N"), F.least(calls, F.lit(20)).cast("string"))


def finding_id(a: Column | str, b: Column | str) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws("||", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def stable_key(a: Column | str, b: Column | str) -> Column:
    """finding_id of qualified names without their line numbers."""
    cut = lambda x: F.regexp_replace(col(x), r":[^:]*$", "")
    return finding_id(cut(a), cut(b))


def short_path(path: Column | str, segments: int = 4) -> Column:
    return F.substring_index(col(path), "/", -segments)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def slashed(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"\\", "/"), r"^\./", "")


def service(path: Column | str) -> Column:
    """The root of services that the path starts with and the folder in it, or null."""
    found = F.regexp_extract(slashed(path), rf"^((?:{'|'.join(SERVICE_ROOTS)})/[^/]+)/", 1)
    return F.when(found != "", found)


def boundaries(path: Column | str) -> Column:
    """All root/folder pairs of services in a path, wherever they stand."""
    parts = F.split(col(path), "/")
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin(*SERVICE_ROOTS) & (i + 1 < F.size(parts)))
    return F.transform(at, lambda i: F.concat_ws("/", F.get(parts, i), F.get(parts, i + 1)))


def end_parts(end: Column | str) -> Column:
    """struct<path, name, mark> of one end path:name:mark of a finding id; a path may hold colons."""
    part = lambda k: F.regexp_extract(col(end), r"^(.*):([^:]*):([^:]*)$", k)
    return F.struct(part(1).alias("path"), part(2).alias("name"), part(3).alias("mark"))


def common_folder(paths: Column) -> Column:
    """Longest run of leading folders that all paths share, with a slash at its end; empty without one."""
    folders = F.transform(paths, lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1))

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.slice(a, F.lit(1), F.coalesce(F.get(F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(a, i) != F.get(b, i))), 0), F.lit(0)).cast("int"))

    run = F.aggregate(folders, F.get(folders, 0), shared)
    return F.when(F.size(run) > 0, F.concat(F.array_join(run, "/"), F.lit("/"))).otherwise("")


def language_of(path: Column | str) -> Column:
    ending = F.lower(F.regexp_extract(col(path), r"(\.[A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ending]


def reuse_class(a: Column | str, b: Column | str) -> Column:
    """direct_import in one language, compatible_import in one runtime, else reference_only."""
    a, b = col(a), col(b)
    shared = F.lit(False)
    for group in RUNTIMES:
        shared = shared | (a.isin(*group) & b.isin(*group))
    return F.when(a == b, "direct_import").when(shared, "compatible_import").otherwise("reference_only")


def preview(source: Column | str, lines: int = 4, chars: int = 300) -> Column:
    return F.left(F.array_join(F.slice(F.split(col(source), "\n"), 1, lines), "\n"), F.lit(chars))


def keywords(text: Column | str, least: int = 3) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= least)))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression over a whole name."""
    import fnmatch

    return fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")


def ignored(path: Column | str, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: plain names match a component, others a prefix, or as globs the path or its last part."""
    p = col(path)
    last = F.substring_index(p, "/", -1)
    hit = F.lit(False)
    for x in patterns:
        bare = x.rstrip("/")
        if "/" not in bare and not set(bare) & set("*?["):
            hit = hit | F.array_contains(F.split(p, "/"), bare)
        else:
            hit = hit | F.startswith(p, F.lit(bare)) | p.rlike("^" + glob_pattern(x)) | last.rlike("^" + glob_pattern(x))
    return hit


#: Endings that only the guess knows, marks of languages in their order, words that name no function, hosts of repositories.
FURTHER_EXTENSIONS = {".cjs": "javascript", ".cc": "cpp", ".cxx": "cpp"}
MARKS = {
    "python": ["def ", "import ", "from ", "elif ", "self"],
    "javascript": ["function ", "const ", "let ", "=>", "console.log"],
    "typescript": ["interface ", "type ", ": string", ": number", "implements "],
    "go": ["package ", "func ", "fmt.", "err != nil"],
    "rust": ["fn ", "let mut ", "impl ", "pub fn ", "match "],
    "java": ["public class ", "public static ", "system.out", "private "],
    "ruby": ["def ", "end", "puts ", "class "],
    "cpp": ["#include <", "std::", "::", "cout", "vector<"],
    "c": ["#include <", "printf(", "malloc(", "free("],
}
KEYWORDS = (
    "async await if else for while do switch case return try catch finally throw new delete typeof instanceof void in of const let var "
    "function class extends super import export default from as yield true false null undefined this"
).split()
HOSTS = ("github", "gitlab")


def guessed_language(code: Column | str, path: Column | str) -> Column:
    """By the ending of the path, else the language of most marks in the code, the first on ties; python without any."""
    endings = F.create_map(*[F.lit(x) for kv in (EXTENSIONS | FURTHER_EXTENSIONS).items() for x in kv])
    low = F.lower(F.coalesce(col(code), F.lit("")))
    score = lambda marks: sum((F.contains(low, F.lit(m)).cast("int") for m in marks), F.lit(0))
    best = F.array_max(F.array(*[F.struct(score(marks).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, marks) in enumerate(MARKS.items())]))
    return F.coalesce(endings[F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))], best["name"])


def names_a_function(name: Column | str, lines: Column | str) -> Column:
    """Whether an extracted name stands: no keyword, and no one-liner that begins with an underscore."""
    return ~col(name).isin(*KEYWORDS) & ~((col(lines) < 2) & F.startswith(col(name), F.lit("_")))


def remote_parts(url: Column | str) -> Column:
    """struct<host, owner, repo> of a repository's address, by SSH or by HTTPS, or null."""
    out = None
    for host in HOSTS:
        for form in (rf"^git@[^:]*{host}[^:]*:(.+?)/(.+?)(?:\.git)?$", rf"^https?://{host}\.com/(.+?)/(.+?)(?:\.git)?$"):
            parts = F.struct(F.lit(host).alias("host"), F.regexp_extract(col(url), form, 1).alias("owner"), F.regexp_extract(col(url), form, 2).alias("repo"))
            out = F.when(col(url).rlike(form), parts) if out is None else out.when(col(url).rlike(form), parts)
    return out


def default_consent(visibility: Column | str) -> Column:
    return F.when(col(visibility) == "public", "public").otherwise("private")


def sends_code(consent: Column | str, visibility: Column | str) -> Column:
    """Code leaves only if both the consent and the repository are public; else features alone."""
    return F.coalesce((col(consent) == "public") & (col(visibility) == "public"), F.lit(False))


def labelled_type(syntactic: Column | str, likeness: Column | str) -> Column:
    """Clone type of a labelled pair: by its syntactic type, from type 3 on by the likeness of its tokens."""
    return F.when(col(syntactic) == 1, "type1").when(col(syntactic) == 2, "type2").when(col(likeness) >= 0.5, "type3").otherwise("type4")


def section(reuse: Column | str, severity: Column | str, a: Column | str, b: Column | str) -> Column:
    """Section of a report: pairs of two languages apart, others by severity; `a` and `b` are languages, null for groups."""
    apart = (col(reuse) == "reference_only") | ((col(reuse) == "cross_service_reference") & (col(a) != col(b)))
    return F.when(apart, "cross_language").when(col(severity) == "extract", "extract").otherwise("review")

"""Personal data: format-preserving pseudonyms.

Numbers and dates that pass their checks (Luhn for cards, octets for addresses, calendar for dates,
digit counts for phones) are permuted by a keyed Feistel network within their own format, so a card
stays a valid card, a date a date, and equal values stay equal in every document; other values of
another key or format never meet. The characters of mail names and hexadecimal secrets are permuted by the same
kind of network, each within its own alphabet (lower case, upper case, digits; hexadecimal digits); marks in
mail names stay, and so does the mail's domain.

The key is the session's setting twinspark.pseudonyms.key; where it is unset, a random one of this application
is used, so that nobody can undo the pseudonyms and no two applications share them.

Defined results: a null text stays null with counts of 0; a text without personal data stays as it is;
a digit string that fails its check stays as it is; rows that repeat an id are treated each alone.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

ROUNDS = 8
_drawn: dict[str, str] = {}

#: The formats looked for. The order decides between formats at one place.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4})(?![0-9A-Za-z])"
FORMATS = {"mail": MAIL, "secret": SECRET, "date": DATE, "address": ADDRESS, "phone": PHONE, "identity": IDENTITY, "card": CARD}
ANY = "|".join(f"(?:{x})" for x in FORMATS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def session_key(spark) -> str:
    return spark.conf.get("twinspark.pseudonyms.key", None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def _digest(of: Column, bits: int = 52) -> Column:
    return F.conv(F.substring(F.sha2(of.cast("binary"), 256), 1, bits // 4), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str, rounds: int = ROUNDS) -> Column:
    """struct<l, r>: a keyed permutation of the pairs in [0, left_size) x [0, right_size).

    Even rounds add a digest of r to l, odd rounds one of l to r; each can be undone, so pairs never meet.
    """
    tag = F.concat(F.lit(f"{key}|"), tweak, F.lit("|"))

    def step(p, k):
        even = F.pmod(p["l"] + F.pmod(_digest(F.concat(tag, k.cast("string"), F.lit("|"), p["r"].cast("string"))), left_size), left_size)
        odd = F.pmod(p["r"] + F.pmod(_digest(F.concat(tag, k.cast("string"), F.lit("|"), p["l"].cast("string"))), right_size), right_size)
        return F.struct(F.when(k % 2 == 0, even).otherwise(p["l"]).alias("l"), F.when(k % 2 == 1, odd).otherwise(p["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def digits_permuted(digits: Column, tweak: Column, key: str) -> Column:
    """A digit string (2 to 36 digits) permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n).cast("long"), size(half), size(n - half), F.concat(tweak, n.cast("string")), key)
    return let(out, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), n - half, F.lit("0"))))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counted once."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by others, in order."""
    parts = F.split(F.regexp_replace(form, "[0-9]", "0"), "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(parts, start, lambda a, c: F.struct(F.concat(a["s"], F.when(c == "0", F.substring(digits, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + (c == "0").cast("int")).alias("i")), lambda a: a["s"])


def _card(x: Column, key: str) -> Column:
    def made(d):
        body = digits_permuted(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
        return refilled(x, let(body, lambda b: F.concat(b, F.pmod(F.lit(0) - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    return let(only_digits(x), lambda d: F.when(luhn_sum(d) % 10 == 0, made(d)))


def _phone(x: Column, key: str) -> Column:
    country = F.regexp_extract(x, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(x, F.length(country) + 1, F.length(x))
    return let(only_digits(rest), lambda d: F.when(F.length(d).between(7, 15), F.concat(country, refilled(rest, digits_permuted(d, F.lit("phone"), key)))))


def _address(x: Column, key: str) -> Column:
    def made(o):
        p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("address"), key)
        return let(p, lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string")))

    return let(F.transform(F.split(x, r"\."), lambda o: o.cast("int")), lambda o: F.when(F.forall(o, lambda v: v <= 255), made(o)))


def _date(x: Column, key: str) -> Column:
    # the calendar's days fill 270 x 271 cells but for a few: walk on until the cell is a day
    def walk(v, _):
        p = feistel(F.floor(v / 271), v % 271, F.lit(270), F.lit(271), F.lit("date"), key)
        return F.when((v < 0) | (v >= DAYS + (1 << 20)), v).otherwise(let(p, lambda p: p["l"] * 271 + p["r"]).cast("long"))

    def moved(day):
        first = walk(day, None)
        return F.aggregate(F.sequence(F.lit(1), F.lit(16)), first, lambda v, i: F.when(v < DAYS, v).otherwise(walk(v, i)))

    day = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return let(day, lambda d: F.when(d.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved(d).cast("int")), "yyyy-MM-dd")))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def characters_permuted(x: Column, alphabets: list[str], tag: str, key: str, rounds: int = ROUNDS) -> Column:
    """x with each character permuted within the alphabet it is of; others stay.

    A Feistel network of both halves: rounds in turn move the characters of one by a keyed digest of the other.
    """

    def moved(half: Column, other: Column, k: Column) -> Column:
        tagged = F.concat(F.lit(f"{key}|{tag}|"), F.length(x).cast("string"), F.lit("|"), k.cast("string"), F.lit("|"))
        digests = F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 16).cast("int")), lambda b: F.sha2(F.concat(tagged, b.cast("string"), F.lit("|"), other).cast("binary"), 256))

        def shifted(d: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                by = F.conv(F.substring(F.get(d, F.floor(i / 16).cast("int")), (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                out = c
                for a in alphabets:
                    at = F.call_function("locate", c, F.lit(a))
                    out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), char), "")

        return let(digests, shifted)

    def step(p: Column, k: Column) -> Column:
        return F.struct(F.when(k % 2 == 0, moved(p["l"], p["r"], k)).otherwise(p["l"]).alias("l"), F.when(k % 2 == 1, moved(p["r"], p["l"], k)).otherwise(p["r"]).alias("r"))

    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda p: F.concat(p["l"], p["r"]))


def pseudonym(x: Column, key: str) -> Column:
    """struct<kind, value> for one found string; kind is null, and the value as it was, where a check fails."""
    local = F.substring_index(x, "@", 1)
    is_ = lambda kind: x.rlike(f"^(?:{FORMATS[kind]})$")
    made = (
        F.when(F.contains(x, F.lit("@")), F.struct(F.lit("mail").alias("kind"), F.concat(characters_permuted(local, [LOWER, UPPER, DIGITS], "mail", key), F.substring(x, F.length(local) + 1, F.length(x))).alias("value")))
        .when(is_("date"), F.struct(F.lit("date").alias("kind"), _date(x, key).alias("value")))
        .when(is_("address"), F.struct(F.lit("address").alias("kind"), _address(x, key).alias("value")))
        .when(is_("identity"), F.struct(F.lit("identity").alias("kind"), refilled(x, digits_permuted(only_digits(x), F.lit("identity"), key)).alias("value")))
        .when(F.startswith(x, F.lit("+")), F.struct(F.lit("phone").alias("kind"), _phone(x, key).alias("value")))
        .when(is_("card"), F.struct(F.lit("card").alias("kind"), _card(x, key).alias("value")))
        .otherwise(F.struct(F.lit("secret").alias("kind"), F.when(x.rlike("[A-F]"), characters_permuted(x, ["0123456789ABCDEF"], "secret", key)).otherwise(characters_permuted(x, ["0123456789abcdef"], "secret", key)).alias("value")))
    )
    return let(made, lambda m: F.struct(F.when(m["value"].isNotNull(), m["kind"]).alias("kind"), F.coalesce(m["value"], x).alias("value")))


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs' columns with text_col replaced, and struct `found`: number of values of each kind."""
    key = key or session_key(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    hits = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda x: pseudonym(x, key))

    def rebuilt(h: Column) -> Column:
        parts = F.zip_with(F.split(text, ANY, -1), h, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m["value"], F.lit(""))))
        counts = F.struct(*[F.size(F.filter(h, (lambda k: lambda m: m["kind"] == k)(kind))).cast("long").alias(kind) for kind in FORMATS])
        return F.struct(F.when(F.size(h) == 0, text).otherwise(F.array_join(parts, "")).alias("text"), counts.alias("found"))

    nothing = F.struct(text.alias("text"), F.struct(*[F.lit(0).cast("long").alias(k) for k in FORMATS]).alias("found"))
    out = F.when(text.rlike("[0-9]|@"), let(hits, rebuilt)).otherwise(nothing)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), out.alias("out"))
    return d.select(*[F.col("out.text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns], F.col("out.found").alias("found"))


def op7_pseudonyms(spark, sf_dir: str) -> DataFrame:
    out = pseudonymised(read(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", *[F.col(f"found.{k}").alias(f"n_{k}") for k in FORMATS])

"""Operators of the llm subpackage on small fixtures, held against plain versions of what they compute."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.llm import batches, fingerprint, langid, licences, lines, mixing, neardup, pieces, pseudonyms, quality, queries, repeats, suffixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, component string"
WORDS = [f"w{k:03d}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if k % 9 == 8 else "") + ("\n" if k % 23 == 22 else "") for k in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, n) for n in (3, 40, 80, 400, 900)] + [None, "", " \n ", "One", "# $ % &", "Ünïcödé ▁ \U0001f600 text\x00"]
    out += [out[3], out[3] + " tail", out[3].replace("w001", "w002"), "A" + out[2], out[2] + "\n" + out[1], prose(rng, 20_000), out[3] + "\n" + out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ("en", "fr")[k % 2] if k % 5 else None, None if k % 7 == 3 else f"s{k % 3}", None, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_has_one_result(spark, folder, docs, name):
    assert queries.QUERIES[name](spark, folder).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name])


def word_list(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_near_duplicates_against_all_pairs(spark, folder, texts):
    sets = []
    for t in texts:
        w = word_list("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op6_neardup(spark, folder).collect() if r.doc_id is not None}
    assert got == {k: (len(s), up[k]) for k, s in enumerate(sets)}


def test_groups_of_many_near_copies(spark):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    up = list(range(120))
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    got = neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(up))


def test_all_links_between_sets_are_found_without_bands(spark):
    """Sets around a hub, many short of the threshold with it: the components are those of all links."""
    rng = random.Random(5)
    hub = list(range(80))
    sets = {0: set(hub), 1: {*hub[2:], 900}}
    for k in range(2, 90):
        sets[k] = set(hub) - set(rng.sample(hub, rng.randrange(1, 14))) | {1000 + rng.randrange(40) for _ in range(rng.randrange(10))}
        if k % 3 == 0:
            sets[k] = set(sets[k - 1]) - set(rng.sample(sorted(sets[k - 1]), rng.randrange(1, 7)))
    up = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = sorted((up[a], up[b]))
                up = {k: x if u == y else u for k, u in up.items()}
    same_regs = [1] * neardup.BUCKETS
    table = spark.createDataFrame([(k, len(s), same_regs, sorted(s)) for k, s in sets.items()], "rep long, n long, regs array<short>, items array<long>")
    got = {r.node: r.component for r in neardup.linked(table, 85).collect()}
    assert {k: got.get(k, k) for k in sets} == up and len(set(up.values())) > 1


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_repeat_an_id_are_linked_by_their_texts(spark, turn):
    rng = random.Random(2)
    a, b = (" ".join(rng.sample(WORDS, 60)) for _ in range(2))
    rows = [(5, a, 1), (5, b, 2), (8, b + " tail", 3), (9, a, 4), (None, a + " end", 5), (5, a, 6), (5, a, 1), (7, "", 7), (7, "", 7), (None, None, 8)][::turn]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra long").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.grouped(d).collect()}
    assert got == {(5, 58, 5), (8, 59, 5), (9, 58, 5), (None, 59, 5), (7, 0, 7), (None, 0, None)}
    kept = neardup.stage(spark, d, "").collect()
    # one row of each of the two groups, and the rows without words
    assert len([r for r in kept if r.text]) == 2 and {r.doc_id for r in kept if r.text} == {5} and {r.text for r in kept if r.text} == {a, b} and len(kept) == 5


def test_chance_of_equal_registers(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 400 * 3000, dtype=np.uint64)
    r = neardup.registers(h, np.arange(0, len(h) + 1, 3000))
    seen = (r[::2] == r[1::2]).mean()
    want = spark.range(1).select(neardup.chance(F.lit(3000.0), F.lit(3000.0))).first()[0]
    assert abs(seen - want) < 0.3 * want


def test_repeats_against_all_windows(spark, folder, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, x in rows:
        for k in range(len(x) - 199):
            seen[x[k : k + 200]] = seen.get(x[k : k + 200], 0) + 1
    want = {}
    for d, x in rows:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        want[d] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in repeats.op5_repeats(spark, folder).collect()} == want


def test_large_groups_of_stretches_are_counted(spark, folder, monkeypatch):
    want = sorted(repeats.op5_repeats(spark, folder).collect(), key=str)
    monkeypatch.setattr(repeats, "MOST", 1)
    assert sorted(repeats.op5_repeats(spark, folder).collect(), key=str) == want


@pytest.mark.parametrize("small", [2, 1024])
def test_suffix_arrays(small, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(2)
    for k in range(120):
        s = rng.integers(1, 2 + k % 5, int(rng.integers(1, 60)))
        s = np.append(np.tile(s, 1 + k % 3), 0).astype(np.int64)
        sa, x = suffixes.suffix_array(s, int(s.max()) + 1), s.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        plcp = suffixes.permuted_lcp(s, sa)
        for a, b in zip(sa[1:], sa, strict=False):
            m = 0
            while max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            assert plcp[a] == m


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    base = [prose(rng, n).replace("\n", " ") for n in (5, 9, 30, 60)]
    rows = []
    for k in range(60):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", "ß"])
        rows.append((k // 3, "".join(x)))
    text = {d: "\n".join(x for e, x in rows if e == d) + "\nshort" for d, _ in rows}
    places = [(d, k, re.sub("[\x20\x09-\x0d]+", " ", x.lower()).strip(" ")) for d, t in text.items() for k, x in enumerate(t.split("\n"))]
    first = {}
    for d, k, x in places:
        first.setdefault(x, (d, k))
    near = {x for x in first if any(first[y] < first[x] and one_edit(x, y) for y in first)}
    gone = {(d, k) for d, k, x in places if len(x) >= 20 and (x in near or first[x] != (d, k))}
    assert any(x in near for x in first)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in text.items()}
    got = lines.deduplicated(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_short_lines_go_if_repeated_exactly(spark, tmp_path):
    rows = [(1, "ab\n\nAB \nx"), (2, "ac\n\nab\n \nx y"), (3, "X"), (4, "q\t\n" + "long enough for the one-edit join"), (5, "long enough for the one-edit joim\nq\n\n")]
    want = {1: "ab\n\nx", 2: "ac\n\n \nx y", 3: "", 4: rows[3][1], 5: "\n"}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_near, r.kept_sha256) for r in lines.op2_lines(spark, str(tmp_path)).collect()}
    near = {5: (2, 1)}
    assert got == {d: (*near.get(d, ({1: 1, 2: 1, 3: 1, 4: 0}.get(d), 0)), hashlib.sha256(t.encode()).hexdigest()) for d, t in want.items()}


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    x, rows = "a line that stands in many documents", []
    rows += [(1, f"{x}\nfirst"), (5, f"{x}\nunique one of five"), (5, f"unique two of five\n{x}"), (None, f"unique of none\n{x}"), (None, f"{x}\nanother of none"), (5, f"{x}\nunique one of five"), ((1 << 63) - 1, f"{x}\nlast")]
    d = spark.createDataFrame([(i, t, "n", "t") for i, t in rows], "doc_id long, text string, __near string, th string").repartition(3)
    got = sorted((r for r in lines.deduplicated(d, exact=1).collect()), key=str)
    want = [(i, t if i == 1 else t.replace(f"{x}\n", "").replace(f"\n{x}", ""), "n", "t") for i, t in rows]
    assert got == sorted([spark.createDataFrame([w], d.schema).first() for w in want], key=str)


def test_pieces_come_back(spark, docs):
    got = pieces.decoded(pieces.encoded(docs)).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in got} == want


def test_pieces_have_the_best_score():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    c = pieces.Coder()
    table = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    for text in ("the house", "unquestionably", "a", "tion  tion", "naïve\nx"):
        s = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e300] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = best[e - 1] + c.rare * len(s[e - 1].encode())
            for b in range(e):
                if s[b:e] in table:
                    best[e] = max(best[e], best[b] + table[s[b:e]])
        got = sum(c.rare if p.is_byte(i) else p.get_score(i) for i in c.encode(text))
        assert abs(got - best[-1]) < 1e-3


def test_mix(spark, folder):
    rows = mixing.op9_mixing(spark, folder).collect()
    assert all(r.taken <= 2 * r.size for r in rows) and all(r.target <= 2 * r.source_size for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows) + 1e-9
    assert sorted(rows, key=str) == sorted(mixing.op9_mixing(spark, folder).collect(), key=str)


def test_mix_comes_near_its_targets(spark):
    d = mixing.op9_mixing(spark, "/root/testdata/sf0.01").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.first("source_size").alias("n"))
    r = d.collect()
    assert abs(sum(x.taken for x in r) / sum(x.target for x in r) - 1) < 0.05


def test_languages_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = langid.op1_langid(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_letterless_texts_are_undetermined(spark, folder, texts):
    got = {r.doc_id: r.lang_pred for r in langid.op1_langid(spark, folder).collect()}
    assert {k: got[k] == "und" for k in range(len(texts))} == {k: t is None or not any(c.isalpha() for c in t) for k, t in enumerate(texts)}


def plain_fingerprint(spark, texts):
    """Winnowing by loops, from the characters' own hashes."""
    chars = sorted({c for t in texts for c in t})
    table = {r.c: r.h for r in spark.createDataFrame([(c,) for c in chars], "c string").select("c", F.xxhash64("c").alias("h")).collect()}
    whole = {r.c: r.h for r in spark.createDataFrame([(re.sub("[\x20\x09-\x0d]", "", t),) for t in texts], "c string").select("c", F.xxhash64("c").alias("h")).collect()}
    ones = (1 << 64) - 1

    def marks(text):
        t = re.sub("[\x20\x09-\x0d]", "", text)
        if len(t) < 8:
            return [(whole[t] & ones, 0)] if t else []
        runs = []
        for i in range(len(t) - 7):
            h = 0
            for c in t[i : i + 8]:
                h = (h << 1 & ones) ^ (table[c] & ones)
            runs.append(h)
        out = []
        for i in range(max(1, len(runs) - 7)):
            at = min(range(i, min(i + 8, len(runs))), key=lambda k: (runs[k] >> 31 & (1 << 32) - 1, -k))
            if (runs[at], at) not in out:
                out.append((runs[at], at))
        return out

    return marks


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_against_plain_winnowing(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 2, 5, 9, 30, 60, 200)] + ["", " \n", "aaaaaaaa" * 9, "One", "\U0001f600 text\x00 Ü" * 7, "x" * 29, "y" * 31 + "z" * 15]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), "unquestionably extraordinary", texts[5]]
    ids = [k * k for k in range(len(texts) - 1)] + [10**15]
    spark.createDataFrame([*zip(ids, texts, strict=True), (None, "of no id"), (None, None)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    marks = plain_fingerprint(spark, texts + edits)
    show = lambda m: "[" * bool(m) + ", ".join(f"{{{h - (h >> 63 << 64)}, {at}}}" for h, at in m) + "]" * bool(m)
    got = {r.doc_id: r for r in fingerprint.op10_fingerprints(spark, str(tmp_path)).collect()}
    for k, i in enumerate(ids):
        own, edited, after = marks(texts[k]), marks(edits[k]), marks(texts[(k + 1) % len(texts)])
        assert (got[i].fingerprint, got[i].edited_fingerprint, got[i].n_chars) == (show(own), show(edited), len(texts[k]))
        assert got[i].edited_sha256 == hashlib.sha256(edits[k].encode()).hexdigest()
        assert abs(got[i].near_edited - alike(own, edited)) < 1e-12 and abs(got[i].near_next - alike(own, after)) < 1e-12
    assert 0 <= got[None].near_next <= 1 and got[ids[5]].fingerprint == got[ids[-1]].fingerprint


def test_blocks_at_quantiles_of_ids(spark):
    ids = [*range(0, 6000, 2), 1 << 60]
    d = fingerprint.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, t string"), "t", block=100)
    assert {r.doc_id: r.next.t for r in d.collect()} == {i: str(n) for i, n in zip(ids, ids[1:] + ids[:1], strict=True)}


def luhn(x):
    d = [int(c) for c in x][::-1]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    t = 'a.b@c.example.com 2024-02-29 10.1.2.3 +1 (017) 555-7713 4111111111111111 4111111111111112 123-45-6789 "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    d = spark.createDataFrame([(1, t), (2, "card 4111111111111111."), (3, None), (4, "on 2024-02-30 at 999.1.1.1")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(d).collect()}
    got = rows[1].text.split(" ")
    assert got[0].endswith("@c.example.com") and not set(got) & (set(t.split(" ")) - {"+1", "4111111111111112"})
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", got[1]) and re.fullmatch(r"\(\d{3}\)", got[4]) and re.fullmatch(r"\d{3}-\d{4}", got[5])
    assert luhn(got[6]) and got[7] == "4111111111111112" and rows[2].text == f"card {got[6]}."
    assert all(int(x) < 256 for x in got[2].split(".")) and rows[3].text is None and rows[4].text == "on 2024-02-30 at 999.1.1.1"


def test_pseudonyms_are_permutations(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    assert d.select(pseudonyms.digits_permuted(F.col("x"), F.lit("t"), "k").alias("y")).distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("x"))
    assert days.select(pseudonyms._date(F.col("x"), "k").alias("y")).where("y is not null").distinct().count() == 3000


def plain_characters(x, alphabets, tag, key):
    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    for k in range(8):
        half, other, out = (left, right, "") if k % 2 == 0 else (right, left, "")
        for i, c in enumerate(half):
            d = hashlib.sha256(f"{key}|{tag}|{len(x)}|{k}|{i // 16}|{other}".encode()).hexdigest()[i % 16 * 4 :][:4]
            a = next((a for a in alphabets if c in a), None)
            out += a[(a.index(c) + int(d, 16)) % len(a)] if a else c
        left, right = (out, right) if k % 2 == 0 else (left, out)
    return left + right


def test_characters_against_a_plain_network(spark):
    rng = random.Random(2)
    every = [pseudonyms.LOWER, pseudonyms.UPPER, pseudonyms.DIGITS]
    xs = ["a", "Z", "7", "a.b+c", "", "j.Doe_99"] + ["".join(rng.choice("abcXYZ019._") for _ in range(n)) for n in (2, 15, 16, 17, 33, 70)] + [f"{a}{b}" for a in "abcdef" for b in pseudonyms.LOWER]
    d = spark.createDataFrame([(x,) for x in xs], "x string").select("x", pseudonyms.characters_permuted(F.col("x"), every, "mail", "k").alias("y"))
    got = {r.x: r.y for r in d.collect()}
    assert got == {x: plain_characters(x, every, "mail", "k") for x in xs} and len(set(got.values())) == len(set(xs))


def test_keys_of_pseudonyms(spark):
    d = spark.createDataFrame([(1, "write to jane.doe@x.example")], "doc_id long, text string")
    texts = [pseudonyms.pseudonymised(d, key=k).first().text for k in (None, None, "a", "b")]
    assert texts[0] == texts[1] and len(set(texts)) == 3 and all(re.fullmatch(r"write to [a-z]{4}\.[a-z]{3}@x\.example", t) for t in texts)


def test_boilerplate_of_a_host(spark):
    rng = random.Random(1)
    rows = [(k, "Follow us on all our channels now and every day please\n" + prose(rng, 30), "h" if k < 40 else f"o{k}") for k in range(60)] + [(99, "Follow us on all our channels now and every day please\n" * 2 + "w1 w2", "h")]
    d = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert d[0].n_boilerplate_words == 11 and d[50].n_boilerplate_words == 0 and d[0].kept and not d[99].kept


def test_licence_notices(spark):
    d = spark.createDataFrame([(1, "some text\nReleased under the MIT license\nmore"), (2, None), (3, licences.TEMPLATES[1][1].replace(". ", ".\n"))], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scanned(d).collect()}
    assert got == {1: "MIT", 2: None, 3: "Apache-2.0"}


@pytest.mark.parametrize("name, disclaimer", [("BSD-3-Clause", licences.BSD_DISCLAIMER), ("MIT", licences.MIT_DISCLAIMER), ("ISC", licences.ISC_DISCLAIMER)])
def test_whole_licence_files(spark, name, disclaimer):
    granted = next(t for n, t in licences.TEMPLATES if n == name and len(t) > 100)
    text = f"{name} License\n\nCopyright (c) 2020, Jane Doe. All rights reserved.\n\n" + granted.replace(". ", ".\n\n") + "\n\n" + disclaimer.replace(", ", ",\n")
    r = licences.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licence == name and r.dice > 0.9


def test_licences_with_other_or_many_separators(spark, same, tmp_path):
    wrapped = "Licensed under\nthe MIT License.\n"
    texts = ["Licensed\nunder\nthe\nMIT\nLicense.", "Licensed\tunder\tthe\tMIT\tLicense.", "\n".join(" " * 35 + x for x in ["Licensed under", "the MIT License."] + ["//"] * 10), wrapped * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.licence, r.dice) for r in licences.op3_licences(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(range(4), "MIT") and got[0][1] == got[1][1] == got[2][1] == 1.0


def plain_pipeline(model, rows):
    """Rows (doc_id, text, source) through the five stages by plain loops; -> sorted (doc_id, ids)."""
    rows = [r for r in rows if model.predict(r[1])[2]]
    # lines
    places = [(i, k, re.sub("[\x20\x09-\x0d]+", " ", x.lower()).strip(" ")) for i, t, _ in rows for k, x in enumerate(t.split("\n"))]
    first = {}
    for i, k, x in sorted(places):
        first.setdefault(x, (i, k))
    near = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and first[y] < first[x] and one_edit(x, y) for y in first)}
    gone = {(i, k) for i, k, x in places if x and (x in near or first[x] != (i, k))}
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), s) for i, t, s in rows]
    rows = [c for c, r in zip(cut, rows, strict=True) if c[1] == r[1] or word_list(c[1])]
    # near duplicates
    sets = []
    for _, t, _ in rows:
        w = word_list("".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    rows = [r for k, r in enumerate(rows) if up[k] == k]
    # mix
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(word_list(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), list(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    coder, out = pieces.Coder(), []
    for i, t, s in rows:
        rate = min(2.0, target[s] / size[s]) if size[s] else 0.0
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, tuple(coder.encode(t)))] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    real = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").orderBy("doc_id").collect() if r.text]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in real]
    base = real[0].text.replace("\n", " ")
    rows += [(500 + k, f"{base} {k}", real[0].lang, "s9") for k in range(4)] + [(600, real[3].text, real[3].lang, None), (601, "qzx9 wvk#7 " * 30, None, "s9"), (602, None, None, "s9"), (603, "", None, "s9"), (604, real[5].text.split("\n")[0], real[5].lang, "s9")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, row string, id int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(langid.sample(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert not model.predict("qzx9 wvk#7 " * 30)[2] and model.predict(real[0].text)[2]
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_pipeline(model, [(i, t, s) for i, t, _, s in rows])


def test_pipeline_of_odd_tables(spark, tmp_path, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    text = "the house stands on the hill and the road goes down to the river " * 4
    rows = [(None, None, None, None)] * 2 + [(7, text, "en", None), (7, text, "en", None), (7, text + "near the old mill where nobody has lived since", "en", "s"), (None, "", "en", "s"), (None, text, "en", "s")]
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, __id int, __near int, p int").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.round_trip for r in got)


def test_language_rejection_and_long_texts(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 4000) if k % 2 else " ".join(rng.choice(("le", "chat", "noir", "dort", "sur", "la", "table")) for _ in range(30)), "xx" if k % 2 else "fr") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample(docs)
    assert {g for _, g in sample} == {"xx", "fr"} and max(len(t) for t, _ in sample) <= langid.MOST_CHARS
    model = langid.fit(sample)
    assert [r[:1] for r in model.predict_many([t for _, t, _ in rows])] == [(g,) for _, _, g in rows]
    texts = ["", None, "ЖЩЫ бвгд " * 20, rows[0][1]]
    assert [m[2] for m in model.predict_many(texts)] == [False, False, False, True]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] for a, b in zip(model.predict_many(texts), map(model.predict, texts), strict=True))


def test_workers_get_small_batches(spark, folder):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    neardup.op6_neardup(spark, folder).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == batches.ROWS_AT_ONCE <= 1000


def test_tables_of_parts_are_bounded():
    coder, plain = pieces.Coder(most=5), pieces.Coder()
    texts = ["one two three four five six seven eight nine ten " * 3, "four nine two"]
    assert [coder.encode(t) for t in texts] == [plain.encode(t) for t in texts]
    assert len(coder.kept) <= 5 and len(coder.older) <= 5 < len(plain.kept)


def test_edited_marks_from_both_texts(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    rows = [(k, some(m), some(q), some(rng.randrange(40))) for k, (m, q) in enumerate([(0, 0), (0, 70), (5, 61), (28, 60), (29, 59), (30, 100), (200, 64), (200, 0), (90, 20), (61, 300)])]
    rows += [(99, "a" * 100, "a" * 100, "a")]
    d = spark.createDataFrame(rows, "k int, h string, g string, more string")
    d = d.select("*", fingerprint.chosen(F.concat("h", "more")).alias("old"), fingerprint.chosen(F.concat("g", "more")).alias("new"), F.concat("h", "g").alias("t"))
    d = d.select("k", fingerprint.rewinnowed(F.col("old"), F.length("h"), F.col("t"), F.col("new")).alias("got"), fingerprint.chosen(F.col("t")).alias("want"))
    assert [r.k for r in d.collect() if r.got != r.want] == []

"""Language identification by nearest centroids.

Texts become vectors of hashed character n-grams (1 to 3), log term frequency times inverse document
frequency, of length one. Every language has a few centroids, clustered by spherical k-means from a
sample of its labelled rows; a text gets the language of the centroid of greatest cosine. A
text is accepted if that cosine is no lower than what pieces of known texts of its length reach,
less a margin; else it is rejected as no text of a known language.

The model is fitted on a bounded sample: for each language the rows with the smallest hashes of their id,
PER_LANGUAGE at most and one at least, MOST_ROWS in all (or one a language, if there are more of them), and of
each a window of MOST_CHARS code points at a hashed place; so the driver holds about 300 MB at most.
Predictions use whole texts and nothing but the text.

Defined results: a null text or one without a letter is `und` with score 0.0 and not accepted; a null id
counts as the text "null" for the fold; rows that repeat are predicted alike; equal cosines
go to the language first by code point; without a labelled row all are `und`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

SIZE = 1 << 13
PER_LANGUAGE, MOST_ROWS, MOST_CHARS = 300, 4000, 4000
#: Texts that are compared with all centroids in one matrix product.
BATCH = 256
CLUSTERS, MARGIN = 3, 0.5
LETTER = re.compile(r"[^\W\d_]")
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams; digits and spaces count as one character each."""
    text = re.sub(r"[\s\d]+", " ", f" {text.lower()} ")
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = np.zeros(SIZE), np.zeros(len(c), np.uint32)
    for n, factor in enumerate(FACTORS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] ^ (c[n:] + np.uint32(n * 7919))) * np.uint32(factor)
        h ^= h >> np.uint32(15)
        out += np.bincount((h >> np.uint32(7)) % np.uint32(SIZE), minlength=SIZE)
    return out


def bucket(n: int) -> int:
    return min(int(max(n, 1)).bit_length(), 13)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # by bucket of length

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)) * self.idf
        return v / (np.sqrt(v @ v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        cosines = self.centroids @ self.vector(text)
        return self.judged(cosines, len(text))

    def judged(self, cosines: np.ndarray, length: int) -> tuple[str, float, bool]:
        k = int(np.argmax(cosines))
        score = float(min(max(cosines[k], 0.0), 1.0))
        return self.languages[k], score, bool(score >= self.least[bucket(length)])

    def predict_many(self, texts: list) -> list[tuple[str, float, bool]]:
        """predict of each text, BATCH of them in one matrix product."""
        out = [("und", 0.0, False)] * len(texts)
        real = [i for i, t in enumerate(texts) if t is not None and self.languages and LETTER.search(t)]
        for at in range(0, len(real), BATCH):
            part = real[at : at + BATCH]
            v = np.stack([self.vector(texts[i]) for i in part])
            for i, cosines in zip(part, v @ self.centroids.T, strict=True):
                out[i] = self.judged(cosines, len(texts[i]))
        return out


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and the rows farthest from those chosen."""
    mean = v.mean(0)
    picks = [int(np.argmax(v @ mean))]
    while len(picks) < min(k, len(v)):
        picks.append(int(np.argmin((v @ v[picks].T).max(1))))
    c = v[picks]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, 1)
        c = np.stack([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, str]], clusters: int = CLUSTERS, margin: float = MARGIN) -> Model:
    """rows: (text, language) with a letter in the text."""
    rows = sorted(((t, g) for t, g in rows if LETTER.search(t)), key=lambda r: (r[1], r[0]))
    if not rows:
        return Model([], np.zeros((0, SIZE)), np.ones(SIZE), np.zeros(14))
    tf = np.stack([np.log1p(counts(t)).astype(np.float32) for t, _ in rows])
    model = Model([], np.zeros((0, SIZE)), np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1, np.zeros(14))
    v = tf * model.idf.astype(np.float32)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    names = np.array([g for _, g in rows])
    parts = []
    for g in sorted(set(names)):
        c = clustered(v[names == g], clusters)
        parts.append(c)
        model.languages += [g] * len(c)
    model.centroids = np.concatenate(parts)
    # what pieces of each length reach: the least bar is a part of nearly the worst of them
    rng = np.random.default_rng(7)
    for b in range(14):
        got = []
        for i in rng.permutation(len(rows))[:400]:
            t, n = rows[i][0], 3 << max(b - 2, 0)
            at = int(rng.integers(0, max(1, len(t) - n + 1)))
            piece = t[at : at + n]
            if LETTER.search(piece):
                got.append(float((model.centroids @ model.vector(piece)).max()))
        model.least[b] = margin * float(np.quantile(got, 0.01)) if got else 0.0
    model.least = np.minimum.accumulate(model.least[::-1])[::-1]
    return model


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """Labelled rows of the learning folds. Counts of each language set a bar that ids' hashes must stay under."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    n = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not n:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(n)))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), F.lit(1 << 40)) / float(1 << 40)
    bars = F.create_map(*[x for g, c in n.items() for x in (F.lit(g), F.lit(min(1.0, (1.5 * per_language + 20) / c)))])
    start = F.pmod(F.xxhash64(F.col(text_col)), F.greatest(F.length(text_col) - MOST_CHARS, F.lit(0)) + 1).cast("int") + 1
    window = F.substring(F.col(text_col), start, F.lit(MOST_CHARS))
    rows = known.where(draw < bars[F.col(lang_col)]).select(draw.alias("d"), window.alias("t"), F.col(lang_col))
    rows = rows.orderBy("d", F.xxhash64("t")).limit(2 * len(n) * (per_language + 20)).collect()
    taken, out = dict.fromkeys(n, 0), []
    for _, t, g in rows:
        if taken[g] < per_language:
            taken[g] += 1
            out.append((t, g))
    return out


def predictor(spark, model: Model):
    """A pandas UDF text -> struct<lang, score, accepted>."""
    sent = spark.sparkContext.broadcast((model.languages, model.centroids, model.idf, model.least))

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = Model(*sent.value)
        return pd.DataFrame(m.predict_many(list(texts)), columns=["lang", "score", "accepted"])

    return predict


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    predict = predictor(spark, fit(sample(docs)))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model accepts."""
    predict = predictor(spark, fit(sample(docs)))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict("text").alias("p")).where("p.accepted")
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

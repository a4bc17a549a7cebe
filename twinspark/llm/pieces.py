"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position the matches that end
there, found along its output links, relax the best score of that position (Viterbi). Characters
that no piece covers are spelt in byte pieces, so each text comes back as it was.

No piece has a space mark behind another character, and characters that are in no piece stand alone:
at both, the best path of a text is that of its parts in a row, so parts are encoded one by one and
a bounded table keeps those seen. A vocabulary where this doesn't hold is read in whole texts.

Defined results: a null text has null ids and counts of 0; an empty text has none. The mark itself,
if a text has it, is spelt in bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .common import read

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts in each of the two tables of a worker, if nothing else is said; when the newer one is full it becomes the older one.
KEPT = 400_000


class Coder:
    def __init__(self, path: str = VOCABULARY, most: int = KEPT):
        import ahocorasick
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.get_piece_size()
        self.bytes, self.table, scores, pieces = [0] * 256, [b""] * size, [0.0], {}
        for i in range(size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                pieces[piece] = (i, len(piece), p.get_score(i))
                self.table[i] = piece.replace(MARK, " ").encode()
                scores.append(p.get_score(i))
        self.rare = min(scores) - 10.0  # of each byte piece
        self.automaton = ahocorasick.Automaton()
        for piece, entry in pieces.items():
            self.automaton.add_word(piece, entry)
        self.automaton.make_automaton()
        apart = all(MARK not in x.lstrip(MARK) for x in pieces)
        known = set("".join(pieces))
        self.alone = {c for c in "\n\t\r" if c not in known}
        stop = re.escape("".join(sorted(self.alone)))
        self.split = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + f"|[{stop}]" * bool(stop)).findall if apart else lambda s: [s]
        self.most = most
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def spelt(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()]

    def part(self, s: str) -> list[int]:
        """Best ids of one part."""
        n = len(s)
        best, back, own = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here have their best score

        def fill(upto):  # by a character in bytes, where no piece got there
            for k in range(done + 1, upto + 1):
                b = best[k - 1] + self.rare * len(s[k - 1].encode("utf-8", "replace"))
                if b > best[k]:
                    best[k], back[k], own[k] = b, k - 1, -1

        for end, (i, length, score) in self.automaton.iter(s):
            end += 1
            if end - 1 > done:
                fill(end - 1)
                done = end - 1
            x = best[end - length] + score
            if x > best[end]:
                best[end], back[end], own[end] = x, end - length, i
        fill(n)
        out, k = [], n
        while k:
            out += [own[k]] if own[k] >= 0 else self.spelt(s[k - 1])[::-1]
            k = back[k]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        kept, out = self.kept, []
        for k, run in enumerate(text.split(MARK)):
            if k:
                out += self.spelt(MARK)
            for x in self.split(("" if k else MARK) + run.replace(" ", MARK)):
                ids = kept.get(x)
                if ids is None:
                    ids = self.older.get(x) or tuple(self.part(x))
                    if len(x) < 64:
                        if len(kept) >= self.most:
                            self.older, self.kept = kept, {}
                            kept = self.kept
                        kept[x] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "replace")


def _coded(path: str, whole: bool, most: int = KEPT):
    def run(batches):
        coder = Coder(path, most)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, same, digests = [], [], []
                for text in part.column(1).to_pylist():
                    got = None if text is None else coder.encode(text)
                    same.append(text is None or coder.decode(got) == text)
                    digests.append(None if got is None else hashlib.sha256(np.array(got, "<i4").tobytes()).hexdigest())
                    ids.append(got if whole else None if got is None else len(got))
                kind = pa.list_(pa.int32()) if whole else pa.int64()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kind), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "ids_sha256", "round_trip"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, whole: bool = True, most: int = KEPT) -> DataFrame:
    """Per document: doc_id, ids (with whole, else their number), a digest of them, and whether decoding gives the text."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_coded(vocabulary, whole, most), f"doc_id long, ids {'array<int>' if whole else 'long'}, ids_sha256 string, round_trip boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens(doc_id, ids) -> (doc_id, text)."""

    def run(batches):
        coder = Coder(vocabulary)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    out = encoded(read(spark, sf_dir), whole=False)
    return out.select("doc_id", F.coalesce("ids", F.lit(0)).alias("n_tokens"), "ids_sha256", "round_trip")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix. Smaller tables of parts: an executor still holds what the stages before took."""
    out = encoded(docs, most=KEPT // 4)
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "round_trip")

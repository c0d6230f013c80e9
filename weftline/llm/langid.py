"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import read_ranks
from weftline.session import carried, in_parts

#: Labelled documents per language that a fit reads at most, whole, in order of a hash of the id.
SAMPLE_PER_LANG = 120
#: Letter runs up to this length are summed in plain numbers, many at a time, longer ones in logarithms.
PLAIN = 32
ROUNDS = 2
UNKNOWN = 1e-9
MEMO = 500_000
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LETTERS = re.compile(r"[^\W\d_]+")


def public_pieces(path: str) -> list[str]:
    """The lower-cased letter strings among the pieces of a rank file."""
    found = set()
    for raw in read_ranks(path):
        try:
            piece = raw.decode("utf-8").strip().lower()
        except UnicodeDecodeError:
            continue
        if piece.isalpha():
            found.add(piece)
    return sorted(found)


def letter_runs(text: str) -> Counter:
    """Letter runs of the lower-cased text with their counts."""
    return Counter(LETTERS.findall(text.lower()))


class Pieces:
    """The vocabulary as sorted 64-bit polynomial hashes of code points, with a bitmap before them."""

    def __init__(self, pieces: list[str]):
        h = np.zeros(len(pieces), np.uint64)
        self.longest = max(map(len, pieces), default=1)
        for m in range(self.longest):
            c = np.array([ord(s[m]) if m < len(s) else 0 for s in pieces], np.uint64)
            h = np.where(c > 0, h * FACTOR + c, h)
        self.order = np.argsort(h)
        self.hashes, self.n = h[self.order], len(pieces)
        self.present = np.zeros(1 << 22, bool)
        self.present[(h * SPREAD >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, -1 where the vocabulary lacks it."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.present[(h * SPREAD >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), max(self.n - 1, 0))
        if self.n:
            hit = self.hashes[at] == h[maybe]
            out[maybe[hit]] = self.order[at[hit]]
        return out


class Lattice:
    """All segmentations of a list of words, as edges sorted by end and word."""

    def __init__(self, words: list[str], pieces: Pieces):
        n = len(words)
        self.length = np.fromiter(map(len, words), np.int64, n)
        width = int(self.length.max()) if n else 0
        chars = np.array(words, f"U{max(width, 1)}").view(np.uint32).reshape(n, max(width, 1)).astype(np.uint64)
        found = []
        h = np.zeros_like(chars)
        for m in range(1, min(pieces.longest, width) + 1):
            h = h[:, : width - m + 1] * FACTOR + chars[:, m - 1 :]
            owner, start = np.nonzero(np.arange(width - m + 1)[None, :] + m <= self.length[:, None])
            piece = pieces.find(h[owner, start])
            if m == 1:
                piece = np.where(piece < 0, pieces.n, piece)
            hit = piece >= 0
            found.append((owner[hit], start[hit], start[hit] + m, piece[hit]))
        self.owner, self.start, self.stop, self.piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.argsort(self.stop * max(n, 1) + self.owner, kind="stable")
        self.owner, self.start, self.stop, self.piece = (x[order] for x in (self.owner, self.start, self.stop, self.piece))
        self.bounds = np.searchsorted(self.stop, np.arange(1, width + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: the probability of each prefix, over all segmentations."""
        a = np.zeros((len(self.length), len(self.bounds), p.shape[1]))
        a[:, 0] = 1.0
        for j in range(1, len(self.bounds)):
            e = slice(self.bounds[j - 1], self.bounds[j])
            own = self.owner[e]
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                a[own[first], j] = np.add.reduceat(a[own, self.start[e]] * p[self.piece[e]], first, axis=0)
        return a

    def totals(self, a: np.ndarray) -> np.ndarray:
        return a[np.arange(len(self.length)), self.length]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, words weighted by ``counts``."""
        a = self.forward(p)
        z = self.totals(a)
        b = np.zeros_like(a)
        b[np.arange(len(self.length)), self.length] = np.divide(counts, z, out=np.zeros_like(z), where=z > 0)
        out = np.zeros_like(p)
        for j in range(len(self.bounds) - 1, 0, -1):
            e = slice(self.bounds[j - 1], self.bounds[j])
            own, begin, piece = self.owner[e], self.start[e], self.piece[e]
            if len(own):
                up = b[own, j] * p[piece]
                gain = a[own, begin] * up
                for g in range(p.shape[1]):
                    out[:, g] += np.bincount(piece, gain[:, g], len(out))
                    b[:, :, g] += np.bincount(own * b.shape[1] + begin, up[:, g], b.shape[0] * b.shape[1]).reshape(b.shape[:2])
        return out


def long_edges(word: str, pieces: Pieces) -> np.ndarray:
    """edges[j, m]: the piece of m + 1 letters that ends behind letter j, or -1; single unknown letters have the last row."""
    n = len(word)
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edges = np.full((n, min(pieces.longest, n)), -1, np.int64)
    h = np.zeros(n, np.uint64)
    for m in range(edges.shape[1]):
        h = h[: n - m] * FACTOR + chars[m:]
        edges[m:, m] = pieces.find(h)
    edges[:, 0] = np.where(edges[:, 0] < 0, pieces.n, edges[:, 0])
    return edges


def long_forward(edges: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log alpha[position, language] of a run of any length: over all segmentations, as ``Lattice.forward``."""
    a = np.zeros((len(edges) + 1, logs.shape[1]))
    for j, row in enumerate(edges):
        m = np.flatnonzero(row >= 0)
        x = a[j - m] + logs[row[m]]
        top = x.max(axis=0)
        a[j + 1] = top + np.log(np.exp(x - top).sum(axis=0))
    return a


def long_expected(edges: np.ndarray, logs: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected uses of each piece in a long run that each language has ``counts`` times."""
    a = long_forward(edges, logs)
    b = np.full_like(a, -np.inf)
    b[-1] = 0.0
    for j in range(len(edges) - 1, -1, -1):
        m = np.flatnonzero(edges[j] >= 0)
        up = b[j + 1] + logs[edges[j, m]]
        np.add.at(out, edges[j, m], np.exp(a[j - m] + up - a[-1]) * counts)
        b[j - m] = np.logaddexp(b[j - m], up)


class Model:
    """Piece probabilities by language over a fixed vocabulary; the last row is the unknown letter."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray):
        self.langs, self.pieces, self.p = langs, Pieces(pieces), p
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))
        self.used = 0

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "rows": self.rows[:0], "used": 0}

    def learn(self, words: list[str]) -> None:
        """Log probabilities of words that the memo lacks, all in one lattice."""
        if self.used + len(words) > MEMO:
            self.memo, self.used = {}, 0
        new = sorted((w for w in words if w not in self.memo), key=len)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            lattice = Lattice(part, self.pieces)
            z = np.log(np.maximum(lattice.totals(lattice.forward(self.p)), 1e-300))
            while self.used + len(part) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros((max(len(self.rows), 50_000), z.shape[1]))])
            self.rows[self.used : self.used + len(part)] = z
            self.memo.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        counted = [letter_runs(t) if t else Counter() for t in texts]
        words = set().union(*counted)
        self.learn([w for w in words if len(w) <= PLAIN])
        long = {w: long_forward(long_edges(w, self.pieces), np.log(self.p))[-1] for w in words if len(w) > PLAIN}
        out = []
        for c in counted:
            if not any(ch.isalpha() for w in c for ch in w):
                out.append(("und", 0.0))
                continue
            plain = [w for w in c if len(w) <= PLAIN]
            s = np.fromiter((c[w] for w in plain), float, len(plain)) @ self.rows[np.fromiter(map(self.memo.__getitem__, plain), np.int64, len(plain))]
            s = s + sum(c[w] * long[w] for w in c if len(w) > PLAIN)
            e = np.exp(s - s.max())
            k = int(np.argmax(s))
            out.append((self.langs[k], float(e[k] / e.sum())))
        return out


def fit(labelled: DataFrame, path: str, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from (doc_id, text, lang): EM over all segmentations of the sample's words.

    The sample is bounded: at most ``per_lang`` whole documents of each language, the first in
    order of a hash of the id. Ids are chosen on narrow rows; words are counted by the executors, and
    the driver gets the counts, which grow with the number of languages only. Null texts and null
    languages teach nothing; repeated rows take one place and teach once. No rows: a model without languages.
    """
    labelled = labelled.select("doc_id", "text", "lang")
    narrow = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h")).distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = narrow.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("doc_id", "lang", "h")
    texts = labelled.join(F.broadcast(chosen.withColumnRenamed("lang", "_l").withColumnRenamed("doc_id", "_i")), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("doc_id", "text") == F.col("h")) & (F.col("lang") == F.col("_l")))
    texts = texts.groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).select("lang", "text")  # a repeated row teaches once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total.setdefault(lang, Counter()).update(letter_runs(text))
        yield pd.DataFrame([(g, w, n) for g, c in total.items() for w, n in c.items()], columns=["lang", "word", "n"])

    words = texts.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(words["lang"]))
    pieces = sorted(set(public_pieces(path)) | {c for w in set(words["word"]) for c in w})
    vocabulary = sorted(words["word"].unique().tolist(), key=lambda w: (len(w), w))
    plain = sum(len(w) <= PLAIN for w in vocabulary)
    at = {w: i for i, w in enumerate(vocabulary)}
    counts = np.zeros((len(vocabulary), len(langs)))
    counts[words["word"].map(at).to_numpy(int), words["lang"].map({g: i for i, g in enumerate(langs)}).to_numpy(int)] = words["n"]
    index = Pieces(pieces)
    lengths = np.array([len(s) for s in pieces] + [1])
    p = np.repeat((0.02 ** np.minimum(lengths, 4))[:, None], max(len(langs), 1), axis=1)
    for _ in range(ROUNDS if langs else 0):
        found = np.zeros_like(p)
        for i in range(0, plain, 20_000):
            n = min(i + 20_000, plain)
            found += Lattice(vocabulary[i:n], index).expected(p, counts[i:n])
        for w, n in zip(vocabulary[plain:], counts[plain:], strict=True):
            long_expected(long_edges(w, index), np.log(p), n, found)
        p = (found + 0.01) / (found.sum(axis=0) + 0.01 * len(p))
        p[-1] = UNKNOWN
    return Model(langs, pieces, p)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score (the posterior, all languages equally likely before).

    Null texts and texts without a letter: ``und``, 0; so is every text if no language was learned.
    Whole texts, one pass, no shuffle. Equal scores: the language first in code point order.
    Repeated rows: equal answers. No rows: no rows. A kept column named like a result comes back with
    ``_in`` behind its name.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    there, back = carried(keep, ["lang_pred", "score"])
    rows = docs.select(*there, docs["text"].alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text").tolist()
            got = [x for part in in_parts(texts) for x in shared.value.predict(texts[part])]
            batch["lang_pred"], batch["score"] = [g for g, _ in got], [s for _, s in got]
            yield batch

    return rows.mapInPandas(run, schema).select(*back, "lang_pred", "score")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.where(~F.coalesce(held_out, F.lit(False))), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])

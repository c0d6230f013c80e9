"""Byte-level BPE: a minimal perfect hash for known pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from weftline.session import carried, text_parts


#: Pre-tokens kept with their ids in one task before the memo starts anew.
MEMO = 500_000
#: Bytes of the texts whose results a task hands over at once.
PART = 1_000_000


class PerfectHash:
    """Hash-and-displace over a fixed set of byte strings: n keys, n slots, no empty slot.

    Keys fall into n/2 groups; large groups come first and search a displacement that sends all
    their keys to free slots; groups of one key take a free slot directly, written as a negative
    number. A lookup compares the whole key, so strangers are told apart for certain.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.groups = n, max(1, n // 2)
        h = self.hashes(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        group = (h % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(self.groups + 1))
        members = [order[starts[g] : starts[g + 1]] for g in range(self.groups)]
        self.shift = np.zeros(self.groups, np.int64)
        taken = np.zeros(n, bool)
        slot_of = np.empty(n, np.int64)
        single = []
        for g in sorted(range(self.groups), key=lambda g: -len(members[g])):
            m = members[g]
            if len(m) == 0:
                break
            if len(m) == 1:
                single.append((g, m[0]))
                continue
            d, s = self.search(h[m], taken)
            taken[s], slot_of[m], self.shift[g] = True, s, d
        for (g, k), s in zip(single, np.flatnonzero(~taken), strict=False):
            slot_of[k], self.shift[g] = s, -s - 1
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for k, s in enumerate(slot_of):
            self.keys[s] = keys[k]
            self.values[s] = values[k]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def place(self, h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        a, b = h >> np.uint64(17), (h >> np.uint64(41)) | np.uint64(1)
        return ((a + np.asarray(d).astype(np.uint64) * b) % np.uint64(self.n)).astype(np.int64)

    def search(self, h: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends all of ``h`` to different free slots, and these."""
        first, many = 0, 32
        while True:
            s = np.sort(self.place(h[None, :], np.arange(first, first + many)[:, None]), axis=1)
            good = np.flatnonzero(~taken[s].any(axis=1) & (np.diff(s, axis=1) > 0).all(axis=1))
            if len(good):
                d = first + int(good[0])
                return d, self.place(h, d)
            first, many = first + many, min(2 * many, 4096)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """The value of each key, -1 for a stranger."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = self.hashes(keys)
        d = self.shift[(h % np.uint64(self.groups)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self.place(h, np.maximum(d, 0)))
        own = self.keys
        return [v if own[s] == k else -1 for k, s, v in zip(keys, slots.tolist(), self.values[slots].tolist(), strict=True)]


def merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: pairs of a linked list of bytes leave a heap by rank, then position."""
    n = len(token)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(token[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or end[j] != stop or not alive[j]:
            continue  # one of the two has grown meanwhile
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            r = ranks.get(token[i : end[after[j]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if before[i] >= 0:
            r = ranks.get(token[before[i] : stop])
            if r is not None:
                heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = after[i]
    return tuple(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), pattern
        self.table = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.pieces[v] = k
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = MEMO
        self.compiled = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "compiled": None}

    def split(self, text: str) -> list[str]:
        if self.compiled is None:
            import regex

            self.compiled = regex.compile(self.pattern)
        return self.compiled.findall(text)

    def learn(self, words: set[str]) -> None:
        """Resolve pre-tokens that the memo lacks: all at once by the hash, misses by merging."""
        if len(self.memo) + len(words) > self.most:
            self.memo = {}
        new = [w for w in words if w not in self.memo]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, v in zip(new, raw, self.table.lookup(raw), strict=True):
            self.memo[w] = (v,) if v >= 0 else merge(b, self.ranks)

    def encode(self, text: str) -> array:
        words = self.split(text)
        self.learn(set(words))
        return array("I", chain.from_iterable(map(self.memo.__getitem__, words)))

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids.

    Each match of ``pattern`` is encoded by itself, without special tokens. One pass over whole
    texts, no shuffle; a task holds a batch of rows, the results of a part of it and its memo. Null and empty texts give no
    tokens; repeated rows the same ids; no rows no rows. ``memo`` bounds the pre-tokens a task remembers. Any text decodes to its own UTF-8 bytes.
    A kept column named like a result comes back with ``_in`` behind its name.
    """
    spark = docs.sparkSession
    codec = Codec(path, pattern)
    codec.most = memo
    shared = spark.sparkContext.broadcast(codec)
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    there, back = carried(keep, results)
    rows = docs.select(*there, docs["text"].alias("text"))
    names = [c for c in rows.columns if c != "text"]
    schema = rows.drop("text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        little = array("I", [1]).tobytes()[0] == 1
        for batch in batches:
            for part in text_parts(batch, "text", PART):  # results leave part by part, so a task holds one part's ids
                counts, ids_hash, text_hash, kept = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    counts.append(len(ids))
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                    if not little:
                        ids.byteswap()
                    ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                done = [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                if with_ids:
                    done.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*map(part.column, names), *done], [*names, *results])

    return rows.mapInArrow(run, schema).select(*back, *results)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])

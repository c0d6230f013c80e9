"""Frame pairs of a scene: their regions compared and assigned one to one, many scenes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.assign import MOST_COLUMNS, PAIRS_BELOW, best_pairs
from weftline.operators.tiles import tiled

#: Frames of a scene that share a chunk, on average.
FRAME_CHUNK = 256
#: Frame pairs, and region pairs, that a task looks at in one step.
FRAME_STEP, REGION_STEP = 1 << 20, 1 << 19
LEAST = 300_000_000


def billionths(score: np.ndarray) -> np.ndarray:
    """Scores rounded half up at their ninth digit, as the decimal number that Spark's ``round`` sees."""
    scaled = score * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4).tolist():
        out[i] = int(Decimal(repr(float(score[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))
    return out


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of items: the owner of each item and its number there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def chosen(i: list[int], j: list[int], v: list[int]) -> int:
    """The largest sum of values of edges no two of which share an end."""
    rows: dict[int, list[tuple[int, int]]] = {}
    place: dict[int, int] = {}
    for a, b, x in zip(i, j, v, strict=True):
        rows.setdefault(a, []).append((place.setdefault(b, len(place)), x))
    if len(place) > MOST_COLUMNS:
        score = np.zeros((len(rows), len(place)))
        for r, options in enumerate(rows.values()):
            for b, x in options:
                score[r, b] = max(score[r, b], x)
        return int(sum(score[x] for x in best_pairs(score)))
    table = {0: 0}
    for options in rows.values():
        after = dict(table)
        for mask, best in table.items():
            for b, x in options:
                if not mask >> b & 1 and after.get(mask | 1 << b, -1) < best + x:
                    after[mask | 1 << b] = best + x
        table = after
    return max(table.values())


def matchings(pair: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` pairs the value of its best one-to-one choice of edges; ``pair`` ascends.

    Edges that share no end need no choice, and of edges that all share one the best stands; what is
    left is settled pair by pair.
    """
    size = np.bincount(pair, minlength=n)
    best = np.zeros(n, np.int64)
    if not len(pair):
        return best
    start = np.cumsum(size) - size
    some = np.flatnonzero(size)
    total, largest = np.add.reduceat(v, start[some]), np.maximum.reduceat(v, start[some])

    def ends(x: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, pair))
        p, x = pair[order], x[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1])])
        return np.bincount(p[new], minlength=n)[some]

    di, dj = ends(i), ends(j)
    simple = (di == size[some]) & (dj == size[some])
    star = (di == 1) | (dj == 1)
    best[some] = np.where(simple, total, largest)
    for p in some[~simple & ~star].tolist():
        at = slice(start[p], start[p] + size[p])
        best[p] = chosen(i[at].tolist(), j[at].tolist(), v[at].tolist())
    return best


class Regions:
    """The regions of many frames as arrays, those of a frame side by side."""

    def __init__(self, regions: pa.StructArray):
        of = lambda name: regions.field(name)
        number = lambda name: of(name).to_numpy(zero_copy_only=False).astype(float)
        self.pos = of("pos").to_numpy(zero_copy_only=False).astype(np.int64)
        self.x1, self.y1, self.x2, self.y2 = (number(c) for c in ("x1", "y1", "x2", "y2"))
        # of two, the one that is no null, as Spark's least and greatest take them
        self.area = np.fmax(self.x2 - self.x1, 0.0) * np.fmax(self.y2 - self.y1, 0.0)
        words = of("w")
        self.known = words.is_valid().to_numpy(zero_copy_only=False)
        flat = words.flatten().dictionary_encode()
        self.count = np.zeros(len(words), np.int64)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.count[:] = lengths
        self.width = int(self.count.max(initial=0))
        self.words = np.full((len(words), self.width), -1, np.int32)
        self.words[np.arange(self.width)[None, :] < self.count[:, None]] = flat.indices.to_numpy(zero_copy_only=False)

    def scores(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Half the Dice coefficient of the words and half the overlap of the boxes."""
        common = np.zeros(len(p), np.int64)
        for a in range(self.width):
            left = self.words[p, a]
            for b in range(self.width):
                common += (left == self.words[q, b]) & (left >= 0)
        dice = 2.0 * common / np.maximum(self.count[p] + self.count[q], 1)
        w = np.fmax(np.fmin(self.x2[p], self.x2[q]) - np.fmax(self.x1[p], self.x1[q]), 0.0)
        h = np.fmax(np.fmin(self.y2[p], self.y2[q]) - np.fmax(self.y1[p], self.y1[q]), 0.0)
        inter = w * h
        union = self.area[p] + self.area[q] - inter
        overlap = np.divide(inter, union, out=np.zeros(len(p)), where=union > 0)
        return np.where(self.known[p] & self.known[q], 0.5 * dice + 0.5 * overlap, 0.0)


def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(a, b, n, d, best) of the frame pairs of a batch of tiles."""
    tiles = batch.column("frames")
    frames = tiles.flatten()
    sizes = tiles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tile = np.repeat(np.arange(len(sizes)), sizes)
    of = lambda name: frames.field(name)
    key = of("frame").to_numpy(zero_copy_only=False)
    n = of("n").to_numpy(zero_copy_only=False).astype(np.int64)
    own = of("own").to_numpy(zero_copy_only=False)
    coded = of("code").is_valid().to_numpy(zero_copy_only=False)
    code = of("code").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    lists = of("regions")
    regions = Regions(lists.flatten())
    lines = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(lines) - lines
    diagonal = (batch.column("_lo").to_numpy() == batch.column("_hi").to_numpy())[tile]
    # frames in order of their keys inside each tile, and how many come after each
    order = np.lexsort((key, tile))
    after = (np.cumsum(sizes)[tile] - 1 - np.arange(len(tile))).astype(np.int64)
    reach = np.cumsum(after)
    at = 0
    while at < len(order):
        end = max(int(np.searchsorted(reach, (reach[at - 1] if at else 0) + FRAME_STEP, "right")), at + 1)
        owner, number = expand(after[at:end])
        x, y = order[owner + at], order[owner + at + 1 + number]
        keep = (key[x] < key[y]) & (diagonal[x] | (own[x] != own[y]))
        x, y = x[keep], y[keep]
        at = end
        todo = np.cumsum(lines[x] * lines[y])
        low = 0
        while low < len(x):
            high = max(int(np.searchsorted(todo, (todo[low - 1] if low else 0) + REGION_STEP, "right")), low + 1)
            a, b = x[low:high], y[low:high]
            low = high
            pair, number = expand(lines[a] * lines[b])
            width = lines[b][pair]
            p, q = first[a][pair] + number // width, first[b][pair] + number % width
            score = regions.scores(p, q)
            near = np.flatnonzero(score >= 0.2999)
            value = billionths(score[near])
            edge = value >= LEAST
            near, value = near[edge], value[edge]
            best = matchings(pair[near], regions.pos[p[near]], regions.pos[q[near]], value * PAIRS_BELOW + 1, len(a))
            d = np.where(coded[a] & coded[b], np.bitwise_count(code[a] ^ code[b]), 63).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.array(np.maximum(n[a], n[b])), pa.array(d), pa.array(best)], names=["a", "b", "n", "d", "best"])


def frame_matches(frames: DataFrame) -> DataFrame:
    """(a, b, n, d, matched, total) of all pairs a < b of frames of one scene.

    ``frames``: scene, frame, n (regions), code (image hash) and regions (array of struct pos, w, x1,
    y1, x2, y2; w different words). Region pairs weigh words and overlap alike, rounded to nine
    digits; regions are assigned one to one so that the sum of scores of at least 0.3 is largest, of
    equal sums that of more pairs. ``d`` is the distance of the hashes, 63 where one is missing.

    A row of the shuffle is a tile of a scene, all of it unless it has very many frames; its pairs
    are made where they are compared, so the shuffle grows with frames, not with pairs.
    """
    rows = frames.where(F.col("scene").isNotNull())
    rows, _ = tiled(rows, ["scene"], "frame", FRAME_CHUNK)
    one = F.struct("frame", "n", "code", F.col("_own").alias("own"), "regions")
    rows = rows.groupBy("scene", "_lo", "_hi").agg(F.collect_list(one).alias("frames")).where(F.size("frames") > 1).select("_lo", "_hi", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from compare(batch)

    found = rows.mapInArrow(run, "a long, b long, n long, d int, best long")
    return found.select("a", "b", "n", "d", F.pmod("best", F.lit(PAIRS_BELOW)).alias("matched"), (F.floor(F.col("best") / PAIRS_BELOW) / 1e9).alias("total"))


#: What ``frame_outcomes`` counts in a frame, beside the sum of its own scores in billionths.
COUNTS = ("n", "given", "echo", "own", "content", "ok", "sure", "wrong", "mism")


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts of words with a space between: whether there is one, how many words it has, and all words in order."""
    lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), " ")
    return texts.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def outcomes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The counts of each frame of a batch: a word of a generated text meets the regions of its frame that have it."""
    lists = batch.column("regions")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    regions = lists.flatten()
    total = len(regions)
    frame = np.repeat(np.arange(len(sizes)), sizes)
    given, n_g, words_g = word_lists(regions.field("g"))
    known, n_t, words_t = word_lists(regions.field("t"))
    codes = pa.concat_arrays([words_g, words_t]).dictionary_encode()
    distinct, code = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of_g, of_t = np.repeat(np.arange(total), n_g), np.repeat(np.arange(total), n_t)
    key_g, key_t = frame[of_g] * distinct + code[: len(of_g)], frame[of_t] * distinct + code[len(of_g) :]
    order = np.argsort(key_t, kind="stable")
    key_t, of_t = key_t[order], of_t[order]
    low = np.searchsorted(key_t, key_g, "left")
    count = np.searchsorted(key_t, key_g, "right") - low
    reach, ends = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(n_g)])
    own, other = np.zeros(total, np.int64), np.zeros(total, np.int64)
    at = 0
    while at < total:
        end = max(int(np.searchsorted(reach[ends], reach[ends[at]] + REGION_STEP, "right")) - 1, at + 1)
        words = slice(ends[at], ends[end])
        at = end
        owner, number = expand(count[words])
        pair, common = np.unique(of_g[words][owner] * total + of_t[low[words][owner] + number], return_counts=True)
        i, j = pair // total, pair % total
        score = billionths(2.0 * common / np.maximum(n_g[i] + n_t[j], 1))
        same = i == j
        own[i[same]] = score[same]
        np.maximum.at(other, i[~same], score[~same])
    half = 500_000_000
    scored, good = given & known, own >= half
    sure = good & (own / 1e9 - other / 1e9 >= 0.1)
    ok = good & (sure | (own >= other))
    wrong = scored & ~ok & (other >= half)
    echo = regions.field("echo").fill_null(False).to_numpy(zero_copy_only=False)
    columns = (np.ones(total), given, given & echo, own, np.maximum(own, other) >= half, ok, sure, wrong, scored & ~ok & ~wrong)
    return pa.RecordBatch.from_arrays([pa.array(np.bincount(frame, c.astype(float), len(sizes)).astype(np.int64)) for c in columns], names=list(COUNTS))


def frame_outcomes(frames: DataFrame) -> DataFrame:
    """COUNTS of each row of ``regions`` (array of struct g, t, echo; g and t different words with a space between, or null).

    A region's text g is held against the t of its own and of all other regions by the Dice
    coefficient, rounded to nine digits. ``content`` counts regions whose text fits some region
    (0.5 or more), ``ok`` those whose own fits at least as well as any other, ``sure`` those where it
    does by 0.1, ``wrong`` those where only another fits, ``mism`` those where none does. Pairs exist
    only in the task that counts them, and only such as share a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield outcomes(batch)

    return frames.select("regions").mapInArrow(run, ", ".join(f"{c} long" for c in COUNTS))

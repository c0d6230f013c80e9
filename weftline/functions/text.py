"""Texts: tokens, similarity, structure, parsing."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TOKEN = "([a-z0-9]+)"
WORDS = re.compile(TOKEN)
#: Values that mean "absent".
ABSENT = ("unknown", "none", "no", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def precision_recall_f1(shared: Column, generated: Column, truth: Column) -> tuple[Column, Column, Column]:
    """From counts; every ratio without a denominator is 0."""
    p = F.when(generated > 0, shared / generated).otherwise(F.lit(0.0))
    r = F.when(truth > 0, shared / truth).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two string arrays: no built-in has it, so an Arrow batch function."""
    return _lcs(a, b)


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bit-parallel: a row of the table is one big integer, its zeros count the matches."""

    def one(x: list, y: list) -> int:
        where: dict = {}
        for i, w in enumerate(x):
            where[w] = where.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for w in y:
            u = v & where.get(w, 0)
            v = (v + u | v - u) & full
        return len(x) - v.bit_count()

    return pd.Series([one(list(x), list(y)) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def shared_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many tokens two string arrays share, repeats counted: an Arrow batch function, linear in their lengths."""
    return pd.Series([(Counter(x.tolist()) & Counter(y.tolist())).total() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")


def rouge_l(generated: Column, truth: Column) -> Column:
    shared = lcs_length(generated, truth).cast("double")
    return precision_recall_f1(shared, F.size(generated).cast("double"), F.size(truth).cast("double"))[2]


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length (our choice of algorithm)."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / n)


def token_dice(a: Column, b: Column) -> Column:
    """Similarity of two short values: Dice coefficient of their token sets."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(F.lit(0.0))


def token_jaccard(x: Column, y: Column) -> Column:
    """Of two arrays of distinct tokens."""
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def hashed_vector(text: Column, dims: int = 256) -> Column:
    """Counts of words and word pairs by the first 8 hex digits of their md5, modulo ``dims``: bucket -> count, sparse."""
    # bound as elements of arrays of one, so that each is computed once and not for every word
    pairs = lambda t: F.transform(F.slice(t, F.lit(2), F.size(t)), lambda w, i: F.concat_ws(" ", F.get(t, i), w))
    grams = F.transform(F.array(tokens(text)), lambda t: F.concat(t, pairs(t)))
    return F.get(F.transform(grams, lambda g: F.transform(g, lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))), 0)


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays of one length; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))


def sentence_ends(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[.!?]")), F.lit(0)).cast("long")


def one_sentence(text: Column, subject: str, within: int = 40) -> Column:
    """At most one sentence end and a subject word near the start."""
    return (sentence_ends(text) <= 1) & F.lower(F.substring(text, 1, within)).rlike(subject)


#: Our own words for the subject of a caption and for what stands behind it.
SUBJECT = r"\b(?:man|woman|person|boy|girl|child|adult|someone)\b"
BACKGROUND = ("background", "wall", "street", "room", "building", "park", "floor", "indoors", "outdoors")


def subject_first(text: Column, within: int = 40) -> Column:
    return F.lower(F.substring(text, 1, within)).rlike(SUBJECT)


def background(text: Column) -> Column:
    """Whether a caption speaks of the place and not of the person."""
    return F.lower(text).rlike(r"\b(?:" + "|".join(BACKGROUND) + r")\b")


def length_score(words: Column) -> Column:
    return F.when((words >= 18) & (words <= 24), F.lit(1.0)).when(((words >= 12) & (words <= 17)) | ((words >= 25) & (words <= 28)), F.lit(-0.5)).otherwise(F.lit(-1.0))


def invalid_output(text: Column) -> Column:
    """Empty, JSON-leading or pipe-delimited."""
    return F.coalesce(F.trim(text) == "", F.lit(True)) | text.rlike(r"^\s*[\{\[]") | text.contains("|")


def present(value: Column) -> Column:
    """The value, or null where it means "absent"."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*ABSENT), F.lit(None)).otherwise(v)


def normalise_values(values: Column) -> Column:
    """A list value: present elements, distinct, in order; a lone string is a list of one."""
    return F.array_distinct(F.filter(F.transform(values, present), lambda v: v.isNotNull()))


def best_element(truth: Column, generated: Column, similarity=token_dice) -> Column:
    """List truth is scored by its best-matching element; 0 without one."""
    return F.coalesce(F.array_max(F.transform(truth, lambda t: similarity(t, generated))), F.lit(0.0))


def loc_tokens(text: Column) -> Column:
    """The integers of ``<loc_N>`` tokens, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<loc_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def parse_regions(text: Column, sep: str = "<sep>") -> Column:
    """Per part: description, its four locations or null, and the raw part."""
    def part(p: Column) -> Column:
        loc = loc_tokens(p)
        ok = (F.size(loc) == 4) & F.forall(loc, lambda x: (x >= 0) & (x <= 999))
        return F.struct(F.trim(F.regexp_replace(p, r"<loc_\d+>", "")).alias("description"), F.when(ok, loc).alias("loc"), p.alias("raw"))

    return F.transform(F.split(text, sep, -1), part)


def snap_score(raw: Column) -> Column:
    """Nearest of 0, .25, .5, .75, 1 (ties upwards, our choice); what doesn't parse is 0."""
    x = raw.try_cast("double")
    return F.coalesce(F.least(F.greatest(F.floor(x * 4 + 0.5) / 4, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def multi_hot(values: Column, classes: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(values, c).cast("int"))


def sign_code(vector: Column) -> Column:
    """Signs of neighbouring differences of a vector, as the bits of a long (at most 63)."""
    n = F.least(F.size(vector) - 1, F.lit(63))
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0).cast("long"),
        lambda acc, i: acc * 2 + F.when(F.element_at(vector, i + 1) > F.element_at(vector, i), F.lit(1)).otherwise(F.lit(0)).cast("long"),
    )


def text_code(text: Column) -> Column:
    """A 63-bit code of a text: the ``sign_code`` of its counts of words and word pairs in 64 hashed buckets; null without a word.

    Buckets as in ``hashed_vector``, counted in arrays: work is linear in the text, whatever the number of buckets.
    """

    @F.pandas_udf("long")
    def code(lowered: pd.Series) -> pd.Series:
        buckets: dict[str, int] = {}
        bits = 1 << np.arange(62, -1, -1, dtype=np.int64)
        out = []
        for x in lowered:
            words = WORDS.findall(x) if x is not None else []
            if not words:
                out.append(None)
                continue
            if len(buckets) > 500_000:
                buckets.clear()
            found = bytearray()
            for g in chain(words, map(" ".join, pairwise(words))):
                k = buckets.get(g)
                if k is None:  # 8 hex digits modulo 64 are the low bits of the fourth byte
                    k = buckets[g] = hashlib.md5(g.encode()).digest()[3] & 63
                found.append(k)
            n = np.bincount(np.frombuffer(found, np.uint8), minlength=64)
            out.append(int(bits[n[1:] > n[:-1]].sum()))
        return pd.Series(out, dtype="Int64")

    return code.asNondeterministic()(F.lower(text))  # else a filter on the code would compute it twice


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: The twelve colour classes; ``unknown`` is the twelfth.
COLOURS = ("black", "white", "gray", "red", "yellow", "green", "blue", "purple", "pink", "orange", "brown")


def closed_colour(text: Column) -> Column:
    """The first of the eleven named colours in a text (grey is gray), else ``unknown``."""
    found = F.regexp_extract(F.regexp_replace(F.lower(text), r"\bgrey\b", "gray"), r"\b(" + "|".join(COLOURS) + r")\b", 1)
    return F.when(found == "", F.lit("unknown")).otherwise(F.coalesce(found, F.lit("unknown")))


#: Our own lexicon of attribute words.
LEXICON = {
    "hair": "hair|bald|ponytail|curly",
    "face": "glasses|sunglasses|mask",
    "top": "shirt|jacket|coat|sweater|dress",
    "bottom": "trousers|jeans|skirt|shorts|dress",
    "shoes": "shoes|boots|sandals|sneakers",
    "colour": "|".join((*COLOURS, "grey")),
    "pose": "standing|sitting|walking|running",
}
#: Words that may stand between a verb of holding and what is held.
THING = r"(?:(?:a|an|the|his|her|their)\s+)?(?:[a-z]+\s+)?"
CARRIED = "bag|handbag|backpack|umbrella|phone|jacket|coat"


def attributes(text: Column) -> dict[str, Column]:
    """Which attribute categories a description mentions, each at most once.

    Traps: a colour before ``background`` or ``wall`` is none of the person's; a held garment isn't
    worn; what is worn or on the back isn't held; a dress is both top and bottom; several details
    of the hair are one attribute.
    """
    low = F.lower(text)
    plain = F.regexp_replace(low, r"\b[a-z]+\s+(?:background|wall)\b", " ")
    held = r"\b(?:holding|carrying)\s+" + THING + "(?:" + CARRIED + r")\b"
    worn = F.regexp_replace(plain, held, " ")
    out = {k: (plain if k in ("colour", "pose") else worn).rlike(r"\b(?:" + words + r")\b") for k, words in LEXICON.items()}
    out["held"] = plain.rlike(held)
    out["carried"] = worn.rlike(r"\b(?:wearing|with)\s+" + THING + r"(?:bag|handbag|backpack)\b")
    return out

"""License scans: phrases by an Aho-Corasick automaton, expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import carried, in_parts

# Phrases of words and their labels. The first three are the base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "public domain": "public-domain",
    "cc0": "cc0",
    "the unlicense": "unlicense",
    "mit license": "mit",
    "isc license": "isc",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "boost software license": "bsl",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "proprietary and confidential": "proprietary",
}
#: Words behind which a licence expression stands, up to the end of the line.
TAGS = ("spdx license identifier", "license expression")
#: How far a label restricts the use of a text, from 0 to 1.
RESTRICTS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "apache": 0.15, "apache-2.0": 0.15, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5,
    "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "proprietary": 1.0, "reserved": 1.0,
}
#: A licence that no list has.
UNKNOWN, UNKNOWN_RESTRICTS = "other", 0.6
#: What an exception leaves of the restriction of its licence.
EXCEPTION = 0.5
#: Beginnings of identifiers, the longer first where one begins another.
IDENTIFIERS = (
    ("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("unlicense", "unlicense"), ("mit", "mit"), ("isc", "isc"), ("0bsd", "bsd"), ("bsd", "bsd"),
    ("bsl-1.0", "bsl"), ("apache-2.0", "apache-2.0"), ("apache", "apache"), ("mpl", "mpl"), ("epl", "epl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("licenseref-proprietary", "proprietary"),
)

#: Only A to Z are lower-cased; every other ASCII character but letters and digits parts words.
WORDS = {c: chr(c + 32) if 65 <= c <= 90 else " " for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
LINE_END = re.compile(r"[\r\n]|$")
PHRASES = {"base": BASE, "notice": NOTICES, "tag": dict.fromkeys(TAGS, "")}
#: Characters of the longest phrase with its spaces.
LONGEST = max(len(p) for phrases in PHRASES.values() for p in phrases) + 2
#: Operators by how tightly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}


def normalised(text: str) -> str:
    """The words of a text with one space before, between and after them; a space alone if there is none."""
    return " " + re.sub(" {2,}", " ", text.translate(WORDS)).strip(" ") + " "


def automaton():
    """One for all phrases and tags, each with a space on both sides; its values are (phrase, kind, label)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, phrases in PHRASES.items():
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (phrase, kind, label))
    out.make_automaton()
    return out


def postfix(text: str) -> list[str]:
    """A licence expression in postfix order, by the shunting-yard algorithm.

    It ends with the line, or before what cannot continue it: an operand behind an operand, an
    operator that lacks its left side, a closing parenthesis that was not opened. Operators without
    a right side and parentheses left open are ignored. ``+`` behind an identifier means later versions.
    """
    out: list[str] = []
    waiting: list[str] = []
    at, opened, operand = 0, 0, True  # an operand is due
    while token := TOKEN.match(text, at):
        t, at = token[1], token.end()
        kind = t.lower()
        if kind == "(":
            if not operand:
                break
            waiting.append("(")
            opened += 1
        elif kind == ")":
            if operand or not opened:
                break
            opened -= 1
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif kind in BINDS:
            if operand:
                break
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[kind]:
                out.append(waiting.pop())
            waiting.append(kind)
            operand = True
        else:
            if not operand:
                break
            out.append(t)
            operand = False
    depth = sum(1 if t not in BINDS else -1 for t in out)
    while waiting:
        top = waiting.pop()
        if top != "(" and depth > 1:
            out.append(top)
            depth -= 1
    return out


def identified(identifier: str) -> str:
    """The label of an identifier: the name of its family, at the end or before a separator."""
    name = identifier.lower().rstrip("+")
    for prefix, label in IDENTIFIERS:
        if name == prefix or name.startswith((prefix + "-", prefix + ".")):
            return label
    return UNKNOWN


def evaluate(tokens: list[str]) -> tuple[float, set[str]]:
    """Restriction and labels of a postfix expression: ``and`` binds to the stricter side, ``or`` leaves
    the choice of the milder one, ``with`` softens its licence; the exception itself is no licence."""
    stack: list[tuple[float, set[str]]] = []
    for t in tokens:
        if t in BINDS:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append((a[0] * EXCEPTION, a[1]))
            else:
                stack.append(((max if t == "and" else min)(a[0], b[0]), a[1] | b[1]))
        else:
            label = identified(t)
            stack.append((RESTRICTS.get(label, UNKNOWN_RESTRICTS), {label}))
    return stack.pop() if stack else (0.0, set())


def _by_start(words: str, machine) -> Iterator[tuple[int, int, str, int, str]]:
    """(start, end, kind, words, label) of all matches by start, then end; the automaton gives them by end."""
    waiting: list = []
    for end, (phrase, kind, label) in machine.iter(words):
        while waiting and waiting[0][0] < end - LONGEST:
            yield heappop(waiting)
        heappush(waiting, (end - len(phrase) - 1, end, kind, phrase.count(" ") + 1, label))
    while waiting:
        yield heappop(waiting)


def _behind(text: str, tags: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """From where to where the text behind each tag (its first and last word by number) goes: to the end of its line or the next tag."""
    words, at, start = WORD.finditer(text), -1, None
    for first, last in tags:
        while at < last:
            word, at = next(words), at + 1
            if at == first and start is not None:
                yield start, LINE_END.search(text, start, word.start()).start()
        start = word.end()
    if start is not None:
        yield start, LINE_END.search(text, start).start()


def scan_text(text: str, machine) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
    words = normalised(text)
    n_words = words.count(" ") - 1 if words.strip(" ") else 0
    n_base, first, last, base_labels, labels, tags = 0, None, None, set(), set(), []
    score, number, at, covered = 0.0, 0, 0, -1
    for start, hits in groupby(_by_start(words, machine), itemgetter(0)):
        number += words.count(" ", at, start)  # as many spaces as words before this one
        at = start
        *_, longest = hits = list(hits)
        for _, _, kind, size, label in hits:
            if kind == "base":
                n_base, first, last = n_base + 1, number if first is None else first, number
                base_labels.add(label)
                labels.add(label)
            elif kind == "tag":
                tags.append((number, number + size - 1))
        if longest[1] > covered and longest[2] != "tag":  # a phrase inside a longer one says nothing of its own
            labels.add(longest[4])
            score = max(score, RESTRICTS[longest[4]])
        covered = max(covered, longest[1])
    expressions = []
    for start, end in _behind(text, tags):
        tokens = postfix(text[start:end].lstrip(" \t:="))
        if tokens:
            value, found = evaluate(tokens)
            score, labels = max(score, value), labels | found
            expressions.append(" ".join(tokens))
    return n_words, n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions


RESULTS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "expressions": "array<string>"}


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts and places of base phrases, labels, score and expressions of each row.

    One pass of one automaton over the words of the whole text, no shuffle; a task holds a batch of
    rows, in parts of bounded length. ``base_labels`` and places come from the three base phrases,
    wherever they stand; ``labels`` adds further notices and the identifiers of licence expressions,
    ``score`` is the strictest restriction that any of them states (0: none): a notice counts unless
    it is part of a longer one, so "Lesser General Public License" is lgpl in the score and both in
    the labels. ``expressions`` has the expressions in postfix order.

    Null and empty texts have no words, no labels and score 0. Repeated rows get equal results; no
    rows: no rows. A kept column named like a result comes back with ``_in`` behind its name.
    """
    there, back = carried(keep, list(RESULTS))
    rows = docs.select(*there, F.col(f"`{text}`").alias("text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*kept, *(f"{n} {t}" for n, t in RESULTS.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in batches:
            texts = batch.pop("text").tolist()
            found = [scan_text(t or "", machine) for part in in_parts(texts) for t in texts[part]]
            for i, (name, kind) in enumerate(RESULTS.items()):
                values = [f[i] for f in found]
                batch[name] = pd.array(values, "Int64") if kind == "long" else pd.Series(values, index=batch.index, dtype=float if kind == "double" else object)
            yield batch

    return rows.mapInPandas(run, schema).select(*back, *RESULTS)


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, ["doc_id"]).select("doc_id", *[c for c in RESULTS if c != "expressions"], F.array_join("expressions", "; ").alias("expressions"))

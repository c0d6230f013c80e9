"""HTML extraction: union-free wrappers inferred by aligning the token streams of a host's pages."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.urlrules import host
from weftline.session import carried, checkpointed

#: Bytes of wrappers or template texts that are sent to every task; beyond it they are joined on the host.
MOST_SENT = 64_000_000
#: Longest repeated stretch of a page's stream and longest repeated group of a wrapper, in tokens.
LONGEST_STRETCH, LONGEST_GROUP = 16, 40
#: A wrapper longer than this meets the pages of its host in groups of about so many characters, not row by row.
MOST_CARRIED, GROUP_CHARS = 100_000, 32_000_000
#: Forms, and about how many characters of them, that one task aligns; wrappers of such shares are aligned in further rounds.
SHARE, SHARE_CHARS = 64, 16_000_000
#: Items of a form or wrapper beyond which a longest common subsequence aligns it, in bits and not item by item.
LONG = 1000
#: Bits of a table that one step holds; larger ones are made in parts.
MOST_BITS = 1 << 27
#: A text can be part of a host's template if so many different pages, and this share of all, have it.
LEAST_PAGES, LEAST_SHARE = 4, 0.25
#: Such texts are no template where they make up more than this share of a page, or half of a host.
MOST_TEMPLATE = 0.75

# Fixed values of HTML: elements by what they mean for the text.
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
HIDDEN = set("script style template noscript iframe svg math object canvas audio video head title textarea select option".split())
ASIDE = set("nav header footer aside menu dialog button".split())
CLOSES_P = set("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = set("ul ol dl table tr article section div main aside nav".split())
#: Elements whose class, id or role is looked at where neither tags nor the wrapper tell, and the words that speak of
#: furniture: as a whole name outside an article, and anywhere, also as a part of one (``cookie-banner``).
CONTAINERS = set("div section ul ol dl table center".split())
WHOLE = set("breadcrumb breadcrumbs contentinfo footer header hidden masthead menu nav navbar navigation notice pagination related search share social toolbar".split())
PARTS = set("ad ads advert adverts advertisement banner comment comments cookie cookies newsletter promo sidebar sponsored subscribe".split())
#: Those that stand for reader comments, also inside an article.
COMMENTS = {"comment", "comments"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
SPACE = re.compile(r"\s+")


def _mark(name: str, attributes: str) -> str:
    """``main``, ``comments``, ``ad`` or ``soft`` (words of furniture) or nothing, by class names, id and role of a container."""
    if name not in CONTAINERS or not attributes:
        return ""
    words: list[str] = []
    for key, value in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            words += value.strip("\"'").lower().split()
        elif key.lower() == "hidden":
            words.append("hidden")
    parts = {p for w in words for p in re.split("[-_]", w)}
    if parts & COMMENTS:
        return "comments"
    return "ad" if parts & PARTS else "soft" if set(words) & WHOLE else "main" if "main" in words else ""


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; what has no name leaves with its content.

    A quote opens a value only behind ``=``; such a value may hold ``>``; where it has no end, the tag
    ends at the next ``>``. Hidden elements leave with their content, as do comments, of which
    ``<!-->`` and ``<!--->`` are empty ones; CDATA is text. Linear in the page's length.
    """
    at, endless = page.find("<"), set()
    while at >= 0:
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield at, at + 9, "", "", ""
            if end >= 0:
                yield end, end + 3, "", "", ""
            at = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            comment = page.startswith("<!--", at)
            if comment and page.startswith((">", "->"), at + 4):
                comment = False
            end = page.find("-->" if comment else ">", at + (4 if comment else 1))
            stop = len(page) if end < 0 else end + (3 if comment else 1)
            yield at, stop, "", "", ""
            at = stop
        else:
            m = TAG.match(page, at)
            if m:
                slash, name, attributes, stop = m[1], m[2].lower(), m[3], m.end()
                if name in HIDDEN:
                    if not slash and not attributes.endswith("/") and name not in endless:
                        end = ENDS[name].search(page, stop)
                        if end:
                            stop = end.end()
                        else:
                            endless.add(name)
                            if name in ("script", "style", "textarea", "title"):
                                stop = len(page)
                    yield at, stop, "", "", ""
                else:
                    yield at, stop, slash, name, attributes
                at = stop
            else:
                at += 1
        at = page.find("<", at)


class Page:
    """A page as a stream of block tags and texts (``#``), in one linear pass.

    ``texts`` are the blocks in page order; ``state`` tells of each whether tags make it furniture
    (``o``), part of the page's article (``i``) or leave it open (``n``; ``m`` for a list item that
    is nothing but a link; ``s`` in a form or a container whose name speaks of furniture, ``a`` such
    a one inside the article). Inline
    tags go and leave their text; a missing end tag is supplied where HTML implies it. An article
    inside an article is a reader's comment; one inside a form or a named container is an article.
    """

    def __init__(self, page: str):
        self.stream: list[str] = []
        self.texts: list[str] = []
        self.state: list[str] = []
        self.stack: list[tuple[str, str, bool, bool, str]] = []  # token, name, in article, furniture, soft
        self.places: dict[str, list[int]] = {}
        self.inside = False
        pending: list[str] = []
        at, links, plain = 0, 0, False

        def text(piece: str) -> None:
            nonlocal plain
            if piece:
                pending.append(piece)
                plain = plain or (not links and not piece.isspace())

        def flush() -> None:
            nonlocal plain
            if pending:
                found = SPACE.sub(" ", entities.unescape("".join(pending))).strip()
                pending.clear()
                if found:
                    self.add(found, not plain)
            plain = False

        for start, stop, slash, name, attributes in tags(page):
            text(page[at:start])
            at = stop
            if not name:
                continue
            if name in INLINE:
                if name in ("br", "img"):
                    pending.append(" ")
                elif name == "a":
                    links = 0 if slash else 1
                continue
            flush()
            if slash:
                if self.places.get(name):
                    self.close(self.places[name][-1])
            elif name not in ("html", "body"):
                self.open(name, attributes)
        text(page[at:])
        flush()
        self.close(0)

    def add(self, found: str, only_link: bool) -> None:
        _, _, inside, out, soft = self.stack[-1] if self.stack else ("", "", False, False, "")
        self.stream.append("#")
        self.texts.append(found)
        self.state.append("o" if out else soft if soft else "i" if inside else "m" if only_link and self.places.get("li") else "n")
        self.inside = self.inside or self.state[-1] in "ia"

    def open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and self.places.get("p"):
            self.close(self.places["p"][-1])
        if name in SIBLINGS:
            last = lambda names: max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)
            sibling = last(SIBLINGS[name])
            if sibling > last(HOLDS - SIBLINGS[name]):
                # the outermost sibling above the element that holds them, as a row closes with its cells
                self.close(min(p for x in SIBLINGS[name] for p in self.places.get(x, [])[-1:] if p > last(HOLDS - SIBLINGS[name])))
        if name in VOID:
            return
        mark = _mark(name, attributes)
        _, _, inside, out, soft = self.stack[-1] if self.stack else ("", "", False, False, "")
        own = name in ("article", "main") or mark == "main"
        out = out or (name in ASIDE and not (name == "header" and inside)) or (name == "article" and bool(self.places.get("article")))
        soft = "" if own and soft != "a" else soft
        if mark == "comments" or (mark == "soft" and not inside):
            soft = "s"
        elif mark == "ad" or name in ("form", "fieldset"):
            soft = soft or ("a" if inside else "s")
        inside = inside or own
        token = f"<{name}.{mark}" if mark else f"<{name}"
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((token, name, inside, out, soft))
        self.stream.append(token)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            token, name, *_ = self.stack.pop()
            self.places[name].pop()
            self.stream.append(">" + token[1:])

    def candidates(self) -> list[bool]:
        """Texts that can be the article's, as far as tags tell."""
        return [s in "ia" or (s in "ns" and not self.inside) for s in self.state]

    def digest(self) -> int:
        """Equal for pages of equal texts."""
        return text_hash("\0".join(self.texts))


def text_hash(text: str) -> int:
    """64 bits; 0 stands for a text that is no candidate."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def folded(stream: list[str], literals: list[str]) -> tuple[list[str], list[int]]:
    """The stream with neighbouring equal stretches reduced to one, and the place of each text in it.

    ``literals`` has a token for each text: ``#``, or ``=hash`` for a text that may be template.
    """
    out: list[str] = []
    held: list[list[int]] = []
    n = 0
    for t in stream:
        held.append([n] if t == "#" else [])
        if t == "#":
            t, n = literals[n], n + 1
        out.append(t)
        size = 1
        while size <= LONGEST_STRETCH and 2 * size <= len(out):
            if out[-1] == out[-1 - size] and out[-size:] == out[-2 * size : -size]:
                for k in range(size):
                    held[-2 * size + k] += held[-size + k]
                del out[-size:], held[-size:]
                break
            size += 1
    place = [0] * n
    for p, texts in enumerate(held):
        for k in texts:
            place[k] = p
    return out, place


Item = str | list  # a token, or ["+", items] (once or more), or ["?", items] (or not)


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring equal stretches become one repeated group, shortest groups first."""
    changed = True
    while changed:
        changed = False
        ids = numbers(items)
        for size in range(1, min(LONGEST_GROUP, len(items)) + 1):
            if not _repeats(ids, size):
                continue
            out: list[Item] = []
            i = 0
            while i < len(items):
                if items[i : i + size] != items[i + size : i + 2 * size]:
                    if out and size == 1 and isinstance(items[i], list) and items[i][0] == "+" and out[-1] == items[i]:
                        changed = True  # (a)+ (a)+ is (a)+
                    else:
                        out.append(items[i])
                    i += 1
                    continue
                group, n = items[i : i + size], 2
                while items[i + n * size : i + (n + 1) * size] == group:
                    n += 1
                out.append(group[0] if size == 1 and isinstance(group[0], list) and group[0][0] == "+" else ["+", group])
                i += n * size
                changed = True
            items = out
            if changed:
                break
    return items


def numbers(items: list[Item], of: dict[str, int] | None = None) -> np.ndarray:
    """A number for each item, equal for equal items."""
    of = {} if of is None else of
    return np.array([of.setdefault(x if isinstance(x, str) else json.dumps(x), len(of)) for x in items], np.int64)


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some stretch of so many items stands twice in a row."""
    same = np.concatenate([[0], np.cumsum(ids[size:] == ids[:-size])])
    return bool((same[size:] - same[:-size] == size).any())


def shape(x: Item | list[Item]) -> Item | list[Item]:
    """An item or list of items with every text generalised."""
    if isinstance(x, str):
        return "#" if x[:1] == "=" else x
    return [shape(y) for y in x]


def core(x: Item) -> str:
    """What makes two items align: a group aligns with its single occurrence."""
    while isinstance(x, list) and len(x[1]) == 1:
        x = x[1][0]
    return json.dumps(x[1] if isinstance(x, list) else x)


def unify(x: Item, y: Item) -> Item:
    """One item for two of equal shape: texts that differ become a slot, ``+`` and ``?`` the wider of both."""
    if isinstance(x, str) and isinstance(y, str):
        return x if x == y else "#"
    if isinstance(x, list) and isinstance(y, list) and shape(x[1]) == shape(y[1]):
        body = [unify(a, b) for a, b in zip(x[1], y[1], strict=True)]
        return [x[0], body] if x[0] == y[0] else ["?", [["+", body]]]
    if isinstance(x, list) and len(x[1]) == 1:
        inner = unify(x[1][0], y)
        return inner if isinstance(inner, list) and inner[0] == x[0] else [x[0], [inner]]
    if isinstance(y, list) and len(y[1]) == 1:
        return unify(y, x)
    raise ValueError("items of different shape")


def optional(items: list[Item]) -> list[Item]:
    if not items:
        return []
    return items if len(items) == 1 and isinstance(items[0], list) and items[0][0] == "?" else [["?", items]]


def places(tokens: list[str]) -> Callable[[str], int]:
    """The places of a token as the bits of an integer; of rare ones only the places are kept."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        at.setdefault(t, []).append(i)
    ready: dict[str, int] = {}

    def bits(token: str) -> int:
        found = ready.get(token)
        if found is None:
            few = at.get(token, ())
            found = 0
            if len(few) > 16:
                raw = np.zeros(len(tokens), np.uint8)
                raw[few] = 1
                found = ready[token] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
            else:
                for i in few:
                    found |= 1 << i
        return found

    return bits


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each prefix of ``b`` the bits of ``a``: a zero where one more item makes the common subsequence longer."""
    bits = places(a)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & bits(w)
        v = (v + u | v - u) & full
        yield v


def subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by a table of bits; one beyond MOST_BITS is made in halves of ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = [(i, i) for i in range(start)]
    tail = [(len(a) - i, len(b) - i) for i in range(end, 0, -1)]
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) * len(b) <= MOST_BITS or len(b) < 2:
        rows = [(1 << len(a)) - 1, *_rows(a, b)]
        i, j, found = len(a), len(b), []
        while i and j:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
                if rows[j] >> (i - 1) & 1:
                    i -= 1
                    found.append((start + i, start + j))
        return out + found[::-1] + tail
    half = len(b) // 2

    def lengths(x: list[str], y: list[str]) -> np.ndarray:
        last = 0
        for last in _rows(x, y):  # noqa: B007
            pass
        raw = np.frombuffer(last.to_bytes(len(x) // 8 + 1, "little"), np.uint8)
        return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, bitorder="little")[: len(x)].astype(np.int64))])

    cut = int(np.argmax(lengths(a, b[:half]) + lengths(a[::-1], b[half:][::-1])[::-1]))
    out += [(start + i, start + j) for i, j in subsequence(a[:cut], b[:half])]
    return out + [(start + cut + i, start + half + j) for i, j in subsequence(a[cut:], b[half:])] + tail


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Stretches that are equal, replaced, or only on one side, in order."""
    if max(len(a), len(b)) <= LONG:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    out: list[tuple[str, int, int, int, int]] = []
    i = k = 0
    for x, y in [*subsequence(a, b), (len(a), len(b))]:
        if i < x or k < y:
            out.append(("delete" if k == y else "insert" if i == x else "replace", i, x, k, y))
        if x < len(a) and y < len(b):
            if out and out[-1][0] == "equal":
                _, p, _, q, _ = out.pop()
                out.append(("equal", p, x + 1, q, y + 1))
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, k = x + 1, y + 1
    return out


def align(a: list[Item], b: list[Item], texts: bool = True) -> list[Item]:
    """One wrapper for both: common items stay, first with equal texts, between them with any.

    Texts that differ at one place become a slot; what one side lacks becomes an optional group.
    """
    if texts:
        groups = [x[1] for x in (*a, *b) if isinstance(x, list) and x[0] == "+"]
        a, b = regroup(a, groups), regroup(b, groups)
    key = core if texts else lambda x: core(shape(x))
    out: list[Item] = []
    for op, i, j, k, n in opcodes([key(x) for x in a], [key(x) for x in b]):
        if op == "equal":
            out += [unify(x, y) for x, y in zip(a[i:j], b[k:n], strict=True)]
        elif op == "replace" and texts:
            out += align(a[i:j], b[k:n], False)
        else:
            out += optional(a[i:j]) + optional(b[k:n])
    return fold(out) if texts else out


def regroup(items: list[Item], groups: list[list[Item]]) -> list[Item]:
    """Single occurrences of a repeated group become that group, longest first, so that both sides align."""
    of: dict[str, int] = {}
    ids = numbers(items, of).tolist()
    beside = set(zip(ids, ids[1:], strict=False))
    for _, body in sorted({json.dumps(g): g for g in groups}.items(), key=lambda g: (-len(g[1]), g[0])):
        own = numbers(body, of).tolist()
        if len(own) > 1 and (own[0], own[1]) not in beside:
            continue
        group = ["+", body]
        [number] = numbers([group], of).tolist()
        out: list[Item] = []
        out_ids: list[int] = []
        i = 0
        for at in [k for k, x in enumerate(ids) if x == own[0] and ids[k : k + len(own)] == own]:
            if at < i:
                continue
            out += items[i:at]
            out_ids += ids[i:at]
            i = at + len(own)
            if out_ids[-1:] != [number]:
                out.append(group)
                out_ids.append(number)
        if i:
            items, ids = out + items[i:], out_ids + ids[i:]
            beside = set(zip(ids, ids[1:], strict=False))
    return items


def length(items: list[Item]) -> int:
    return sum(1 if isinstance(x, str) else 1 + length(x[1]) for x in items)


def infer(parts: list[list[Item]]) -> list[Item]:
    """One wrapper from forms or wrappers, all of them, small ones first: a regular expression without unions."""
    wrapper: list[Item] | None = None
    for part in sorted(parts, key=lambda p: (length(p), json.dumps(p))):
        part = fold(list(part))
        wrapper = part if wrapper is None else align(wrapper, part)
    return wrapper or []


Step = tuple[str, bool] | tuple[int, int]  # a token and whether each page has it, or two next steps, the first preferred


def program(items: list[Item]) -> list[Step]:
    """A wrapper as steps: groups first try to take more."""
    steps: list[Step] = []

    def add(body: list[Item], must: bool) -> None:
        for x in body:
            at = len(steps)
            if isinstance(x, str):
                steps.append((x, must))
            elif x[0] == "+":
                add(x[1], must)
                steps.append((at, len(steps) + 1))
            else:
                steps.append((at, at))
                add(x[1], False)
                steps[at] = (at + 1, len(steps))

    add(items, True)
    return steps


def match(steps: list[Step], stream: list[str], strict: bool) -> list[str] | None:
    """What the wrapper makes of each token: ``d`` text in a slot, ``t`` template text, ``u`` template
    text of an optional group, empty for tags; None if the stream has not the wrapper's form.

    From the last step to the first: the places of the stream from which the rest of the wrapper
    takes the rest of the stream, as bits; then one walk that prefers each first next step that can
    still end. No step is tried in vain, and parts between groups bound what is held to MOST_BITS
    (or one group's). ``strict`` keeps texts that may be template out of slots, so that a template
    item further on can have them.
    """
    bits = places(stream)
    slot = bits("#")
    if not strict:
        raw = np.array([t[:1] == "=" for t in stream], np.uint8)
        slot |= int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
    loops: dict[int, list[int]] = {}
    inside = np.zeros(len(steps) + 1, np.int64)
    for k, (x, y) in enumerate(steps):
        if isinstance(x, int):
            low, high = min(x, k), max(k, y - 1)
            inside[low + 1] += 1
            inside[high + 1] -= 1
            if x <= k:
                loops.setdefault(x, []).append(k)
    apart = max(MOST_BITS // (len(stream) + 1), 1)
    cuts = [0]
    for k in (np.flatnonzero(np.cumsum(inside) == 0)).tolist():
        if k - cuts[-1] >= apart:
            cuts.append(k)
    if cuts[-1] != len(steps):
        cuts.append(len(steps))

    def part(low: int, high: int, after: int) -> list[int]:
        can = [0] * (high - low) + [after]
        k = high - 1
        while k >= low:
            x, y = steps[k]
            if not isinstance(x, int):
                can[k - low] = can[k - low + 1] >> 1 & (slot if x == "#" else bits(x))
            elif x > k:
                can[k - low] = can[x - low] | can[y - low]
            else:
                can[k - low] |= can[y - low]
            again = next((e for e in loops.get(k, ()) if can[k - low] & ~can[e - low]), None)
            if again is not None:  # once more through the group, which can end at more places
                can[again - low] |= can[k - low]
                k = again
            k -= 1
        return can

    ends = {len(steps): 1 << len(stream)}
    can = [1 << len(stream)]
    for low, high in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        can = part(low, high, ends[high])
        ends[low] = can[0]
    if not ends[0] & 1:
        return None
    kinds: list[str] = []
    last: dict[int, int] = {}
    at = 0
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low:
            can = part(low, high, ends[high])
        k = low
        while k < high:
            if k in loops:
                last[k] = at
            x, y = steps[k]
            if isinstance(x, int):
                # a group that has taken nothing isn't entered again
                k = x if can[x - low] >> at & 1 and (x > k or last[x] != at) else y
                continue
            kinds.append("d" if x == "#" else "" if x[:1] != "=" else "t" if y else "u")
            k, at = k + 1, at + 1
    return kinds


def verdicts(steps: list[Step] | None, stream: list[str]) -> tuple[bool, list[str]]:
    """Whether the form matches, and ``match``'s kinds; unmatched, texts that may be template count as optional."""
    kinds = None
    if steps is not None:
        kinds = match(steps, stream, True)
        if kinds is None:
            kinds = match(steps, stream, False)
    return kinds is not None, ["d" if t == "#" else "u" if t[:1] == "=" else "" for t in stream] if kinds is None else kinds


def main_text(page: Page, place: list[int], kinds: list[str]) -> str:
    """The blocks of the article, joined.

    Of the texts that tags leave, those of the template go: all of them outside the page's own
    article, inside it only such as no page of the host's form lacks. A page of which less than
    1 - MOST_TEMPLATE would remain is a copy of others rather than a filled form: all of it stays.
    What the wrapper cannot tell from the article, slots that differ from page to page, names settle:
    texts in forms and in containers that are called furniture go, unless they are most of what is left.
    """
    left = [k for k, ok in enumerate(page.candidates()) if ok]
    data = [k for k in left if kinds[place[k]] == "d" or (kinds[place[k]] == "u" and page.state[k] in "ia")]
    chars = lambda ks: sum(len(page.texts[k]) for k in ks)
    if chars(data) < (1 - MOST_TEMPLATE) * chars(left):
        data = left
    own = [k for k in data if page.state[k] not in "sa"]
    if 2 * chars(own) >= chars(data):
        data = own
    return "\n\n".join(page.texts[k] for k in data)


def literals(page: Page, common: frozenset[int] | set[int]) -> list[str]:
    return [f"={h}" if c and (h := text_hash(t)) in common else "#" for t, c in zip(page.texts, page.candidates(), strict=True)]


def _by_host(rows: DataFrame, small: DataFrame, value: str) -> DataFrame:
    """``rows`` with the one row that ``small`` (w_host, value) has for the host, sent to all tasks if it is small."""
    size = small.agg(F.sum(F.length(value) + F.length("w_host") + 64)).first()[0] or 0
    return rows.join(F.broadcast(small) if size <= MOST_SENT else small, rows["host"] == small["w_host"], "left").drop("w_host")


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, text, n_chars and wrapped (whether the page has the form of its host's wrapper).

    Pass one turns each page into its stream of block tags and texts. Texts that at least
    LEAST_PAGES different pages and LEAST_SHARE of all pages of a host have may be its template and
    stay literal; all others are slots. Streams are folded and made distinct for each host, at most
    SHARE of them are aligned in a task, and the wrappers of such shares in further rounds, until
    each host has one: a regular expression of tags, literal texts, slots, and optional and
    repeated groups. A literal that differs from what other pages have at its place becomes a slot.
    All forms take part, long ones too: beyond LONG items their alignment is a longest common
    subsequence in bits, and a wrapper beyond MOST_CARRIED meets its pages in groups. Pass two matches each page against it, which tells its template texts from its own.

    Of a page's texts these are the article: not in furniture by their tags (an article inside an
    article is a comment); inside the page's own article or main, or anywhere (but for list items
    that are only links) if it has none; and not template. Template texts inside the article leave
    only if no page of the form lacks them. Pages, or hosts, that would be mostly template are copies
    of each other: nothing leaves. Names of containers, and forms, settle only what both leave open.
    What other pages have never decides which part of a page is its article.

    Null and empty html: empty text. Null urls and urls without host share a host without a name.
    Repeated rows: equal answers, and one page as evidence. No rows: no rows. Very long or deeply
    nested pages take linear time and memory where their forms fold; else an alignment takes the product
    of both forms, and a match that of wrapper and form, in bits, with bounded memory. A kept column named like a result comes back with ``_in`` behind its name.
    """
    keep = keep or ["page_id", url]
    there, back = carried(keep, ["text", "n_chars", "wrapped"])
    rows = pages.select(*there, host(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [Page(p) for p in batch.pop("html")]
            batch["page"] = [p.digest() for p in got]
            batch["stream"] = [" ".join(p.stream) for p in got]
            batch["texts"] = [[text_hash(t) if c else 0 for t, c in zip(p.texts, p.candidates(), strict=True)] for p in got]
            batch["sizes"] = [[len(t) if c else 0 for t, c in zip(p.texts, p.candidates(), strict=True)] for p in got]
            yield batch

    # tags and hashes of each page: a small part of the page, read twice below
    seen = checkpointed(rows.select("host", "html").mapInPandas(streams, "host string, page long, stream string, texts array<long>, sizes array<int>"))
    pages_of = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all"))
    texts = seen.select("host", "page", F.explode(F.array_distinct(F.arrays_zip("texts", "sizes"))).alias("t")).where("t.texts != 0")
    texts = texts.groupBy("host", F.col("t.texts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("different"), F.max("t.sizes").alias("size"))
    common = texts.where(F.col("different") >= LEAST_PAGES).join(pages_of.where(F.col("pages") >= LEAST_PAGES), "host")
    common = common.where(F.col("n") >= F.col("pages") * LEAST_SHARE)
    # at most 1 / LEAST_SHARE times the texts of a page
    common = common.groupBy(F.col("host").alias("w_host")).agg(F.to_json(F.sort_array(F.collect_list("h"))).alias("common"), F.sum(F.col("n") * F.col("size")).alias("shared"), F.max("all").alias("all"))
    common = checkpointed(common.where(2 * F.col("shared") <= F.col("all")).select("w_host", "common"))

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for h, stream, hashes, raw in zip(batch["host"], batch["stream"], batch["texts"], batch["common"], strict=True):
                may = set(json.loads(raw)) if raw else ()
                form, _ = folded(stream.split(" ") if stream else [], [f"={x}" if x in may else "#" for x in hashes.tolist()])
                found.add((h, json.dumps(form)))
            if found:
                yield pd.DataFrame(sorted(found), columns=["host", "wrapper"])

    parts = _by_host(seen.select("host", "stream", "texts"), common, "common").mapInPandas(shapes, "host string, wrapper string").distinct()

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [g["host"].iloc[0]], "wrapper": [json.dumps(infer([json.loads(f) for f in g["wrapper"]]))]})

    more = True
    while more:
        parts = checkpointed(parts)
        n = F.count(F.lit(1))
        # at least two to a share on average, so that each round leaves fewer
        shares = parts.groupBy(F.col("host").alias("s_host")).agg(F.least(F.greatest(F.ceil(n / SHARE), F.ceil(F.sum(F.length("wrapper")) / SHARE_CHARS)), F.ceil(n / 2)).alias("shares"))
        more = not shares.where("shares > 1").isEmpty()
        shares = checkpointed(shares)  # the join is then of plain exchanges, and a hot host can be split
        parts = parts.join(shares, F.col("host") == F.col("s_host")).withColumn("share", F.pmod(F.xxhash64("wrapper"), F.col("shares")))
        parts = parts.groupBy("host", "share").applyInPandas(learn, "host string, wrapper string")
    wrappers = checkpointed(parts.withColumnRenamed("host", "w_host"))
    wrappers = wrappers.join(common.withColumnRenamed("w_host", "c_host"), F.col("w_host") == F.col("c_host"), "left")
    wrappers = checkpointed(wrappers.select("w_host", F.concat_ws("\n", "wrapper", F.coalesce("common", F.lit("[]"))).alias("wrapper")))
    long = wrappers.where(F.length("wrapper") > MOST_CARRIED)
    schema = rows.drop("html", "host").schema.add("text", "string").add("n_chars", "long").add("wrapped", "boolean")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, tuple[list[Step] | None, set[int], dict]] = {}
        held = 0  # characters of wrappers and tokens of forms in the memo
        for batch in batches:
            found, wrapped = [], []
            for raw, w in zip(batch.pop("html"), batch.pop("wrapper"), strict=True):
                if w not in ready:
                    if len(ready) > 2000 or held > 4_000_000:
                        ready.clear()
                        held = 0
                    held += len(w or "")
                    items, may = (w or "null\n[]").split("\n")
                    items = json.loads(items)
                    ready[w] = (None if items is None else program(items), set(json.loads(may)), {})
                steps, may, memo = ready[w]
                page = Page(raw)
                form, place = folded(page.stream, literals(page, may))
                key = tuple(form)
                if key not in memo:
                    if len(memo) > 2000 or held > 4_000_000:
                        ready.clear()
                        memo.clear()
                        held = 0
                    held += len(form)
                    memo[key] = verdicts(steps, form)
                ok, kinds = memo[key]
                found.append(main_text(page, place, kinds))
                wrapped.append(ok)
            batch["text"], batch["n_chars"], batch["wrapped"] = found, [len(t) for t in found], wrapped
            yield batch

    if long.isEmpty():
        done = _by_host(rows, wrappers, "wrapper").drop("host").mapInPandas(read, schema)
        return done.select(*back, "text", "n_chars", "wrapped")

    def group(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if some.empty:
            return pd.DataFrame(columns=schema.names)
        return next(read(iter([some.drop(columns=["host", "share"]).assign(wrapper=own["wrapper"].iloc[0])])))

    few = rows.join(long.select("w_host"), F.col("host") == F.col("w_host"), "left_anti")
    done = _by_host(few, wrappers.where(F.length("wrapper") <= MOST_CARRIED), "wrapper").drop("host").mapInPandas(read, schema)
    # a long wrapper goes once to each group of pages
    many = rows.join(long.select("w_host"), F.col("host") == F.col("w_host")).groupBy("w_host").agg((F.floor(F.sum(F.length("html")) / GROUP_CHARS) + 1).alias("shares"))
    many = checkpointed(many)
    kept = [c for c in rows.columns if c != "host"]
    split = rows.join(many, F.col("host") == F.col("w_host")).withColumn("share", F.pmod(F.xxhash64(*kept), F.col("shares"))).select("host", "share", *kept)
    own = long.join(many, "w_host").select("w_host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "wrapper")
    done = done.unionByName(split.groupBy("host", "share").cogroup(own.groupBy("w_host", "share")).applyInPandas(group, schema))
    return done.select(*back, "text", "n_chars", "wrapped")


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

"""Leaf blocks of HTML pages, in page order, with the path of tags above them."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa

from . import arrays

# Names of elements by what they do to the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr "
    # a formula is part of its sentence; what stands in for an object is part of the text around it
    "object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup "
    "msubsup munder mover munderover mmultiscripts mprescripts semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template")
HIDDEN = frozenset({"svg", "noscript", "iframe"})
# elements that end a drawing when they begin in it, and those that may hold them there
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
IN_SVG = frozenset({"foreignobject", "desc", "title"})
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    + "".join(rf"|<{name}(?=[\s/>])[^>]*>.*?(?:</{name}\s*>|\Z)" for name in RAW)
    + r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|([^<]+|<)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attribute_words(attributes: str) -> tuple[str, ...]:
    """The words in an element's class, id and role."""
    if not attributes or "=" not in attributes:
        return ()
    found = [a or b or c for a, b, c in _NAMES.findall(attributes)]
    return tuple(_WORD.findall(_SPLIT.sub(" ", " ".join(found)).lower())) if found else ()


def blocks(page: str) -> list[tuple[str, tuple, int]]:
    """[(text, path, characters inside links)] of the page's blocks that have a text.

    A path is a tuple of (element, words of its class, id and role), from the outermost element on. Character
    references are decoded, runs of white space are one space. Text between tags belongs to one block until an
    element that is not inline begins or ends. The text of scripts, styles and templates is left out up to their
    close tag, that of HIDDEN elements up to their close tag or where what they stand in ends.
    """
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    hidden: list[str] = []  # a HIDDEN element that is open, and what is open in it
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def close(names, until=()) -> None:
        """Take the nearest open element of `names`, and what it holds, from the stack; not beyond `until`."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    def ends_hidden(name: str, closes: bool) -> bool:
        """Whether a tag that is not the hidden element's own shows that it has ended."""
        if closes:
            return name in INLINE or any(name == n for n, _ in stack)
        if hidden[0] == "svg" and name in ENDS_SVG and IN_SVG.isdisjoint(hidden):
            return True
        ends, until = SIBLINGS.get(name, ((), ()))
        return any(n in ends for n, _ in stack) and not any(n in ends or n in until for n in hidden)

    for token in _TOKEN.finditer(page):
        if hidden:
            name = (token.group(2) or "").lower()
            closes = bool(token.group(1))
            if not name:
                continue
            if closes and name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                continue
            if not ends_hidden(name, closes):
                if not closes and name not in VOID and not token.group(3).rstrip().endswith("/"):
                    hidden.append(name)
                continue
            hidden.clear()
        text = token.group(4)
        if text is not None:
            parts.append(text)
            linked += len(text) * in_link
            continue
        name = token.group(2)
        if name is None:
            if not token.group(0).startswith("<!--"):
                flush()
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if token.group(1) else 1
            if name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            continue
        flush()
        if name in HIDDEN and not token.group(1):
            if not token.group(3).rstrip().endswith("/"):
                hidden.append(name)
            continue
        in_link = 0
        if token.group(1):
            close({name})
            continue
        if name in ENDS_P:
            close({"p"}, {"article", "section", "div", "main", "body", "td", "li", "form", "aside", "footer", "header", "nav"})
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        if name not in VOID and not token.group(3).rstrip().endswith("/"):
            stack.append((name, attribute_words(token.group(3))))
    flush()
    return out


#: buckets of hashed path entries and of hashed words
PATH, WORDS = 96, 32
#: plain measurements beside them
PLAIN = 9
FEATURES = PATH + WORDS + PLAIN
_BUCKETS: dict[str, int] = {}


def bucket(entry: str) -> int:
    got = _BUCKETS.get(entry)
    if got is None:
        h = arrays.hashes(pa.array([entry.encode()], pa.large_binary()))[0]
        if len(_BUCKETS) > 1 << 16:
            _BUCKETS.clear()
        got = _BUCKETS[entry] = int(h % np.uint64(PATH))
    return got


def path_entries(path: tuple) -> list[str]:
    """What the path says: elements, their words, and the two innermost elements by their place."""
    out = []
    for name, words in path:
        if name not in ("html", "body"):
            out.append(name)
        out += [f".{w}" for w in words]
    out += [f"{k}:{path[-k][0]}" for k in (1, 2) if len(path) >= k]
    return out


def features(pages: list[list[tuple[str, tuple, int]]]) -> list[np.ndarray]:
    """For each page one row per block: hashed path entries, hashed words of the whole text, plain measurements."""
    found = [b for page in pages for b in page]
    n = len(found)
    out = np.zeros((n, FEATURES), np.float32)
    ends = np.cumsum([len(page) for page in pages]).astype(np.int64)
    if not n:
        return [out] * len(pages)
    known: dict[tuple, list[int]] = {}
    for i, (_, path, _) in enumerate(found):
        got = known.get(path)
        if got is None:
            got = known[path] = sorted({bucket(e) for e in path_entries(path)})
        out[i, got] = 1
    sizes = np.array([len(t) for t, _, _ in found], np.float32)
    words = np.zeros(n)
    for low, high, data, rows in arrays.pieces(pa.array([t for t, _, _ in found], pa.string())):
        values, before = arrays.words(data, rows)
        at = (arrays.hashes(values) % np.uint64(WORDS)).astype(np.int64)
        count = np.diff(before)
        row = np.repeat(np.arange(high - low), count)
        sums = np.bincount(row * WORDS + at, minlength=(high - low) * WORDS).reshape(-1, WORDS)
        out[low:high, PATH : PATH + WORDS] = sums / np.sqrt((sums**2).sum(1, keepdims=True) + 1)
        words[low:high] = count
    plain = out[:, PATH + WORDS :]
    plain[:, 0] = np.log1p(sizes) / 5
    plain[:, 1] = np.log1p(words) / 4
    plain[:, 2] = [min(1.0, linked / len(t)) for t, _, linked in found]
    plain[:, 3] = [t[-1] in ".!?:;…。" for t, _, _ in found]
    plain[:, 4] = [min(1.0, 20 * (t.count(".") + t.count(",") + t.count(";")) / len(t)) for t, _, _ in found]
    plain[:, 5] = [min(1.0, len(path) / 10) for _, path, _ in found]
    plain[:, 6] = sizes > 80
    some = np.array([len(page) > 0 for page in pages])
    plain[(ends - [len(page) for page in pages])[some], 7] = 1
    plain[(ends - 1)[some], 8] = 1
    return np.split(out, ends[:-1])

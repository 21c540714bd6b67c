"""Plain versions of the numbered operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from html.parser import HTMLParser


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_duplicates(rows: list[tuple[int, str | None]], n: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of the set, component)."""
    sets = {}
    for doc, text in rows:
        w = words(lower(text))
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    of = {d: d for d in sets}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    index: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    pairs = {(a, b) for group in index.values() for i, a in enumerate(group) for b in group[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def repeated_words(rows: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, words removed, digest of the rest)."""
    first: dict[tuple, int] = {}
    split = {d: words(t) for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def repeated_bytes(rows: list[tuple[int, str | None]], n: int = 200) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (bytes, bytes removed, runs removed, digest of the rest)."""
    count: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in rows}
    for b in data.values():
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] = count.get(b[i : i + n], 0) + 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        out[d] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def contamination(rows, items, n: int = 13):
    """doc_id -> (words, hit words, items, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = split(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in rows:
        w = split(text)
        hit, found = [False] * len(w), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit[i : i + size] = [True] * size
                    found |= windows[k]
        out[d] = (len(w), sum(hit), sorted(found - {None}), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def line_rules(rows, most: int):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, frequent words). rows: id, host, text."""
    plain = lambda line: " ".join(words(re.sub("[1-9]", "0", lower(line))))
    seen: dict[tuple, set] = {}
    for d, host, text in rows:
        for line in (text or "").split("\n"):
            if words(line):
                seen.setdefault((host, plain(line)), set()).add(d)
    out = {}
    for d, host, text in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        frequent = sum(len(words(x)) for x in lines if len(seen[(host, plain(x))]) > most)
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), frequent)
    return out


class _Reader(HTMLParser):
    """Blocks of text outside of what marks boilerplate, by open elements alone."""

    BLOCKS = {"p", "div", "section", "article", "main", "body", "h1", "h2", "h3", "li", "ul", "ol", "td", "tr", "table", "blockquote", "pre", "header", "figure", "figcaption"}
    OUT = {"nav", "footer", "aside", "form", "script", "style", "head", "button", "noscript"}
    WORDS = {"ad", "ads", "sidebar", "related", "share", "comments", "cookie", "newsletter", "menu", "notice", "promo"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.run = [], [], []

    def close_block(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.close_block()
        if tag == "br":
            self.run.append(" ")
        elif tag not in ("img", "meta", "link", "hr", "input"):
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            page_header = tag == "header" and not any(t == "article" for t, _ in self.open)
            self.open.append((tag, tag in self.OUT or page_header or bool(set(re.split(r"[\s_-]+", names)) & self.WORDS)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.close_block()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(cut for _, cut in self.open):
            self.run.append(data)


def main_text(page: str) -> str:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.close_block()
    return "\n".join(reader.out)


def segmentations(word: str, weights: dict[str, float], of_byte: dict[int, float]) -> list[tuple[list[str], float]]:
    """All ways to spell a word by pieces, with their weights; a character without a piece is spelled by its bytes."""
    if not word:
        return [([], 1.0)]
    out = []
    for n in range(1, len(word) + 1):
        piece = word[:n]
        w = weights.get(piece)
        if w is None and n == 1:
            w = math.prod(of_byte[b] for b in piece.encode())
        if w is not None:
            out += [([piece, *rest], w * v) for rest, v in segmentations(word[n:], weights, of_byte)]
    return out

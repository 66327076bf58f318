"""Cutting oversized texts into pieces at natural boundaries, through the structure of the text."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.tokens import TOKENIZERS, encoder
from tracefold.sources import table

LIMIT, OVERLAP = 512, 64

#: Levels of boundaries inside a node without children, the coarsest first.
_PARAGRAPH, _LINE, _SENTENCE, _SPACE = range(4)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_STOPS = np.isin(np.arange(256), list(b".!?;"))
_QUOTES = np.isin(np.arange(256), list(b"\"')]"))
#: Full stops of scripts that are written without spaces.
_WIDE_STOPS = ("\u3002".encode(), "\uff01".encode(), "\uff1f".encode())

_MARKUP = re.compile(rb"<(/?)(h[1-6]|section|article|main|header|footer|nav|aside|div|table|thead|tbody|tr|td|th|ul|ol|dl|li|dt|dd|p|pre|blockquote|form|fieldset|figure|head|body)\b[^<>]*>", re.I)
#: Elements that end an open one of the same group without a tag of its own.
_CLOSES = {b"li": (b"li",), b"dt": (b"dt", b"dd"), b"dd": (b"dt", b"dd"), b"tr": (b"tr", b"td", b"th"), b"td": (b"td", b"th"), b"th": (b"td", b"th")}
_DATA = re.compile(rb'"(?:\\.|[^"\\])*"|[{}\[\],]', re.S)
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(rb" {0,3}(#{1,6})(?:[ \t]|\r?$)")
_ITEM = re.compile(rb"([ \t]*)(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|\r?$)")
_UNDERLINE = re.compile(rb" {0,3}(=+|-{2,})[ \t]*\r?$")
_RULE = re.compile(rb" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")


def data_marks(data: bytes) -> list[tuple[int, int]]:
    """Where members of nested lists and objects begin: (byte, depth). Brackets and commas inside strings don't count."""
    out, depth = [], 0
    for m in _DATA.finditer(data):
        c = m[0]
        if c in b"{[":
            depth += 1
            out.append((m.end(), depth))
        elif c in b"}]":
            depth = max(0, depth - 1)
        elif c == b",":
            out.append((m.end(), depth))
    return out


def markup_marks(data: bytes) -> list[tuple[int, int]]:
    """Where block elements begin and end: (byte, depth). Headings open sections that hold what follows them."""
    out: list[tuple[int, int]] = []
    stack: list[bytes] = []
    for m in _MARKUP.finditer(data):
        tag = m[2].lower()
        if not m[1] and stack and stack[-1] == b"p":  # a paragraph ends where any block begins
            stack.pop()
        if tag[0] == 104 and len(tag) == 2 and tag[1:].isdigit():  # h1 to h6: a section, up to a heading as high or the container's end
            if not m[1]:
                while stack and stack[-1][:1] == b"#" and stack[-1][1:] >= tag[1:]:
                    stack.pop()
                out.append((m.start(), len(stack)))
                stack.append(b"#" + tag[1:])
            continue
        if m[1]:
            if tag in stack:
                while stack.pop() != tag:
                    pass
                out.append((m.end(), len(stack)))
            continue
        for other in _CLOSES.get(tag, ()):
            while stack and stack[-1] == other:
                stack.pop()
        out.append((m.start(), len(stack)))
        stack.append(tag)
    return out


def outline_marks(data: bytes) -> list[tuple[int, int]]:
    """Where sections, list items, fenced blocks and paragraphs begin: (byte, depth).

    A section holds what follows its heading up to one as high; an item holds
    items and paragraphs that are indented more. Inside a fence nothing is
    markup: the block is one node.
    """
    out: list[tuple[int, int]] = []
    sections: list[int] = []
    items: list[int] = []
    fence = b""
    blank, at, before = True, 0, -1
    for line in data.split(b"\n"):
        start, at = at, at + len(line) + 1
        if fence:
            body = line.strip()
            if body.startswith(fence) and not body.strip(fence[:1]):
                fence, blank = b"", True
            continue
        if not line.strip():
            blank, before = True, -1
            continue
        if m := _FENCE.match(line):
            fence = m[1]
            out.append((start, len(sections) + len(items)))
            continue
        level, where = 0, start
        if m := _HEADING.match(line):
            level = len(m[1])
        elif before >= 0 and (m := _UNDERLINE.match(line)):
            level, where = (1 if m[1][:1] == b"=" else 2), before
        if level:
            while sections and sections[-1] >= level:
                sections.pop()
            items = []
            if out and out[-1][0] == where:
                out.pop()
            out.append((where, len(sections)))
            sections.append(level)
            blank, before = True, -1
            continue
        if _RULE.match(line):
            items = []
            out.append((start, len(sections)))
            blank, before = True, -1
            continue
        m = _ITEM.match(line)
        if m:
            indent = len(m[1].expandtabs(4))
            while items and items[-1] >= indent:
                items.pop()
            out.append((start, len(sections) + len(items)))
            items.append(indent)
        elif blank:
            indent = len(line) - len(line.lstrip())
            while items and items[-1] >= indent:
                items.pop()
            out.append((start, len(sections) + len(items)))
        before = start if blank and not m else -1
        blank = False
    return out


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a text as the bytes where nodes begin, in order, with their depths.

    A node reaches to the next one that is not deeper. Data, markup and plain
    outlines are told apart by how the text begins and whether it has block tags.
    """
    head = data[:1].strip() or data.lstrip()[:1]
    if head in (b"{", b"[") and data.count(b'"') + data.count(b",") > data.count(b"\n"):
        marks = data_marks(data)
    else:
        marks = markup_marks(data)
        if len(marks) < 2:
            marks = outline_marks(data)
    if not marks:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    t = np.array(marks, dtype=np.int64)
    t = t[np.argsort(t[:, 0], kind="stable")]
    first = np.concatenate(([True], t[1:, 0] != t[:-1, 0]))
    depth = np.minimum.reduceat(t[:, 1], np.flatnonzero(first))
    return t[first, 0], depth


class _Text:
    """A text with its token edges and the boundaries of each level."""

    def __init__(self, text: str, enc, lengths: np.ndarray):
        self.data = text.encode("utf-8", "replace")
        self.enc = enc
        ids = enc.encode_to_numpy(text, disallowed_special=())
        self.edges = np.concatenate(([0], np.cumsum(lengths[ids]))) if len(ids) else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[raw]
        self.spaces = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if len(raw) else np.zeros(0, dtype=np.int64)
        self.levels = self._levels(raw, space)
        at, depth = structure(self.data)
        at, kept = self._snapped(at, space)
        self.nodes, self.depth = at, depth[kept]

    def _snapped(self, at: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places moved back to the start of the white space before them, those at token edges only, and which they were."""
        which = np.arange(len(at))
        if len(at) and len(self.spaces):
            k = np.searchsorted(self.spaces, at, "right") - 1
            head = np.where(k >= 0, self.spaces[k], at)
            solid = np.cumsum(~space, dtype=np.int32)
            inside = (k >= 0) & (head < at) & (solid[np.maximum(at - 1, 0)] == solid[np.maximum(head - 1, 0)])
            at = np.where(inside, head, at)
        if len(at):
            ok = np.concatenate(([True], at[1:] != at[:-1])) & (self.edges[np.minimum(self.edges.searchsorted(at), len(self.edges) - 1)] == at)
            at, which = at[ok], which[ok]
        return at, which

    def _levels(self, raw: np.ndarray, space: np.ndarray) -> list[np.ndarray]:
        """By level the bytes where a part may begin; white space belongs to the part after it."""
        lines = np.flatnonzero(raw == 10)
        blank = np.array([m.start() for m in re.finditer(rb"\n(?=[ \t\r]*\n)", self.data)], dtype=np.int64)
        before = self.spaces - 1
        quoted = _QUOTES[raw[before]] & (before > 0)
        stop = _STOPS[raw[before]] | (quoted & _STOPS[raw[before - 1]])
        wide = [i + len(w) for w in _WIDE_STOPS if w in self.data for i in _places(self.data, w)]
        sentence = np.sort(np.concatenate((self.spaces[stop], np.array(wide, dtype=np.int64)))) if wide else self.spaces[stop]
        return [self._snapped(x, space)[0] for x in (blank, lines, sentence, self.spaces)]

    def count(self, a: int, b: int) -> int:
        """Tokens from byte a to byte b, both at token edges."""
        return int(self.edges.searchsorted(b) - self.edges.searchsorted(a))

    def cuts(self, level: int, a: int, b: int) -> np.ndarray:
        c = self.levels[level]
        return c[c.searchsorted(a, "right") : c.searchsorted(b)]

    def whole(self, k: int) -> bool:
        """Is byte k not inside a character?"""
        return k >= len(self.data) or (self.data[k] & 0xC0) != 0x80


def _places(data: bytes, what: bytes) -> list[int]:
    out, i = [], data.find(what)
    while i >= 0:
        out.append(i)
        i = data.find(what, i + len(what))
    return out


def _merged(t: _Text, edges: list[int], room: int, inner: Callable[[int, int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Sibling parts between ``edges``: neighbours that fit together are merged, an oversized one is cut by ``inner`` by itself."""
    sizes = np.diff(np.searchsorted(t.edges, edges)).tolist()
    out: list[tuple[int, int]] = []
    last = 0
    for i, n in enumerate(sizes):
        if n > room:
            out += inner(i, edges[i], edges[i + 1])
            last = room
        elif out and last + n <= room:
            out[-1] = (out[-1][0], edges[i + 1])
            last += n
        else:
            out.append((edges[i], edges[i + 1]))
            last = n
    return out


def _tree(t: _Text, a: int, b: int, room: int) -> list[tuple[int, int]]:
    """Pieces (from, to) of one node, none above ``room``.

    A node that fits is a piece. Of an oversized one only the children are
    looked at: sibling subtrees that fit together are merged, an oversized child
    is cut alike and shares no piece with its siblings. A node without children
    is cut at paragraphs, lines, sentences or blanks, whichever first occurs.
    """
    if t.count(a, b) <= room:
        return [(a, b)]
    i, j = t.nodes.searchsorted(a, "right"), t.nodes.searchsorted(b)
    if i < j:
        cuts = t.nodes[i:j][t.depth[i:j] == t.depth[i:j].min()]
        return _merged(t, [a, *cuts.tolist(), b], room, lambda _, x, y: _tree(t, x, y, room))
    return _leaf(t, a, b, room, 0)


def _leaf(t: _Text, a: int, b: int, room: int, level: int) -> list[tuple[int, int]]:
    while level < len(t.levels) and not len(t.cuts(level, a, b)):
        level += 1
    if level < len(t.levels):
        return _merged(t, [a, *t.cuts(level, a, b).tolist(), b], room, lambda _, x, y: _leaf(t, x, y, room, level + 1))
    out, i, end = [], int(np.searchsorted(t.edges, a)), int(np.searchsorted(t.edges, b))
    while i < end:
        j = min(i + room, end)
        while j > i + 1 and not t.whole(int(t.edges[j])):
            j -= 1
        if not t.whole(int(t.edges[j])):
            while j < end and not t.whole(int(t.edges[j])):
                j += 1
        out.append((int(t.edges[i]), int(t.edges[j])))
        i = j
    return out


def pieces(text: str, enc, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, tokens, overlapping tokens) per piece, in bytes of the text.

    Pieces without their overlap add up to the text. Each but the first repeats
    up to ``overlap`` tokens of the one before, from the nearest start of white
    space on. A piece begins and ends where white space begins wherever there is
    any, since tokens then are the same alone as in the whole; other pieces are
    counted by themselves and cut again if they don't fit.
    """
    if len(text.encode("utf-8", "replace")) <= limit:  # a token has a byte at least
        n = len(enc.encode_ordinary(text))
        return [(0, len(text.encode("utf-8", "replace")), n, 0)]
    t = _Text(text, enc, lengths)
    end = len(t.data)
    if len(t.edges) - 1 <= limit:
        return [(0, end, len(t.edges) - 1, 0)]
    room = limit - overlap
    spaces = t.cuts(_SPACE, 0, end)
    safe = set(spaces.tolist()) | {0, end}
    out: list[tuple[int, int, int, int]] = []
    todo = _tree(t, 0, end, room)[::-1]
    while todo:
        a, b = todo.pop()
        start = a
        if out and overlap:
            i = int(np.searchsorted(t.edges, a))
            back = int(t.edges[max(0, i - overlap)])
            k = int(np.searchsorted(spaces, back))
            start = int(spaces[k]) if k < len(spaces) and spaces[k] < a else next((int(e) for e in t.edges[max(0, i - overlap) : i] if t.whole(int(e))), a)
            start = max(start, out[-1][0])
        n, shared = t.count(start, b), t.count(start, a)
        if start not in safe or b not in safe:
            n = len(enc.encode_ordinary(t.data[start:b].decode("utf-8", "replace")))
            if n > limit:
                if start < a:  # first give up the overlap
                    start, shared = a, 0
                    n = len(enc.encode_ordinary(t.data[start:b].decode("utf-8", "replace")))
                if n > limit:
                    i, j = np.searchsorted(t.edges, [a, b])
                    mid = next((int(e) for e in t.edges[(i + j) // 2 : j] if t.whole(int(e))), b)
                    if a < mid < b:
                        todo += [(mid, b), (a, mid)]
                        continue
        out.append((start, b, n, shared))
    return out


def split_texts(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every text as pieces of at most ``limit`` tokens.

    Output: ``key``, ``piece_no``, ``n_pieces``, ``overlap_tokens`` (at the start,
    shared with the piece before), ``n_tokens``, ``piece``. A text within the
    limit is one piece; a NULL or empty text gives none. Cutting is per text, so
    rows never move; a very long text is one task's work on one row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to below limit")

    def run(batches):
        enc, lengths = encoder(tokenizers)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                s = x.as_py()
                if not s:
                    continue
                data = s.encode("utf-8", "replace")
                ps = pieces(s, enc, lengths, limit, overlap)
                for i, (start, stop, n, shared) in enumerate(ps):
                    for c, v in zip(cols, (k, i, len(ps), shared, n, data[start:stop].decode("utf-8", "replace"))):
                        c.append(v)
                size += len(data)
                if size > 8_000_000:
                    yield out(cols, b.schema.field(0).type)
                    cols, size = [[], [], [], [], [], []], 0
            yield out(cols, b.schema.field(0).type)

    def out(cols, kind):
        kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[key, "piece_no", "n_pieces", "overlap_tokens", "n_tokens", "piece"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece_no int, n_pieces int, overlap_tokens int, n_tokens int, piece string")


def p10_pieces(spark: SparkSession, store: str) -> DataFrame:
    return split_texts(table(spark, store, "documents"), "doc_id", "text")

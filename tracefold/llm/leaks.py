"""Evaluation passages inside training texts: a generalised suffix automaton of the items."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.sources import table

#: Words of all items that one automaton may hold (it has twice as many states at most); more items are taken in blocks,
#: each of which reads the texts once.
BLOCK_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[/!]?[A-Za-z!-][^<>]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"/\\]))")


def words(text: str) -> list[str]:
    """Words without regard to case, punctuation, white space and markup.

    Escapes of JSON and entities of HTML are read, tags and the targets of
    Markdown links removed, and compatible characters unified.
    """
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """All substrings of several word sequences, each state with the items it occurs in."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owner: list[set[int]] = [set()]
        for item, sequence in items:
            last = 0
            for w in sequence:
                last = self._append(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1), owner)
                owner[last].add(item)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                owner[self.link[s]] |= owner[s]
        # a match of `least` words or more belongs to the items of the shortest such suffix's state
        self.items: list[tuple[int, ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            if self.length[s] >= least:
                up = self.link[s]
                self.items[s] = self.items[up] if self.length[up] >= least else tuple(sorted(owner[s]))

    def _state(self, length: int, link: int, following: dict[int, int], owner: list[set[int]], items: set[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        owner.append(items)
        return len(self.link) - 1

    def _append(self, last: int, w: int, owner: list[set[int]]) -> int:
        if (there := self.next[last].get(w)) is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, there, w, owner)
        new = self._state(self.length[last] + 1, 0, {}, owner, set())
        s = last
        while s >= 0 and w not in self.next[s]:
            self.next[s][w] = new
            s = self.link[s]
        if s >= 0:
            q = self.next[s][w]
            self.link[new] = q if self.length[q] == self.length[s] + 1 else self._split(s, q, w, owner)
        return new

    def _split(self, s: int, q: int, w: int, owner: list[set[int]]) -> int:
        half = self._state(self.length[s] + 1, self.link[q], dict(self.next[q]), owner, set(owner[q]))
        self.link[q] = half
        while s >= 0 and self.next[s].get(w) == q:
            self.next[s][w] = half
            s = self.link[s]
        return half

    def tables(self) -> tuple:
        """The automaton as flat arrays, to be sent to the workers."""
        count = [len(d) for d in self.next]
        state = np.repeat(np.arange(len(self.next), dtype=np.int64), count)
        word = np.fromiter((w for d in self.next for w in d), dtype=np.int64, count=sum(count))
        to = np.fromiter((t for d in self.next for t in d.values()), dtype=np.int32, count=sum(count))
        return self.vocabulary, state * (len(self.vocabulary) + 1) + word, to, np.array(self.link, dtype=np.int32), np.array(self.length, dtype=np.int32), self.items


class _Walker:
    """A sent automaton, ready to walk: one flat map of (state, word) to state."""

    def __init__(self, tables: tuple):
        self.vocabulary, moves, to, link, length, self.items = tables
        self.n_words = len(self.vocabulary) + 1
        self.moves = dict(zip(moves.tolist(), to.tolist()))
        self.link, self.length = link.tolist(), length.tolist()

    def walk(self, ids: list[int], least: int):
        """(position of the last word, matched length, items) wherever at least ``least`` words match."""
        s = n = 0
        get, size, link, length, items = self.moves.get, self.n_words, self.link, self.length, self.items
        for i, w in enumerate(ids):
            t = get(s * size + w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = get(s * size + w)
            if t is None:
                n = 0
            else:
                s, n = t, n + 1
                if n >= least:
                    yield i, n, items[s]

    def scan(self, ws: list[str], least: int) -> list[tuple[int, int, tuple]]:
        """The matches among words. Only runs of words that occur in items are walked."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))
        out: list[tuple[int, int, tuple]] = []
        if len(ids) >= least:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= least:
                    out += [(int(a) + i, n, items) for i, n, items in self.walk(ids[a:b].tolist(), least)]
        return out


_walkers: dict[int, _Walker] = {}


def _walker(shared) -> _Walker:
    """The walker of a broadcast automaton, made once per worker process."""
    key = id(shared.value)
    if key not in _walkers:
        _walkers.clear()
        _walkers[key] = _Walker(shared.value)
    return _walkers[key]


def _blocks(items: DataFrame, key: str, passage: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of a bounded number of words; the driver holds one block at a time. NULL keys or passages are left out."""
    rows = items.select(key, passage).where(F.col(passage).isNotNull() & F.col(key).isNotNull())
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in rows.toLocalIterator():
        w = words(r[1])
        while size + len(w) > BLOCK_WORDS and block:
            yield block
            block, size = [], 0
        block.append((r[0], w))
        size += len(w)
    yield block


_CHAR = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def words_at(text: str) -> list[tuple[str, int, int]]:
    """``words`` with the places in the text where each begins and ends; slower, for texts that hold something."""
    at = list(range(len(text)))

    def sub(pattern: re.Pattern, new, s: str, at: list[int]) -> tuple[str, list[int]]:
        out, pos, last = [], [], 0
        for m in pattern.finditer(s):
            x = new(m)
            out += [s[last : m.start()], x]
            pos += at[last : m.start()] + [at[m.start()]] * len(x)
            last = m.end()
        return "".join([*out, s[last:]]), pos + at[last:]

    text_len = len(text)
    text, at = sub(_ESCAPE, lambda m: chr(int(m[1], 16)) if m[1] else " ", text, at)
    text, at = sub(_CHAR, lambda m: html.unescape(m[0]), text, at)
    text, at = sub(_TAG, lambda m: " ", text, at)
    text, at = sub(_LINK, lambda m: " ", text, at)
    if not text.isascii():
        text, at = sub(_MARKED, lambda m: unicodedata.normalize("NFKC", m[0]), text, at)
    lower = [c.lower() for c in text]
    if any(len(c) != 1 for c in lower):
        at = [p for c, p in zip(lower, at) for _ in c]
    return [(m[0], at[m.start()], at[m.end() - 1] + 1 if m.end() - 1 < len(at) else text_len) for m in _WORD.finditer("".join(lower))]


_MARKED = re.compile(r"[^\x00-\x7f]+|[\x00-\x7f](?=[\u0300-\u036f])[\u0300-\u036f]+")


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, passage: str, least: int = 12) -> DataFrame:
    """One row per item and document that hold ``least`` consecutive words in common.

    Columns: ``item``, ``key``, ``longest`` (words of the longest match). The
    items become one automaton per block of bounded size, built once, sent to the
    workers and kept there; texts stream through it and never move. Texts or
    passages that are NULL, empty or shorter than ``least`` words give no rows,
    nor do items without a key; a document without a key counts as one.
    Repeated rows give their rows again only if their keys differ.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = items.schema[item].dataType, docs.schema[key].dataType
    schema = T.StructType([T.StructField("item", kinds[0]), T.StructField("doc", kinds[1]), T.StructField("longest", T.IntegerType())])
    arrow = [to_arrow_type(k) for k in kinds]
    out = None
    for block in _blocks(items, item, passage):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, least).tables())

        def run(batches, shared=shared):
            walker = _walker(shared)
            for b in batches:
                found: list[tuple] = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                    if not (t := t.as_py()):
                        continue
                    best: dict = {}
                    for _, n, its in walker.scan(words(t), least):
                        for i in its:
                            best[i] = max(best.get(i, 0), n)
                    found += [(i, k, n) for i, n in best.items()]
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow[0]), pa.array(cols[1], arrow[1]), pa.array(cols[2], pa.int32())], names=["item", "doc", "longest"])

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("item").alias(item), F.col("doc").alias(key)).agg(F.max("longest").alias("longest"))


def strip_leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, passage: str, least: int = 12, coverage: float = 0.5) -> DataFrame:
    """Every document without the passages that leaked into it.

    Output: ``key``, ``n_words``, ``leaked_words``, ``spans`` (word ranges [start,
    stop) inside items), ``action`` and ``cleaned``. 'keep' leaves the text as it
    is, 'cut' takes the spans' characters out, 'drop' (spans over more than
    ``coverage`` of the words) gives a NULL text. NULL and empty texts are kept.
    With several blocks of items the texts pass one automaton after another;
    what one has cut the next doesn't see, so spans of later blocks count words
    of the text as it then is. Documents without a key are treated alike.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("leaked_words", T.LongType()), T.StructField("spans", span), T.StructField("whole", T.LongType()), T.StructField("t", T.StringType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(key).alias("k"), F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("leaked_words"), F.array().cast(span).alias("spans"), F.lit(None).cast("long").alias("whole"), F.col(text).alias("t"))
    for block in _blocks(items, item, passage):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, least).tables())

        def run(batches, shared=shared):
            walker = _walker(shared)
            for b in batches:
                cols: list[list] = [[], [], [], [], [], []]
                for k, _, leaked, spans, whole, t in zip(*(c.to_pylist() for c in b.columns)):
                    ws = words(t) if t else []
                    if walker.scan(ws, least):
                        placed = words_at(t)
                        ws = [w for w, _, _ in placed]
                        here: list[list[int]] = []
                        for i, m, _ in walker.scan(ws, least):
                            if here and i - m + 1 <= here[-1][1]:
                                here[-1] = [min(here[-1][0], i - m + 1), i + 1]
                            else:
                                here.append([i - m + 1, i + 1])
                        spans = spans + [{"start": x, "stop": y} for x, y in here]
                        leaked += sum(y - x for x, y in here)
                        for x, y in reversed(here):
                            t = t[: placed[x][1]] + t[placed[y - 1][2] :]
                    for c, v in zip(cols, (k, len(ws), leaked, spans, len(ws) if whole is None else whole, t)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        rows = rows.mapInArrow(run, schema)
    action = F.when(F.col("leaked_words") == 0, "keep").when(F.col("leaked_words") > coverage * F.col("whole"), "drop").otherwise("cut")
    return rows.withColumn("action", action).select(F.col("k").alias(key), F.coalesce("whole", F.lit(0)).alias("n_words"), "leaked_words", "spans", "action", F.when(F.col("action") != "drop", F.col("t")).alias("cleaned"))


def p9_found(spark: SparkSession, store: str) -> DataFrame:
    return leaks(table(spark, store, "documents"), table(spark, store, "eval_items"), "doc_id", "text", "item_id", "passage").select("item_id", "doc_id")


def p9_cleaned(spark: SparkSession, store: str) -> DataFrame:
    """Every document with what leaked into it taken out."""
    s = strip_leaks(table(spark, store, "documents"), table(spark, store, "eval_items"), "doc_id", "text", "item_id", "passage")
    return s.select("doc_id", "n_words", "leaked_words", F.size("spans").alias("n_spans"), "action", "cleaned")

"""Full-text search: an index of postings, the query language, ranking and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions.bodies import MAX_INDEXED, indexable
from tracefold.plans.shared import exists

TOKENIZERS = ("unicode61", "porter", "trigram")
#: Parts of the index by token; a search reads only those its words fall in.
PARTS = 64
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: str) -> str:
    """The stem of an English word by the usual suffix-stripping steps."""
    if len(word) < 3 or not word.isascii():
        return word
    shape = lambda w: re.sub("v+", "V", re.sub("c+", "C", "".join("v" if c in "aeiou" or (c == "y" and i and w[i - 1] not in "aeiou") else "c" for i, c in enumerate(w))))
    m = lambda w: shape(w).count("VC")
    vowel = lambda w: "V" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and shape(w[-1]) == "C"

    def short(w: str) -> bool:  # consonant, vowel, consonant other than w, x, y
        return len(w) > 2 and w[-1] not in "aeiouwxy" and shape(w[: len(w)])[-2:] == "VC" and w[-2] in "aeiouy" and w[-3] not in "aeiou"

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (
        # The suffixes of the second and third step with what they become.
        "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log",
        "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:",
    ):
        for pair in steps.split():
            end, new = pair.split(":")
            if w.endswith(end):
                if m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split():
        if w.endswith(end):
            base = w[: -len(end)]
            if m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if m(w) > 1 and double(w) and w.endswith("l") else w


@F.pandas_udf(T.StringType())
def _stemmed(token: pd.Series) -> pd.Series:
    return token.map({t: stem(t) for t in token.unique()})


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)), na_action="ignore")


def without_marks(text: Column) -> Column:
    """The text without diacritics; ASCII texts never leave the JVM."""
    other = text.rlike(r"[^\x00-\x7f]")
    return F.when(other, _plain(F.when(other, text))).otherwise(text)


def postings(docs: DataFrame, key: str, text: str, tokenizer: str = "unicode61") -> DataFrame:
    """``token``, ``key``, ``tf`` and ``positions``. NULL and empty texts have none.

    unicode61 folds case and drops diacritics, porter also takes stems, trigram
    indexes every three characters in a row.
    """
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), without_marks(F.col(text)).alias("__t"))
    if tokenizer == "trigram":
        low = F.lower("__t")
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substring(low, i, F.lit(3)))
        rows = rows.where(F.length("__t") >= 3).select(key, F.posexplode(cut).alias("position", "token"))
    else:
        rows = rows.select(key, F.posexplode(tokens(F.col("__t"))).alias("position", "token"))
        if tokenizer == "porter":
            rows = rows.withColumn("token", _stemmed("token"))
    # grouped by token and document: a hot token is as many groups as documents that hold it
    return rows.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


class Index:
    """Postings and lengths of texts kept at a path, in parts by token.

    ``add`` replaces what the index has of the same keys, ``remove`` takes keys
    out. A search without an index is an error that says how to make one.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = "unicode61"):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")

    def build(self, docs: DataFrame, key: str, text: str) -> Index:
        """The index made anew from ``docs``."""
        d = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text"))
        p = postings(d, "doc", "text", self.tokenizer).withColumn("part", self._part())
        # parts of a bounded size: small ones together, one with a hot token in several
        p.hint("rebalance", "part").sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings")
        d.write.mode("overwrite").parquet(f"{self.path}/docs")
        p = self.spark.read.parquet(f"{self.path}/postings")
        p.groupBy("doc").agg(F.sum("tf").alias("len")).write.mode("overwrite").parquet(f"{self.path}/lengths")
        return self

    def build_bodies(self, blobs: DataFrame, entries: DataFrame | None = None, cap: int = MAX_INDEXED) -> Index:
        """The index of bodies that can be searched, of those that entries name as answers if entries are given."""
        b = blobs.where(indexable(F.col("content"), F.col("mime_type"), cap))
        if entries is not None:
            b = b.join(entries.select(F.col("response_body_hash").alias("hash")).where("hash is not null").distinct(), "hash", "left_semi")
        return self.build(b.select("hash", F.col("content").cast("string").alias("body")), "hash", "body")

    def update(self, docs: DataFrame, key: str, text: str, gone: DataFrame | None = None) -> Index:
        """Adds texts, instead of older ones of the same key, and takes the keys of ``gone`` (column ``doc``) out."""
        new = docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text"))
        keys = new.select("doc") if gone is None else new.select("doc").unionByName(gone.select(F.col("doc").cast("string").alias("doc")))
        old = self.spark.read.parquet(f"{self.path}/docs").join(keys.distinct(), "doc", "left_anti")
        fresh = Index(self.spark, f"{self.path}-next", self.tokenizer).build(old.unionByName(new), "doc", "text")
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(p(self.path), True)
        fs.rename(p(fresh.path), p(self.path))
        return self

    def _read(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            raise ValueError(f"there is no search index at {self.path}: make one with fts-rebuild")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, query: str) -> DataFrame:
        """Documents that match, with ``score``; the smallest is the best."""
        return Search(self._read("postings"), self._read("lengths"), self.tokenizer).run(parse(query))

    def snippets(self, hits: DataFrame, query: str, words: int = 12) -> DataFrame:
        """``hits`` with ``snippet``: the words around the first match, matches in brackets."""
        return hits.join(self._read("docs"), "doc").withColumn("snippet", snippet(F.col("text"), sorted(set(leaves(parse(query)))), words)).drop("text")


@dataclass
class Node:
    """A part of a query: 'word', 'prefix', 'phrase', 'near', 'and', 'or' or 'not'."""

    kind: str
    words: list[str] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)
    within: int = 10


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|([():,+^])|(\w+)\s*:(?!\s*$)|([^\s"():,+*^]+)(\*)?)')


def parse(text: str) -> Node:
    """A query: words (all of them), "phrases", prefixes*, AND, OR, NOT, parentheses, NEAR(a b, n), a NEAR/n b, column: parts.

    NOT binds closest, then AND (or nothing), then OR. A column's name is read
    and of no effect, since there is one column. An unreadable query is a ValueError.
    """
    lexed, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unreadable query at {text[at:]!r}")
        at = m.end()
        if m[1] is not None:
            lexed.append(("phrase", m[1].replace('""', '"'), bool(m[2])))
        elif m[3]:
            lexed.append((m[3], m[3], False))
        elif m[4]:
            continue
        else:
            lexed.append(("op" if m[5] in ("AND", "OR", "NOT") or re.fullmatch(r"NEAR(/\d+)?", m[5]) else "word", m[5], bool(m[6])))
    pos = 0

    def peek(k: int = 0):
        return lexed[pos + k] if pos + k < len(lexed) else ("end", "", False)

    def term() -> Node:
        nonlocal pos
        kind, s, star = peek()
        pos += 1
        if kind == "(":
            n = either()
            if peek()[0] != ")":
                raise ValueError("a parenthesis is missing")
            pos += 1
            return n
        if kind == "op" and s == "NEAR" and peek()[0] == "(":
            pos += 1
            ws, within = [], 10
            while peek()[0] not in (")", ",", "end"):
                ws += words_of(peek()[1])
                pos += 1
            if peek()[0] == ",":
                within = int(peek(1)[1])
                pos += 2
            if peek()[0] != ")" or not ws:
                raise ValueError("NEAR is not complete")
            pos += 1
            return Node("near", ws, within=within)
        if kind not in ("word", "phrase"):
            raise ValueError(f"unreadable query: a word is missing before {s!r}")
        ws = words_of(s)
        if not ws:
            raise ValueError("unreadable query: no word")
        if star and len(ws) == 1:
            return Node("prefix", ws)
        return Node("word", ws) if len(ws) == 1 else Node("phrase", ws)

    def close() -> Node:
        nonlocal pos
        n = term()
        while peek()[0] == "op" and peek()[1].startswith("NEAR") and peek(1)[0] != "(":
            within = int(peek()[1][5:] or 10)
            pos += 1
            n = Node("near", n.words + term().words, within=within)
        while peek()[0] == "op" and peek()[1] == "NOT":
            pos += 1
            n = Node("not", parts=[n, term()])
        return n

    def both() -> Node:
        nonlocal pos
        parts = [close()]
        while True:
            if peek()[0] == "op" and peek()[1] == "AND":
                pos += 1
                parts.append(close())
            elif peek()[0] in ("word", "phrase", "(") or (peek()[0] == "op" and peek()[1] == "NEAR" and peek(1)[0] == "("):
                parts.append(close())
            else:
                return parts[0] if len(parts) == 1 else Node("and", parts=parts)

    def either() -> Node:
        nonlocal pos
        parts = [both()]
        while peek()[0] == "op" and peek()[1] == "OR":
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=parts)

    out = either()
    if pos < len(lexed):
        raise ValueError(f"unreadable query at {peek()[1]!r}")
    return out


def words_of(text: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"[\W_]+", plain) if w]


def leaves(n: Node, wanted: bool = True) -> list[str]:
    """The words a query looks for; those behind NOT are none."""
    if n.kind == "not":
        return leaves(n.parts[0])
    return [w + "*" if n.kind == "prefix" else w for w in n.words] + [w for p in n.parts for w in leaves(p)]


class Search:
    """Runs a parsed query over postings: only those of its words are read."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, tokenizer: str = "unicode61"):
        self.tokenizer, self.postings, self.lengths = tokenizer, postings, lengths

    def _of(self, word: str) -> DataFrame:
        w = stem(word) if self.tokenizer == "porter" else word
        rows = self.postings.where(F.col("token") == w)
        return rows.where(F.col("part") == F.pmod(F.xxhash64(F.lit(w)), F.lit(PARTS)).cast("int")) if "part" in self.postings.columns else rows

    def _docs(self, n: Node) -> DataFrame:
        """Documents (``doc``) that match a node, once each."""
        if n.kind == "word":
            return self._of(n.words[0]).select("doc")
        if n.kind == "prefix":
            return self.postings.where(F.col("token").startswith(n.words[0])).select("doc").distinct()
        if n.kind in ("phrase", "near"):
            out = None
            for i, w in enumerate(n.words):
                p = self._of(w).select("doc", F.col("positions").alias(f"p{i}"))
                out = p if out is None else out.join(p, "doc")
            if n.kind == "phrase":
                rest = lambda at: _all_of([F.array_contains(f"p{i}", at + i) for i in range(1, len(n.words))])
                return out.where(F.exists("p0", rest)).select("doc")
            # all words within a window: around some place of the first that is left of none or more
            ends = [F.col(f"p{i}") for i in range(len(n.words))]
            window = F.exists(F.array_distinct(F.flatten(F.array(*ends))), lambda at: _all_of([F.exists(p, lambda x: x.between(at, at + n.within + len(n.words) - 1)) for p in ends]))
            return out.where(window).select("doc")
        if n.kind == "not":
            return self._docs(n.parts[0]).join(self._docs(n.parts[1]), "doc", "left_anti")
        out = self._docs(n.parts[0])
        for p in n.parts[1:]:
            out = out.join(self._docs(p), "doc", "left_semi") if n.kind == "and" else out.unionByName(self._docs(p)).distinct()
        return out

    def _in_threes(self, n: Node) -> Node:
        """A query over every three characters in a row: words and phrases match anywhere inside a text; shorter ones match nothing."""
        if n.kind in ("word", "prefix", "phrase"):
            t = " ".join(n.words)
            return Node("phrase", [t[i : i + 3] for i in range(max(1, len(t) - 2))])
        return Node(n.kind, n.words, [self._in_threes(p) for p in n.parts], n.within)

    def run(self, n: Node) -> DataFrame:
        """Matching documents with their BM25 score, negative, the smallest best; phrases count by their words."""
        n = self._in_threes(n) if self.tokenizer == "trigram" else n
        hits = self._docs(n)
        total = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))  # one row
        parts = []
        for w in dict.fromkeys(leaves(n)):
            p = self.postings.where(F.col("token").startswith(w[:-1])).groupBy("doc").agg(F.sum("tf").alias("tf")) if w.endswith("*") else self._of(w).select("doc", "tf")
            df = p.agg(F.count(F.lit(1)).alias("df"))  # one row
            parts.append(p.join(hits, "doc", "left_semi").join(F.broadcast(df)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.join(F.broadcast(total)).join(self.lengths, "doc")
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        return rows.groupBy("doc").agg(F.round(-F.sum(s), 6).alias("score"))


def _starting(s: str):
    return lambda t: t.startswith(s)


def _all_of(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def snippet(text: Column, words: list[str], width: int = 12) -> Column:
    """``width`` words from the text's first match on (or its start), matches in brackets, an ellipsis where more stands before or after."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    exact, starts = [w for w in words if not w.endswith("*")], [w[:-1] for w in words if w.endswith("*")]

    def hit(w: Column) -> Column:
        own = tokens(w)
        c = F.arrays_overlap(own, F.array(*map(F.lit, exact))) if exact else F.lit(False)
        for s in starts:
            c = c | F.exists(own, _starting(s))
        return c

    first = F.greatest(F.array_position(F.transform(parts, hit), True).cast("int"), F.lit(1))
    begin = F.greatest(F.least(first, F.size(parts) - width + 1), F.lit(1))
    shown = F.array_join(F.transform(F.slice(parts, begin, F.lit(width)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(begin > 1, "...").otherwise(""), shown, F.when(begin + width - 1 < F.size(parts), "...").otherwise(""))


def entries_of_hits(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose answer's body was hit, the best first, then by start and id."""
    j = entries.join(hits.select(F.col("doc").alias("response_body_hash"), "score", *(c for c in hits.columns if c == "snippet")), "response_body_hash")
    return j.select("id", "started_at", "url", "status", "score", *(c for c in hits.columns if c == "snippet")).orderBy("score", F.asc_nulls_first("started_at"), "id")


def working_index(spark: SparkSession, docs: DataFrame, key: str, text: str, tokenizer: str = "unicode61") -> Index:
    """An index in the shared folder that goes when the session ends."""
    from tracefold.plans.shared import Spool, delete_at_exit

    path = Spool(spark).root
    delete_at_exit(spark, path)
    return Index(spark, path, tokenizer).build(docs, key, text)

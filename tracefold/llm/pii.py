"""Personal information inside free text, found by a tagger and replaced by typed placeholders.

A text is first made readable (percent codes, also nested, escapes of JSON,
entities of HTML), every character keeping its place in the original. Every
character of it then goes through the network, in overlapping windows whose
scores are blended; one best path is decoded over the blended scores. What is found passes a check of its written form: whole
words, a possible number of digits, the check digit of cards.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import pii_model as M
from tracefold.llm.repeats import text_of
from tracefold.sources import table

WINDOW, OVERLAP = 512, 48
#: Characters that are decoded at once, and those on either side that are decoded with them.
SEGMENT, MARGIN = 1024, 96
#: Windows that are scored together, and segments that are decoded together.
ROWS, SEGMENTS = 384, 384
#: Characters of texts that are held at once; longer ones are read in such slices, with some around each.
SLICE, AROUND = 400_000, 256
TOKENS = {k: f"<{k.upper()}>" for k in M.KINDS}

_CODE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9a-fA-F]{4}|\\[nrtbf\"/\\]|&(?:#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[A-Za-z]{2,8});|\+")

_VALUE = re.compile(r"""(?:[=:]\s*|\bname is )["']?$""", re.I)


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def readable(text: str, form: bool) -> tuple[str, list[int] | None]:
    """The text with its codes read, and where each character begins in the original (None: unchanged).

    ``form``: a plus sign after the first ``?`` or ``=`` is a blank. Codes are
    read again as long as that changes anything; each turn shortens the text, so
    it ends.
    """
    at: list[int] | None = None
    turn = -1
    while True:
        turn += 1
        if not ("%" in text or "\\" in text or "&" in text or (turn == 0 and form and "+" in text)):
            break
        cut = min((i for i in (text.find("?"), text.find("=")) if i >= 0), default=len(text))
        out: list[str] = []
        pos: list[int] = []
        last, changed = 0, False
        for m in _CODE.finditer(text):
            s = m[0]
            if s[0] == "%":
                b = bytes.fromhex(s.replace("%", ""))
                new = b.decode("utf-8", "surrogateescape") if b.isascii() else b.decode("utf-8", "replace")
            elif s[0] == "+":
                if turn or not form or m.start() < cut:
                    continue
                new = " "
            elif s[0] == "\\":
                new = chr(int(s[2:], 16)) if s[1] == "u" else {"n": "\n", "r": "\r", "t": "\t"}.get(s[1], " " if s[1] in "bf" else s[1])
            else:
                new = html.unescape(s)
                if new == s:
                    continue
            out += [text[last : m.start()], new]
            pos += range(last, m.start())
            pos += [m.start()] * len(new)
            last, changed = m.end(), True
        if not changed:
            break
        out.append(text[last:])
        pos += range(last, len(text))
        text = "".join(out)
        at = pos if at is None else [at[i] for i in pos]
    return text, at


def _scores(w: dict, coded: list[np.ndarray]) -> list[np.ndarray]:
    """Blended scores (time, tags) of each coded text."""
    rows: list[np.ndarray] = []
    home: list[tuple[int, int]] = []
    for i, c in enumerate(coded):
        starts = [0] if len(c) <= WINDOW else [*range(0, len(c) - WINDOW, WINDOW - OVERLAP), len(c) - WINDOW]
        for s in starts:
            rows.append(c[s : s + WINDOW])
            home.append((i, s))
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(lengths, kind="stable")
    out: list[np.ndarray] = [np.zeros((len(c), M.N_TAGS), dtype=np.float32) if len(c) > WINDOW else c for c in coded]
    weight = {i: np.zeros(len(c), dtype=np.float32) for i, c in enumerate(coded) if len(c) > WINDOW}
    for k in range(0, len(order), ROWS):
        part = order[k : k + ROWS]
        e = M.fast_emissions(w, [rows[r] for r in part]).transpose(1, 0, 2)
        for j, r in enumerate(part):
            i, s = home[r]
            n = lengths[r]
            if i not in weight:
                out[i] = e[j, :n]
                continue
            edge = np.minimum(np.arange(n) + 1, n - np.arange(n)).astype(np.float32)
            if s == 0:
                edge[: n // 2] = n
            if s + n == len(coded[i]):
                edge[n // 2 :] = n
            out[i][s : s + n] += e[j, :n] * edge[:, None]
            weight[i][s : s + n] += edge
    for i, x in weight.items():
        out[i] /= x[:, None]
    return out


def _runs(w: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Tagged runs (kind, from, to) of each text.

    Scores are decoded in segments with a margin on both sides; a run belongs to
    the segment it begins in.
    """
    scores = _scores(w, [M.codes(t) for t in texts])
    parts = [(i, a, max(0, a - MARGIN), min(len(e), a + SEGMENT + MARGIN)) for i, e in enumerate(scores) for a in range(0, len(e), SEGMENT)]
    parts.sort(key=lambda p: p[3] - p[2])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k in range(0, len(parts), SEGMENTS):
        some = parts[k : k + SEGMENTS]
        e = np.zeros((len(some), some[-1][3] - some[-1][2], M.N_TAGS), dtype=np.float32)
        for j, (i, _, x, y) in enumerate(some):
            e[j, : y - x] = scores[i][x:y]
        tags = M.viterbi(w, np.ascontiguousarray(e.transpose(1, 2, 0)), np.array([y - x for _, _, x, y in some]))
        kind = (tags + 1) // 2
        before = np.concatenate((np.zeros((len(some), 1), dtype=kind.dtype), kind[:, :-1]), axis=1)
        begins = (kind > 0) & ((tags % 2 == 1) | (before != kind))
        for j, s in zip(*np.nonzero(begins)):
            i, a, x, _ = some[j]
            if not a <= x + s < a + SEGMENT:
                continue
            stop = np.flatnonzero(begins[j, s + 1 :] | (kind[j, s + 1 :] != kind[j, s]))
            end = s + 1 + int(stop[0]) if len(stop) else kind.shape[1]
            out[i].append((M.KINDS[kind[j, s] - 1], x + int(s), x + end))
    for runs in out:
        runs.sort(key=lambda r: r[1])
    return out


def _plausible(kind: str, s: str, text: str, a: int, b: int) -> bool:
    """A check of the written form of what the tagger found.

    Whole words only; an address of mail has its sign, a telephone number seven
    to fifteen digits, an identity number six digits or letters in all; a run of
    card length that is bare or grouped like a card's needs the check digit; a
    street address has a number; a name has none and is not part of a mail address.
    One word alone, or words in small letters, are a name only as the value of
    something (after a key's sign, or after "name is"), and one word in small
    letters never is.
    """
    if (a and text[a - 1].isalnum() and s[0].isalnum()) or (b < len(text) and text[b].isalnum() and s[-1].isalnum()):
        return False
    digits = re.sub(r"\D", "", s)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", s, re.I)) and sum(c.isalnum() for c in s) >= 5
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "id_number":
        groups = [len(g) for g in re.findall(r"\d+", s)]
        if 13 <= len(digits) <= 19 and not any(c.isalpha() for c in s) and (len(groups) == 1 or set(groups[:-1]) == {4} or groups == [4, 6, 5]):
            return luhn(digits)
        return len(digits) >= 6 or sum(c.isalnum() for c in s) >= 8
    if kind == "address":
        return bool(digits) and sum(c.isalpha() for c in s) >= 3
    if digits or "@" in text[max(0, a - 1) : b + 1] or sum(c.isalpha() for c in s) < 2:
        return False
    small = s.islower()
    if len(s.split()) > 1 and not small:
        return True
    return (len(s.split()) > 1 or not small) and bool(_VALUE.search(text[max(0, a - 16) : a]))


def find(w: dict, texts: list[tuple[str, bool]]) -> list[list[tuple[str, int, int]]]:
    """Per text the (kind, from, to) of what is personal in it, by places in the original.

    Texts are tagged some at a time, very long ones slice by slice, so memory
    doesn't grow with the input.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    pending: list[tuple[int, int, str, list[int] | None, str]] = []

    def flush() -> None:
        for (i, start, t, at, part), runs in zip(pending, _runs(w, [p[4] for p in pending])):
            base = max(0, start - AROUND)
            for kind, x, y in runs:
                x, y = x + base, y + base
                if start <= x < start + SLICE and _plausible(kind, t[x:y], t, x, y):
                    out[i].append((kind, x, y) if at is None else (kind, at[x], at[y] if y < len(at) else len(texts[i][0])))
        pending.clear()

    size = 0
    for i, (raw, form) in enumerate(texts):
        t, at = readable(raw, form)
        for start in range(0, len(t), SLICE):
            part = t[max(0, start - AROUND) : start + SLICE + AROUND]
            pending.append((i, start, t, at, part))
            size += len(part)
            if size > SLICE:
                flush()
                size = 0
    flush()
    return out


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its placeholder, the rest as it was."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= last:
            out += [text[last:a], TOKENS[kind]]
            last = b
    return "".join([*out, text[last:]])


_loaded: dict[str, dict] = {}


def detect(rows: DataFrame, key: str, text: str, form: str, weights: str = M.WEIGHTS, masked: bool = False) -> DataFrame:
    """``rows`` (a key, a text, a flag: is it a URL or form) with ``kinds`` and, if asked, ``masked``.

    Only rows with a find are kept. NULL and empty texts have none; a text is
    read whole, however long. Equal texts of a batch are tagged once. All other
    columns pass through, whatever their names.
    """
    names = [c for c in rows.columns if c not in (text, form)]
    kept = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").alias("__text"), F.col(f"`{form}`").alias("__form"))
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*kept.schema.fields[:-2], T.StructField("kinds", T.ArrayType(T.StringType())), *([T.StructField("masked", T.StringType())] if masked else [])])
    arrow = to_arrow_schema(schema)

    def run(batches):
        if weights not in _loaded:
            _loaded[weights] = M.load(weights)
        w = _loaded[weights]
        for b in batches:
            texts = b.column("__text").to_pylist()
            forms = b.column("__form").to_pylist()
            distinct = list(dict.fromkeys((t, bool(f)) for t, f in zip(texts, forms) if t))
            got = dict(zip(distinct, find(w, distinct)))
            found = [got.get((t, bool(f)), []) if t else [] for t, f in zip(texts, forms)]
            keep = pa.array([bool(x) for x in found], pa.bool_())
            cols = [b.column(n).filter(keep) for n in names]
            cols.append(pa.array([sorted({k for k, _, _ in x}) for x in found if x], pa.list_(pa.string())))
            if masked:
                cols.append(pa.array([mask(t, x) for t, x in zip(texts, found) if x], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return kept.mapInArrow(run, schema)


def personal_values(spark: SparkSession, store: str) -> DataFrame:
    """The three fields as one column of texts."""
    e = table(spark, store, "entries").select("id", "url", "query_string")
    form = F.struct(F.lit("entries.url").alias("field"), F.col("url").alias("text")), F.struct(F.lit("entries.query_string").alias("field"), F.col("query_string").alias("text"))
    e = e.select(F.col("id").cast("string").alias("row_key"), F.explode(F.array(*form)).alias("v")).select("v.field", "row_key", "v.text", F.lit(True).alias("form"))
    kind = F.lower(F.coalesce(F.col("mime_type"), F.lit("")))
    b = table(spark, store, "blobs").select(F.lit("blobs.content").alias("field"), F.col("hash").alias("row_key"), text_of(F.col("content"), F.col("mime_type")).alias("text"), kind.contains("urlencoded").alias("form"))
    return e.unionByName(b).where(F.length("text") > 0)


def p6_found(spark: SparkSession, store: str) -> DataFrame:
    d = detect(personal_values(spark, store), "row_key", "text", "form")
    return d.select("field", "row_key", F.explode("kinds").alias("kind"))


def p6_masked(spark: SparkSession, store: str) -> DataFrame:
    """Values with something personal, the finds replaced by placeholders."""
    return detect(personal_values(spark, store), "row_key", "text", "form", masked=True).select("field", "row_key", "masked")

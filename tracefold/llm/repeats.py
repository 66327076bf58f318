"""New batches against everything accepted before: exact repeats and near repeats of bodies.

Distance of two texts is the number of words to delete and insert to turn one
into the other, a metric: d = |a| + |b| - 2 * (longest common subsequence).
Texts repeat each other if the common words reach nine tenths of the longer one.

The pivot-distance table keeps, for every text in the store, its true distances
to fixed pivots: the empty text (that distance is the length) and PIVOTS real
texts taken from the first batch. By the triangle inequality two texts can't be
nearer than their distances to any pivot differ. A range join on pivot distances
alone leaves a fixed share of all pairs (the README has the counts), so rows of
the table carry one of the rarest tenth of their text's words, too: two texts
with that much in common share one. Rows meet on a word, within a range of
distances; all pivots, and word counts by class, prune; the true distance decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.instants import with_instant
from tracefold.operators.timestamps import import_zones
from tracefold.plans.scan import ordered_scan
from tracefold.plans.shared import Spool, delete_at_exit, exists
from tracefold.sources import table

SHARE = (9, 10)
LEAST_WORDS = 40
#: Real texts that distances are stored to, and the most words one may have.
PIVOTS, PIVOT_WORDS = 8, 256
#: Classes of words (by hash) whose counts bound the distance from below, too.
CLASSES = 32
#: Bytes of a row's distances (two each) and class counts (one each).
WIDTH = 2 * PIVOTS + CLASSES
#: Parts of the stored texts; a small batch reads only the parts its candidates lie in.
PARTS = 16
#: Stored texts are keyed anew, by the words of all of them, once there are this many times as many as at the last keying.
REKEY = 4
#: Counters of the frequency sketch that orders words; its size is fixed, any order of words is exact.
SKETCH = 1 << 18
#: Members of a block compared with all others of the block in one round.
LEADERS = 64


def text_of(content: Column, mime: Column) -> Column:
    """A body as text: UTF-8, else Latin-1; NULL for compressed, image and empty bodies."""
    head = F.hex(F.substring(content, 1, 4))
    packed = head.startswith("1F8B") | (head == "89504E47") | head.startswith("FFD8FF") | (head == "47494638") | (head == "28B52FFD") | head.startswith("504B0304")
    kind = F.coalesce(F.lower(mime), F.lit(""))
    other = kind.rlike("^(image|audio|video|font)/|gzip|zip|octet-stream|brotli|zstd")
    return F.when(packed | other | (F.octet_length(content) == 0), None).otherwise(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")))


def word_hashes(text: Column) -> Column:
    """The words of a text, split at white space, as 64-bit hashes in their order."""
    return F.transform(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def row_digests(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """``id``, ``import_id``, ``body`` and a digest (128 bits) of all columns that make two entries the same.

    Starts count as instants where they are readable; NULL equals NULL, and 0
    equals -0.
    """
    e = with_instant(entries.join(zones, "import_id", "left"), F.col("started_at"), F.col("zone"), "__us")
    skip = {"id", "import_id", "entry_hash", "started_at", "zone", "__us"}
    cols = []
    for f in sorted(e.schema.fields, key=lambda f: f.name):
        if f.name not in skip:
            c = F.col(f"`{f.name}`")
            cols.append((c + 0.0) if f.dataType.simpleString() in ("double", "float") else c)
    cols = [F.col("__us"), F.when(F.col("__us").isNull(), F.col("started_at")), *cols]
    # a hash passes over NULLs, so which values are NULL is hashed, too
    empty = F.array(*(c.isNull() for c in cols))
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), empty, *cols)), 16, "0")
    return e.select("id", "import_id", F.col("response_body_hash").alias("body"), F.unhex(F.concat(part(1), part(2))).alias("digest"))


def texts_of(first: DataFrame, blobs: DataFrame) -> DataFrame:
    """Bodies of at least LEAST_WORDS words: ``tid``, ``body``, ``n``, ``words``.

    ``first`` names the bodies (``body``) and the first entry that has each
    (``tid``); only blobs that it names are decoded.
    """
    b = blobs.select(F.col("hash").alias("body"), "content", "mime_type").where(F.col("body").isNotNull()).join(first, "body")
    b = b.select("tid", "body", text_of(F.col("content"), F.col("mime_type")).alias("text")).where(F.length("text") >= 2 * LEAST_WORDS - 1)
    b = b.groupBy("body").agg(F.min("tid").alias("tid"), F.first("text").alias("text")).withColumn("words", word_hashes(F.col("text")))
    return b.select("tid", "body", F.size("words").cast("long").alias("n"), "words").where(F.col("n") >= LEAST_WORDS)


def sketch_of(texts: DataFrame) -> DataFrame:
    """How often words occur, by SKETCH classes of their hash: ``c``, ``n``."""
    return texts.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(SKETCH - 1).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))


def order_of(sketch: DataFrame) -> np.ndarray:
    """The sketch as an array (SKETCH numbers at most reach the driver)."""
    got = sketch.toArrow()
    out = np.zeros(SKETCH, dtype=np.int64)
    out[got["c"].to_numpy()] = got["n"].to_numpy()
    return out


def pivots_of(texts: DataFrame) -> list[list[int]]:
    """PIVOTS texts, picked by a hash of their words; each is of bounded length."""
    short = texts.where(F.col("n") <= PIVOT_WORDS).select("words", F.xxhash64("words").alias("h"), "tid")
    got = [list(r.words) for r in short.orderBy("h", "tid").select("words").limit(PIVOTS).collect()]
    return got + [[]] * (PIVOTS - len(got))


class _Pivot:
    """Distances to one text: where each of its words stands, as bits of one integer."""

    def __init__(self, words: list[int]):
        self.n, self.at = len(words), {}
        for i, w in enumerate(words):
            self.at[w] = self.at.get(w, 0) | (1 << i)
        self.every = (1 << self.n) - 1

    def common(self, words: list[int]) -> int:
        v, every, at = self.every, self.every, self.at
        for w in words:
            if w in at and (u := v & at[w]):
                v = ((v + u) | (v - u)) & every
        return self.n - v.bit_count()


def signatures(texts: DataFrame, sketch: np.ndarray, pivots: list[list[int]]) -> DataFrame:
    """The pivot-distance table by rare word: ``key``, ``tid``, ``n``, ``far`` (distances and class counts)."""
    num, den = SHARE
    shared = texts.sparkSession.sparkContext.broadcast((sketch, pivots))

    def run(batches):
        order, known = shared.value[0], [_Pivot(p) for p in shared.value[1]]
        for b in batches:
            keys, tids, ns, fars = [], [], [], []
            for tid, words in zip(b.column(0).to_pylist(), b.column(1)):
                w = words.values.to_numpy()
                n = len(w)
                plain = w.tolist()
                away = np.array([min(n + p.n - 2 * p.common(plain), 65535) for p in known], dtype=np.uint16)
                counts = np.minimum(np.bincount((w >> 40) & (CLASSES - 1), minlength=CLASSES), 255).astype(np.uint8)
                w = np.sort(w)
                start = np.concatenate(([True], w[1:] != w[:-1]))
                turn = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
                first = np.lexsort((turn, w, order[w & (SKETCH - 1)]))[: n - -(-num * n // den) + 1]
                with np.errstate(over="ignore"):
                    keys.append(w[first] + turn[first] * np.int64(-7046029254386353131))
                tids += [tid] * len(first)
                ns += [n] * len(first)
                fars += [away.tobytes() + counts.tobytes()] * len(first)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(tids, pa.int64()), pa.array(ns, pa.int64()), pa.array(fars, pa.binary())], names=["key", "tid", "n", "far"])

    return texts.select("tid", "words").mapInArrow(run, "key long, tid long, n long, far binary")


def _within(n1, n2, f1, f2):
    """Can two texts repeat each other, by their lengths, pivot distances and class counts?"""
    num, den = SHARE
    short, long_ = np.minimum(n1, n2), np.maximum(n1, n2)
    common = -(-num * long_ // den)
    most = short + long_ - 2 * common
    d1, d2 = (np.ascontiguousarray(f[:, : 2 * PIVOTS]).view(np.uint16).astype(np.int32) for f in (f1, f2))
    classes = np.abs(f1[:, 2 * PIVOTS :].astype(np.int16) - f2[:, 2 * PIVOTS :]).sum(axis=1)
    return (short >= common) & (np.abs(d1 - d2).max(axis=1, initial=0) <= most) & (classes <= most)


def candidates(sigs: DataFrame) -> DataFrame:
    """Pairs that meet on a key and pass the pivots, at least one of them ``fresh``.

    Output ``lo``, ``hi``, ``key`` (NULL unless the block is large) and, with a
    NULL ``lo``, the members of large blocks beyond the first LEADERS. Each member
    is compared with the first LEADERS of its block, wherever they are stored, so
    a block of any size costs in proportion to its members.
    """
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("lo", "hi", "key")])

    def unpack(b):
        p = np.frombuffer(b"".join(b.column("far").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
        return b.column("key").to_numpy(), b.column("tid").to_numpy(), b.column("n").to_numpy(), p, np.asarray(b.column("fresh"))

    def head(key, tid, n, p, fresh, at):
        return [(int(tid[i]), int(n[i]), p[i].tobytes(), bool(fresh[i])) for i in at]

    def summarise(batches):
        first = last = None
        single, members = True, []
        for b in batches:
            cols = unpack(b)
            key = cols[0]
            if first is None:
                first = int(key[0])
            begin = int(np.searchsorted(key != key[-1], True)) if (key == key[-1]).all() else int(np.flatnonzero(key != key[-1])[-1]) + 1
            begin = 0 if (key == key[-1]).all() else begin
            if begin or (last is not None and last != int(key[0])):
                single, members = single and begin == 0 and last is None, []
            last = int(key[-1])
            members += head(*cols, range(begin, min(begin + LEADERS - len(members), len(key))))
        return first, last, single, members

    def combine(carry, s):
        first, last, single, members = s
        return (last, (carry[1] + members)[:LEADERS]) if single and carry and carry[0] == first else (last, members)

    def rescan(batches, carry):
        for b in batches:
            out, carry = scan(b, carry)
            yield out

    def scan(b, carry):
        """The pairs of one batch, whose first block may go on from ``carry`` (its key and first members), and the carry after it."""
        key, tid, n, p, fresh = unpack(b)
        own = 0
        if carry and carry[0] == key[0]:
            m = carry[1]
            key = np.concatenate((np.full(len(m), key[0]), key))
            tid = np.concatenate((np.array([x[0] for x in m]), tid))
            n = np.concatenate((np.array([x[1] for x in m]), n))
            p = np.concatenate((np.frombuffer(b"".join(x[2] for x in m), dtype=np.uint8).reshape(-1, WIDTH), p))
            fresh = np.concatenate((np.array([x[3] for x in m], dtype=bool), fresh))
            own = len(m)
        start = np.concatenate(([True], key[1:] != key[:-1]))
        base = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        rank = np.arange(len(key)) - base
        rows = np.arange(len(key)) >= own
        los, his, ks = [], [], []
        for r in range(min(LEADERS, int(rank.max()) if len(rank) else 0)):
            i = np.flatnonzero(rows & (rank > r))
            j = base[i] + r
            ok = (fresh[i] | fresh[j]) & (tid[i] != tid[j])
            i, j = i[ok], j[ok]
            near = _within(n[i], n[j], p[i], p[j])
            i, j = i[near], j[near]
            los.append(tid[j])
            his.append(tid[i])
            ks.append(np.where(rank[i] >= LEADERS, key[i], 0))
        beyond = np.flatnonzero(rows & (rank >= LEADERS))
        lo = np.concatenate([*los, np.zeros(len(beyond), dtype=np.int64)])
        k = np.concatenate([*ks, key[beyond]])
        hi = np.concatenate([*his, tid[beyond]])
        mask = np.arange(len(lo)) >= len(lo) - len(beyond)
        out = pa.RecordBatch.from_arrays([pa.array(lo, pa.int64(), mask=mask), pa.array(hi, pa.int64()), pa.array(k, pa.int64(), mask=~mask & (k == 0))], names=["lo", "hi", "key"])
        return out, (int(key[-1]), head(key, tid, n, p, fresh, range(base[-1], min(base[-1] + LEADERS, len(key)))))

    return ordered_scan(sigs, ["key"], ["tid"], summarise, combine, rescan, schema)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | (1 << i)
    every = (1 << len(a)) - 1
    v = every
    for w in b.tolist():
        if u := v & at.get(w, 0):
            v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``lo``, ``hi``) whose true distance makes them repeats."""
    num, den = SHARE
    a = texts.select(F.col("tid").alias("lo"), F.col("words").alias("a"))
    b = texts.select(F.col("tid").alias("hi"), F.col("words").alias("b"))
    both = pairs.select("lo", "hi").distinct().join(a, "lo").join(b, "hi").select("lo", "hi", "a", "b")

    def run(batches):
        for x in batches:
            keep = []
            for p, q in zip(x.column(2), x.column(3)):
                p, q = p.values.to_numpy(), q.values.to_numpy()
                keep.append(common_words(p, q) * den >= num * max(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["lo", "hi"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "lo long, hi long")


def _cells(sigs: DataFrame, around: bool) -> DataFrame:
    """Rows by ranges of their distances to the empty text (a step of a ninth) and to the first real pivot.

    Texts that repeat each other lie in the same or neighbouring ranges of both.
    A range of the second is as wide as the largest distance allowed among texts
    of the longer one's range of lengths, so each row is filed under its own
    range of lengths and the next, and one side under the neighbours, too.
    """
    num, den = SHARE
    step = den / num
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(step)) + 1e-9)
    away = F.conv(F.concat(F.hex(F.substring("far", 2, 1)), F.hex(F.substring("far", 1, 1))), 16, 10).cast("long")
    rows = sigs.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("cell", F.floor(away / (2 * (step - 1) * F.pow(F.lit(step), F.col("band") + 1) + 1)))
    return rows.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))) if around else rows


def _meets(near: str, other: str) -> Column:
    """The triangle inequality for all pivots, and the bound by classes, on two rows of the table."""
    least = F.ceil(F.greatest(f"{near}.n", f"{other}.n") * SHARE[0] / SHARE[1])
    return (F.least(f"{near}.n", f"{other}.n") >= least) & (F.col(f"{near}.tid") != F.col(f"{other}.tid"))


def _prune(met: DataFrame) -> DataFrame:
    """Pairs of rows (``ltid``, ``ln``, ``lfar``, ``rtid``, ``rn``, ``rfar``) that the pivots leave, as ``lo`` and ``hi``."""

    def run(batches):
        for b in batches:
            f = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, WIDTH) for c in ("lfar", "rfar")]
            l, r = b.column("ltid").to_numpy(), b.column("rtid").to_numpy()
            ok = _within(b.column("ln").to_numpy(), b.column("rn").to_numpy(), *f)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(l, r)[ok]), pa.array(np.maximum(l, r)[ok])], names=["lo", "hi"])

    return met.mapInArrow(run, "lo long, hi long")


def near_pairs(sigs: DataFrame, texts: DataFrame, spool: Spool, alone: DataFrame | None = None) -> DataFrame:
    """Verified pairs with a fresh text, enough of them that every text's first partner is among them.

    A member of a block that is near one of its first LEADERS is settled there:
    the partner it seeks is among them. Fresh members that aren't, and stored
    ones without any partner (``alone``, by ``tid``), are joined with the rest of
    their block by ranges of pivot distances, all in one step.
    """
    c = spool.put("candidates", candidates(sigs))
    pairs = c.where(F.col("lo").isNotNull())
    near = spool.put("near", verify(pairs, texts))
    beyond = c.where(F.col("lo").isNull()).select("key", F.col("hi").alias("tid"))
    settled = pairs.where(F.col("key").isNotNull()).join(near, ["lo", "hi"], "left_semi").select("key", F.col("hi").alias("tid")).distinct()
    rest = spool.put("rest", beyond.join(sigs, ["key", "tid"]))
    todo = rest.where("fresh").join(settled, ["key", "tid"], "left_anti")
    if alone is not None:
        todo = todo.unionByName(rest.where("not fresh").join(alone, "tid", "left_semi").select(todo.columns))
    l, r = _cells(todo, True).alias("l"), _cells(rest, False).alias("r")
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.cell") == F.col("r.cell"))
    met = l.join(r, same & (F.col("l.fresh") | F.col("r.fresh")) & _meets("l", "r")).select(*(F.col(f"{s}.{c}").alias(s + c) for s in "lr" for c in ("tid", "n", "far")))
    return near.unionByName(verify(_prune(met), texts)).distinct()


def partners(near: DataFrame) -> DataFrame:
    """``tid`` and the smallest ``partner`` it repeats or is repeated by."""
    both = near.select(F.col("lo").alias("tid"), F.col("hi").alias("partner")).unionByName(near.select(F.col("hi").alias("tid"), F.col("lo").alias("partner")))
    return both.groupBy("tid").agg(F.min("partner").alias("partner"))


class RepeatStore:
    """The accepted entries, as tables at a path that a batch is checked against and appended to.

    Kept are one row per digest of an entry, one per body, the texts (as word
    hashes), the pivot-distance table, each text's first partner, the pivots and
    the frequencies that order words. All but the texts are narrow and are joined
    to a batch's own rows before anything else; texts are read only for pairs
    that pass the pivots. Nothing compares two stored texts again. A batch is
    there once its row in ``meta`` is written, so one that was cut short leaves
    nothing behind that counts, and a later session goes on from the path. Without
    a path the store lives in a folder of its own below the shared one.

    Batches come in the order of loading: ids must be larger than all before.
    NULL bodies, bodies without a blob and short texts repeat nothing by their
    body; an empty batch appends nothing. Other columns of the tables, whatever
    their names, are part of an entry's digest.
    """

    NAMES = {
        "digests": "digest binary, id long", "bodies": "body string, tid long, text boolean", "texts": "tid long, n long, words array<long>, part int", "sigs": "key long, tid long, n long, far binary",
        "partners": "tid long, partner long", "pivots": "no int, words array<long>", "sketch": "c int, n long", "meta": "no int, max_id long, texts long, keyed long, key_batch int",
    }

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or Spool(spark).root
        if not path:
            delete_at_exit(spark, self.path)

    def _state(self) -> tuple[int, int | None, int, int, int]:
        """Batches so far, largest id, texts, texts at the last keying and the batch it was made in."""
        if not exists(self.spark, f"{self.path}/meta"):
            return 0, None, 0, 0, 0
        r = self._read("meta", None).orderBy(F.desc("no")).first()
        return (r.no + 1, r.max_id, r.texts, r.keyed, r.key_batch) if r else (0, None, 0, 0, 0)

    def _read(self, name: str, batches: int | None, since: int = 0) -> DataFrame:
        """What the first ``batches`` batches have written of a table."""
        cols = [c.split()[0] for c in self.NAMES[name].split(", ")]
        root = f"{self.path}/{name}"
        if batches is None:
            return self.spark.read.schema(self.NAMES[name]).parquet(root).select(*cols)
        there = [p for b in range(since, batches) if exists(self.spark, p := f"{root}/batch={b}")]
        return self.spark.read.schema(self.NAMES[name]).option("basePath", root).parquet(*there).select(*cols) if there else self.spark.createDataFrame([], self.NAMES[name])

    def _write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        cols = [c.split()[0] for c in self.NAMES[name].split(", ")]
        path = f"{self.path}/{name}/batch={batch}"
        w = df.select(*cols).write.mode("overwrite")
        (w.partitionBy("part") if name == "texts" else w).parquet(path)
        return self.spark.read.schema(self.NAMES[name]).parquet(path)

    def _stored_texts(self, pairs: DataFrame, batches: int) -> DataFrame:
        """Stored texts, only of the parts that the pairs touch (PARTS numbers at most reach the driver)."""
        ids = pairs.select(F.explode(F.array("lo", "hi")).alias("tid"))
        parts = [r.part for r in ids.select(F.pmod(F.xxhash64("tid"), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]
        return self._read("texts", batches).where(F.col("part").isin(parts)).select("tid", "words")

    def append(self, entries: DataFrame, blobs: DataFrame, zones: DataFrame) -> DataFrame:
        """Repeats among the batch's entries: ``accepted_id`` (smallest entry repeated), ``entry_id``."""
        spool = Spool(self.spark)
        batch, top, n_texts, keyed, key_batch = self._state()
        rows = spool.put("rows", row_digests(entries, zones))
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return rows.select(F.col("id").alias("accepted_id"), F.col("id").alias("entry_id"))
        if top is not None and low <= top:
            raise ValueError(f"ids must be larger than those stored (up to {top}), got {low}")
        # entries: the first of each digest, in the store or the batch
        mine = rows.groupBy("digest").agg(F.min("id").alias("id"))
        old = self._read("digests", batch).select("digest", F.col("id").alias("before"))
        firsts = spool.put("firsts", mine.join(old, "digest", "left"))
        self._write("digests", batch, firsts.where("before is null"))
        exact = rows.join(firsts.select("digest", F.coalesce("before", "id").alias("accepted_id")), "digest").where(F.col("accepted_id") < F.col("id"))
        exact = exact.select("accepted_id", F.col("id").alias("entry_id"))
        # bodies: those not seen before, and their texts
        mine = rows.where(F.col("body").isNotNull()).groupBy("body").agg(F.min("id").alias("tid"))
        old = self._read("bodies", batch).select("body", F.col("tid").alias("before"), "text")
        seen = spool.put("seen", mine.join(old, "body", "left"))
        texts = texts_of(seen.where("before is null").select("body", "tid"), blobs)
        texts = self._write("texts", batch, texts.withColumn("part", F.pmod(F.xxhash64("tid"), F.lit(PARTS)).cast("int")).repartition("part"))
        fresh = texts.count()
        is_text = texts.select("tid", F.lit(True).alias("is"))
        bodies = spool.put("bodies", seen.join(is_text, "tid", "left").select("body", F.coalesce("before", "tid").alias("tid"), F.coalesce("text", "is", F.lit(False)).alias("text"), F.col("before").isNull().alias("new")))
        self._write("bodies", batch, bodies.where("new"))
        if fresh:
            found = self._near(spool, texts, batch, key_batch, n_texts == 0)
        if fresh and not n_texts:
            keyed, key_batch = fresh, batch
        elif fresh and n_texts + fresh >= REKEY * keyed:
            self._key(self._read("texts", batch + 1), batch)
            keyed, key_batch = n_texts + fresh, batch
        known = self._read("partners", batch)
        if fresh:
            known = known.unionByName(self._write("partners", batch, partners(found)))
        best = bodies.where("text").select("body", "tid").join(known, "tid").groupBy("body").agg(F.min("partner").alias("accepted_id"))
        near = rows.join(best, "body").where(F.col("accepted_id") < F.col("id")).select("accepted_id", F.col("id").alias("entry_id"))
        self._write("meta", batch, self.spark.createDataFrame([(batch, high, n_texts + fresh, keyed, key_batch)], self.NAMES["meta"]).coalesce(1))
        return spool.finish(exact.unionByName(near).groupBy("entry_id").agg(F.min("accepted_id").alias("accepted_id")).select("accepted_id", "entry_id"))

    def _key(self, texts: DataFrame, batch: int) -> DataFrame:
        """Orders the words by how often these texts hold them and writes the table's rows anew; returns the order's table."""
        order = order_of(self._write("sketch", batch, sketch_of(texts)))
        return self._write("sigs", batch, signatures(texts, order, self._pivots()))

    def _pivots(self) -> list[list[int]]:
        return [list(r.words) for r in self._read("pivots", None).orderBy("no").collect()]

    def _near(self, spool: Spool, texts: DataFrame, batch: int, key_batch: int, first: bool) -> DataFrame:
        """Verified pairs of the batch's texts with each other and with stored ones."""
        if first:
            self._write("pivots", batch, self.spark.createDataFrame(list(enumerate(pivots_of(texts))), self.NAMES["pivots"]))
            return spool.put("found", near_pairs(self._key(texts, batch).withColumn("fresh", F.lit(True)), texts, spool))
        order = order_of(self._read("sketch", key_batch + 1, key_batch))
        mine = self._write("sigs", batch, signatures(texts, order, self._pivots())).withColumn("fresh", F.lit(True))
        old = self._read("sigs", batch, key_batch).join(mine.select("key").distinct(), "key", "left_semi").withColumn("fresh", F.lit(False))
        sigs = spool.put("both", mine.unionByName(old.select(mine.columns)))
        paired = self._read("partners", batch).select("tid")
        alone = sigs.where("not fresh").select("tid").distinct().join(paired, "tid", "left_anti")
        stored = self._stored_texts(sigs.where("not fresh").select(F.col("tid").alias("lo"), F.col("tid").alias("hi")), batch)
        return spool.put("found", near_pairs(sigs, texts.select("tid", "words").unionByName(stored), spool, alone))


def in_batches(spark: SparkSession, store: str, batches: int) -> DataFrame:
    """The store's entries appended in the order of loading, in so many batches: ``batch``, ``accepted_id``, ``entry_id``."""
    entries, blobs, zones = table(spark, store, "entries"), table(spark, store, "blobs"), import_zones(spark, store)
    top = (entries.agg(F.max("id")).first()[0] or 0) + 1
    s, out = RepeatStore(spark), None
    for b in range(batches):
        part = entries.where((F.col("id") >= top * b // batches if b else F.lit(True)) & (F.col("id") < top * (b + 1) // batches))
        found = s.append(part, blobs, zones).select(F.lit(b).alias("batch"), "accepted_id", "entry_id")
        out = found if out is None else out.unionByName(found)
    return out


def p2_found(spark: SparkSession, store: str) -> DataFrame:
    """All repeats: the earlier half of the entries is loaded, then the later half is checked against it and added."""
    return in_batches(spark, store, 2).select("accepted_id", "entry_id")


def p2_batches(spark: SparkSession, store: str) -> DataFrame:
    """Repeats batch by batch, four batches in the order of loading."""
    return in_batches(spark, store, 4)

"""Bodies: decoding, decompression, what is kept, and files outside the store."""

from __future__ import annotations

import os
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a body, as loaded, decompressed or indexed, unless told otherwise.
MAX_BODY, MAX_DECOMPRESSED, MAX_INDEXED = 100 * 1024, 50 * 1024 * 1024, 1024 * 1024


def text_mime(mime: Column) -> Column:
    """Does a MIME type name text? NULL doesn't."""
    return F.coalesce(F.lower(mime).rlike("text/|json|xml|javascript|css|html|x-www-form-urlencoded"), F.lit(False))


def indexable(content: Column, mime: Column, cap: int = MAX_INDEXED) -> Column:
    """Can a body be searched: not empty, within the cap, valid UTF-8, and of a text type or none?"""
    return F.octet_length(content).between(1, cap) & F.is_valid_utf8(content.cast("string")) & (mime.isNull() | text_mime(mime))


def decoded(text: Column, encoding: Column) -> Column:
    """A body as it stands in a capture as bytes: base64 if it says so (NULL if that can't be read), else UTF-8."""
    return F.when(F.lower(encoding) == "base64", F.try_to_binary(text, F.lit("base64"))).otherwise(F.encode(text, "UTF-8"))


def unpack(content: bytes | None, encodings: str | None, cap: int = MAX_DECOMPRESSED) -> bytes | None:
    """A body without its content encodings, the last applied undone first; None if one is unknown, broken or the result too large.

    gzip, x-gzip and deflate are known, identity is skipped. Brotli needs a codec
    that isn't there and counts as unknown.
    """
    if content is None:
        return None
    for name in reversed([x.strip().lower() for x in (encodings or "").split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        try:
            out, rest = b"", content
            while rest:
                z = zlib.decompressobj(31 if name != "deflate" else 15)
                out += z.decompress(rest, cap + 1 - len(out))
                if len(out) > cap or (not z.eof):
                    return None
                rest = z.unused_data
            content = out
        except zlib.error:
            return None
    return content


def unpacked(content: Column, encodings: Column, cap: int = MAX_DECOMPRESSED) -> Column:
    """``unpack`` over columns; bodies without an encoding never leave the JVM."""

    @F.pandas_udf(T.BinaryType())
    def run(c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([unpack(None if x is None else bytes(x), y, cap) for x, y in zip(c, e)], dtype=object)

    named = F.lower(F.coalesce(encodings, F.lit(""))).rlike("[^, ]") & ~F.lower(F.trim(encodings)).eqNullSafe("identity")
    return F.when(named, run(F.when(named, content), encodings)).otherwise(content)


def form_of(params: Column, text: Column, mime: Column) -> Column:
    """The body of a posted form: its text or, where there is none and the type allows it, one made of its parameters."""
    made = F.array_join(F.transform(params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(F.coalesce(p["value"], F.lit(""))))), "&")
    form = mime.isNull() | F.lower(mime).contains("x-www-form-urlencoded")
    return F.when(F.coalesce(text, F.lit("")) != "", text).when(form & (F.size(params) > 0), made)


def kept(content: Column, mime: Column, store: bool = True, text_only: bool = False, cap: int | None = MAX_BODY) -> Column:
    """Is a body stored: if bodies are, of a text type where only those are, not empty, and within the cap?"""
    c = F.lit(store) & (F.octet_length(content) > 0)
    if text_only:
        c = c & text_mime(mime)
    return F.coalesce(c & (F.octet_length(content) <= cap) if cap is not None else c, F.lit(False))


def shard_path(root: str, hash_: str, levels: int = 2) -> str:
    """Where a body's file lies: two digits of its hash per level of folders."""
    return os.path.join(root, *(hash_[2 * i : 2 * i + 2] for i in range(levels)), hash_)


def extract(blobs: DataFrame, root: str, levels: int = 2) -> DataFrame:
    """Writes bodies to files of their own, each once, and gives the table with empty content and their paths.

    A file that is there stays. It is written under a name of its own and then
    renamed, so a task that is run again does no harm.
    """
    def run(batches):
        for b in batches:
            paths = []
            for h, c in zip(b.column("hash").to_pylist(), b.column("content")):
                c = c.as_py()
                if not c or h is None:
                    paths.append(None)
                    continue
                p = shard_path(root, h, levels)
                if not os.path.exists(p):
                    os.makedirs(os.path.dirname(p), exist_ok=True)
                    part = f"{p}.{os.getpid()}"
                    with open(part, "wb") as f:
                        f.write(c)
                    os.replace(part, p)
                paths.append(p)
            moved = pa.array([p is not None for p in paths])
            import pyarrow.compute as pc

            yield pa.RecordBatch.from_arrays([b.column("hash"), pc.if_else(moved, pa.scalar(b"", pa.binary()), b.column("content")), b.column("size"), b.column("mime_type"), pc.coalesce(pa.array(paths, pa.string()), b.column("external_path"))], names=["hash", "content", "size", "mime_type", "external_path"])

    return blobs.select("hash", "content", "size", "mime_type", "external_path").mapInArrow(run, "hash string, content binary, size long, mime_type string, external_path string")


def with_external(blobs: DataFrame, root: str | None) -> DataFrame:
    """Blobs with the content of their files, where it is empty but should not be; nothing is read without ``root``.

    Only files below ``root``, links resolved, are opened; others stay empty.
    """
    if root is None:
        return blobs
    names = blobs.columns

    def run(batches):
        base = os.path.realpath(root)
        for b in batches:
            out = []
            for c, n, p in zip(b.column("content"), b.column("size").to_pylist(), b.column("external_path").to_pylist()):
                c = c.as_py()
                if not c and p and (n or 0) > 0:
                    real = os.path.realpath(os.path.join(base, p))
                    if real.startswith(base + os.sep) and os.path.isfile(real):
                        with open(real, "rb") as f:
                            c = f.read()
                out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if k == "content" else b.column(k) for k in names], names=names)

    return blobs.mapInArrow(run, blobs.schema)

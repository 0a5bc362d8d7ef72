"""BSON article dumps: a decoder for the subset that dumps use, and a scan that survives damage."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T

LARGEST = 64 << 20
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Damaged(ValueError):
    """Bytes that are no document."""


def decode(data: bytes) -> dict:
    """The fields of one document. Kinds: double, text, document, array, binary, object id, bool, date, null, int32, int64."""
    try:
        fields, end = _fields(data, 0)
    except (struct.error, IndexError, UnicodeDecodeError, OverflowError) as e:
        raise Damaged(str(e)) from e
    if end != len(data):
        raise Damaged("length")
    return fields


def _fields(data: bytes, at: int) -> tuple[dict, int]:
    size = struct.unpack_from("<i", data, at)[0]
    end, out = at + size, {}
    if size < 5 or end > len(data) or data[end - 1]:
        raise Damaged("frame")
    at += 4
    while at < end - 1:
        kind = data[at]
        stop = data.index(b"\0", at + 1)
        name = data[at + 1 : stop].decode()
        out[name], at = _value(data, kind, stop + 1)
    if at != end - 1:
        raise Damaged("overrun")
    return out, end


def _value(data: bytes, kind: int, at: int) -> tuple[object, int]:
    if kind == 0x01:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == 0x02:
        size = struct.unpack_from("<i", data, at)[0]
        if size < 1 or at + 4 + size > len(data):
            raise Damaged("text")
        return data[at + 4 : at + 3 + size].decode(), at + 4 + size
    if kind in (0x03, 0x04):
        inner, end = _fields(data, at)
        return (list(inner.values()) if kind == 0x04 else inner), end
    if kind == 0x05:
        size = struct.unpack_from("<i", data, at)[0]
        return data[at + 5 : at + 5 + size], at + 5 + size
    if kind == 0x07:
        return data[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return data[at] == 1, at + 1
    if kind == 0x09:
        return _EPOCH + timedelta(milliseconds=struct.unpack_from("<q", data, at)[0]), at + 8
    if kind == 0x0A:
        return None, at
    if kind == 0x10:
        return struct.unpack_from("<i", data, at)[0], at + 4
    if kind == 0x12:
        return struct.unpack_from("<q", data, at)[0], at + 8
    raise Damaged(f"kind {kind}")


def documents(data: bytes) -> Iterator[dict]:
    """Documents of a dump. Where none can be read the scan moves on byte by byte to the next one that starts with an id.

    A frame that runs past the end is either a cut-off tail, behind which nothing is found, or damage.
    """
    at, sound = 0, True
    while at + 5 <= len(data):
        size = struct.unpack_from("<i", data, at)[0]
        if 5 <= size <= LARGEST and at + size <= len(data) and (sound or data[at + 5 : at + 9] == b"_id\0"):
            try:
                yield decode(data[at : at + size])
                at, sound = at + size, True
                continue
            except Damaged:
                pass
        at, sound = at + 1, False


def _as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else str(v)


#: Names of a dump's fields and of the columns they become.
FIELDS = {"_id": "id", "Title": "title", "Text": "body", "Source": "source", "Href": "href", "Topic": "topic", "PostDate": "post_date", "ScrapeDate": "scrape_date", "Author": "author"}


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, all fields as text; a file is one task's work, so dumps should come in parts."""
    schema = ", ".join(f"{c} string" for c in FIELDS.values())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                rows = []
                for d in documents(content):
                    rows.append([d.get(f) if f in ("Title", "Text") and not isinstance(d.get(f), str) else _as_text(d.get(f)) for f in FIELDS])
                    rows[-1] = [v if v is None or isinstance(v, str) else None for v in rows[-1]]
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=list(FIELDS.values()))
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=list(FIELDS.values()))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def extract(articles: DataFrame, min_len: int = 100, normalise: bool = True) -> DataFrame:
    """Cleaned documents: title and body joined, metadata renamed, the author left out; rows without a text go."""
    text = T.clean_document(F.col("title"), F.col("body"), min_len, normalise)
    cols = {"id": F.col("id"), "text": text, "source": F.col("source"), "url": F.col("href"), "topic": F.col("topic")}
    kept = articles.select(*[(c if n in ("id", "text") else T.blank_to_null(c)).alias(n) for n, c in cols.items()], "post_date", "scrape_date")
    return kept.where(F.col("text").isNotNull())


def extract_stats(articles: DataFrame, min_len: int = 100, normalise: bool = True) -> DataFrame:
    """read, kept, skipped in one row."""
    has = articles.select(T.clean_document(F.col("title"), F.col("body"), min_len, normalise).isNotNull().alias("has"))
    return has.agg(F.count("*").alias("read"), F.count_if("has").alias("kept"), F.count_if(~F.col("has")).alias("skipped"))

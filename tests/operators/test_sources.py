import gzip
import json
import struct

import pytest
from textloom.schemas import DOCUMENT, RELEASE
from textloom.sources import bson, files, release
from textloom.streaming.incremental import ingest


def enc(d):
    out = b""
    for k, v in d.items():
        key = k.encode() + b"\0"
        if v is None:
            out += b"\x0a" + key
        elif isinstance(v, bool):
            out += b"\x08" + key + bytes([v])
        elif isinstance(v, int):
            out += (b"\x10" + key + struct.pack("<i", v)) if abs(v) < 2**31 else (b"\x09" + key + struct.pack("<q", v))
        elif isinstance(v, float):
            out += b"\x01" + key + struct.pack("<d", v)
        elif isinstance(v, dict):
            out += b"\x03" + key + enc(v)
        else:
            out += b"\x02" + key + struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"
    return struct.pack("<i", len(out) + 5) + out + b"\0"


DOCS = [
    {"_id": 1, "Title": "Վերնագիր", "Text": "բ" * 200, "Source": "s", "PostDate": 1735689600000, "ScrapeDate": 1735689600120, "Author": "x", "Href": " ", "Topic": "t"},
    {"_id": 2, "Title": "", "Text": "բ" * 200},
    {"_id": 3, "Title": "a", "Text": "b"},
    {"_id": 4, "Title": "T", "Text": "c" * 150, "PostDate": None, "Extra": {"k": 1.5, "t": True}},
]


def test_articles(spark, tmp_path):
    (tmp_path / "a.bson").write_bytes(b"".join(map(enc, DOCS)))
    rows = bson.read_articles(spark, str(tmp_path))
    assert bson.extract_stats(rows).first().asDict() == {"read": 4, "kept": 2, "skipped": 2}
    got = {r.id: r for r in bson.extract(rows).collect()}
    assert sorted(got) == ["1", "4"] and got["1"].text == "Վերնագիր\n" + "բ" * 200
    assert got["1"].post_date == "2025-01-01T00:00:00" and got["1"].scrape_date == "2025-01-01T00:00:00.120000" and got["1"].url is None
    assert got["4"].post_date is None and "author" not in got["1"].asDict()


def test_damage_is_passed_over():
    a, b = enc(DOCS[0]), enc(DOCS[3])
    ids = lambda data: [d["_id"] for d in bson.documents(data)]
    assert ids(a + b"\x07garbage" + b) == [1, 4]
    assert ids(a[:40] + b) == [4] and ids(a + b[:-9]) == [1] and ids(b"") == [] and ids(b"\xff" * 50) == []
    broken = bytearray(a)
    broken[-1] = 7
    assert ids(bytes(broken) + b) == [4]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "1", "text": "é"}\n\n  \n{"id": "2", "text": null}\n')
    assert {r.id: r.text for r in files.read_jsonl(spark, str(p), DOCUMENT).collect()} == {"1": "é", "2": None}
    p.write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(p), DOCUMENT).collect()
    assert files.read_jsonl_tolerant(spark, str(p), DOCUMENT).select("id").collect()[0].id == "1"
    files.append_jsonl(spark.createDataFrame([("a", None)], "id string, text string"), str(tmp_path / "o"))
    files.append_jsonl(spark.createDataFrame([("b", "ü")], "id string, text string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_labels_and_benchmarks(spark, tmp_path):
    with gzip.open(tmp_path / "l.tsv.gz", "wt") as f:
        f.write("a\thye\nb\teng\na\trus\n")
    assert {(r.id, r.label) for r in files.read_labels(spark, str(tmp_path / "l.tsv.gz")).collect()} == {("a", "hye"), ("b", "eng"), ("a", "rus")}
    d = tmp_path / "bench"
    d.mkdir()
    (d / "one.txt").write_text("first\nsecond\n")
    (d / "._one.txt").write_text("no")
    (d / "two.md").write_text("no")
    assert sorted(tuple(r) for r in files.read_benchmarks(spark, str(d)).collect()) == [("one", "first"), ("one", "second")]


def test_release(spark, tmp_path):
    rows = [(f"{s}{i}", "t" * 150, "src", "u", 1, s, "en") for s in ("train", "val") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, text string, source string, url string, cluster_size int, split string, lid string")
    out = str(tmp_path / "r")
    m = {r.split: (r.rows, r.text_bytes) for r in release.write(df.coalesce(1), out, shard_rows=3).collect()}
    assert m == {"train": (5, 750), "val": (5, 750)}
    back = spark.read.parquet(out)
    assert sorted(back.columns) == sorted(RELEASE.fieldNames()) and back.schema["cluster_size"].dataType.simpleString() == "int"
    listed = release.file_manifest(spark, out).collect()
    assert sorted(r.rows for r in listed) == [2, 2, 3, 3] and all(len(r.sha256) == 64 for r in listed)
    with pytest.raises(release.ReleaseError, match="duplicate id"):
        release.write(df.unionByName(df.limit(1)), out)
    with pytest.raises(release.ReleaseError, match="bad text"):
        release.write(df.withColumn("text", df.source), out)


def test_report(spark, tmp_path):
    got = files.write_report(spark, spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "rep"))
    assert got == {"a": 1, "b": "é"} and json.loads(spark.read.text(str(tmp_path / "rep")).first().value) == got


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    where = [str(tmp_path / x) for x in ("out", "sig", "ck")]
    (src / "1.json").write_text('{"id": "1", "text": "Same text"}\n{"id": "2", "text": "same  text!!"}\n{"id": "3", "text": "other"}\n')
    ingest(spark, str(src), DOCUMENT, *where).awaitTermination()
    (src / "2.json").write_text('{"id": "4", "text": "OTHER."}\n{"id": "5", "text": "new"}\n')
    ingest(spark, str(src), DOCUMENT, *where).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(where[0]).collect()) == ["2", "3", "5"]

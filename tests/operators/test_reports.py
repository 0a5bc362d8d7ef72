"""Release checks, paragraph and panel reports, key rotation, the shared folder."""

import pytest
from pyspark.sql import functions as F
from textloom import workspace
from textloom.operators import dedup, splits, translate
from textloom.sources import files, release


def test_split_mismatch(spark):
    text = "x" * 120
    rows = lambda *r: spark.createDataFrame(r, "id string, text string, split string")
    given = release.of_splits({"train": rows(("a", text, "train"), ("b", text, "val"), ("c", text, None)), "val": rows(("d", text, "val"))})
    assert sorted((r.id, r.reason) for r in release.violations(given).collect()) == [("b", "split mismatch"), ("c", "split mismatch")]
    with pytest.raises(release.ReleaseError, match="split mismatch: b in val"):
        release.write(given.where("id <> 'c'"), "/tmp/never-written")
    assert release.violations(release.of_splits({"val": rows(("d", text, "val"))})).count() == 0


def test_report_of_stripping(spark):
    foot = " ".join(f"f{i}" for i in range(20))
    body = lambda i: " ".join("abcdefghij"[i] + chr(107 + k // 10) + chr(107 + k % 10) for k in range(40))
    df = spark.createDataFrame([(i, f"{body(i)}\n\n{foot}\n\n{foot}") for i in range(5)] + [(7, "short"), (8, None), (9, f"a\n\n{foot}")], "doc_id int, text string")
    assert dedup.strip_report(df, min_docs=5).first().asDict() == {"paragraphs_removed": 11, "docs_touched": 6, "docs_dropped": 3}
    got = {r.doc_id: r for r in dedup.strip_boilerplate(df, min_docs=5).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[3].text == body(3) and got[3].removed == 2


def test_winners_get_their_texts(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b!!", "y"), (3, "c", "z")], "doc_id long, text string, source string")
    found = dedup.with_texts(dedup.exact_survivors(docs, F.regexp_replace("text", "!", "")), docs)
    assert {(r.doc_id, r.text, r.source, r["count"]) for r in found.collect()} == {(2, "a b!!", "y", 2), (3, "c", "z", 1)}


def test_panel_manifest(spark):
    df = spark.createDataFrame([("a b",), ("é",)], "text string")
    got = {r.panel: r for r in files.panel_manifest({"x": df, "none": df.limit(0)}).collect()}
    assert (got["x"].docs, got["x"].text_bytes, got["x"].tokens) == (2, 5, 3) and (got["none"].docs, got["none"].text_bytes, got["none"].tokens) == (0, 0, 0)


def test_keys_take_turns():
    used = []

    def key(name, fails):
        def call(prompt):
            used.append(name)
            if name in fails:
                raise ConnectionError
            return name

        return call

    call = translate.rotating([key("a", "ab"), key("b", "ab"), key("c", "ab")], waits=(0, 0, 0))
    assert [call("x"), call("x"), call("x")] == ["c", "c", "c"] and used == ["a", "b", "c", "b", "c", "c"]
    with pytest.raises(ConnectionError):
        translate.rotating([key("a", "ab"), key("b", "ab")], waits=(0, 0))("x")


def test_splits_equal_a_plain_rank(spark):
    rows = [(i, f"s{i % 3}" if i % 11 else None, f"20{10 + i % 2}-0{1 + i % 3}-05") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, source string, post_date string")
    got = splits.assign(df, val_n=60, test_n=45, months=1, cap=50).toPandas()
    assert len(got) == 900 and got.split.value_counts()[["val", "test_iid", "test_tail"]].tolist() == [60, 45, 50]
    import hashlib

    got["turn"] = [hashlib.md5(f"1337|{i}".encode()).hexdigest() for i in got.id]
    for _, g in got[(got.split != "test_tail") & (got.month != got.month.max())].groupby(["source", "month"]):
        order = g.sort_values("turn").split.tolist()
        assert order == sorted(order, key=["val", "test_iid", "train"].index)


def test_no_own_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://h:1"

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return self

                def isDefined(self):
                    return False

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())

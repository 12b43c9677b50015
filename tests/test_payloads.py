"""Drifting payloads against plain Python, and the streaming source of captures: order, restart, columns."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leadlake.sources import captures as CA
from leadlake.sources import payloads as PY

FIELDS = {"n": ("$.n", "long"), "name": ("$.name", "string"), "deep": ("$.a.b", "double"), "yes": ("$.yes", "boolean")}


def typed(spark, texts, fields=FIELDS):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return PY.typed_fields(PY.parsed(df, "text"), "payload", fields, "text")


def test_awkward_payloads(spark):
    got = {r.i: r for r in typed(spark, [
        None, "", "{", "[1]", "7", "null", "{}", '{"n": 1, "n": 2}', '{"n": 5, "name": "x", "a": {"b": 2}, "yes": true}',
        '{"n": "12", "name": 3, "a": {"b": "1.5"}, "yes": "false"}', '{"n": 1.5, "name": {"x": 1}, "a": 1, "yes": 7, "zz": 1, "b": null}',
        '{"n": 3.0, "name": null, "a": {"b": null}}', '{"n": 99999999999999999999, "name": "' + "y" * 300_000 + '"}',
        '{"n": "twelve", "a": []}', '{"n": 9007199254740993}']).collect()}
    assert len(got) == 15
    none = (None, None, None, None)
    value = lambda k: (got[k].n, got[k].name, got[k].deep, got[k].yes)
    assert [got[k].reason for k in range(6)] == ["no payload", "malformed", "malformed", "not an object", "not an object", "not an object"]
    assert all(value(k) == none and got[k].unknown is None for k in range(6)) and got[7].reason == "malformed"
    assert value(6) == none and got[6].reason is None and got[6].unknown == []
    assert value(8) == (5, "x", 2.0, True) and got[8].reason is None
    assert value(9) == (12, "3", 1.5, False) and got[9].reason is None
    assert got[10].n is None and got[10].reason.startswith("n: number") and got[10].unknown == ["b", "zz"]
    assert value(11) == (3, None, None, None) and got[11].reason is None
    assert got[12].n is None and got[12].reason == "n: number" and len(got[12].name) == 300_000
    assert got[13].reason == "n: string" and got[13].deep is None and got[14].n == 9007199254740993


def test_random_payloads_against_plain_python(spark):
    r = random.Random(3)
    values = [1, -4, 2.5, "7", "x", None, True, [1], {"v": 1}]
    objects = [{k: r.choice(values) for k in r.sample(["n", "name", "other", "more"], r.randrange(5))} for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "i long, text string")
    rows = PY.typed_fields(PY.parsed(df, "text"), "payload", {"n": ("$.n", "long")}, "text").collect()
    assert len(rows) == 300
    for x in rows:
        v = objects[x.i].get("n")
        want = int(v) if isinstance(v, (int, bool)) or v == "7" else None
        kind = {float: "number", str: "string", list: "array", dict: "object"}.get(type(v))
        assert x.n == want and x.reason == (f"n: {kind}" if v is not None and want is None else None)
        assert x.unknown == sorted(set(objects[x.i]) - {"n"})
    shape = {(x.field, x.kind): x.n for x in PY.payload_shape(PY.parsed(df, "text"), "payload").collect()}
    names = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    want = {}
    for o in objects:
        for k, v in o.items():
            want[k, names[type(v)]] = want.get((k, names[type(v)]), 0) + 1
    assert shape == want


def test_elements_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, '{"a": [{"pos": 4}, 2, null]}', "k"), (2, '{"a": []}', "k"), (3, '{"a": 1}', "k"), (4, None, "k")], "i long, text string, reason string")
    each = PY.elements(PY.parsed(df, "text"), "payload", "$.a")
    rows = sorted((r.i, r.pos, r.inner, r.reason) for r in PY.typed_fields(each, "payload", {"inner": ("$.pos", "int")}).collect())
    assert [x[:2] for x in rows] == [(1, 0), (1, 1), (1, 2)] and rows[0][2:] == (4, None) and rows[1][3] == "not an object"
    assert typed(spark, ["{}"]).limit(0).count() == 0 and PY.payload_shape(PY.parsed(df.limit(0), "text"), "payload").count() == 0
    plan = typed(spark, ["{}"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


SCHEMA = "page_id long, url string, html string"


def capture(root, name, ids, closed=True, **extra):
    folder = root / name
    folder.mkdir(parents=True, exist_ok=True)
    columns = {"page_id": pa.array(ids, pa.int32()), "url": pa.array([f"u{i}" for i in ids]), **extra}
    pq.write_table(pa.table(columns), folder / "part.parquet", row_group_size=3)
    if closed:
        (folder / CA.MARKER).touch()


def ids(df):
    return sorted(r.page_id for r in df.collect())


def run(spark, root, base):
    q = (CA.stream_captures(spark, str(root), SCHEMA).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return ids(spark.read.schema(SCHEMA).parquet(f"{base}/out"))


def test_captures_come_once_in_order_over_restarts(spark, tmp_path):
    root, base = tmp_path / "in", tmp_path / "run"
    capture(root, "2024-01", range(10))
    capture(root, "2024-02", range(10, 14), closed=False)
    capture(root, "2024-03", range(20, 25))
    (root / "_tmp").mkdir()
    (root / "a file").write_text("x")
    assert run(spark, root, base) == list(range(10))  # the open folder holds the later one back
    assert run(spark, root, base) == list(range(10))
    (root / "2024-02" / CA.MARKER).touch()
    assert run(spark, root, base) == [*range(14), *range(20, 25)]
    capture(root, "2024-04", [30, 30])
    assert run(spark, root, base) == [*range(14), *range(20, 25), 30, 30]
    assert ids(CA.read_captures(spark, str(root), SCHEMA)) == [*range(14), *range(20, 25), 30, 30]


def test_columns_by_name_row_groups_as_partitions_and_no_rows(spark, tmp_path):
    capture(tmp_path, "c1", range(7), html=pa.array(["h"] * 7), other=pa.array([1.5] * 7))
    capture(tmp_path, "c2", [])
    capture(tmp_path, "c3", [9])
    df = CA.read_captures(spark, f"file:{tmp_path}", SCHEMA)
    assert df.columns == ["page_id", "url", "html"] and df.where(F.col("html").isNull()).count() == 1 and df.count() == 8
    assert df.rdd.getNumPartitions() >= 4
    assert CA.read_captures(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0


def test_a_file_that_does_not_fit_the_schema_fails(spark, tmp_path):
    capture(tmp_path, "c1", range(2), html=pa.array([[1], [2]]))
    with pytest.raises(Exception):
        CA.read_captures(spark, str(tmp_path), SCHEMA).collect()

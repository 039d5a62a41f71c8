"""JSON arrays cut anywhere: byte ranges in strings, escapes and nested objects; order; several files."""
import json
import random

import pytest
from pyspark.sql import types as T

from sqlforge.sources import io as IO
from sqlforge.sources.json_array import read_json_array

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sub", T.StructType([
    T.StructField("x", T.StringType()), T.StructField("ys", T.ArrayType(T.StructType([T.StructField("z", T.StringType())])))]))])
STRINGS = ['{', '}', '"', '\\', '\\"', '{"a": "b"}', '[{', '}]', '\\\\{', 'é{ü', '', 'plain text', '"},{"', 'x' * 90, '\n{\t', '  {']


def rows(seed, n):
    r = random.Random(seed)
    some = lambda: "".join(r.choices(STRINGS, k=r.randint(0, 4)))
    out = []
    for k in range(n):
        o = {"a": some(), "n": k}
        if k % 3 == 0:
            o["sub"] = {"x": some(), "ys": [{"z": some()} for _ in range(k % 4)]}
        if k % 5 == 0:
            o = {"other": [{"q": some()}, [{}], {}], **o}
        out.append(o)
    return out


def expected(objects):
    return [(o["a"], o["n"], (o["sub"]["x"], [(y["z"],) for y in o["sub"]["ys"]]) if "sub" in o else None) for o in objects]


def got(df):
    out = sorted(df.collect(), key=lambda r: r.record)
    assert [r.record for r in out] == list(range(len(out)))
    return [(r.a, r.n, r["sub"] and (r["sub"].x, [(y.z,) for y in r["sub"].ys])) for r in out]


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent,ascii_only,size", [(None, True, 61), (2, False, 97), (None, False, 1000), (1, True, 134217728)])
def test_any_cut(spark, tmp_path, small_splits, indent, ascii_only, size):
    objects = rows(size, 60)
    path = str(tmp_path / "a.json")
    json.dump(objects, open(path, "w", encoding="utf-8"), indent=indent, ensure_ascii=ascii_only)
    small_splits(size)
    if size < 200:
        assert spark.read.option("lineSep", "{").text(path).rdd.getNumPartitions() > 30
    assert got(read_json_array(spark, path, SCHEMA)) == expected(objects)


def test_several_files_and_odd_layouts(spark, tmp_path, small_splits):
    small_splits(80)
    for k in range(3):
        json.dump(rows(k, 7), open(tmp_path / f"f{k}.json", "w"))
    assert got(read_json_array(spark, str(tmp_path), SCHEMA)) == [x for k in range(3) for x in expected(rows(k, 7))]
    for text, n in (("", 0), ("[]", 0), ("[1, \"{\", []]", 0), ('{"a": "x", "n": 0}', 1), ('[{"a": "x"}, {}, {"a": 1}]', 3), ('\n [ {"a":"}"} ]\n', 1)):
        (tmp_path / "g.txt").write_text(text)
        assert read_json_array(spark, str(tmp_path / "g.txt"), SCHEMA).count() == n, text


def test_ids_follow_the_file(spark, tmp_path, small_splits):
    objects = [{"db_id": "d", "question": f"q{{{k}", "query": "SELECT '}'"} for k in range(200)]
    path = str(tmp_path / "train.json")
    json.dump(objects, open(path, "w"), indent=4)
    small_splits(512)
    out = IO.read_qa_json(spark, path, "plain", number=3).orderBy("sample_id").collect()
    assert [r.question for r in out] == [o["question"] for o in objects]
    assert [r.sample_id - (3 << IO._ID_BITS) for r in out] == list(range(200))


def test_report_details_in_splits(spark, tmp_path, small_splits):
    details = [{"db_id": "d", "question": "{q", "ex": k % 2 == 0, "gold_sql": str(k)} for k in range(40)]
    path = str(tmp_path / "r.json")
    json.dump({"ex": 0.5, "difficulty": {"easy": {"n": 1}}, "details": details}, open(path, "w"), indent=2)
    small_splits(150)
    out = IO.read_stage1(spark, path).orderBy("detail_ord").collect()
    assert [(r.detail_ord, r.gold_sql, r.ex) for r in out] == [(k, str(k), k % 2 == 0) for k in range(40)]

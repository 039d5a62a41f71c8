"""The pipeline: columns, decisions, awkward inputs, oracles of the registered queries."""
import pytest
from helpers import SF_SMALL, awkward, empty, prose

import __spark_entry__ as E
import corpus_pipeline as C
from checks.compare import compare
from sqlforge.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLES[name])
    assert r["columns_match"] and r["values_match"], r


def test_registered():
    assert {f"op{k}" for k in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_documents(spark, make):
    docs = make(spark)
    names = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, SF_SMALL).cache()
        docs.count()
        if k < len(C.STAGES) - 1:
            assert docs.columns == names
    assert (docs.count() > 0) == (make is awkward)


def test_extra_columns_stay_whatever_their_names(spark):
    extra = ("score", "predicted", "_fp", "_row", "spans", "_spans", "size", "taken", "_key", "_src", "_part", "_doc", "_text")
    docs = awkward(spark, clash=extra)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL).cache()
        assert docs.columns[-len(extra):] == list(extra)
        assert all(r[c] == "other" for r in docs.collect() for c in extra)
    assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() > 0


def test_decisions_take_effect(spark, tmp_path):
    toxic = [(k, prose(k, 60) + " grumbolt grumbolting fizzlegrumbolt", "en", "s", 0) for k in range(200, 280)]
    clean = [(k, prose(k, 60), "en", f"s{k % 4}", 0) for k in range(80)]
    copies = [(500 + k, prose(3, 60), "en", "s1", 0) for k in range(5)]
    secret = [(600, prose(600, 60) + " password=abcdef99XYZ123", "en", "s1", 0)]
    rows = toxic + clean + copies + secret
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(r in toxic)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for _, stage in C.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert sum(k in seen[0] for k in range(200, 280)) <= 4 and sum(k in seen[0] for k in range(80)) >= 78
    assert not {500, 501, 502, 503, 504} & set(seen[1]) and 3 in seen[1]
    assert seen[2][600].endswith("password=<secret>") and set(seen[2]) == set(seen[1])
    pieces = C.run(spark, str(tmp_path)).collect()
    assert pieces and {r.doc_id for r in pieces} <= set(seen[2])

"""Output scoring as a stream gives the same result as the batch expressions."""
import json
import tempfile

from sqlforge.streaming.outputs import start_output_scoring


def test_stream_scoring(spark):
    src, sink, ck = (tempfile.mkdtemp(prefix="sqlforge-") for _ in range(3))
    rows = [{"sample_id": 1, "output": "<clause_select> a </clause_select><clause_from> t </clause_from>"},
            {"sample_id": 2, "output": "<summary>\nSELECT b FROM u\n</summary>"}]
    with open(f"{src}/part-0.json", "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    q = start_output_scoring(spark, src, sink, checkpoint=ck)
    q.awaitTermination(120)
    got = {r["sample_id"]: r["final_sql"] for r in spark.read.parquet(sink).collect()}
    assert got == {1: "SELECT a\nFROM t", 2: "SELECT b FROM u"}

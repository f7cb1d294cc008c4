"""Flow ids are matched in all spellings, and each 5-tuple moves once."""

from __future__ import annotations

from flowspark.operators import reconcile as rc


def test_spellings_meet_without_copies(spark):
    tuples = [("a-b", "c", 1, 2, 6), ("a-b", "c", 1, 2, 6), ("x", "y", 3, 3, 6), (None, "y", 3, 3, 6), ("p", "q", 7, 8, 17), ("r", "s", 1, 2, 6)]
    generated = spark.createDataFrame(tuples, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    ids = [(" c-a-b-1-2-6 ", "second", 1), ("a-b-c-1-2-6", "third", 2), ("c-a-b-1-2-6", "later", 9), ("y-x-3-3-6", None, 3), ("q-p-7-17-8", "other order", 4), (None, "none", 5), ("s-r-2-1-6", "first", 7)]
    labelled = spark.createDataFrame(ids, "`Flow ID` string, Label string, sample_id int")
    out = rc.match_flows(generated, labelled)
    got = {r["src_ip"]: (r["n_rows"], r["flow_id"], r["label"]) for r in out.collect()}
    assert got == {"a-b": (2, "c-a-b-1-2-6", "second"), "x": (1, "y-x-3-3-6", None), None: (1, None, None), "p": (1, None, None), "r": (1, "s-r-2-1-6", "first")}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row per spelling

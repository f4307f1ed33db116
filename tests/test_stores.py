"""Stored vectors, runs and queues, and models that answer."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import answer, models
from folioscope.operators.dense import DimensionMismatch
from folioscope.sources import messages, vectors
from folioscope.streaming import machine, runs


def test_vectors_are_replaced_and_deleted(spark, tmp_path):
    path = str(tmp_path / "vectors")
    make = lambda rows: spark.createDataFrame(rows, "vec_id int, document_id string, embedding array<float>")
    held = lambda: {r.vec_id: (r.document_id, list(r.embedding)) for r in vectors.read(spark, path).collect()}
    vectors.delete_documents(spark, path, spark.createDataFrame([("a",)], "document_id string"))  # no collection yet
    first = make([(i, f"d{i % 7}", [float(i), 1.0]) for i in range(40)])
    for _ in range(2):  # repeating a write changes nothing
        vectors.upsert(first, path, buckets=4)
    assert len(held()) == 40
    vectors.upsert(make([(3, "d3", [9.0, 9.0]), (100, "d3", [0.0, 1.0])]), path, buckets=4)
    assert len(held()) == 41 and held()[3] == ("d3", [9.0, 9.0]) and held()[4] == ("d4", [4.0, 1.0])
    with pytest.raises(DimensionMismatch):
        vectors.upsert(make([(5, "d5", [1.0])]), path, buckets=4)
    vectors.delete_documents(spark, path, spark.createDataFrame([("d3",), ("d3",), ("none",)], "document_id string"))
    assert {d for d, _ in held().values()} == {"d0", "d1", "d2", "d4", "d5", "d6"}
    vectors.delete_documents(spark, path, first.select("document_id"))
    assert not list((tmp_path / "vectors").glob("bucket=*"))
    vectors.upsert(make([(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0])]), path, buckets=4)
    vectors.upsert(make([(1, "b", [3.0, 0.0]), (2, "b", [4.0, 0.0]), (2, "c", [5.0, 0.0]), (2, "c", [5.0, 0.0])]), path, buckets=4)  # ids that move, and one that repeats
    assert vectors.read(spark, path).count() == 2 and held() == {1: ("b", [3.0, 0.0]), 2: ("c", [5.0, 0.0])}
    vectors.delete_documents(spark, path, spark.createDataFrame([("b",), ("a",)], "document_id string"))
    assert held() == {2: ("c", [5.0, 0.0])}


def test_ensure_runs(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "document_id string")
    once = {r.document_id: (r.run_id, r.created) for r in runs.ensure_runs(wanted).collect()}
    assert set(once) == {"a", "b"} and once == {r.document_id: (r.run_id, r.created) for r in runs.ensure_runs(wanted).collect()}
    there = spark.createDataFrame([("a", "run-1"), ("a", "run-2")], "document_id string, run_id string")
    again = {r.document_id: (r.run_id, r.created) for r in runs.ensure_runs(wanted, there).collect()}
    assert again == {"a": ("run-1", False), "b": (once["b"][0], True)}


def rows_of(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_queue_round_trip(spark, tmp_path):
    path = str(tmp_path / "queues")
    raw = [json.dumps({"document_id": d, "run_id": "r", "stage": s, "family": "flow", "pipeline_version": "1"}) for d, s in (("a", "chunk"), ("b", "chunk"), ("c", "embed"))]
    df = messages.decode(spark.createDataFrame([(x,) for x in raw], "raw string"))
    runs.publish(df, path)
    got = rows_of(runs.consume(spark, path, "chunk").select("message.document_id", "message.stage", "error"), tmp_path, "chunk_queue")
    assert sorted(r.document_id for r in got) == ["a", "b"] and all(r.stage == "chunk" and r.error is None for r in got)
    with pytest.raises(ValueError, match="unknown stage"):
        runs.consume(spark, path, "polish")


def test_snapshot_and_what_comes_after(spark, tmp_path):
    path = str(tmp_path / "progress")
    put = lambda rows: spark.createDataFrame(rows, runs.PROGRESS).write.mode("append").json(path)
    put([(1, "r", "detect", "running", 1, None), (2, "r", "detect", "completed", 1, None), (3, "other", "detect", "running", 1, None)])
    table = spark.createDataFrame([("r", "flow"), ("other", "flow")], "run_id string, family string")
    now, later, last = runs.snapshot_then_stream(spark, table, path, "r")
    assert last == 2 and {r.stage: r.status for r in now.collect()} == {"detect": "completed", "parse_flow": "pending", "chunk": "pending", "contextualize": "pending", "embed": "pending"}
    put([(4, "r", "parse_flow", "running", 1, None), (5, "other", "detect", "completed", 1, None)])
    assert [(r.seq, r.stage) for r in rows_of(later, tmp_path, "later")] == [(4, "parse_flow")]


def test_redelivered_events_count_once():
    import pandas as pd

    state = json.loads(json.dumps(machine.NEW))
    event = pd.DataFrame([(1, "flow", "chunk", "failed", "timeout")], columns=["event_id", "family", "stage", "outcome", "error_class"])
    assert machine.advance("r", state, event)["action"].tolist() == ["retry"] and machine.advance("r", state, event).empty
    assert state["attempts"] == {"chunk": 1}


@pytest.fixture(scope="module")
def asked(spark):
    questions = spark.createDataFrame([(1, "what"), (2, "why"), (3, "who")], "query_id int, text string")
    passages = spark.createDataFrame([(1, 1, "doc", "first passage", ["A"], 3), (1, 2, "doc2", "second", None, None), (2, 1, "doc", "only", None, None)], "query_id int, position int, document_name string, text string, section_path array<string>, page_no int")
    return questions, passages


def test_models(spark, asked):
    def make():
        def run(prompts):
            if any("Question: why" in p for p in prompts):
                raise RuntimeError("busy")
            return [("It says so [1].", len(p), 5) for p in prompts]

        return run

    models.register_model("echo", make)
    with pytest.raises(ValueError, match="unknown model"):
        models.get_model("none")
    got = asked[0].select("query_id", models.complete(F.concat(F.lit("Question: "), F.col("text")), make, batch=1).alias("r")).select("query_id", "r.*").orderBy("query_id").collect()
    assert [r.text for r in got] == ["It says so [1].", None, "It says so [1]."] and got[1].error == "RuntimeError: busy"
    one = asked[0].where("query_id <> 2")
    out = {r.query_id: r for r in models.answers(one, asked[1], "echo", answer.price_table(spark, [("echo", 1.0, 2.0)])).collect()}
    assert out[1].model == "echo" and out[1].cost_usd == pytest.approx((out[1].input_tokens + 10) / 1e6)
    failed = models.answers(asked[0].where("query_id = 2"), asked[1], "echo").first()
    assert failed.error == "RuntimeError: busy" and failed.model is None and "only" in failed.answer
    plain = {r.query_id: r.answer for r in models.answers(*asked).collect()}
    assert plain[3] == answer.NOTHING_FOUND and "first passage" in plain[1]


def test_answer_frames(spark, asked):
    answered = spark.createDataFrame([(1, "It says so [1], and [2]. " * 20, "echo", 3, 4, 0.5), (3, "", None, 0, 0, 0.0)], "query_id int, answer string, model string, input_tokens int, output_tokens int, cost_usd double")
    got = models.frames(answered, asked[1]).orderBy("query_id", "seq").collect()
    one = [r for r in got if r.query_id == 1]
    assert [r.event for r in one] == ["passages", "delta", "delta", "delta", "citations", "usage", "done"] and [r.seq for r in one] == list(range(7))
    assert "".join(json.loads(r.data)["text"] for r in one if r.event == "delta") == "It says so [1], and [2]. " * 20
    assert [p["document_name"] for p in json.loads(one[0].data)] == ["doc", "doc2"] and [c["marker"] for c in json.loads(one[4].data)] == [1, 2]
    assert json.loads(one[5].data)["cost_usd"] == 0.5 and one[-1].data == "[DONE]"
    assert [r.event for r in got if r.query_id == 3] == ["passages", "delta", "citations", "usage", "done"]

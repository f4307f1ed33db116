import pytest
from pyspark.sql import functions as F

from folioscope.plans import ingest
from folioscope.streaming import machine, stages
from folioscope.streaming.stages import Stage


def walk(family):
    done, out = set(), []
    while new := stages.ready(family, done):
        out.append(new)
        done |= set(new)
    return out


def test_paths():
    assert walk("flow") == [["detect"], ["parse_flow"], ["chunk"], ["contextualize"], ["embed"]]
    assert walk("pdf") == [["detect"], ["parse"], ["ocr"], ["tables", "figures"], ["chunk"], ["contextualize"], ["embed"]]
    assert walk("web")[1] == ["convert"]
    stages.validate()


def test_bad_graphs():
    with pytest.raises(ValueError, match="unknown"):
        stages.validate((Stage("a", "parse", ("pdf",), ("x",)),))
    with pytest.raises(ValueError, match="before"):
        stages.validate((Stage("a", "parse", ("pdf",), ("b",)), Stage("b", "parse", ("pdf",), ())))
    with pytest.raises(ValueError, match="never"):
        stages.validate((Stage("a", "parse", stages.FAMILIES, ()),))


def test_relations_agree_with_python(spark):
    rows = [(f, sorted(done), sorted(sent)) for f in stages.FAMILIES for n in range(9) for done in [[s.name for s in stages.stages_for(f)][:n]] for sent in (done, [*done, "chunk"])]
    df = spark.createDataFrame(rows, "family string, completed array<string>, dispatched array<string>")
    got = {}
    for r in stages.ready_stages(df).collect():
        got.setdefault((r.family, tuple(r.completed), tuple(r.dispatched)), set()).add(r.stage)
    for f, done, sent in rows:
        assert got.get((f, tuple(done), tuple(sent)), set()) == set(stages.ready(f, set(done), set(sent)))


def test_selection_and_handlers():
    assert stages.select_stages(pool="parse", exclude=["ocr"]) == ["detect", "convert", "parse", "parse_flow", "tables"]
    with pytest.raises(ValueError):
        stages.select_stages(only=["x"])
    with pytest.raises(ValueError):
        stages.handler("x")


def test_machine_dispatches_once():
    state = {"completed": [], "dispatched": [], "attempts": {}}
    assert machine.step(state, "flow", "detect", "ok", None) == [("dispatch", "parse_flow", 1, None)]
    assert machine.step(state, "flow", "detect", "ok", None) == []
    assert machine.step(state, "flow", "parse_flow", "failed", "timeout")[0][:3] == ("retry", "parse_flow", 2)
    machine.step(state, "flow", "parse_flow", "failed", "timeout")
    assert machine.step(state, "flow", "parse_flow", "failed", "timeout")[0][3] == "attempts exhausted"
    assert machine.step(state, "flow", "chunk", "failed", "unsupported_format")[0][3] == "permanent"


def test_stream_gives_what_the_table_gives(spark):
    rows = lambda q: sorted(map(tuple, q(spark, "/root/testdata/sf0.001").select("run_id", "action", "stage", "attempt", F.coalesce("reason", F.lit(""))).collect()))
    got = rows(ingest.pipeline_stream)
    assert got == rows(ingest.pipeline_batch) and got

import json
import os

import pytest

from weftline.cli import main
from weftline.plans.planner import check, compile_workflow
from weftline.plans.runner import run_workflow
from weftline.plans.workflow import WorkflowError, parse_workflow


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def chain(tmp_path, data, *nodes, settings="", sink_params=""):
    src = write(tmp_path / "in.csv", data)
    text = f'version: "1.0"\nname: t\n{settings}nodes:\n  - id: source\n    type: SourceCsv\n    params: {{path: "{src}"}}\n'
    last = "source"
    for i, (kind, params) in enumerate(nodes):
        text += f"  - id: n{i}\n    type: {kind}\n    inputs: {{in: {last}}}\n    params: {json.dumps(params)}\n"
        last = f"n{i}"
    return text + f'sinks:\n  - id: sink\n    type: SinkCsv\n    inputs: {{in: "{last}"}}\n    params: {{path: "{tmp_path}/out/out.csv"{sink_params}}}\n'


def run(spark, tmp_path, *args, **kw):
    result = run_workflow(spark, parse_workflow(chain(tmp_path, *args, **kw)))
    out = tmp_path / "out" / "out.csv"
    return result, out.read_text() if out.exists() else None


def test_demo(spark, tmp_path):
    result, out = run(spark, tmp_path, "id,status\n5,inactive\n12,active\n20,active\n8,inactive\n", ("TransformFilter", {"when": "id > 10"}))
    assert out == "id,status\n12,active\n20,active\n" and result.sinks["sink"].rows == 2
    assert os.listdir(tmp_path / "out") == ["out.csv"]


def test_filters(spark, tmp_path):
    _, out = run(spark, tmp_path, "id,isActive,status\n1,true,active\n2,false,inactive\n3,true,archived\n", ("TransformFilter", {"when": "isActive == true"}), ("TransformFilter", {"when": 'status startsWith "act"'}))
    assert out == "id,isActive,status\n1,true,active\n"


def test_aggregate(spark, tmp_path):
    _, out = run(spark, tmp_path, "category,value\nA,10\nB,7\nA,5\nB,3\nA,5\nB,10\n", ("TransformAggregator", {"groupBy": "category", "aggregates": "count:*:row_count;sum:value:total;avg:value:mean;min:value;max:value"}))
    assert sorted(out.splitlines()[1:]) == ["A,3,20,6.666666666666667,5,10", "B,3,20,6.666666666666667,3,10"]
    assert out.splitlines()[0] == "category,row_count,total,mean,min_value,max_value"


def test_empty_result_is_an_empty_file(spark, tmp_path):
    _, out = run(spark, tmp_path, "id\n1\n", ("TransformFilter", {"when": "id > 10"}))
    assert out == ""


def test_csv_shapes(spark, tmp_path):
    """Short rows are padded, long ones cut, blank lines are rows, quotes are plain."""
    _, out = run(spark, tmp_path, 'a,b\n1\n2,"x,y"\n\n3,z,more\n')
    assert out == 'a,b\n1,\n2,"x\n0,\n3,z\n'


BRANCH = """
version: "1"
name: branches
settings: {{errorLog: "{dir}/errors.ndjson"}}
nodes:
  - {{id: a, type: SourceCsv, params: {{path: "{dir}/a.csv"}}}}
  - {{id: bad, type: TransformCalculator, errorPolicy: {policy}, inputs: {{in: a}}, params: {{expression: "missing + 1", outputField: x}}}}
  - {{id: b, type: SourceCsv, params: {{path: "{dir}/b.csv"}}}}
sinks:
  - {{id: broken, type: SinkCsv, inputs: {{in: bad}}, params: {{path: "{dir}/broken.csv"}}}}
  - {{id: healthy, type: SinkCsv, inputs: {{in: b}}, params: {{path: "{dir}/healthy.csv"}}}}
"""


def test_policies(spark, tmp_path):
    write(tmp_path / "a.csv", "id,value\n1,2\n")
    write(tmp_path / "b.csv", "id,name\n10,a\n11,b\n")
    result = run_workflow(spark, parse_workflow(BRANCH.format(dir=tmp_path, policy="StopBranch")))
    assert not (tmp_path / "broken.csv").exists() and len((tmp_path / "healthy.csv").read_text().splitlines()) == 3
    assert result.errors[0][0] == "bad" and json.loads((tmp_path / "errors.ndjson").read_text().splitlines()[0])["NodeId"] == "bad"
    run_workflow(spark, parse_workflow(BRANCH.format(dir=tmp_path, policy="Ignore")))
    assert (tmp_path / "broken.csv").read_text() == ""
    with pytest.raises(WorkflowError, match="missing"):
        run_workflow(spark, parse_workflow(BRANCH.format(dir=tmp_path, policy="StopPipeline")))


def test_failing_sink_keeps_the_old_file(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "out.csv").write_text("old")
    src = write(tmp_path / "x.csv", "id\n1\n")
    w = parse_workflow(f'version: "1"\nname: t\nnodes:\n  - {{id: s, type: SourceCsv, params: {{path: "{src}"}}}}\nsinks:\n  - {{id: k, type: SinkCsv, inputs: {{in: s}}, params: {{path: "{tmp_path}/out/out.csv"}}}}\n')
    plan = compile_workflow(spark, w)
    os.remove(src)
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error of a file that went
        plan.writers["k"]()
    assert (tmp_path / "out" / "out.csv").read_text() == "old" and len(os.listdir(tmp_path / "out")) == 1


def test_all_errors_at_once():
    w = parse_workflow('version: "1"\nname: t\nnodes:\n  - {id: a, type: Nope}\n  - {id: a, type: TransformNoop, inputs: {in: ghost}}\n  - {id: f, type: TransformFilter, inputs: {in: s, other: s}}\n  - {id: s, type: SourceCsv, params: {path: x, hasHeader: maybe}}\nsinks: []\n')
    with pytest.raises(WorkflowError) as e:
        check(w)
    text = str(e.value)
    for part in ("no sink", "used twice", "unknown block type 'Nope'", "'when' is required", "unknown input port 'other'", "no boolean"):
        assert part in text


def test_cycle():
    w = parse_workflow('version: "1"\nname: t\nnodes:\n  - {id: s, type: SourceCsv, params: {path: x}}\n  - {id: f, type: TransformFilter, inputs: {in: g}, params: {when: "id > 1"}}\n  - {id: g, type: TransformNoop, inputs: {in: f}}\nsinks:\n  - {id: k, type: SinkCsv, inputs: {in: f}, params: {path: y}}\n')
    with pytest.raises(WorkflowError, match="cycle"):
        check(w)


def test_ports():
    base = 'version: "1"\nname: t\nnodes:\n  - {{id: s, type: SourceCsv, params: {{path: x}}}}\n  - {{id: c, type: TransformConditionalSplitter, inputs: {{in: s}}, params: {{branches: "low:id < 5"}}}}\nsinks:\n  - {{id: k, type: SinkCsv, inputs: {{in: "c:{port}"}}, params: {{path: y}}}}\n'
    check(parse_workflow(base.format(port="LOW")))
    with pytest.raises(WorkflowError, match="no output port 'hi'"):
        check(parse_workflow(base.format(port="hi")))


def test_yaml():
    w = parse_workflow('version: "1.0"\nname: n\nsettings: {batchSize: 250, errorLog: x}\nnodes:\n  - {id: a, type: SourceCsv, params: {path: "${P}", hasHeader: true}}\n  - {id: b, type: TransformNoop, inputs: {in: a}, errorPolicy: Ignore}\nsinks:\n  - {id: k, type: SinkCsv, inputs: {in: b}, params: {path: y}}\n', {"P": "p.csv"})
    assert w.settings.batch_size == 250 and w.nodes[0].params == {"path": "p.csv", "hasHeader": "true"} and w.nodes[1].error_policy == "Ignore" and len(w.sinks) == 1
    with pytest.raises(WorkflowError, match="GONE"):
        parse_workflow('version: "1"\nname: "${GONE}"', {})
    with pytest.raises(WorkflowError, match="version"):
        parse_workflow("name: x")
    with pytest.raises(WorkflowError, match="scalar"):
        parse_workflow('version: "1"\nname: t\nnodes:\n  - {id: a, type: b, params: {x: [1]}}')


def test_branches_as_list():
    w = parse_workflow('version: "1"\nname: t\nnodes:\n  - {id: c, type: TransformConditionalSplitter, params: {branches: [{name: low, when: "id < 5"}, {name: high, when: "id > 9"}]}}\n')
    assert w.nodes[0].params["branches"] == "low:id < 5;high:id > 9"


def test_resume(spark, tmp_path):
    token = write(tmp_path / "token", "1")
    src = write(tmp_path / "r.csv", "id,name\n1,a\n2,b\n3,c\n")
    text = f'version: "1"\nname: t\nnodes:\n  - {{id: s, type: SourceCsv, params: {{path: "{src}", checkpointPath: "{token}"}}}}\nsinks:\n  - {{id: k, type: SinkCsv, inputs: {{in: s}}, params: {{path: "{tmp_path}/o.csv"}}}}\n'
    run_workflow(spark, parse_workflow(text))
    assert (tmp_path / "o.csv").read_text() == "id,name\n2,b\n3,c\n" and json.loads((tmp_path / "token").read_text()) == {"Type": "long", "Value": 3}
    run_workflow(spark, parse_workflow(text))
    assert (tmp_path / "o.csv").read_text() == ""


def test_fan_out(spark, tmp_path):
    src = write(tmp_path / "f.csv", "id,score\n1,5\n2,50\n3,500\n")
    text = f'version: "1"\nname: t\nsettings: {{metricsLog: "{tmp_path}/m.ndjson"}}\nnodes:\n  - {{id: s, type: SourceCsv, params: {{path: "{src}"}}}}\n  - {{id: c, type: TransformConditionalSplitter, inputs: {{in: s}}, params: {{branches: "low:score < 10;high:score >= 100"}}}}\nsinks:\n' + "".join(f'  - {{id: {p}, type: SinkCsv, inputs: {{in: "c:{p}"}}, params: {{path: "{tmp_path}/{p}.csv", includeHeader: "false"}}}}\n' for p in ("low", "high", "out"))
    result = run_workflow(spark, parse_workflow(text))
    assert [(tmp_path / f"{p}.csv").read_text() for p in ("low", "high", "out")] == ["1,5\n", "3,500\n", "2,50\n"]
    assert {k: v.rows for k, v in result.sinks.items()} == {"low": 1, "high": 1, "out": 1} and (tmp_path / "m.ndjson").exists()


def test_cli(spark, tmp_path, capsys):
    assert main([]) == 0 and main(["/nowhere.yaml"]) == 1
    path = write(tmp_path / "w.yaml", chain(tmp_path, "id\n1\n", ("TransformFilter", {"when": "nope > 1"})))
    assert main([path]) == 1 and "nope" in capsys.readouterr().err
    path = write(tmp_path / "w.yaml", chain(tmp_path, "id\n1\n"))
    assert main([path, "--validate"]) == 0 and not (tmp_path / "out").exists()
    assert main([path]) == 0 and (tmp_path / "out" / "out.csv").read_text() == "id\n1\n"

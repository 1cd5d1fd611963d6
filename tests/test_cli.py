import json

from relweave.__main__ import main
from relweave.sources.catalog import Schema


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    Schema.parse({"description": "Letters", "entities": [{"name": "a", "source": "a.csv", "columns": [{"name": "id", "type": "int", "pk": True}, {"name": "name"}]}]}).save(tmp_path / "s.json")
    schema, data = str(tmp_path / "s.json"), str(tmp_path)
    selector = {"op": "query", "root_entity": "a", "filters": {"type": "comparison", "field": "name", "op": "=", "value": " Y"}}

    def said(*args):
        code = main([*args], spark)
        return code, capsys.readouterr().out.strip()

    assert said("query", schema, data, json.dumps(selector), "--format", "csv") == (0, "id=2 | name=y")
    (tmp_path / "q.json").write_text(json.dumps({**selector, "filters": None}))
    assert said("query", schema, data, f"@{tmp_path}/q.json", "--format", "csv", "--out", f"{data}/out")[0] == 0 and spark.read.parquet(f"{data}/out").count() == 2
    assert "Letters" in said("describe", schema, data)[1]
    base, new = tmp_path / "base.jsonl", tmp_path / "new.jsonl"
    base.write_text('{"id": "1", "status": "ok", "tags": ["t"]}\n{"id": "2", "status": "error"}')
    new.write_text('{"id": "1", "status": "failed"}\n{"id": "2", "status": "ok"}')
    for style in ("table", "markdown", "json", "junit"):
        code, text = said("compare", str(base), str(new), "--style", style)
        assert code == 1 and "1" in text
    assert said("compare", str(base), str(base))[0] == 0
    assert json.loads(said("summary", str(base))[1])["total"] == 2 and json.loads(said("summary", str(base), "--by-tag")[1])["tag"] == "t"
    (tmp_path / "h.jsonl").write_text('{"run_id": "1", "timestamp": "2024-01-01"}\n{"run_id": "2", "timestamp": "2024-01-02", "run_status": "FAILED"}\n')
    assert json.loads(said("history", str(tmp_path / "h.jsonl"), "--last", "1")[1])["status"] == "FAILED"


def scripted(prompt):
    """A model that plans a count of the letters and answers from what was fetched."""
    if "Context:" not in prompt:
        if "broken" in prompt:
            raise RuntimeError("no plan today")
        selector = {"op": "query", "root_entity": "a", "aggregations": [{"field": "id", "agg": "count", "alias": "n"}]}
        return "```json\n" + json.dumps({"context_plan": [{"provider": "catalog", "selectors": selector}]}) + "\n```"
    return "There are " + prompt.split("n=")[1].split()[0] + " letters"


def test_runs_of_cases(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    Schema.parse({"entities": [{"name": "a", "source": "a.csv", "columns": [{"name": "id", "type": "int", "pk": True}, {"name": "name"}]}]}).save(tmp_path / "s.json")
    cases = [{"id": "right", "question": "how many?", "expected": "There are 2 letters", "tags": ["count"]}, {"id": "wrong", "question": "how many?", "expected_contains": "3"}, {"id": "fails", "question": "broken?", "expected": "x"}, {"id": "open", "question": "how many?"}, {"id": "left out", "question": "how many?", "skip": True}]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, cases)))
    at, runs = (str(tmp_path / "s.json"), str(tmp_path)), str(tmp_path / "runs")
    model = ("--format", "csv", "--model", "test_cli:scripted")
    monkeypatch.syspath_prepend(str(__import__("pathlib").Path(__file__).parent))

    def said(*args):
        code = main([*args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    code, (entry,) = said("batch", *at, str(tmp_path / "cases.jsonl"), "--runs", runs, "--tag", "t1", *model)
    assert code == 1 and (entry["run_status"], entry["planned_total"], entry["executed_total"], entry["fail_count"], entry["pass_rate"]) == ("FAILED", 5, 5, 2, 0.25)
    code, (again,) = said("batch", *at, str(tmp_path / "cases.jsonl"), "--runs", runs, "--tag", "t1", "--only-failed", *model)
    assert code == 1 and again["planned_total"] == 2
    code, rows = said("report", runs, "--tag", "t1")
    assert code == 1 and [rows[0][k] for k in ("total", "ok", "mismatch", "error", "skipped", "unchecked")] == [5, 1, 1, 1, 1, 1] and rows[1]["tag"] == "count"
    assert said("report", runs, "--run", entry["run_id"])[1][0]["total"] == 5
    assert [(r["tag"], r["n_runs"], r["n_cases"]) for r in said("tags", runs, "--pattern", "t*")[1]] == [("t1", 2, 5)]
    assert [r["status"] for r in said("case-history", runs, "fails")[1]] == ["error", "error"]
    assert [r["status"] for r in said("stats", runs)[1]] == ["FAILED", "FAILED"]
    assert said("open", runs, "right", "--run", entry["run_id"])[1][0]["answer"] == "There are 2 letters"
    code, (one,) = said("case", *at, str(tmp_path / "cases.jsonl"), "right", "--runs", runs, *model)
    assert code == 0 and one["status"] == "ok"
    assert said("batch", *at, str(tmp_path / "cases.jsonl"), "--runs", runs, "--include-ids", "open", "--plan-only", *model)[1][0]["run_status"] == "SUCCESS"
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO("how many?\nbroken?\nquit\nnever\n"))
    assert main(["chat", *at, *model], spark) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["There are 2 letters", "RuntimeError: no plan today"]


def test_gen(spark, tmp_path, capsys):
    out = str(tmp_path / "shop")
    assert main(["gen", out, "--rows", "40"], spark) == 0
    selector = {"op": "query", "root_entity": "orders", "relations": ["orders_customers"], "aggregations": [{"field": "customers.name", "agg": "count", "alias": "n"}]}
    assert main(["query", f"{out}/schema.json", out, json.dumps(selector), "--format", "csv"], spark) == 0
    assert capsys.readouterr().out.strip() == "Aggregations: n=40"


def test_http_model(monkeypatch):
    import http.server
    import threading

    from relweave.runs.model import HttpModel, load_settings, model_of

    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("SOME_KEY", "k")
        model = model_of({"model": {"url": f"http://127.0.0.1:{server.server_port}/", "name": "m", "key_env": "SOME_KEY", "wait": 0.0}})
        assert isinstance(model, HttpModel) and model("well?") == "yes"
    finally:
        server.shutdown()
    assert len(asked) == 2 and asked[1][0] == "Bearer k" and asked[1][1]["messages"] == [{"role": "user", "content": "well?"}]
    assert load_settings(None) == {}

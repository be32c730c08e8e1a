"""Sources, extractors and streams on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import diff, graph, logs
from factloom.sources import extract, files
from factloom.streaming import gates


def test_files_are_listed_and_indexed_within_a_budget(spark, tmp_path):
    for name, text in (("a.py", "x"), ("src/b.py", "yy"), ("src/c.md", "zzz"), ("node_modules/d.py", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = [r["path"].split("/")[-1] for r in files.listed(spark, str(tmp_path), "*.py", "/node_modules/").collect()]
    assert got == ["a.py", "b.py"] and files.listed(spark, str(tmp_path), "*.rs").count() == 0
    index = files.content_index(spark, str(tmp_path), ["node_modules"])
    assert {(r["path"], r["size"], r["sha256"]) for r in index.collect()} == {(p, len(t), hashlib.sha256(t.encode()).hexdigest()) for p, t in (("a.py", "x"), ("src/b.py", "yy"), ("src/c.md", "zzz"))}
    assert files.source_digest(index).first() == files.source_digest(index.orderBy(F.desc("path"))).first()
    with pytest.raises(ValueError):
        files.content_index(spark, str(tmp_path), most_files=2)


def test_strict_log_counts_noise_and_refuses_bad_receipts(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id": 1, "ref": "a"}\nnoise here\n\n{"id": 2, "ref": "b"}\n')
    rows, noise = files.strict_jsonl(spark, str(tmp_path / "ok.jsonl"), "id INT, ref STRING", "id IS NOT NULL")
    assert {(r["id"], r["ref"]) for r in rows.collect()} == {(1, "a"), (2, "b")} and noise == 1
    (tmp_path / "bad.jsonl").write_text('{"ref": "a"}\n')
    with pytest.raises(ValueError):
        files.strict_jsonl(spark, str(tmp_path / "bad.jsonl"), "id INT, ref STRING", "id IS NOT NULL")
    with pytest.raises(ValueError):
        files.strict_jsonl(spark, str(tmp_path / "ok.jsonl"), "id INT, ref STRING", "true", most_lines=2)


def test_features_drop_corrupt_and_archived(spark, tmp_path):
    rows = spark.createDataFrame([("002-b", "open", False), ("001-a", "open", None), (None, "open", False), ("003-c", "corrupt", False), ("004-d", "done", True)], "feature_id string, state string, archived boolean")
    assert [r["feature_id"] for r in files.features(rows).collect()] == ["001-a", "002-b"]
    assert [r["feature_id"] for r in files.features(rows, True).collect()] == ["001-a", "002-b", "004-d"]
    files.append_events(rows.limit(1), str(tmp_path / "log"))
    files.append_events(rows.limit(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_generic_routes_do_not_take_a_decorator_twice(spark):
    text = 'app.get("/a")\nrouter.POST( \'/b\')\n@app.route("/c")\n@router.put("/d")'
    got = extract.generic_routes(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string"), "text").collect()
    assert {(r["framework"], r["verb"], r["path"]) for r in got} == {("express", "GET", "/a"), ("express-router", "POST", "/b"), ("flask", "?", "/c"), ("fastapi", "PUT", "/d")} and len(got) == 4


def test_ddl_facts(spark):
    sql = """create table "App"."Users" (id uuid primary key, team_id int references teams(id), price numeric(10, 2) check (price > abs(0)), constraint k unique (id));
    ALTER TABLE ONLY users ADD CONSTRAINT fk FOREIGN KEY (boss) REFERENCES app.users(id); CREATE TABLE open_ended (a int"""
    got = {(r["kind"], r["table"], r["name"], r["parent"]) for r in extract.ddl_facts(spark.createDataFrame([("f", sql), ("g", None)], "file string, sql string"), "sql").collect()}
    assert got == {("column", "Users", c, None) for c in ("id", "team_id", "price")} | {("fk", "Users", "team_id", "teams.id"), ("fk", "users", "boss", "users.id")}


def test_gate_stream_keeps_the_last_state_and_all_history(spark, tmp_path):
    events = [("a", 1, "pass"), ("a", 3, "revoke"), ("b", 1, "pass"), ("a", 2, "force")]
    for i, e in enumerate(events):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(("gate", "at", "state"), e, strict=True))))
    stream = lambda: spark.readStream.schema("gate string, at long, state string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    q = gates.upserts(stream(), "gate", ["at"], str(tmp_path / "states"), str(tmp_path / "history"), str(tmp_path / "cp"), lambda s: seen.append({r["gate"]: r["state"] for r in s.collect()}))
    q.awaitTermination(120)
    assert seen[-1] == {"a": "revoke", "b": "pass"} and len(seen) == 4
    assert spark.read.parquet(str(tmp_path / "history")).count() == 4
    q = gates.latest_states(stream(), "gate", "at", "state").writeStream.outputMode("complete").format("memory").queryName("gate_states_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["gate"]: r["state"] for r in spark.table("gate_states_now").collect()} == {"a": "revoke", "b": "pass"}
    q = gates.receipt_counts(stream(), "gate", "state", "pass").writeStream.outputMode("complete").format("memory").queryName("receipts_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["gate"]: (r["matched"], r["stale"]) for r in spark.table("receipts_now").collect()} == {"a": (1, 2), "b": (1, 0)}


def test_null_keys_match(spark):
    made = lambda *rows: spark.createDataFrame(rows, "code string, subject string")
    before, after = made(("a", None), ("b", "x")), made(("a", None), ("b", "y"), (None, None))
    assert {tuple(r) for r in diff.set_delta(before, after).collect()} == {("b", "y"), (None, None)}
    open_, waived, stale = diff.waivers(after, before, ["code", "subject"])
    assert {tuple(r) for r in waived.collect()} == {("a", None)} and stale.count() == 1 and open_.count() == 2
    assert tuple(diff.agreement(before, after, ["code", "subject"]).first())[:3] == (1, 1, 2)


def test_gate_status_order(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [(None, None, 30, False, "not_run"), ("awaiting", None, 30, True, "awaiting"), ("revoke", None, 30, True, "revoked"), ("pass", None, 30, False, "stale"), ("pass", None, 0, False, "pass"),
            ("force", "2024-01-01 23:50:00", 30, False, "forced"), ("force", "2024-01-01 23:50:00", 30, True, "stale"), ("pass", "2024-01-01 23:29:59", 30, False, "stale"), ("pass", "2024-01-03 00:00:00", 30, False, "pass")]
    made = spark.createDataFrame(rows, "event string, at string, minutes int, changed boolean, want string")
    got = made.select(logs.gate_status(now, F.try_to_timestamp("at"), F.col("event"), F.col("minutes"), F.col("changed")).alias("s"), "want").collect()
    assert [r["s"] for r in got] == [r["want"] for r in got]


def test_alias_cycles_have_no_target(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "name string, next string")
    assert {r["name"]: r["target"] for r in graph.alias_targets(a).collect()} == {"a": "c", "b": "c", "x": None, "y": None, "z": None}

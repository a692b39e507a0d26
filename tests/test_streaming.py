"""Owner replacement: a replayed stream equals a fresh analysis, and bad runs leave nothing behind."""

import hashlib
import json

import pytest
from factloom.schema import ENVELOPE
from factloom.streaming import protocol, windows


def owner(i):
    return {"kind": "file", "id": i}


def run(run_id, base, target, owners, nodes, *, drop=(), status="success", edges=(), grown=None, begin=None, end=None):
    """Envelopes of a run: nodes and edges by owner, one batch each; ``grown`` owners come in a scope batch of an incremental run."""
    head = {"repo_id": "r", "context_id": "c", "run_id": run_id, "schema_version": 2}
    out = [head | {"type": "begin_replace", "base_generation": base, "target_generation": target, "owner_scope": [owner(o) for o in owners], "owner_scope_len": len(owners)} | ({"scope_mode": "incremental"} if grown is not None else {}) | (begin or {})]
    for seq, (o, ids) in enumerate(nodes, 1):
        mine = [{"owner": owner(o), "id": f"e{a}{b}", "source_id": a, "kind": "calls", "target": b, "resolution": "resolved", "occurrence": 0} for p, a, b in edges if p == o]
        out.append(head | {"type": "batch", "phase": "resolved", "seq": seq, "nodes": [{"owner": owner(o), "id": i, "kind": "symbol", "name": f"n{i}", "occurrence": 0} for i in ids], "edges": mine})
    more = {}
    if grown is not None:
        out.append(head | {"type": "batch", "phase": "scope", "seq": len(nodes) + 1, "owners": [owner(o) for o in grown]})
        every = sorted({f"file\0{o}" for o in [*owners, *grown]})
        more = {"owner_scope_len": len(every), "owner_scope_digest": hashlib.sha256("\n".join(every).encode()).hexdigest()}
    out.append(head | {"type": "end_replace", "batch_count": len(out) - 1, "status": status} | more | (end or {}))
    return [e for i, e in enumerate(out) if i not in drop]


def frame(spark, envelopes):
    text = spark.createDataFrame([(json.dumps(e),) for e in envelopes], "value string")
    from pyspark.sql import functions as F

    return text.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")


def verdicts(spark, envelopes, applied=()):
    log = spark.createDataFrame(list(applied), "repo_id string, context_id string, run_id string, generation long")
    return {r["run_id"]: r["verdict"] for r in protocol.judged(frame(spark, envelopes), log).collect()}


GOOD = run("a", 0, 1, ["x", "y"], [("x", ["1", "2"]), ("y", ["3"])])


def test_verdicts(spark):
    cases = {
        "good": run("good", 0, 1, ["x"], [("x", ["1"])]), "open": run("open", 0, 1, ["x"], [("x", ["1"])], drop=(2,)), "gap": run("gap", 0, 1, ["x"], [("x", ["1"]), ("x", ["2"])], drop=(1,)),
        "failed": run("failed", 0, 1, ["x"], [], status="error"), "waiting": run("waiting", 7, 8, ["x"], []), "outside": run("outside", 0, 1, ["x"], [("z", ["1"])]),
        "edge_outside": run("edge_outside", 0, 1, ["x"], [("x", []), ("z", [])], edges=[("z", "1", "2")]), "grown": run("grown", 0, 1, [], [("z", ["1"])], edges=[("z", "1", "2")], grown=["z"]),
        "not_grown": run("not_grown", 0, 1, [], [("z", ["1"])], grown=["y"]), "unstated": run("unstated", 0, 1, [], [("z", ["1"])], grown=["z"], end={"owner_scope_digest": None}),
        "miscounted": run("miscounted", 0, 1, ["x"], [], begin={"owner_scope_len": 2}),
    }
    got = verdicts(spark, [e for es in cases.values() for e in es])
    assert got == {
        "good": "apply", "open": "open", "gap": "bad_sequence", "failed": "failed", "waiting": "waiting", "outside": "out_of_scope", "edge_outside": "out_of_scope",
        "grown": "apply", "not_grown": "out_of_scope", "unstated": "bad_scope", "miscounted": "bad_scope",
    }
    assert verdicts(spark, GOOD, [("r", "c", "z", 5)]) == {"a": "stale"}
    digest = protocol.run_digests(frame(spark, GOOD)).first()["batch_digest"]
    signed = [e | ({"batch_digest": digest} if e["type"] == "end_replace" else {}) for e in GOOD]
    assert verdicts(spark, signed[::-1]) == {"a": "apply"}
    changed = json.loads(json.dumps(signed).replace('"n1"', '"renamed"'))  # ids as before, another payload
    assert verdicts(spark, changed) == {"a": "bad_digest"}
    assert verdicts(spark, GOOD, [("r", "c", "a", 1)]) == {"a": "duplicate"}
    assert verdicts(spark, GOOD + GOOD) == {"a": "apply"}
    other = dict(GOOD[1]) | {"nodes": []}
    assert verdicts(spark, [*GOOD, other]) == {"a": "bad_sequence"}


def ids(consumer, part="node"):
    return sorted((r["owner"].split("\0")[1], r["id"]) for r in consumer.state().filter(f"part = '{part}'").collect())


RUNS = [
    run("a", 0, 1, ["x", "y"], [("x", ["1", "2"]), ("y", ["3"])], edges=[("x", "1", "2"), ("y", "3", "1")]),
    run("b", 1, 2, ["x"], [("x", ["9"])], edges=[("x", "9", "3")]),
    run("a", 0, 1, ["x", "y"], [("x", ["1", "2"]), ("y", ["3"])], edges=[("x", "1", "2"), ("y", "3", "1")]),
    run("bad", 2, 3, ["y"], [], status="error"),
    run("d", 2, 3, [], [("z", ["7"])], edges=[("z", "7", "9")], grown=["y", "z"]),
]


def test_stream_equals_fresh(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, es in enumerate(RUNS):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, es)))
    consumer = protocol.Consumer(spark, str(tmp_path / "state"))
    consumer.start(protocol.read_envelopes(spark, str(source), files=1), str(tmp_path / "cp")).awaitTermination()
    assert ids(consumer) == [("x", "9"), ("z", "7")] and ids(consumer, "edge") == [("x", "e93"), ("z", "e79")]
    again = protocol.Consumer(spark, str(tmp_path / "fresh"))
    again.run_batch(protocol.read_envelopes(spark, str(source), stream=False), 0)
    assert protocol.same_state(consumer.state(), again.state())
    copy = protocol.fork(consumer, str(tmp_path / "fork"), ("r", "c", 3, "d"))
    assert protocol.same_state(copy.state(), consumer.state())
    with pytest.raises(ValueError):
        protocol.fork(consumer, str(tmp_path / "no"), ("r", "c", 2, "b"))
    assert consumer.compact() == 2 and protocol.same_state(copy.state(), consumer.state())


def test_runs_split_over_batches_and_repeats(spark, tmp_path):
    """Unsettled runs wait, settled ones leave nothing behind, and a repeated batch changes nothing."""
    consumer = protocol.Consumer(spark, str(tmp_path / "state"))
    pieces = [RUNS[1][:2], RUNS[0][:2], [*RUNS[1][2:], *RUNS[0][2:]]]
    kept = []
    for k, es in enumerate(pieces):
        for _ in range(2):
            consumer.run_batch(frame(spark, es), k)
        kept.append(consumer._read("unsettled", protocol.ENVELOPE).count())
    assert kept == [2, 4, 0]
    assert ids(consumer) == [("x", "9"), ("y", "3")] and ids(consumer, "edge") == [("x", "e93"), ("y", "e31")]
    assert [r["generation"] for r in consumer.commits().orderBy("generation").collect()] == [1, 2]


def test_windows_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumbled").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windows.tumbling(events).collect()}
    assert got and all(want[k] == n for k, n in got.items())

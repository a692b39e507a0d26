"""The consumer's state over many graphs."""

from pathlib import Path

from factloom.streaming import protocol

from .test_streaming import frame, run


def of(repo, *args, **more):
    return [e | {"repo_id": repo} for e in run(*args, **more)]


def owned(consumer):
    return sorted((r["repo_id"], r["id"]) for r in consumer.state().collect())


def test_folders_do_not_grow_with_graphs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(protocol.Consumer, "BUCKETS", 4, raising=False)
    consumer = protocol.Consumer(spark, str(tmp_path / "state"))
    consumer.run_batch(frame(spark, [e for k in range(40) for e in of(f"r{k}", "a", 0, 1, ["x"], [("x", [str(k)])])]), 0)
    assert len([p for p in Path(tmp_path / "state" / "state").rglob("*") if p.is_dir()]) <= 5
    consumer.run_batch(frame(spark, of("r7", "b", 1, 2, ["x"], [("x", ["new"])])), 1)
    want = sorted([(f"r{k}", str(k)) for k in range(40) if k != 7] + [("r7", "new")])
    assert owned(consumer) == want
    assert consumer.compact() == 1 and owned(consumer) == want  # the rows of other graphs in the first folder have moved
    assert consumer.compact() == 0 and owned(consumer) == want
    consumer.run_batch(frame(spark, of("r8", "b", 1, 2, ["x"], [("x", ["newer"])])), 2)
    assert ("r8", "newer") in owned(consumer) and len(owned(consumer)) == 40 and consumer.commits().count() == 42

"""The journal between producer and consumer: once each, refused conflicts, fences, bounds, compaction."""

import pytest
from factloom.streaming import journal


def test_journal(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([(m, "graph", p) for m, p in rows], journal.ENTRY)
    ids = lambda names: spark.createDataFrame([(n,) for n in names], "msg_id string")
    log = journal.Journal(spark, str(tmp_path), writer="w", epoch=1, most_bytes=40)
    waiting = lambda: [(r["segment"], r["msg_id"]) for r in log.pending().collect()]
    assert log.pending().count() == 0 and log.compact() == 0
    assert log.append(frame([("b", "2"), ("a", "1"), ("a", "1")]), 1) == 2
    assert log.append(frame([("b", "2"), ("a", "1")]), 1) == 2  # the segment again
    assert log.append(frame([("a", "1"), ("c", "3")]), 2) == 1
    assert waiting() == [(1, "a"), (1, "b"), (2, "c")]
    with pytest.raises(journal.Conflict):
        log.append(frame([("a", "other")]), 3)
    with pytest.raises(journal.Full):
        log.append(frame([("d", "x" * 60)]), 3)
    log.ack(ids(["a", "unknown"]))
    log.tombstone(ids(["b"]))
    assert waiting() == [(2, "c")] and log.compact() == 1 and waiting() == [(2, "c")]
    assert log.append(frame([("a", "1"), ("b", "2")]), 4) == 0  # settled messages stay known
    with pytest.raises(journal.Conflict):
        log.append(frame([("b", "9")]), 5)
    log.fence("w", 2)
    with pytest.raises(journal.Fenced):
        log.append(frame([("e", "5")]), 6)
    assert journal.Journal(spark, str(tmp_path), writer="w", epoch=2).append(frame([("e", "5")]), 6) == 1

"""Owner replacement: begin, batches and end of a run become one idempotent commit.

A run's envelopes may arrive late, repeated or out of order; nothing is applied
before a valid end is there.  Validation is a set of aggregates over a run's
envelopes, so a whole micro-batch of runs is judged at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..schema import ENVELOPE

RUN = ["repo_id", "context_id", "run_id"]
_SAME = ["repo_id", "context_id", "owner", "part", "id", "kind", "occurrence", "payload"]

def read_envelopes(spark: SparkSession, path: str, *, stream: bool = True, files: int = 100) -> DataFrame:
    """Envelopes as JSON lines; a trigger takes so many files at most, which bounds a micro-batch."""
    if stream:
        return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files).json(path)
    return spark.read.schema(ENVELOPE).json(path)


def message_id() -> Column:
    return F.concat_ws(":", "run_id", "type", F.coalesce("seq", F.lit(0)))


def owner_digest(owners: Column) -> Column:
    """sha256 over the sorted distinct owners."""
    named = F.array_sort(F.array_distinct(F.transform(owners, lambda o: F.concat_ws("\0", o["kind"], o["id"]))))
    return F.sha2(F.array_join(named, "\n").cast("binary"), 256)


def batch_hash() -> Column:
    """sha256 of a batch's whole content: phase, number, nodes, edges and owners."""
    return F.sha2(F.to_json(F.struct("phase", "seq", "nodes", "edges", "owners")).cast("binary"), 256)


def _contents(envelopes: DataFrame) -> DataFrame:
    """``repo_id, context_id, run_id, seq, _h``: each content of each batch once, as its hash."""
    return envelopes.filter("type = 'batch'").select(*RUN, "seq", batch_hash().alias("_h")).distinct()


def run_digests(envelopes: DataFrame) -> DataFrame:
    """``repo_id, context_id, run_id, batch_digest``: sha256 over the hashes of each run's batches in their order, one short hash a batch."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_h"))), lambda x: x["_h"])
    return _contents(envelopes).groupBy(*RUN).agg(F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("batch_digest"))


def _owner(c: str) -> Column:
    return F.concat_ws("\0", f"{c}.kind", f"{c}.id")


def scopes(envelopes: DataFrame) -> DataFrame:
    """``repo_id, context_id, run_id, owner``: the owners that a run replaces, as its begin and its scope batches name them."""
    begin = envelopes.filter("type = 'begin_replace'").select(*RUN, F.explode("owner_scope").alias("o"))
    grown = envelopes.filter("type = 'batch' and phase = 'scope'").select(*RUN, F.explode("owners").alias("o"))
    return begin.unionByName(grown).select(*RUN, _owner("o").alias("owner")).distinct()


def written(envelopes: DataFrame) -> DataFrame:
    """Nodes and edges of resolved and epoch batches as rows of the state: local and scope batches write nothing."""
    mine = envelopes.filter("type = 'batch' and phase in ('resolved', 'epoch')")
    nodes = mine.select(*RUN, F.explode("nodes").alias("x")).select(*RUN, _owner("x.owner").alias("owner"), F.lit("node").alias("part"), "x.id", "x.kind", "x.occurrence", F.to_json(F.struct("x.name")).alias("payload"))
    edges = mine.select(*RUN, F.explode("edges").alias("x")).select(*RUN, _owner("x.owner").alias("owner"), F.lit("edge").alias("part"), "x.id", "x.kind", "x.occurrence", F.to_json(F.struct("x.source_id", "x.target", "x.target_id", "x.resolution")).alias("payload"))
    return nodes.unionByName(edges)


def judged(envelopes: DataFrame, applied: DataFrame) -> DataFrame:
    """Each run's verdict: apply, duplicate, waiting, stale, open, failed, bad_sequence, bad_digest, bad_scope or out_of_scope.

    ``applied(repo_id, context_id, run_id, generation)`` is the log of commits.
    Repeated messages with equal content count once; a repeated number with
    other content is bad.  Every node and edge must belong to an owner in the
    run's final scope, that of its begin and its scope batches; an incremental
    run must state that scope's size and digest at its end.
    """
    is_ = lambda t: F.col("type") == t
    # repeats don't change the greatest values of begin and end; of batches, whose rows are wide, only hashes are compared
    marks = envelopes.filter("type is null or type <> 'batch'").select(
        *RUN,
        F.when(is_("begin_replace"), F.col("base_generation")).alias("base"),
        F.when(is_("begin_replace"), F.col("target_generation")).alias("target"),
        F.when(is_("begin_replace"), F.struct("owner_scope_len", "owner_scope_digest", "scope_mode", F.size("owner_scope").alias("named"), owner_digest(F.col("owner_scope")).alias("digest"))).alias("begin"),
        F.when(is_("end_replace"), F.struct("batch_count", "status", "batch_digest", "owner_scope_len", "owner_scope_digest")).alias("end"),
    )
    numbered = _contents(envelopes).groupBy(*RUN, "seq").agg(F.count("*").alias("n"))
    sent = numbered.groupBy(*RUN).agg(F.sum("n").alias("batches"), F.count("seq").alias("seqs"), F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"))
    counted = ("batches", "seqs", "last_seq", "first_seq")
    runs = marks.unionByName(sent, allowMissingColumns=True).groupBy(*RUN).agg(*(F.max(c).alias(c) for c in ("base", "target", "begin", "end", *counted)))
    runs = runs.select(*RUN, "base", "target", "begin", "end", *(F.coalesce(c, F.lit(0)).alias(c) for c in counted))
    scope = scopes(envelopes)
    size = scope.groupBy(*RUN).agg(F.count("*").alias("scope_size"))
    # a digest is over sorted owners or batches, so it needs them together: only for runs that state one at their end
    ends = envelopes.filter("type = 'end_replace'")
    stated = ends.filter("owner_scope_digest is not null").select(*RUN).distinct()
    digest = scope.join(stated, RUN, "left_semi").groupBy(*RUN).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("owner")), "\n").cast("binary"), 256).alias("scope_digest"))
    signed = ends.filter("batch_digest is not null").select(*RUN).distinct()
    content = run_digests(envelopes.join(signed, RUN, "left_semi")) if not signed.isEmpty() else run_digests(envelopes.filter("false"))
    outside = written(envelopes).select(*RUN, "owner").distinct().join(scope, [*RUN, "owner"], "left_anti").select(*RUN).distinct().withColumn("outside", F.lit(True))
    log = applied.groupBy("repo_id", "context_id").agg(F.max("generation").alias("at"))
    done = applied.select(*RUN, F.lit(True).alias("done")).distinct()
    out = runs.join(log, ["repo_id", "context_id"], "left")
    for more in (done, size, digest, outside, content.withColumnRenamed("batch_digest", "content")):
        out = out.join(more, RUN, "left")
    at, final = F.coalesce("at", F.lit(0)), F.coalesce("scope_size", F.lit(0))
    growing = F.coalesce(F.col("begin.scope_mode") == "incremental", F.lit(False))
    bad_scope = (
        (~growing & (F.col("begin.named") != F.col("begin.owner_scope_len")))
        | (~growing & F.col("begin.owner_scope_digest").isNotNull() & (F.col("begin.owner_scope_digest") != F.col("begin.digest")))
        | (growing & (F.col("end.owner_scope_len").isNull() | F.col("end.owner_scope_digest").isNull()))
        | (F.coalesce("end.owner_scope_len", F.lit(0)) != F.when(growing | (F.coalesce("end.owner_scope_len", F.lit(0)) != 0), final).otherwise(0))
        | (F.col("end.owner_scope_digest").isNotNull() & (F.col("end.owner_scope_digest") != F.coalesce("scope_digest", F.sha2(F.lit("").cast("binary"), 256))))
    )
    verdict = (
        F.when(F.col("done"), "duplicate")
        .when(F.col("begin").isNull() | F.col("end").isNull(), "open")
        .when(F.col("end.status") != "success", "failed")
        .when(F.col("base") > at, "waiting")
        .when(F.col("base") < at, "stale")
        .when((F.col("batches") != F.col("seqs")) | (F.col("seqs") != F.col("end.batch_count")) | ((F.col("seqs") > 0) & ((F.col("first_seq") != 1) | (F.col("last_seq") != F.col("seqs")))), "bad_sequence")
        .when(F.col("end.batch_digest").isNotNull() & (F.col("end.batch_digest") != F.coalesce("content", F.lit(""))), "bad_digest")
        .when(F.coalesce(bad_scope, F.lit(False)), "bad_scope")
        .when(F.col("outside"), "out_of_scope")
        .otherwise("apply")
    )
    return out.withColumn("verdict", verdict).select(*RUN, "base", "target", "verdict")


def replaced(state: DataFrame, envelopes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The state after all runs to apply: owners in a run's final scope lose their nodes and edges, and the run's take their place; an epoch also drops owners outside its scope."""
    go = verdicts.filter("verdict = 'apply'").select(*RUN, "target")
    epochs = envelopes.filter("phase = 'epoch' or scope_mode = 'epoch'").select(*RUN).distinct().join(go, RUN, "left_semi").select("repo_id", "context_id").distinct()
    fresh = written(envelopes).join(go, RUN).distinct().select("repo_id", "context_id", "owner", "part", "id", "kind", "occurrence", "payload", F.col("target").alias("generation"))
    mine = scopes(envelopes).join(go, RUN, "left_semi").select("repo_id", "context_id", "owner").distinct()
    kept = state.join(mine, ["repo_id", "context_id", "owner"], "left_anti").join(epochs, ["repo_id", "context_id"], "left_anti")
    return kept.unionByName(fresh)


def canonical(state: DataFrame) -> DataFrame:
    return state.select(*_SAME).orderBy(*_SAME)


def same_state(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states are the same multiset, generations apart."""
    x, y = a.select(*_SAME), b.select(*_SAME)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


class Consumer:
    """Applies envelopes, kept under ``path``: the envelopes of runs that aren't settled, a log of commits, and each graph's state by generation.

    ``run_batch`` is for ``foreachBatch``.  The new states of the graphs that a turn changes are written before its commits, in
    a folder of the turn, so a batch that is repeated after a failure
    writes the same again; one that was finished changes nothing.  Only graphs that
    a batch changes are rewritten, and only unsettled runs are kept.  A turn's rows lie in ``BUCKETS``
    folders by their graph, so their number doesn't grow with that of the graphs.
    """

    STATE = "repo_id string, context_id string, owner string, part string, id string, kind string, occurrence int, payload string, generation long"
    LOG = "repo_id string, context_id string, run_id string, generation long"
    _KEPT = STATE + ", graph string, at long, step string, bucket int"
    _STEPS = LOG + ", step string, moved int"
    BUCKETS = 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _steps(self) -> DataFrame:
        return self._read("commits", self._STEPS)

    def commits(self) -> DataFrame:
        return self._steps().drop("step", "moved").distinct()

    def current(self) -> DataFrame:
        """``graph, at, step``: the committed generation of each graph, and the turn whose folder holds it."""
        last = self._steps().groupBy(_graph().alias("graph")).agg(F.max(F.struct("generation", "moved", "step")).alias("m"))
        return last.select("graph", F.col("m.generation").alias("at"), F.col("m.step").alias("step"))

    def _held(self) -> DataFrame:
        return self._read("state", self._KEPT).join(self.current(), ["graph", "at", "step"], "left_semi")

    def state(self) -> DataFrame:
        return self._held().drop("graph", "at", "step", "bucket")

    def _keep(self, rows: DataFrame, step: str) -> None:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("graph"), F.lit(self.BUCKETS)).cast("int")).repartition("bucket")
        dealt.drop("step").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/step={step}")

    def _commit(self, runs: DataFrame, step: str, moved: int = 0) -> None:
        runs.select(*RUN, "generation", F.lit(step).alias("step"), F.lit(moved).alias("moved")).write.mode("append").parquet(f"{self.path}/commits")

    def run_batch(self, batch: DataFrame, version: int) -> None:
        files = _Files(self.spark, self.path)
        if f"version={version}" in files.names("unsettled"):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/incoming/version={version}")
        earlier = [n for n in files.names("unsettled") if n.startswith("version=")]
        waiting = self._read("incoming/" + f"version={version}", ENVELOPE)
        for n in earlier:
            waiting = waiting.unionByName(self._read(f"unsettled/{n}", ENVELOPE))
        turn = self._steps().filter(F.startswith("step", F.lit(f"v{version}t"))).select("step").distinct().count()  # those of an earlier try are committed
        while True:  # a run may wait for one that is applied in this turn: each turn applies one generation at least
            verdicts = cut(judged(waiting, self.commits()))
            first = verdicts.filter("verdict = 'apply'").groupBy("repo_id", "context_id").agg(F.min(F.struct("target", "run_id")).alias("m"))
            first = cut(first.select("repo_id", "context_id", F.col("m.run_id").alias("run_id"), F.col("m.target").alias("target"), F.lit("apply").alias("verdict")))
            if first.isEmpty():
                break
            touched = self.state().join(first.select("repo_id", "context_id"), ["repo_id", "context_id"], "left_semi")
            after = replaced(touched, waiting, first).join(first.select("repo_id", "context_id", F.col("target").alias("at")), ["repo_id", "context_id"])
            self._keep(after.withColumn("graph", _graph()), f"v{version}t{turn}")
            self._commit(first.withColumnRenamed("target", "generation"), f"v{version}t{turn}")
            turn += 1
            # other runs of the graphs that changed may go now; of other graphs every verdict stands
            later = verdicts.filter("verdict in ('apply', 'waiting')").join(first, RUN, "left_anti").join(first, ["repo_id", "context_id"], "left_semi")
            if later.isEmpty():
                break
        open_runs = verdicts.filter("verdict in ('open', 'waiting')").select(*RUN)
        waiting.join(open_runs, RUN, "left_semi").write.mode("overwrite").parquet(f"{self.path}/unsettled/version={version}")
        for n in earlier:
            files.delete(f"unsettled/{n}")
        files.delete("incoming")

    def compact(self) -> int:
        """Remove the folders of turns that hold rows of generations that aren't current; their number.  Other rows of theirs move to a new folder first."""
        files, current = _Files(self.spark, self.path), cut(self.current())
        used = {r["step"] for r in current.select("step").distinct().toLocalIterator()}
        rows = self._read("state", self._KEPT)
        stale = rows.select("graph", "at", "step").distinct().join(current, ["graph", "at", "step"], "left_anti").select("step").distinct()
        mixed = {r["step"] for r in stale.toLocalIterator()}
        moving = current.filter(F.col("step").isin(sorted(mixed & used)))
        if mixed & used:
            step, moved = f"m{uuid.uuid4().hex}", self._steps().agg(F.max("moved")).first()[0] + 1
            self._keep(rows.join(moving, ["graph", "at", "step"], "left_semi").drop("bucket"), step)
            runs = self._steps().withColumn("graph", _graph()).join(moving.select("graph", F.col("at").alias("generation"), "step"), ["graph", "generation", "step"], "left_semi")
            self._commit(cut(runs), step, moved)
        gone = [n for n in files.names("state") if n.startswith("step=") and (n.removeprefix("step=") in mixed or n.removeprefix("step=") not in used)]
        gone = [n for n in gone if not (mixed & used) or n != f"step={step}"]
        for name in gone:
            files.delete(f"state/{name}")
        return len(gone)

    def start(self, envelopes: DataFrame, checkpoint: str):
        return envelopes.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _graph() -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", "repo_id", "context_id").cast("binary"), 256), 1, 16)


class _Files:
    """Names in a folder of any store that Spark writes to, and their removal."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def fork(consumer: Consumer, path: str, expected: tuple[str, str, int, str]) -> Consumer:
    """A consumer that starts from another's state, if that is at the expected (repository, context, generation, run)."""
    repo, context, generation, run = expected
    at = consumer.commits().filter((F.col("repo_id") == repo) & (F.col("context_id") == context)).orderBy(F.desc("generation")).first()
    if at is None or (at["generation"], at["run_id"]) != (generation, run):
        raise ValueError("the seed isn't at the expected generation and run")
    out = Consumer(consumer.spark, path)
    out._keep(consumer._held().drop("step", "bucket"), "seed")
    consumer._steps().select(*RUN, "generation").distinct().select("*", F.lit("seed").alias("step"), F.lit(0).alias("moved")).write.mode("overwrite").parquet(f"{path}/commits")
    return out


def invalidated(changed: DataFrame, imports: DataFrame, *, depth: int | None = None) -> DataFrame:
    """Dirty files: those changed and all that read them, directly or not: changed(file), imports(src, dst)."""
    from ..operators.traversal import walk

    edges = imports.withColumn("rel", F.lit("reads"))
    return walk(edges, changed.select(F.col("file").alias("name")), direction="reverse", depth=depth).select(F.col("name").alias("file"), "depth")

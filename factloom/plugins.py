"""Extension points: extractors, annotators, explainers, binders, signals and renderers as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import FACTS, FINDINGS


@dataclass
class Registry:
    """Named plug-ins in the order in which they were added; a name is used once."""

    extractors: dict[str, Callable] = field(default_factory=dict)
    annotators: dict[str, Callable] = field(default_factory=dict)
    explainers: dict[str, Callable] = field(default_factory=dict)
    binders: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    signals: dict[str, tuple[str, Callable]] = field(default_factory=dict)
    renderers: dict[str, Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, f: Callable, stage: str = "post") -> None:
        held = getattr(self, kind)
        if name in held:
            raise ValueError(f"{kind} {name} is already there")
        held[name] = (stage, f) if kind in ("binders", "signals") else f

    def extract(self, files: DataFrame) -> DataFrame:
        """Facts of all extractors: ``f(file, content)`` gives dicts for one file; files are dealt over the cluster."""
        extractors = dict(self.extractors)

        def run(batches):
            import pandas as pd

            names = [c.split(" ")[0] for c in _columns(FACTS)]
            for batch in batches:
                rows = [dict.fromkeys(names) | {"props": {}, "relations": []} | fact for file, content in zip(batch["file"], batch["content"], strict=True) for f in extractors.values() for fact in f(file, content)]
                if rows:
                    frame = pd.DataFrame(rows, columns=names)
                    for c in ("line", "end_line"):
                        frame[c] = frame[c].astype("Int32")
                    yield frame

        return files.select("file", "content").mapInPandas(run, FACTS)

    def bind(self, stage: str, facts: DataFrame) -> DataFrame:
        for at, f in self.binders.values():
            if at == stage:
                facts = f(facts)
        return facts

    def links(self, facts: DataFrame) -> DataFrame | None:
        """Evidence of all signals, the directional ones first."""
        out = None
        for phase in ("directional", "symmetric"):
            for at, f in self.signals.values():
                if at == phase:
                    got = f(facts)
                    out = got if out is None else out.unionByName(got)
        return out

    def annotate(self, facts: DataFrame) -> DataFrame:
        for f in self.annotators.values():
            facts = f(facts)
        return facts

    def explain(self, facts: DataFrame, edges: DataFrame) -> DataFrame:
        """Findings of all explainers by the fixed schema."""
        out = facts.sparkSession.createDataFrame([], FINDINGS)
        for name, f in self.explainers.items():
            out = out.unionByName(f(facts, edges).withColumn("source", F.lit(name)), allowMissingColumns=True)
        return out


def _columns(schema: str) -> Iterable[str]:
    depth, at = 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            yield schema[at:i].strip()
            at = i + 1
    yield schema[at:].strip()


def finding(title, *, description: str = "", confidence=1.0, file=None, informational: bool = False) -> list:
    """The columns of a finding from columns or values."""
    col = lambda x: x if hasattr(x, "alias") else F.lit(x)
    none = F.lit(None).cast("string")
    evidence = F.array(F.struct((col(file) if file is not None else none).alias("file"), F.lit(None).cast("int").alias("line"), none.alias("symbol"), none.alias("fact"), none.alias("detail")))
    return [
        col(title).alias("title"), F.lit(description).alias("description"), col(confidence).cast("double").alias("confidence"), F.lit(informational).alias("informational"),
        evidence.alias("evidence"), F.array().cast("array<string>").alias("actions"), F.create_map().cast("map<string,string>").alias("metrics"),
    ]

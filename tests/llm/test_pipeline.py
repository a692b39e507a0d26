"""The corpus pipeline stage by stage."""

import re

import corpus_pipeline
import pytest
from factloom.llm import decontaminate, language, secrets
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) >= 0.8 * len(ids)
        ids = now
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in coded.collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == len(ids)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)


def grams(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_each_stage_against_brute_force(spark):
    """Every decision of every stage on its own input, which also has nulls, blanks, repeats and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en"), (9002, "", None), (9003, " \n", "de"), (9004, "12 34", "fr"), (None, "no key here", "en")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(more.select(*docs.columns)).unionByName(docs.limit(5))
    for name in ("node", "n", "print", "key", "label", "a", "b", "_key", "_text", "found", "spans", "bucket"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs = docs.cache()
    rows = [r.asDict() for r in docs.collect()]
    texts = {r["doc_id"]: r["text"] for r in rows}
    stages = dict(corpus_pipeline.STAGES)

    model = language.fit(language.training_rows(docs))
    good = language.Predictor(model).predict([r["text"] or "" for r in rows])[2]
    kept = stages["language_id"](spark, docs, SF)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r, ok in zip(rows, good, strict=True) if ok)
    assert not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in kept.collect()}

    sets = {k: grams(t or "") for k, t in texts.items()}
    ids = sorted(k for k in sets if k is not None)
    label = {k: k for k in ids}
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if sets[x] == sets[y] or 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = {k: new if v == old else v for k, v in label.items()}
    kept = stages["near_dedup"](spark, docs, SF)
    got = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    want = {k for k in ids if label[k] == k}
    assert len(got) == len(set(got)) and set(got) >= want and len(set(got) - want) <= 2  # a pair at 0.8 is found with a chance of 0.95
    assert kept.columns == docs.columns

    searcher = decontaminate.Searcher([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    kept = stages["decontamination"](spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if not searcher.find(r["text"] or ""))

    clean = stages["secret_scan"](spark, docs, SF).collect()
    assert len(clean) == len(rows)
    scanner = secrets.Scanner()
    for r in clean:
        found = scanner.spans([texts[r["doc_id"]] or ""])[0]
        want = secrets.cut(texts[r["doc_id"]], found, "<secret>") if found else texts[r["doc_id"]]
        assert r["text"] == want and not scanner.spans([r["text"] or ""])[0]

    from factloom.llm.queries import tokenizer_file
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    coded = stages["encoding"](spark, docs, SF).collect()
    assert len(coded) == len(rows)
    for r in coded:
        ids_of = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids_of and r["n_tokens"] == len(ids_of) and r["decoded"] == library.decode(ids_of, skip_special_tokens=False)

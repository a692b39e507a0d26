"""Declarations, change queues, publishing and binders."""

import json

import pytest
from factloom.functions import names as fn
from factloom.operators import explainers, filters, linking
from factloom.schema import ENVELOPE
from factloom.sources import config
from factloom.streaming import changes
from pyspark.sql import functions as F


def test_rules_from_a_declaration(tmp_path):
    spec = {
        "components": {"core": {"paths": ["core/**"], "where": {"exported": True}}, "web": {"names": ["web.*"]}},
        "rules": [{"id": "r", "form": "forbid", "subject": "core", "to": "web"}, {"id": "p", "form": "protocol", "subject": "web", "steps": ["core", {"names": ["x"]}]}],
    }
    (tmp_path / "d.json").write_text(json.dumps(spec))
    got = config.rules(config.load(str(tmp_path / "d.json")))
    assert [r.form for r in got] == ["forbid", "protocol"] and got[0].subject.where == {"exported": "true"} and len(got[1].steps) == 2
    for bad in ({"id": "x", "form": "nope"}, {"id": "x", "form": "forbid", "subject": "gone"}, {"id": "x", "form": "cap", "subject": "core", "odd": 1}):
        with pytest.raises(ValueError):
            config.rules(spec | {"rules": [bad]})
    assert config.vocabulary({"samples": 3}).samples == 3
    assert config.policy({"exempt": ["a"]}).exempt == ("a",)


def test_changes(spark):
    rows = [(1, 1, "a", "edit", "2024-01-01 00:00:00"), (1, 2, "a", "delete", "2024-01-01 00:00:01"), (1, 3, "b", "edit", "2024-01-01 00:01:00"), (2, 5, "c", "edit", "2024-01-01 00:00:00"), (2, 7, "c", "edit", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "epoch long, seq long, path string, op string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r["epoch"], r["path"]): (r["op"], r["reconcile"]) for r in changes.coalesced(df).collect()} == {(1, "a"): ("delete", False), (1, "b"): ("edit", False), (2, "c"): ("edit", True)}
    assert sorted((r["epoch"], r["n"]) for r in changes.bursts(df).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_publishing_is_idempotent(spark, tmp_path):
    rows = [json.dumps({"type": "batch", "repo_id": "r", "context_id": "c", "run_id": "a", "seq": i}) for i in (1, 2, 2)]
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", ENVELOPE).alias("e")).select("e.*")
    publisher = changes.Publisher(spark, str(tmp_path))
    assert (publisher.publish(df), publisher.publish(df)) == (2, 0)
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_binders(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    seams = linking.client_seams(f([("A.get", "http.fetch", "/users")], "src string, dst string, argument string"), f([("http.fetch", "GET")], "function string, method string"))
    assert tuple(seams.first()) == ("A.get", "GET", "/users", "client")
    named = linking.grpc_names(f([("a", "Users"), ("b", "Twice")], "name string, service string"), f([("acme.Users",), ("x.Twice",), ("y.Twice",)], "name string"))
    assert {r["name"]: r["service"] for r in named.collect()} == {"a": "acme.Users", "b": "Twice"}
    specs = linking.vendored_specs(f([("server", "vendor/api.yaml"), ("server", "api.yaml")], "role string, file string"))
    assert sorted(r["role"] for r in specs.collect()) == ["client", "server"]
    impl = linking.grpc_implementations(f([("acme.Users",)], "name string"), f([("x.UsersServicer",), ("x.Other",)], "name string"))
    assert [r["class"] for r in impl.collect()] == ["x.UsersServicer"]
    mixed = linking.mixin_owners(f([("C.run", "C", "help")], "src string, owner string, bare string"), f([("C", "M")], "class string, mixin string"), f([("M", "help", "M.help"), ("N", "help", "N.help")], "owner string, bare string, name string"))
    assert [r["target"] for r in mixed.collect()] == ["M.help"]
    bound = linking.literal_bindings(f([("a", "x"), ("b", "y")], "src string, literal string"), f([("x", "T")], "literal string, target string"))
    assert {r["src"]: r["target"] for r in bound.collect()} == {"a": "T", "b": None}
    link = f([("a", "b", "http", 1), ("a", "b", "topic", 2), ("a", "a", "http", 3)], "from_repo string, to_repo string, edge_type string, route_id long")
    services, pairs = linking.service_facts(link)
    assert services.count() == 2 and tuple(pairs.first()) == ("a", "b", "depends_on", ["1", "2"], 0)
    assert linking.evidence(link, link).agg(F.sum("n")).first()[0] == 4


def test_scalar_functions(spark):
    one = spark.range(1).select(
        fn.short_name(F.lit("a/b.Thing.py")).alias("short"), fn.owner_name(F.lit("A::B#run")).alias("owner"), fn.resolve_relative(F.lit("a/b"), F.lit("../c/./d")).alias("rel"),
        fn.resolve_relative(F.lit("a/b"), F.lit("lib")).alias("plain"), fn.route_path(F.lit("/v1/users/:id/42.json/")).alias("route"), fn.http_method(F.lit("use")).alias("method"),
        fn.controller_key(F.lit("Admin::UsersController")).alias("key"), fn.title_key(F.lit("3 of 4.5 x")).alias("title"), fn.camel_parts(F.lit("fooBar_baz")).alias("camel"),
        fn.remote_label(F.lit("git@host:org/repo.git")).alias("label"), fn.half_up(F.lit(-2.5), 0).alias("half"), fn.is_generated_path(F.lit("a/x.pb.go")).alias("generated"),
        fn.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("j"), fn.code_tokens(F.lit("a = a+b1")).alias("tokens"), fn.dirname(F.lit("x")).alias("dir"),
    ).first()
    assert one.asDict() == {
        "short": "Thing", "owner": "A::B", "rel": "a/c/d", "plain": "lib", "route": "v1/users/{}/42", "method": "*", "key": "admin/users", "title": "# of # x", "camel": ["foo", "bar", "baz"],
        "label": "repo", "half": -3.0, "generated": True, "j": pytest.approx(1 / 3), "tokens": ["a", "=", "+", "b1"], "dir": ".",
    }


def test_source_window_and_layers(spark):
    files = spark.createDataFrame([("f", "1\n2\n3\n4\n5\n6\n7")], "file string, content string")
    at = spark.createDataFrame([("n", "f", 4), ("m", "f", 1)], "name string, file string, line int")
    assert {r["name"]: r["source"] for r in filters.source_window(files, at, around=1).collect()} == {"n": "3\n4\n5", "m": "1\n2"}
    edges = spark.createDataFrame([("app/domain", "app/web"), ("app/web", "app/domain"), ("app/web", "lib")], "src string, dst string")
    found = explainers.layer_violations(edges, {"domain": 0, "web": 2})
    assert {r["src"]: r["direction"] for r in found.collect()} == {"app/domain": "against", "app/web": "inward"}
    assert explainers.layer_conformance(found).first()["conformance"] == 0.5

"""Nothing of a long secret is left after redaction."""

import random
import string

from factloom.llm import secrets

BASE64 = string.ascii_letters + string.digits + "+/"


def test_whole_keys_and_tokens_go(spark):
    rnd = random.Random(3)
    run = lambda n, among=BASE64: "".join(rnd.choice(among) for _ in range(n))
    url = string.ascii_letters + string.digits + "_-"
    body = [run(64) for _ in range(20)] + [run(30) + "=="]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(body) + "\n-----END RSA PRIVATE KEY-----"
    locked = pem.replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n", 1)
    texts = {
        1: f"before {pem} after",
        2: f"before {locked} after",
        3: "before -----BEGIN PRIVATE KEY-----\n" + "\n".join(body[:-1] + ["Zx9", "", "and then after"]),
        4: "before " + pem.replace("\n", "\\n") + " after",
        5: f"before eyJ{run(9000, url)}.eyJ{run(12000, url)}.{run(5000, url)} after",
        6: f"before Bearer {run(20000)} after",
        7: f"before {pem} between {pem} after",
        8: "before -----BEGIN PRIVATE KEY----- after",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert {got[k] for k in (1, 2, 4, 5, 6, 8)} == {"before <secret> after"}
    assert got[3].split() == ["before", "<secret>", "and", "then", "after"]
    assert got[7] == "before <secret> between <secret> after"


def test_no_length_hides_a_secret(spark):
    """Every rule finds a secret of 100,000 characters, and nothing of it is left; repeated rows stay repeated."""
    rnd = random.Random(5)
    run = lambda n, among=string.ascii_letters + string.digits: "".join(rnd.choice(among) for _ in range(n))
    n = 100_000
    planted = {
        "assign": "password=" + run(n), "access": "AKIA" + run(n, "ABC123"), "hex": run(n, "0123456789abcdef"), "github": "ghp_" + run(n), "slack": "xoxb-" + run(n),
        "stripe": "sk_live_" + run(n), "jwt": f"eyJ{run(n)}.eyJ{run(n)}.{run(n)}", "bearer": "Bearer " + run(n), "url_login": f"://{run(n)}:{run(n)}@",
        "private_key": "-----BEGIN " + "VERY LONG " * 20 + "PRIVATE KEY-----\n" + run(n) + "\n-----END " + "VERY LONG " * 20 + "PRIVATE KEY-----",
    }
    rows = [(i, f"before {s} after", 1) for i, s in enumerate(planted.values())]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, spans int")
    found = {r["doc_id"]: {x["kind"] for x in r["spans"]} for r in secrets.scan_secrets(docs).collect()}
    for i, kind in enumerate(planted):
        assert kind in found[i]
    clean = secrets.redact_secrets(docs)
    got = clean.collect()
    assert len(got) == len(rows) + 2 and clean.columns == docs.columns
    for r in got:
        assert r["text"].startswith("before") and r["text"].endswith(" after") and len(r["text"]) < 40
    assert secrets.scan_secrets(clean).filter("size(spans) > 0").count() == 0

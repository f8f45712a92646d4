"""Signatures, decisions on deliveries as a batch and a stream, redaction."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from ripplet.operators import webhooks
from ripplet.streaming import state
from tests.test_jobs import at
from tests.test_streams import collected, stream

#: Keys, data and digests of RFC 4231.
VECTORS = [
    ("0b" * 20, b"Hi There".hex(), "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe".hex(), b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    ("aa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First".hex(), "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


def signed(body, key="s3"):
    return "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_hmac_has_the_digests_of_the_rfc(spark):
    rows = spark.createDataFrame(VECTORS, "k string, m string, d string").select(webhooks.hmac_sha256(F.unhex("k"), F.unhex("m")).alias("got"), "d").collect()
    assert all(r.got == r.d for r in rows) and len(rows) == 4


def test_signatures(spark):
    body = '{"a": "é"}'
    cases = [(body, signed(body), "s3", True), (body, signed(body) + "0", "s3", False), (body, signed(body)[:-1] + "x", "s3", False), (body, None, "s3", False), (body, "", "s3", False), (body, signed(body, ""), "", False), (body, signed(body), None, False), (None, signed(""), "s3", True), (body + " ", signed(body), "s3", False)]
    rows = spark.createDataFrame(cases, "b string, s string, k string, ok boolean").select(webhooks.is_signed(F.col("b"), F.col("s"), F.col("k")).alias("got"), "ok").collect()
    assert [r.got for r in rows] == [r.ok for r in rows]


def test_signing_goes_over_no_bytes_one_by_one(spark):
    """A fixed key's blocks are literals, and digests are compared: no function of a higher order runs in a row."""
    rows = spark.createDataFrame([(signed("x", k), k) for k in ("s3", "k" * 64, "é" * 70)], "s string, k string")
    got = rows.select([F.when(F.col("k") == k, webhooks.is_signed(F.lit("x"), F.col("s"), k)).alias(f"c{i}") for i, k in enumerate(("s3", "k" * 64, "é" * 70))])
    assert [[r.c0, r.c1, r.c2] for r in got.collect()] == [[True, None, None], [None, True, None], [None, None, True]]
    assert not rows.select(webhooks.is_signed(F.lit("x"), F.col("s"), "").alias("no")).where("no").count()
    for secret in ("s3", F.col("k")):
        plan = rows.select(webhooks.is_signed(F.lit("x"), F.col("s"), secret))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan


def pull(action="opened", **more):
    return json.dumps({"action": action, "pull_request": {"number": 7, "head": {"sha": "abc"}} | more.pop("pr", {}), "repository": {"name": "R", "owner": {"login": "O"}}} | more)


CASES = [
    ("pull_request", pull(), "accepted"),
    ("pull_request", pull("closed"), "ignored"),
    ("pull_request", pull(pr={"draft": True}), "ignored"),
    ("pull_request", pull(repository={"name": "R"}), "incomplete"),
    ("pull_request", json.dumps({"action": "synchronize", "number": 5, "repository": {"name": "R", "owner": {"login": "O"}}}), "accepted"),
    ("push", pull(), "ignored"),
    (None, pull(), "ignored"),
    ("ping", "not json", "pong"),
    ("pull_request", "not json", "invalid"),
    ("installation", '{"action": "deleted", "installation": {"id": 3}}', "installation"),
]


def test_decisions(spark):
    rows = [(f"d{i}", e, signed(b), b, want) for i, (e, b, want) in enumerate(CASES)] + [("forged", "pull_request", signed(pull(), "other"), pull(), "unauthorized")]
    got = webhooks.decided(spark.createDataFrame(rows, "delivery string, event string, signature string, body string, want string"), F.lit("s3")).collect()
    assert [(r.delivery, r.decision) for r in got] == [(r[0], r[4]) for r in rows]
    assert [(r.owner, r.repo, r.number, r.sha) for r in got if r.decision == "accepted"] == [("O", "R", 7, "abc"), ("O", "R", 5, None)]


def test_a_stream_drops_forged_rows_before_a_delivery_is_claimed(spark, tmp_path):
    rows = [("d1", at(0), 0, "pull_request", signed(pull(), "other"), pull(), 0), ("d1", at(1), 1, "pull_request", signed(pull()), pull(), 0), ("d1", at(2), 2, "pull_request", signed(pull()), pull(), 1), ("d2", at(3), 3, "push", signed(pull()), pull(), 1), ("d3", at(4), 4, "pull_request", signed(pull()), pull(), 1)]
    source = stream(spark, tmp_path, rows, "delivery string, ts timestamp, event_id long, event string, signature string, body string, part int", "part")
    first = state.stream_first_deliveries(webhooks.decided(source, F.lit("s3")).where("decision = 'accepted'"))
    got = collected(spark, tmp_path, webhooks.enqueues(first), "hooks")
    assert sorted((r.key, r.event_id, r.job) for r in got) == [("pr:o/r#7@abc", 1, "job:d1"), ("pr:o/r#7@abc", 4, "job:d3")]


def test_redaction(spark):
    texts = [
        ("https://x-access-token:abc@github.com/o/r", "https://[redacted]@github.com/o/r"),
        ("git clone https://me:pw@host/x", "git clone https://[redacted]@host/x"),
        ("id ghs_abc123 end", "id [redacted] end"),
        ("xghs_abc stays", "xghs_abc stays"),
        ("Bearer  a.b-c!", "Bearer [redacted]!"),
        ("the password is", "[redacted]"),
        ("api-key", "api-key"),
        ("plain", "plain"),
        (None, None),
    ]
    rows = spark.createDataFrame(texts, "t string, want string").select("t", "want", webhooks.redacted(F.col("t")).alias("got"), webhooks.redacted_json(F.to_json(F.struct(F.col("t").alias("v")))).alias("deep")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [json.loads(r.deep).get("v") for r in rows] == [r.want for r in rows]
    documents = [
        ('{"a": {"Api_Key": {"x": 1}, "b": ["Bearer abc", 1, null, {"TOKEN": 2}]}, "n": 1.5}', '{"a":{"Api_Key":"[redacted]","b":["Bearer [redacted]",1,null,{"TOKEN":"[redacted]"}]},"n":1.5}'),
        ("not json, but a secret", "[redacted]"),
        ('"short"', '"short"'),
        ("[" * 100_000, "[redacted]"),
        (None, None),
        ("", ""),
    ]
    rows = spark.createDataFrame(documents, "d string, want string").select(webhooks.redacted_json("d").alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]

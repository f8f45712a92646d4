"""Deliveries of webhooks: signatures, what becomes of a delivery, and secrets in what is logged."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The actions of a pull request that start an analysis.
HANDLED = ("opened", "synchronize", "reopened", "ready_for_review")
#: Names of secrets, and forms of them that stand in texts, with what is put in their place.
SENSITIVE = r"(token|secret|password|authorization|private[_-]?key|api[_-]?key)"
FORMS = (
    (r"(?i)x-access-token:[^@\s]+@", "x-access-token:[redacted]@"),
    (r"//[^:@\s]+:[^@\s]+@", "//[redacted]@"),
    (r"\b(ghs_|gho_|ghu_|ghr_|github_pat_)[A-Za-z0-9_]+\b", "[redacted]"),
    (r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [redacted]"),
)
GONE = "[redacted]"


def _xor(block: Column, byte: int) -> Column:
    """Every byte of a binary of 64 bytes with one byte: eight numbers of eight bytes."""
    digits, mask = F.hex(block), F.lit(int(f"{byte:02x}" * 8, 16)).cast("long")
    part = lambda i: F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(mask)
    return F.unhex(F.concat(*[F.lpad(F.hex(part(i)), 16, "0") for i in range(8)]))


def _pads(key: Column | str) -> tuple[Column, Column]:
    """A key's inner and outer block. Those of a fixed key are worked out here, not in each row."""
    if isinstance(key, str):
        fixed = key.encode()
        fixed = (hashlib.sha256(fixed).digest() if len(fixed) > 64 else fixed).ljust(64, b"\0")
        return F.lit(bytes(b ^ 0x36 for b in fixed)), F.lit(bytes(b ^ 0x5C for b in fixed))
    key = key.cast("binary")
    block = F.when(F.length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    block = F.concat(block, F.unhex(F.repeat(F.lit("00"), F.lit(64) - F.length(block))))
    return _xor(block, 0x36), _xor(block, 0x5C)


def hmac_sha256(key: Column | str, message: Column) -> Column:
    """HMAC-SHA256 of a text or binary with a key (a column, or one text for all rows), as lower-case hexadecimal digits; null if
    either is null. A key of more than 64 bytes is hashed first, a shorter one is filled up with zeros."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal, found in a time that tells nothing of where they differ: their digests are compared."""
    return F.coalesce(F.sha2(a.cast("binary"), 256) == F.sha2(b.cast("binary"), 256), F.lit(False))


def is_signed(body: Column, signature: Column, secret: Column | str) -> Column:
    """Whether a signature ("sha256=" and digits) is that of a body. Without a signature or secret it isn't; a null body is empty."""
    expected = F.concat(F.lit("sha256="), hmac_sha256(secret, F.coalesce(body, F.lit(""))))
    some = F.lit(secret != "") if isinstance(secret, str) else secret != ""
    return F.coalesce(some & same_text(expected, signature), F.lit(False))


def decided(deliveries: DataFrame, secret: Column | str) -> DataFrame:
    """deliveries (delivery, event, signature, body, ...) with what becomes of them (decision) and, of pull requests, owner, repo,
    number, action, installation, sha. Only columns of a row are used, so this is the first step of a stream as well.

    In this order: unauthorized without the right signature, pong to a ping, invalid if the body is no JSON, installation events,
    ignored if it is no pull request, not a HANDLED action or a draft, incomplete without owner, repo or number, else accepted.
    """
    at = lambda path: F.get_json_object("body", path)
    named = deliveries.withColumns(
        {
            "action": F.coalesce(at("$.action"), F.lit("")),
            "owner": at("$.repository.owner.login"),
            "repo": at("$.repository.name"),
            "number": F.coalesce(at("$.pull_request.number"), at("$.number")).try_cast("long"),
            "installation": at("$.installation.id").try_cast("long"),
            "sha": at("$.pull_request.head.sha"),
        }
    )
    event, some = F.coalesce("event", F.lit("unknown")), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    decision = (
        F.when(~is_signed(F.col("body"), F.col("signature"), secret), "unauthorized")
        .when(event == "ping", "pong")
        .when(F.try_parse_json("body").isNull(), "invalid")
        .when(event.isin("installation", "installation_repositories"), "installation")
        .when((event != "pull_request") | ~F.col("action").isin(*HANDLED) | (F.coalesce(at("$.pull_request.draft"), F.lit("false")) == "true"), "ignored")
        .when(~some("owner") | ~some("repo") | (F.coalesce("number", F.lit(0)) == 0), "incomplete")
        .otherwise("accepted")
    )
    return named.withColumn("decision", decision)


def enqueues(accepted: DataFrame) -> DataFrame:
    """The accepted ones of decided() deliveries (with ts, event_id) as events for jobs.enqueued() or its stream: the key is the
    pull request and its head."""
    key = F.concat_ws("", F.lit("pr:"), F.lower("owner"), F.lit("/"), F.lower("repo"), F.lit("#"), F.col("number").cast("string"), F.lit("@"), F.coalesce("sha", F.lit("")))
    job, none = F.concat(F.lit("job:"), F.col("delivery")), F.lit(None).cast("string")
    return accepted.where("decision = 'accepted'").select(key.alias("key"), "ts", "event_id", F.lit(True).alias("enqueue"), job.alias("job"), none.alias("status"))


def redacted(text: Column) -> Column:
    """A text without secrets: known forms are replaced, and a text of more than 12 characters that still names a secret goes."""
    out = text
    for form, instead in FORMS:
        out = F.regexp_replace(out, F.lit(form), F.lit(instead))
    return F.when(out.rlike("(?i)" + SENSITIVE) & (F.length(out) > 12), GONE).otherwise(out)


_FORMS = [(re.compile(form.replace(r"\b(", r"(?<![A-Za-z0-9_])(").replace(r"\b", r"(?![A-Za-z0-9_])")), instead) for form, instead in FORMS]
_SENSITIVE = re.compile(SENSITIVE, re.I)


def _text(value: str) -> str:
    for form, instead in _FORMS:
        value = form.sub(instead, value)
    return GONE if len(value) > 12 and _SENSITIVE.search(value) else value


def _value(value):
    """Any JSON value: texts at any depth, and whatever stands under the name of a secret."""
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, list):
        return [_value(x) for x in value]
    if isinstance(value, dict):
        return {k: GONE if _SENSITIVE.search(k) else _value(v) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def redacted_json(documents: pd.Series) -> pd.Series:
    """JSON documents without secrets, written without spaces: texts as in redacted(), and [redacted] for what a key names that is
    called like a secret, whatever it is. What is no JSON is a text; what is nested too deeply to be read goes; null is null."""

    def one(document: str | None) -> str | None:
        if document is None:
            return None
        try:
            return json.dumps(_value(json.loads(document)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return _text(document)
        except RecursionError:
            return GONE

    return documents.map(one)

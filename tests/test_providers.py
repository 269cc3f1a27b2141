"""Requests and responses of vision providers as columns; posting with a fake wire."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources.providers import ANSWER_SCHEMA, APIS, post, requests_of

RESPONSES = {
    "messages": [({"model": "m2", "content": [{"type": "thinking"}, {"type": "text", "text": "A"}], "usage": {"input_tokens": 5, "output_tokens": 2}}, ("A", "m2", 5, 2, None)), ({"stop_reason": "refusal"}, "refused"), ({"stop_reason": "max_tokens"}, "truncated"), ({"content": []}, "invalid_response")],
    "responses": [({"status": "completed", "output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "A"}]}], "usage": {"input_tokens": 5, "output_tokens": 2}}, ("A", "m", 5, 2, None)), ({"status": "incomplete", "incomplete_details": {"reason": "content_filter"}}, "refused"), ({"status": "incomplete"}, "truncated"), ({"output": [{"type": "message", "content": [{"type": "refusal"}]}]}, "refused"), ({"output": []}, "invalid_response")],
    "content": [({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "no", "thought": True}, {"text": "A"}, {"text": "B"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 2, "thoughtsTokenCount": 3}}, ("AB", "m", 5, 5, None)), ({"promptFeedback": {"blockReason": "X"}}, "refused"), ({"candidates": [{"finishReason": "SAFETY"}]}, "refused"), ({"candidates": [{"finishReason": "MAX_TOKENS"}]}, "truncated"), ({"candidates": []}, "invalid_response")],
    "chat": [({"choices": [{"finish_reason": "stop", "message": {"content": "A"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}, ("A", "m", 5, 2, None)), ({"choices": [{"finish_reason": "length"}]}, "truncated"), ({"choices": [{"finish_reason": "content_filter"}]}, "refused"), ({"choices": [{"message": {"refusal": "no"}}]}, "refused"), ({"choices": [{"message": {"content": " "}}]}, "invalid_response"), ({"choices": []}, "invalid_response")],
}


@pytest.mark.parametrize("name", sorted(APIS))
def test_requests_and_replies(name, spark):
    api = APIS[name]
    one = spark.createDataFrame([(bytearray(b"jpg"), "read")], "content binary, instructions string")
    body = json.loads(one.select(api.body(F.col("content"), F.col("instructions"), "m")).first()[0])
    text = json.dumps(body)
    assert "anBn" in text and "read" in text
    if name != "chat":
        assert json.dumps(ANSWER_SCHEMA["properties"]["tags"]["items"]["required"])[1:-1] in text
    cases = [*RESPONSES[name], (None, "invalid_response")]
    rows = spark.createDataFrame([(i, json.dumps(r) if r is not None else "oops") for i, (r, _) in enumerate(cases)], "i int, r string")
    got = [r["x"] for r in rows.select("i", api.reply(F.col("r"), "m").alias("x")).orderBy("i").collect()]
    for g, (_, want) in zip(got, cases, strict=True):
        assert (g["error"] if isinstance(want, str) else tuple(g)) == want


def wire(url, headers, body, timeout):
    n = json.loads(body)["n"]
    if n == 0:
        return 200, {}, "ok"
    if n == 1:
        return 429, {"retry-after": "0"}, "{}"
    if n == 2:
        return 403, {}, json.dumps({"error": {"type": "insufficient_quota"}})
    raise OSError("down")


def secret():
    return "k"


def test_post(spark):
    rows = spark.createDataFrame([(i, json.dumps({"n": i})) for i in range(4)], "i int, body string")
    got = post(rows, APIS["chat"], "m", secret, transport=wire, sleep=lambda s: None).orderBy("i").collect()
    assert [(r["http_status"], r["error_code"]) for r in got] == [(200, None), (429, None), (403, "insufficient_quota"), (None, None)]


def test_waits_spread(spark):
    from lectern.sources.providers import _wait

    assert [_wait({}, limited, n, lambda: 0.25) for limited, n in ((False, 0), (False, 2), (True, 1), (True, 9))] == [1.25, 4.25, 10.25, 60.0]
    assert [_wait(h, True, 0, lambda: 0.25) for h in ({"retry-after-ms": "1500"}, {"retry-after": "7"}, {"retry-after": "999"}, {"retry-after": "soon"})] == [1.5, 7.0, 60.0, 5.25]


def test_images_as_large_as_the_model_reads(spark):
    from lectern.catalog import Catalog
    from lectern.sources.images import PixelMap

    api = APIS["messages"]
    assert api.side("old-1", ("new-",)) == 1568 and api.side("new-2", ("new-",)) == api.max_side and APIS["chat"].side("any") == 1300
    wide = PixelMap().encode(np.zeros((10, 3200, 3), np.uint8))
    photos = spark.createDataFrame([("a", bytearray(wide)), ("b", bytearray(b"?"))], "image string, content binary")
    got = {r["image"]: r for r in requests_of(photos, api, "old-1", Catalog("e"), make=PixelMap).collect()}
    assert (got["a"]["width"], got["a"]["height"]) == (1568, 5) and "1568 by 5 pixels" in got["a"]["body"]
    assert got["b"]["body"] is None and got["b"]["error"]


def test_a_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([("{}",)], "body string")
    for api in APIS.values():
        plan = rows.select(api.reply(F.col("body"), "m1").alias("r")).select("r.*")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1


def test_constant_parts_of_requests_are_written_once(spark):
    """No variant is written for each row; the schema stands in the request with keys in order, and a text like it stays a text."""
    said = 'Read "schema":"" \u00e9\n'
    rows = spark.createDataFrame([(b"abc", said)], "content binary, said string").select(*(a.body(F.col("content"), F.col("said"), "m1").alias(n) for n, a in APIS.items()))
    assert "variant" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {n: json.loads(body) for n, body in rows.first().asDict().items()}
    assert got["messages"]["output_config"]["format"]["schema"] == got["responses"]["text"]["format"]["schema"] == got["content"]["generationConfig"]["responseJsonSchema"] == ANSWER_SCHEMA
    assert got["messages"]["messages"][0]["content"][1]["text"] == got["responses"]["input"][0]["content"][0]["text"] == got["content"]["contents"][0]["parts"][1]["text"] == said
    assert got["chat"]["messages"][0]["content"][0]["text"].startswith(said)

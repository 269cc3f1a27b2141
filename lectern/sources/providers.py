"""Vision providers as tables: requests and responses are JSON columns, the wire is an Arrow map.

Building a request and reading a response are expressions, so they are planned,
pruned and tested like any other column; only posting leaves the engine.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.decision import QUOTA_CODES, RETRY_STATUSES
from lectern.catalog import Catalog
from lectern.operators.answers import ANGLES, LEGIBILITY, instructions
from lectern.sources.images import Codec, codec, prepared

# The schema of an answer.
ANSWER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["tags"],
    "properties": {"tags": {"type": "array", "items": {
        "type": "object", "additionalProperties": False, "required": ["text", "legibility", "alternatives", "box", "angle"],
        "properties": {
            "text": {"type": "string"}, "legibility": {"type": "string", "enum": list(LEGIBILITY)}, "alternatives": {"type": "array", "items": {"type": "string"}},
            "box": {"type": "array", "items": {"type": "number"}}, "angle": {"type": "string", "enum": list(ANGLES)},
        },
    }}},
}
SORTED_SCHEMA = json.loads(json.dumps(ANSWER_SCHEMA, sort_keys=True))
REPLY = "text string, model string, input_tokens long, output_tokens long, error string"


def _object(**fields: Column | str | int | bool) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def _written(members: dict[str, Any]) -> Column:
    """A JSON object of columns and of constants, which are written once and not for each row: a variant's text costs a new parser for every string in it."""
    parts: list[Column] = []
    for key, value in members.items():
        head = f"{',' if parts else '{'}{json.dumps(key)}:"
        parts += [F.lit(head), F.to_json(value)] if isinstance(value, Column) else [F.lit(head + json.dumps(value, ensure_ascii=False, separators=(",", ":")))]
    return F.concat(*parts, F.lit("}"))


def _reply(text: Column, model: Column, tokens_in: Column, tokens_out: Column, error: Column) -> Column:
    def shown(error: Column) -> Column:
        ok = error.isNull()
        number = lambda c: F.when(ok, F.coalesce(c, F.lit(0).cast("long")))
        return _object(text=F.when(ok, text), model=F.when(ok, model), input_tokens=number(tokens_in), output_tokens=number(tokens_out), error=error)

    return let(error, shown)


@dataclass(frozen=True)
class Api:
    """One provider: where requests go, how boxes come back, and the response's DDL."""

    name: str
    url: str
    box_format: str
    max_side: int
    key_header: str
    response: str
    build: Callable[[Column, Column, str], dict[str, Any]]
    extract: Callable[[Column, str], Column]
    key_prefix: str = ""
    headers: tuple[tuple[str, str], ...] = ()
    older_side: int | None = None

    def side(self, model: str, recent: tuple[str, ...] = ()) -> int:
        """The longest side of an image that a model reads as it is. Where older models shrink images, only names that start like one of recent get max_side."""
        return self.older_side if self.older_side and not model.startswith(recent) else self.max_side

    def body(self, content: Column, instructions: Column, model: str) -> Column:
        """The request as JSON text."""
        return _written(self.build(F.base64(content), instructions, model))

    def reply(self, response: Column, model: str) -> Column:
        """struct REPLY of a response body: refused, truncated and invalid_response are errors."""
        nothing = _reply(*[F.lit(None).cast(t) for t in ("string", "string", "long", "long")], F.lit("invalid_response"))
        # bound, because the rules look at the response dozens of times, each of which would parse it
        return let(F.from_json(response, self.response), lambda r: F.when(r.isNull(), nothing).otherwise(self.extract(r, model)))


def _messages_build(image: Column, text: Column, model: str) -> dict[str, Any]:
    source = _object(type="base64", media_type="image/jpeg", data=image)
    picture = F.struct(F.lit("image").alias("type"), source.alias("source"), F.lit(None).cast("string").alias("text"))
    words = F.struct(F.lit("text").alias("type"), F.lit(None).cast(source_type := "struct<type:string,media_type:string,data:string>").alias("source"), text.alias("text"))
    content = F.array(picture.cast(f"struct<type:string,source:{source_type},text:string>"), words)
    form = {"format": {"type": "json_schema", "schema": SORTED_SCHEMA}}
    return {"model": model, "max_tokens": 16000, "output_config": form, "messages": F.array(_object(role="user", content=content))}


def _messages_extract(r: Column, model: str) -> Column:
    text = F.get(F.filter(r["content"], lambda b: b["type"] == "text"), F.lit(0))["text"]
    error = F.when(r["stop_reason"] == "refusal", "refused").when(r["stop_reason"] == "max_tokens", "truncated").when(text.isNull(), "invalid_response")
    return _reply(text, F.coalesce(r["model"], F.lit(model)), r["usage"]["input_tokens"], r["usage"]["output_tokens"], error)


def _responses_build(image: Column, text: Column, model: str) -> dict[str, Any]:
    kind = "struct<type:string,text:string,image_url:string,detail:string>"
    none = F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.lit("input_text").alias("type"), text.alias("text"), none.alias("image_url"), none.alias("detail")).cast(kind),
        F.struct(F.lit("input_image").alias("type"), none.alias("text"), F.concat(F.lit("data:image/jpeg;base64,"), image).alias("image_url"), F.lit("high").alias("detail")).cast(kind),
    )
    form = {"format": {"type": "json_schema", "name": "tags", "strict": True, "schema": SORTED_SCHEMA}}
    return {"model": model, "input": F.array(_object(role="user", content=parts)), "text": form}


def _responses_extract(r: Column, model: str) -> Column:
    parts = F.flatten(F.transform(F.filter(r["output"], lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    text = F.get(F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull()), F.lit(0))["text"]
    partial = r["status"] == "incomplete"
    error = (
        F.when(partial & (r["incomplete_details"]["reason"] == "content_filter"), "refused").when(partial, "truncated")
        .when(F.coalesce(F.exists(parts, lambda p: p["type"] == "refusal"), F.lit(False)), "refused").when(text.isNull(), "invalid_response")
    )
    return _reply(text, F.coalesce(r["model"], F.lit(model)), r["usage"]["input_tokens"], r["usage"]["output_tokens"], error)


def _content_build(image: Column, text: Column, model: str) -> dict[str, Any]:
    kind = "struct<inline_data:struct<mime_type:string,data:string>,text:string>"
    picture = F.struct(_object(mime_type="image/jpeg", data=image).alias("inline_data"), F.lit(None).cast("string").alias("text")).cast(kind)
    words = F.struct(F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"), text.alias("text")).cast(kind)
    return {"contents": F.array(_object(role="user", parts=F.array(picture, words))), "generationConfig": {"responseMimeType": "application/json", "responseJsonSchema": SORTED_SCHEMA}}


# Finish reasons that mean a refusal.
BLOCKED = ("SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "IMAGE_SAFETY")


def _content_extract(r: Column, model: str) -> Column:
    first = F.get(r["candidates"], F.lit(0))
    texts = F.filter(first["content"]["parts"], lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False)))
    text = F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda p: p["text"]), ""))
    error = (
        F.when(F.coalesce(r["promptFeedback"]["blockReason"], F.lit("")) != "", "refused").when(first["finishReason"].isin(*BLOCKED), "refused")
        .when(first["finishReason"] == "MAX_TOKENS", "truncated").when(text.isNull(), "invalid_response")
    )
    use, zero = r["usageMetadata"], F.lit(0).cast("long")
    out = F.coalesce(use["candidatesTokenCount"], zero) + F.coalesce(use["thoughtsTokenCount"], zero)
    return _reply(text, F.coalesce(r["modelVersion"], F.lit(model)), use["promptTokenCount"], out, error)


def _chat_build(image: Column, text: Column, model: str) -> dict[str, Any]:
    kind = "struct<type:string,text:string,image_url:struct<url:string>>"
    asked = F.concat(text, F.lit(f"\n\nAnswer with one JSON object of this JSON Schema and nothing else:\n{json.dumps(ANSWER_SCHEMA)}"))
    words = F.struct(F.lit("text").alias("type"), asked.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(kind)
    picture = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), _object(url=F.concat(F.lit("data:image/jpeg;base64,"), image)).alias("image_url")).cast(kind)
    return {"model": model, "messages": F.array(_object(role="user", content=F.array(words, picture))), "response_format": {"type": "json_object"}}


def _chat_extract(r: Column, model: str) -> Column:
    first = F.get(r["choices"], F.lit(0))
    said = first["message"]
    error = (
        F.when(first["finish_reason"] == "content_filter", "refused").when(first["finish_reason"] == "length", "truncated").when(F.coalesce(said["refusal"], F.lit("")) != "", "refused")
        .when(F.btrim(F.coalesce(said["content"], F.lit(""))) == "", "invalid_response")
    )
    return _reply(said["content"], F.coalesce(r["model"], F.lit(model)), r["usage"]["prompt_tokens"], r["usage"]["completion_tokens"], error)


_TOKENS = "usage struct<input_tokens:long,output_tokens:long>"
APIS = {
    a.name: a
    for a in (
        Api("messages", "https://api.anthropic.com/v1/messages", "pixels_xyxy", 2576, "x-api-key", f"model string, stop_reason string, content array<struct<type:string,text:string>>, {_TOKENS}", _messages_build, _messages_extract, headers=(("anthropic-version", "2023-06-01"),), older_side=1568),
        Api("responses", "https://api.openai.com/v1/responses", "normalized_xyxy", 2048, "Authorization", f"model string, status string, incomplete_details struct<reason:string>, output array<struct<type:string,content:array<struct<type:string,text:string>>>>, {_TOKENS}", _responses_build, _responses_extract, "Bearer "),
        Api("content", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "normalized_yxyx", 2048, "x-goog-api-key", "modelVersion string, promptFeedback struct<blockReason:string>, candidates array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean>>>>>, usageMetadata struct<promptTokenCount:long,candidatesTokenCount:long,thoughtsTokenCount:long>", _content_build, _content_extract),
        Api("chat", "https://api.deepseek.com/chat/completions", "normalized_xyxy", 1300, "Authorization", "model string, choices array<struct<finish_reason:string,message:struct<content:string,refusal:string>>>, usage struct<prompt_tokens:long,completion_tokens:long>", _chat_build, _chat_extract, "Bearer "),
    )
}


def _transport(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, dict[str, str], str]:
    request = urllib.request.Request(url, body, headers | {"content-type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode(errors="replace")


def _wait(headers: dict[str, str], limited: bool, attempt: int, spread: Callable[[], float]) -> float:
    """Seconds before the next attempt: what the answer asks for, else doubling with up to a second of spread, at most a minute."""
    for name, unit in (("retry-after-ms", 0.001), ("retry-after", 1.0)):
        try:
            return min(max(float(headers[name]) * unit, 0.0), 60.0)
        except (KeyError, ValueError):
            continue
    return min((5.0 if limited else 1.0) * 2.0**attempt + spread(), 60.0)


def requests_of(photos: DataFrame, api: Api, model: str, catalog: Catalog, recent: tuple[str, ...] = (), make: Callable[[], Codec] = codec) -> DataFrame:
    """(image, width, height, body, error) of photos (image, content): upright, as large as the model reads, with instructions for that size.

    Boxes in an answer are in pixels of the image that was sent; scale leads back.
    """
    sent = photos.select("image", prepared(F.col("content"), api.side(model, recent), make).alias("p")).select("image", "p.*")
    wide, high = F.round(F.col("width") / F.col("scale")).cast("int"), F.round(F.col("height") / F.col("scale")).cast("int")
    text = F.replace(F.replace(F.lit(instructions(catalog, api.box_format, 0, 0)), F.lit("the image is 0 by 0 pixels"), F.concat(F.lit("the image is "), wide, F.lit(" by "), high, F.lit(" pixels"))), F.lit("\r"), F.lit(""))
    body = F.when(F.col("error").isNull(), api.body(F.col("content"), text, model))
    return sent.select("image", wide.alias("width"), high.alias("height"), "scale", body.alias("body"), "error")


def post(requests: DataFrame, api: Api, model: str, key: Callable[[], str], retries: int = 2, timeout: float = 120.0, transport: Callable = _transport, sleep: Callable[[float], None] = time.sleep, spread: Callable[[], float] = random.random) -> DataFrame:
    """requests (with a column body) and http_status, error_code, response; transport faults have a null status.

    key is called on the executor, so that no plan or log holds it. Rate limits, server
    and network faults are tried again; a spent quota is not. Save the result before
    using it: a plan that runs again posts, and pays, again.
    """
    from pyspark.sql.types import StructType

    schema = StructType(requests.schema.fields + StructType.fromDDL("http_status int, error_code string, response string").fields)
    url = api.url.replace("{model}", model)

    def once(body: str, headers: dict[str, str]) -> tuple[int | None, str | None, str | None]:
        for attempt in range(retries + 1):
            try:
                status, back, text = transport(url, headers, body.encode(), timeout)
            except OSError:
                status, back, text = None, {}, None
            code = None
            if status is not None and not 200 <= status < 300:
                try:
                    error = json.loads(text)["error"]
                    code = next((error[k] for k in ("code", "type") if isinstance(error.get(k), str)), None)
                except (ValueError, KeyError, TypeError, AttributeError):
                    pass
            again = status is None or ((status in RETRY_STATUSES or status >= 500) and status != 402 and code not in QUOTA_CODES)
            if not again or attempt == retries:
                return status, code, text
            sleep(_wait(back, status == 429, attempt, spread))
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        headers = {api.key_header: api.key_prefix + key()} | dict(api.headers)
        for batch in batches:
            said = [once(b, headers) for b in batch.column(batch.schema.get_field_index("body")).to_pylist()]
            new = [pa.array([s[i] for s in said], arrow.field(len(batch.schema.names) + i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *new], arrow, strict=True)], schema=arrow)

    return requests.mapInArrow(run, schema)

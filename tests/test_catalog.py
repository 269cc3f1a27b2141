"""Catalog documents: round trips and located errors; kinds and headers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.catalog import Catalog, CatalogError, Kind
from lectern.functions import decision as D
from lectern.operators import headers
from lectern.queries import HEADED, LOT

GOOD = {"schema_version": "1.0", "name": "m", "tags_per_individual": 1, "tags": [{"id": "primary", "pattern": r"MD\d{5}"}, {"id": "b", "pattern": r"[A-Z]{2}-\d{3,4}", "header": "H"}]}


def test_round_trip_and_empty():
    c = Catalog.from_json(json.dumps(GOOD))
    assert Catalog.from_json(c.to_json()) == c and c.match("MD12345") == "primary" and c.match("x") is None
    assert Catalog.from_dict(GOOD | {"tags": []}).match("a") is None
    with pytest.raises(KeyError):
        c.kind("none")


@pytest.mark.parametrize(("change", "location"), [
    ({"schema_version": "2"}, "schema_version"), ({"extra": 1}, "extra"), ({"tags": {}}, "tags"), ({"name": ""}, "name"), ({"tags_per_individual": True}, "tags_per_individual"),
    ({"tags": [{"id": "a", "pattern": "MD\\d+"}]}, "tags[0].pattern"), ({"tags": [{"id": "a", "pattern": "A"}, {"id": "a", "pattern": "B"}]}, "tags[1].id"),
    ({"tags": [{"id": "1", "pattern": "A"}]}, "tags[0].id"), ({"tags": [{"id": "a", "pattern": "A", "header": " "}]}, "tags[0].header"), ({"tags": [{"id": "a"}]}, "tags[0].pattern"), ({"tags": [5]}, "tags[0]"),
])
def test_located_errors(change, location):
    with pytest.raises(CatalogError) as e:
        Catalog.from_dict(GOOD | change)
    assert e.value.location == location


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"a": NaN}', "{", "[]"])
def test_strict_json(text):
    with pytest.raises(CatalogError):
        Catalog.from_json(text)


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_kinds_in_columns_equal_the_driver(spark):
    texts = ["GJ07966", "GJ07966\n", "0086", "AB12345", "", "FWS4019", "Brand#7", "gj07966", None]
    assert column(spark, texts, LOT.kind_of) == [LOT.match(t) if t is not None else None for t in texts]
    assert column(spark, ["a"], Catalog("e").kind_of) == [None]
    assert LOT.kinds_frame(spark).count() == len(LOT.kinds)


def test_confusable_and_turned(spark):
    c = Catalog("c", (Kind("FieldTag", r"[A-Z]{2}\d{5}"), Kind("FWS", r"FWS\d{4}"), Kind("GJ", r"GJ\d{5}")))
    rows = spark.createDataFrame([("FW54019", "FieldTag"), ("FWS4019", "FWS"), ("GJ02948", "GJ")], "t string, k string")
    assert [r[0] for r in rows.select(D.other_kind_readings(F.col("t"), F.col("k"), c)).collect()] == [["FWS4019"], ["FW54019"], []]
    assert column(spark, ["9800", "GJ1", ""], D.upside_down) == ["0086", None, ""]


def test_fit_code(spark):
    got = column(spark, ["GJ 07470", "https://museum.test/specimen/gj07470?lang=en", "4006381333931", "GJ07470;AB12345"], lambda t: D.fit_code(t, LOT))
    assert [[tuple(x) for x in g] for g in got] == [[("GJ07470", "primary")], [("GJ07470", "primary")], [], [("GJ07470", "primary"), ("AB12345", "field")]]


@pytest.mark.parametrize(("text", "kind", "least"), [("15950-1", "id", 0.65), ("GJ07966", "id", 0.65), ("12/345", "id", 0.65), ("FWS 4019", "id", 0.65), ("ENTOMOLOGY COLLECTION", "header", 0.1), ("1 2 3 4 5 6", "noise", 0.05), ("x", "noise", 0.02), ("cm", "noise", 0.05)])
def test_likelihood(text, kind, least, spark):
    got = column(spark, [text], D.tag_likelihood)[0]
    assert got["kind"] == kind and got["likelihood"] >= least


def test_local_decisions(spark):
    c = Catalog("lot", (Kind("primary", r"GJ\d{5}"), Kind("secondary", r"\d{4}")))
    rows = [("GJ07966", 0.97, True), ("GJ07966", 0.97, False), ("GJ07966", 0.05, False), ("9800", 0.95, True)]
    frame = spark.createDataFrame([(i, [(t, p, c.match(t))], a) for i, (t, p, a) in enumerate(rows)], "i int, r array<struct<text:string,probability:double,tag_id:string>>, a boolean")
    got = [r["d"] for r in frame.select("i", D.local_decision(F.col("r"), F.col("a"), c).alias("d")).orderBy("i").collect()]
    assert [(g["status"], g["text"], [x["text"] for x in g["candidates"]]) for g in got] == [("accepted", "GJ07966", []), ("review", "GJ07966", []), ("unreadable", None, ["GJ07966"]), ("review", "9800", ["0086"])]
    assert got[1]["confidence"] == 0.89
    with pytest.raises(ValueError):
        D.status(F.lit(1.0), accept=0.2, review=0.5)


def test_provider_decisions(spark):
    c = Catalog("m", (Kind("primary", r"MD\d{5}"),))
    frame = spark.createDataFrame([(0, "MDO4127", "certain", ["MD04127"]), (1, "HELLO", "certain", []), (2, "", "unreadable", [])], "i int, t string, l string, a array<string>")
    build = lambda accept: D.provider_decision(F.col("t"), F.col("l"), F.col("a"), c, accept=accept)
    got = [r["d"] for r in frame.select("i", build(0.9).alias("d")).orderBy("i").collect()]
    assert (got[0]["text"], got[0]["status"], got[0]["candidates"][0]["text"]) == ("MD04127", "review", "MDO4127")
    assert got[2]["status"] == "unreadable" and got[2]["text"] is None and got[2]["candidates"] == []
    assert frame.where("i = 1").select(D.provider_decision(F.col("t"), F.col("l"), F.col("a"), c, accept=0.28, review=0.1)["status"]).first()[0] == "review"


def test_headers(spark):
    seen = lambda lines: column(spark, ["".join(lines)], lambda t: headers.headers_in(t, HEADED))[0]
    assert seen(["ENTOMOLOGY", "COLLECTION", "16368"]) == ["printed_a"]
    assert seen(["ENT0M0LOGY C0LLECTION"]) == ["printed_a"] and seen(["HERBARIUM B"]) == ["printed_b"] and seen(["12345"]) == []
    assert headers.holds("", "A") is False and headers.holds("XABY", "") is False

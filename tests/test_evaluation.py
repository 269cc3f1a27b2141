"""Labels, pairing against a plain version, metrics, geometry, answers, results and streaming."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.operators import answers, pairing, vision
from lectern.plans import evaluation
from lectern.sources import labels as L
from lectern.sources import results as R
from lectern.streaming import ingest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain_pairs(ls, ps):
    cands = sorted((distance(p, t) / max(len(t), 1), i, j) for i, t in enumerate(ls) if t is not None for j, p in enumerate(ps) if p is not None)
    out, ul, up = [], set(), set()
    for cer, i, j in cands:
        if cer <= 0.5 and i not in ul and j not in up:
            out.append((i, j)), ul.add(i), up.add(j)
    for nl, nt in ((True, False), (False, True), (True, True)):
        free_l = [i for i, t in enumerate(ls) if i not in ul and (t is None) == nl]
        free_p = [j for j, t in enumerate(ps) if j not in up and (t is None) == nt]
        for i, j in zip(free_l, free_p, strict=False):
            out.append((i, j)), ul.add(i), up.add(j)
    return out


def test_pairing_equals_a_plain_version(spark):
    rng = random.Random(3)
    text = lambda: None if rng.random() < 0.25 else "".join(rng.choice("AB1") for _ in range(rng.randint(0, 4)))
    cases = [([text() for _ in range(rng.randint(0, 4))], [text() for _ in range(rng.randint(0, 4))]) for _ in range(600)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, l array<string>, p array<string>")
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in frame.select("i", pairing.pairs(F.col("l"), F.col("p")).alias("x")).collect()}
    assert all(got[i] == plain_pairs(a, b) for i, (a, b) in enumerate(cases))


def test_jsonl_and_rules(spark, tmp_path):
    rows = [{"image": "b.jpg", "text": "GJ1", "session": "s", "verified": True}, {"image": "b.jpg", "text": "?"}, {"image": "a.jpg", "text": "-", "session": "s"}, {"image": "c.jpg", "text": "X", "verified": "no"}, {"image": "d.jpg", "text": "A_REMPLIR"}]
    path = tmp_path / "labels.jsonl"
    path.write_text("\n\n".join(map(json.dumps, rows)), encoding="utf-8")
    records = L.read_jsonl(spark, str(path))
    got = {r["image"]: [t["text"] for t in r["tags"]] for r in L.load(records).collect()}
    assert got == {"b.jpg": ["GJ1", None], "a.jpg": []}
    photos = spark.createDataFrame([("a.jpg",)], "image string")
    with pytest.raises(L.DatasetError, match="not found"):
        L.load(records, photos)
    path.write_text('{"image": "a"}\nnope\n', encoding="utf-8")
    with pytest.raises(L.DatasetError, match="line 2"):
        L.read_jsonl(spark, str(path))
    path.write_text('{"text": "a"}\n', encoding="utf-8")
    with pytest.raises(L.DatasetError, match="image"):
        L.read_jsonl(spark, str(path))
    path.write_text('{"image": "a", "session": "s", "split": "x"}\n{"image": "b", "session": "s"}\n', encoding="utf-8")
    with pytest.raises(L.DatasetError, match="several splits"):
        L.load(L.read_jsonl(spark, str(path)))


def test_csv(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("﻿image;session;text;verified;notes\nEXEMPLE_1.jpg;s;A;oui;\nx.jpg; s ;GJ1;oui;a, b\ny.jpg;s;GJ2;;\n;s;Q;oui;\n", encoding="utf-8")
    got = L.load(L.read_csv(spark, str(path))).collect()
    assert [(r["image"], r["session"], [t["text"] for t in r["tags"]]) for r in got] == [("x.jpg", "s", ["GJ1"])]
    path.write_text("", encoding="utf-8")
    assert L.read_csv(spark, str(path)).count() == 0


TAG = "struct<text:string,status:string,source:string,tag_id:string>"


def outcome_rows(spark):
    t = lambda text, status="accepted", source="local": (text, status, source, "k")
    labels = [("a", "s1", [("GJ1",), (None,)]), ("b", "s1", [("GJ2",)]), ("c", "s2", [("GJ3",)]), ("d", "s2", [])]
    found = [("a", [t("GJ1"), t("ZZZZ")], None), ("b", [t("GJ9")], None), ("c", [], "failed"), ("d", [t("Q", "review", "fallback")], None)]
    l = spark.createDataFrame([(i, s, [(x[0],) for x in v]) for i, s, v in labels], "image string, session string, tags array<struct<text:string>>")  # noqa: E741
    p = spark.createDataFrame([(i, v, {"x": 500.0, "y": 500.0}, e) for i, v, e in found], f"image string, tags array<{TAG}>, timings_ms map<string,double>, error string")
    return l, p


def test_metrics_and_report(spark, tmp_path):
    rows = [r.asDict() for r in evaluation.evaluate(*outcome_rows(spark)).collect()]
    total = next(r for r in rows if r["total"])
    expected = {"photos": 4, "failed_photos": 1, "readable_tags": 2, "unreadable_tags": 1, "predicted_tags": 4, "accepted_tags": 3, "exact_matches": 1, "accepted_correct": 1, "silent_errors": 2, "missed_tags": 0, "invented_tags": 1, "edits": 1, "characters": 6, "fallback_tags": 1, "seconds": 3.0}
    assert {k: total[k] for k in expected} == expected
    doc = evaluation.report(total, [r for r in rows if not r["total"]], dataset="lot", tokens={"input": 10**6, "output": 0}, price_per_million_tokens={"input": 0.3, "output": 1})
    assert doc["metrics"]["sessions"]["s2"]["photos"] == 2 and doc["cost_per_1000_photos_usd"] == 100.0
    assert "GJ" not in evaluation.markdown(doc) and evaluation.report_stem("2026", "Lot 02", "x/y") == "2026_lot-02_x-y"
    evaluation.save_report(doc, str(tmp_path), "r")
    assert json.loads((tmp_path / "r.json").read_text())["metrics"]["photos"] == 4


def test_merge_one_reader(spark):
    _, p = outcome_rows(spark)
    rows = evaluation.merge_readers(p.select("image", F.lit("s").alias("session"), "tags")).collect()
    assert {(r["image"], r["text"]): r["priority"] for r in rows} == {("a", "GJ1"): 3, ("a", "ZZZZ"): 3, ("b", "GJ9"): 3, ("c", "-"): 1, ("d", "Q"): 0}


def test_vision_geometry():
    mask = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 0, 1], [0, 0, 0, 0, 1], [1, 0, 0, 0, 0]], bool)
    assert sorted(len(r) for r, _ in vision.components(mask)) == [1, 2, 3] and vision.components(np.zeros((4, 4), bool)) == []
    u = np.zeros((5, 7), bool)
    u[:, 0] = u[:, 6] = u[4] = True
    assert len(vision.components(u)) == 1
    assert sorted(map(tuple, vision.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]])))) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    for degrees in (0, 15, 30, 45, -20, 89):
        quad = vision.corners(np.array([50.0, 40.0]), 30.0, 8.0, math.radians(degrees))
        centre, w, h, angle = vision.smallest_rectangle(quad)
        assert np.allclose(centre, (50, 40)) and np.allclose((w, h), (30, 8)) and -math.pi / 2 < angle <= math.pi / 2
    m = np.zeros((40, 60))
    m[10:16, 5:45], m[30:32, 50:52], m[25:28, 5:20] = 0.9, 0.9, 0.25
    ((quad, score),) = vision.boxes(m, 0.2, 0.4, 1.5)
    grow = 240 * 1.5 / 92
    assert score == pytest.approx(0.9) and np.allclose([quad.min(axis=0), quad.max(axis=0)], [[5 - grow, 10 - grow], [45 + grow, 16 + grow]])


def test_least_rectangle_of_equal_areas():
    """Upright 3 by 3 and, along the slope of 2 to 1, 1.8 x sqrt(5) by sqrt(5) are both 9: the flatter one counts, and is too flat for a box."""
    m = np.zeros((8, 8))
    m[5, 0] = m[6, :3] = m[7, 2] = 0.9
    rows, columns = np.nonzero(m)
    for turned in (lambda p: p, lambda p: p[:, ::-1]):
        ends = turned(np.concatenate([np.stack([columns, rows], axis=1) + k for k in ((0, 0), (0, 1), (1, 0), (1, 1))]))
        assert np.allclose(vision.smallest_rectangle(ends)[1:3], (1.8 * 5**0.5, 5**0.5))
    assert vision.boxes(m, 0.5, 0.75, 1.5) == [] == vision.boxes(m.T, 0.5, 0.75, 1.5)
    m[4:7, 3:6] = m[5, 0] = m[6, :3] = m[7, 2] = 0.0
    m[2:5, 2:5] = 0.9
    ((_, _, width, height),) = vision.sized_boxes(m, 0.5, 0.75, 1.5)
    assert width == height == 5.25


def test_column_geometry(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(G.exif_turn(F.lit(i))) for i in range(10)] == [0, 0, 0, 180, 180, 90, 90, 270, 270, 0]
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert value(G.pixel_box(box(0, 0, 0.5, 50), "pixels_xyxy", F.lit(200), F.lit(100))) is None
    assert tuple(value(G.pixel_box(box(500, 1000, 0, 0), "normalized_yxyx", F.lit(200), F.lit(100)))) == (0.0, 0.0, 200.0, 50.0)
    quad = G.box_quad(*(F.lit(float(v)) for v in (0, 0, 4, 2)), F.lit(90))
    assert tuple(value(quad)[0]) == (4.0, 0.0) and value(G.turned_angle(F.lit(-10.0), F.lit(0.0))) == 350.0
    assert tuple(value(G.padded_crop(quad, F.lit(1.0), F.lit(4), F.lit(9)))) == (0.0, 0.0, 4.0, 3.0)
    with pytest.raises(ValueError):
        G.pixel_box(box(0), "x", F.lit(1), F.lit(1))


def test_answers(spark):
    tag = {"text": " GJ1 ", "legibility": "certain", "alternatives": ["GJ1", "a", "b", "c", "d", "a"], "box": [0, 0, 10, 10], "angle": "90"}
    assert answers.parse_answer(json.dumps({"tags": [tag]}), "pixels_xyxy", 20, 20) == [{"text": "GJ1", "legibility": "certain", "alternatives": ["a", "b", "c"], "box": [0.0, 0.0, 10.0, 10.0], "angle": 90}]
    bad = [{"box": [0, 0, True, 1]}, {"angle": 90}, {"legibility": "x"}, {"text": 1}, {"alternatives": "a"}, {"box": [0, 0, 0.5, 9]}, {"box": [1, 2, 3]}, {"more": 1}]
    for change in bad:
        with pytest.raises(ValueError):
            answers.parse_answer(json.dumps({"tags": [tag | change]}), "pixels_xyxy", 20, 20)
    from lectern.catalog import Catalog
    from lectern.queries import LOT

    assert "primary" in answers.instructions(LOT, "pixels_xyxy", 1, 1) and "patterns" not in answers.instructions(Catalog("e"), "pixels_xyxy", 1, 1)


class Fake:
    def read(self, request):
        if request["id"] == 1:
            raise RuntimeError("down")
        return {"answer": "{}", "input_tokens": 3, "output_tokens": 1}


def test_provider_calls(spark):
    calls = answers.ask(spark.createDataFrame([(0,), (1,)], "id int"), Fake).collect()
    assert [(r["id"], r["input_tokens"], r["error"]) for r in sorted(calls)] == [(0, 3, None), (1, None, "RuntimeError: down")]


def test_results_table_and_stream(spark, tmp_path):
    photos = tmp_path / "photos"
    photos.mkdir()
    for n in ("a.jpg", "B.PNG", "c.txt"):
        (photos / n).write_bytes(b"x")
    found = R.read_photos(spark, str(photos))
    assert sorted(r["image"] for r in found.collect()) == ["B.PNG", "a.jpg"]
    reads = lambda d: d.select("image", F.lit(1).alias("n"))
    table = str(tmp_path / "predictions")
    for _ in range(2):
        assert R.read_missing(found, table, "m", reads).count() == 2
    # forcing one photo keeps the others; what failed is read again, what was read is not
    again = lambda d: d.select("image", F.lit(2).alias("n"))
    only = found.where("image = 'a.jpg'")
    assert [tuple(r)[:2] for r in R.read_missing(only, table, "m", again, force=True).select("image", "n").collect()] == [("a.jpg", 2)]
    assert {r["image"]: r["n"] for r in R.predictions(spark, table, "m").collect()} == {"a.jpg": 2, "B.PNG": 1}
    fails = lambda d: d.select("image", F.lit(None).cast("int").alias("n"), F.lit("down").alias("error"))
    assert {r["error"] for r in R.read_missing(found, table, "f", fails).collect()} == {"down"}
    heard = []
    assert {r["n"] for r in R.read_missing(found, table, "f", again, progress=lambda *x: heard.append(x), parts=3).collect()} == {2} and heard == [(1, 3), (2, 3), (3, 3)]
    assert {(r["n"], r["error"]) for r in R.read_missing(found, table, "f", fails, force=True).collect()} == {(2, None)}
    # a stream reads into the same table, only photos, and only what is missing
    (photos / "d.jpeg").write_bytes(b"x")
    stream = ingest.photo_stream(spark, str(photos))
    ingest.read_stream(stream, lambda d: d.select("image", F.lit(9).alias("n")), table, "m", str(tmp_path / "cp")).awaitTermination(60)
    assert {r["image"]: r["n"] for r in R.predictions(spark, table, "m").collect()} == {"a.jpg": 2, "B.PNG": 1, "d.jpeg": 9}
    assert R.predictions(spark, table, "none") is None
    named = R.read_photos(spark, str(photos / "c.txt"), str(photos))
    assert [r["image"] for r in R.in_order(named.select("image")).collect()] == ["B.PNG", "a.jpg", "c.txt", "d.jpeg"]
    name = spark.createDataFrame([("IMG_20260102_1.jpg", None), ("x.jpg", "2026:03:04 10:00"), ("x", None)], "n string, t string")
    assert [r[0] for r in name.select(R.session_of(F.col("n"), F.col("t"))).collect()] == ["2026-01-02", "2026-03-04", ""]


def test_json_round_trip(spark):
    row = spark.range(1).select(F.lit("a").alias("image"), F.lit(None).cast("array<string>").alias("other_texts"))
    text = row.select(R.result_json(F.struct("image", "other_texts")).alias("j"))
    assert text.first()["j"] == '{"image":"a"}' and text.select(R.parse_results(F.col("j"))["image"]).first()[0] == "a"

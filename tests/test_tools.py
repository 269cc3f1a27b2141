"""Command line, SQL functions, review page and model files."""

from __future__ import annotations

import hashlib
import io
import json

import pytest

from lectern.__main__ import main
from lectern.functions.registry import register
from lectern.plans.review import page, write_review
from lectern.queries import LOT
from lectern.sources.models import Manifest, ModelError, fetch, manifests, ship


def result(image, *tags):
    quad = [{"x": 0.0, "y": 0.0}] * 4
    return json.dumps({"image": image, "tags": [{"tag_id": "primary", "text": t, "confidence": 0.95, "status": "accepted", "polygon": quad, "angle": 0.0, "candidates": [], "source": "local"} for t in tags], "timings_ms": {"read": 5.0}})


def test_command_line(spark, tmp_path):
    (tmp_path / "lot.csv").write_text("image,session,text\na.jpg,s,GJ00001\nb.jpg,s,GJ00002\n", encoding="utf-8")
    for name, second in (("good", "GJ00002"), ("bad", "GJ00003")):
        (tmp_path / f"{name}.jsonl").write_text(result("a.jpg", "GJ00001") + "\n" + result("b.jpg", second) + "\n", encoding="utf-8")
        assert main(["evaluate", str(tmp_path / "lot.csv"), str(tmp_path / f"{name}.jsonl"), str(tmp_path / name)]) == 0
    reports = [str(tmp_path / n / "lot_all_local.json") for n in ("good", "bad")]
    assert main(["compare", *reports]) == 1 and main(["compare", *reports[::-1]]) == 0
    assert main(["evaluate", str(tmp_path / "lot.csv"), str(tmp_path / "good.jsonl"), str(tmp_path / "x"), "--split", "none"]) == 2
    assert main(["prelabel", str(tmp_path / "pre"), str(tmp_path / "good.jsonl"), str(tmp_path / "bad.jsonl")]) == 0
    shown = (tmp_path / "pre" / "review.html").read_text(encoding="utf-8")
    assert shown.index("b.jpg") < shown.index("a.jpg")
    (tmp_path / "c.json").write_text(LOT.to_json(), encoding="utf-8")
    spark.createDataFrame([("GJ 00001",), ("?",)], "text string").write.parquet(str(tmp_path / "in"))
    assert main(["match", str(tmp_path / "c.json"), str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert sorted((r["fitted"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("?", None), ("GJ00001", "primary")]


def test_sql_functions(spark):
    register(spark, LOT)
    assert [tuple(r) for r in spark.sql("SELECT match_kind('GJ00001'), match_kind('GJ00001\\n'), match_kind('?'), reading_status(0.3)").collect()] == [("primary", None, None, "review")]
    rows = spark.sql("SELECT d.code, d.position, d.states FROM VALUES ('a{0}'), ('ab') AS t(p), LATERAL pattern_diagnostics(t.p) d ORDER BY d.states").collect()
    assert [tuple(r) for r in rows] == [("invalid_quantifier", 1, None), (None, None, 3)]


def test_page_escapes():
    text = page("<t>", [{"image": "<i>", "session": "", "tag_id": "", "text": '"</script>', "ai_1": "<a>", "ai_2": "", "priority": 0}])
    assert "<i>" not in text and "</script>\"" not in text and "&lt;t&gt;" in text


def test_pages_keep_photos_together(spark, tmp_path):
    rows = [(f"p{i // 3}", "s", i % 3, "t", "k", "t", "", 0 if i < 3 else 3) for i in range(30)]
    frame = spark.createDataFrame(rows, "image string, session string, row_no int, text string, tag_id string, ai_1 string, ai_2 string, priority int")
    pictures = spark.createDataFrame([("p1", bytearray(b"jpg"))], "image string, picture binary")
    paths = write_review(frame, str(tmp_path), "r", pictures, most=10)
    bodies = [open(p, encoding="utf-8").read() for p in paths]
    assert [b.count("data-row=") for b in bodies] == [12, 12, 6] and sum(b.count("base64,anBn") for b in bodies) == 3 and bodies[0].index("p0") < bodies[0].index("p1")


def test_models(spark, tmp_path):
    raw = b"model"
    doc = {"name": "m", "files": [{"name": "f.onnx", "url": "u", "sha256": hashlib.sha256(raw).hexdigest(), "size": 5}], "detection": {"threshold": 0.3}, "charset": "ab"}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    (m,) = manifests(tmp_path)
    assert m.classes == ["", "a", "b", " "]
    asked = []
    opener = lambda url: asked.append(url) or io.BytesIO(raw)
    for _ in range(2):
        paths = list(fetch(m, opener, tmp_path / "cache"))
    assert asked == ["u"] and ship(spark, paths) == ["f.onnx"]
    with pytest.raises(ModelError):
        list(fetch(m, lambda url: io.BytesIO(b"other"), tmp_path / "bad"))
    with pytest.raises(ModelError):
        Manifest.from_json("{}")

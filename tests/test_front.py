"""Pixels to results with fakes in place of models, images, the command line, the server and run-time settings."""

from __future__ import annotations

import base64
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import server
from lectern.__main__ import main
from lectern.catalog import Catalog, Kind
from lectern.operators import front
from lectern.plans import reading
from lectern.sources import images, runtime
from lectern.sources.models import ModelError

DIGITS = Catalog("digits", (Kind("pair", r"\d{2}"),))
CLASSES = ["", *"0123456789"]


class Stripes:
    """A fake detector: every run of rows with light pixels is a line."""

    def detect(self, pixels):
        light = (pixels.max(axis=(1, 2)) > 0).astype(int)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], light, [0]])))
        w = pixels.shape[1]
        return [{"quad": [(0, a), (w, a), (w, b), (0, b)], "score": 0.9} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


class Shades:
    """A fake recogniser: a column's shade says its digit (10 a step); dark columns are blanks."""

    classes = CLASSES

    def probabilities(self, pixels):
        out = []
        for shade in pixels[:, :, 0].mean(axis=0)[4::8]:
            row = np.full(len(CLASSES), 0.001)
            row[round(shade / 20)] = 1 - 0.001 * (len(CLASSES) - 1)
            out += [row, np.eye(len(CLASSES))[0] * 0.99 + 0.0001]
        return np.array(out)


class Codes:
    def decode(self, pixels):
        return [{"text": " 77 ", "symbology": "QR", "quad": [(0, 0), (1, 0), (1, 1), (0, 1)], "angle": 370}, {"text": " ", "symbology": "QR", "quad": [], "angle": 0}] if pixels[0, 0, 2] == 9 else []


def fakes():
    return CLASSES, Stripes, Shades, Codes


def photo(*numbers, code=False):
    """A pixel map with a stripe for each number."""
    rows = [np.zeros((4, 16, 3))]
    for n in numbers:
        stripe = np.zeros((8, 16, 3))
        stripe[:, :8], stripe[:, 8:] = 20 * (n // 10 + 1), 20 * (n % 10 + 1)
        rows += [stripe, np.zeros((4, 16, 3))]
    pixels = np.concatenate(rows).astype(np.uint8)
    if code:
        pixels[0, 0, 2] = 9
        pixels[0, 0] = 0, 0, 9
        pixels[0] = 0
        pixels[0, 0, 2] = 9
    return images.PixelMap().encode(pixels)


def test_read_local(spark):
    photos = spark.createDataFrame([("a", bytearray(photo(12, 34))), ("b", bytearray(b"broken")), ("c", bytearray(photo()))], "image string, content binary")
    got = {r["image"]: r for r in reading.read_local(photos, CLASSES, DIGITS, Stripes, Shades, make=images.PixelMap).collect()}
    assert {t["text"] for t in got["a"]["tags"]} == {"12", "34"} and all(t["tag_id"] == "pair" for t in got["a"]["tags"])
    assert got["b"]["error"] and got["b"]["tags"] == [] and got["c"]["tags"] == [] and got["c"]["error"] is None
    codes = front.decoded(photos.unionByName(spark.createDataFrame([("d", bytearray(photo(code=True)))], "image string, content binary")), Codes, make=images.PixelMap)
    found = {(r["photo"], r["text"], r["angle"], r["error"] is not None) for r in codes.collect()}
    assert found == {("b", None, None, True), ("d", "77", 10.0, False)}


def test_crop_and_turns():
    pixels = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    assert np.array_equal(front.crop(pixels, [(3, 2), (13, 2), (13, 8), (3, 8)]), pixels[2:8, 3:13])
    turned = front.crop(pixels, [(13, 8), (3, 8), (3, 2), (13, 2)])
    assert np.array_equal(turned, pixels[2:8, 3:13][::-1, ::-1])
    assert front.turns_of(np.zeros((13, 10, 3))) == (0, 180, 90, 270) and front.turns_of(np.zeros((12, 10, 3))) == (0, 180)
    assert front.crop(pixels, [(5, 5)] * 4).shape == (2, 2, 3)


class Session:
    """A fake of a model session: the map is the red channel, or class i where a column is i."""

    def __init__(self, classes=None):
        self.classes, self.seen = classes, []

    def get_inputs(self):
        return [type("Input", (), {"name": "x"})]

    def run(self, _, feed):
        x = feed["x"]
        self.seen.append(x.shape)
        return [x[:, :1]] if self.classes is None else [np.eye(self.classes)[np.zeros(x.shape[3], int)][None]]


def test_onnx_wrappers():
    pixels = np.zeros((100, 200, 3), np.uint8)
    pixels[20:40, 40:160] = 255
    settings = {"mean": [0, 0, 0], "std": [1, 1, 1], "multiple_of": 32, "limit_side": 128, "threshold": 0.3, "box_threshold": 0.5, "unclip_ratio": 1.5}
    session = Session()
    (line,) = front.OnnxDetector(session, settings).detect(pixels)
    xs, ys = zip(*line["quad"], strict=True)
    assert session.seen == [(1, 3, 64, 128)] and min(xs) < 40 and max(xs) > 160 and 5 < min(ys) < 20 and max(ys) > 40 and line["score"] > 0.9
    read = front.OnnxRecognizer(Session(4), {"mean": [0.5] * 3, "std": [0.5] * 3, "height": 48, "min_width": 320, "max_width": 3200, "channel_order": "BGR"}, list("abcd"))
    assert read.probabilities(pixels).shape == (320, 4) and read.session.seen == [(1, 3, 48, 320)]
    with pytest.raises(ValueError, match="classes"):
        front.OnnxRecognizer(Session(3), read.settings, list("abcd")).probabilities(pixels)


def test_images(spark):
    stored = np.zeros((2, 3, 3), np.uint8)
    stored[0, 0] = 255  # the corner that shows the turn
    corner = {o: tuple(np.argwhere(images.upright(stored, o)[0][:, :, 0])[0].tolist()) for o in range(1, 9)}
    assert corner == {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (2, 1), 8: (2, 0)}
    assert [images.upright(stored, o)[1] for o in (0, 1, 3, 6, 8, 9)] == [0, 0, 180, 90, 270, 0]
    flat = np.full((40, 60, 3), 7, np.uint8)
    assert np.array_equal(images.resized(flat, 13, 9), np.full((9, 13, 3), 7)) and np.array_equal(images.resized(flat[:3, :3], 9, 9), np.full((9, 9, 3), 7))
    rows = spark.createDataFrame([(0, bytearray(images.PixelMap().encode(flat))), (1, bytearray(b"P6 9 9 255 x")), (2, None)], "i int, content binary")
    got = {r["i"]: r["p"] for r in rows.select("i", images.prepared(F.col("content"), 30, images.PixelMap).alias("p")).collect()}
    assert (got[0]["width"], got[0]["height"], got[0]["scale"], got[0]["exif_rotation"]) == (60, 40, 2.0, 0) and got[1]["error"] and got[2]["error"]
    small = rows.where("i = 0").select(images.thumbnail(F.col("content"), 6, images.PixelMap)).first()[0]
    assert images.PixelMap().decode(bytes(small))[0].shape == (4, 6, 3)
    with pytest.raises(ValueError):
        images.prepared(F.lit(None), 0)


def test_runtime(tmp_path):
    assert runtime.installed("json") and not runtime.installed("no_such_module") and not runtime.installed("no_such.sub")
    assert runtime.execution_providers("cpu") == [runtime.CPU] and runtime.execution_providers("auto", [runtime.CPU]) == [runtime.CPU]
    assert runtime.execution_providers("cuda", [runtime.CPU, runtime.CUDA]) == [runtime.CUDA, runtime.CPU]
    with pytest.raises(ModelError):
        runtime.execution_providers("cuda", [runtime.CPU])
    with pytest.raises(ValueError):
        runtime.execution_providers("gpu")
    assert runtime.allowed_cpus(tmp_path) is None
    (tmp_path / "cpu").mkdir()
    for quota, want in (("150000", 1.5), ("-1", None)):
        (tmp_path / "cpu" / "cpu.cfs_quota_us").write_text(quota)
        (tmp_path / "cpu" / "cpu.cfs_period_us").write_text("100000")
        assert runtime.allowed_cpus(tmp_path) == want
    for line, want in (("max 100000", None), ("50000 100000", 0.5)):
        (tmp_path / "cpu.max").write_text(line)
        assert runtime.allowed_cpus(tmp_path) == want
    assert runtime.usable_cpus(tmp_path) == 1
    with pytest.raises(ModelError):
        runtime.session(str(tmp_path / "none.onnx"))


def test_read_run_and_models(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(images, "codec", images.PixelMap)
    folder = tmp_path / "photos"
    folder.mkdir()
    (folder / "b.png").write_bytes(photo(12))
    (folder / "a.jpg").write_bytes(photo(34))
    (tmp_path / "c.json").write_text(DIGITS.to_json(), encoding="utf-8")
    options = ["--catalog", str(tmp_path / "c.json"), "--models", "test_front:fakes", "--table", str(tmp_path / "table")]
    assert main(["read", str(folder), *options, "--out", str(tmp_path / "out"), "--parts", "2"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(x["file"], x["result"]["tags"][0]["text"]) for x in lines] == [("a.jpg", "34"), ("b.png", "12")] and (tmp_path / "out" / "a.jpg.json").is_file()
    (folder / "broken.jpg").write_bytes(b"?")
    assert main(["read", str(folder), *options]) == 1
    (tmp_path / "lot.csv").write_text('image,session,text\na.jpg,s,34\n"b.png",s,13\n', encoding="utf-8")
    assert main(["run", str(tmp_path / "lot.csv"), str(folder), *options, "--reports", str(tmp_path / "reports"), "--price", "1", "2"]) == 0
    (report,) = (tmp_path / "reports").glob("*.json")
    assert json.loads(report.read_text())["metrics"]["exact_match_rate"] == 0.5
    assert main(["run", str(tmp_path / "lot.csv"), str(folder), *options, "--split", "none"]) == 2
    (tmp_path / "known").mkdir()
    (tmp_path / "known" / "m.json").write_text(json.dumps({"name": "m", "files": [], "detection": {}, "charset": "a"}))
    assert main(["models", "list", "--manifests", str(tmp_path / "known")]) == 0 and main(["models", "path"]) == 0 and main(["models", "download", "x", "--manifests", str(tmp_path / "known")]) == 1


def ask(url, body=None, token=None):
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=10) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())["error"]["code"]


def test_server():
    config = server.ServerConfig.from_env({"LECTERN_MODEL": "m", "LECTERN_TOKEN": "secret", "LECTERN_MAX_BYTES": "2000", "LECTERN_THREADS": "3"})
    assert (config.threads, config.concurrency) == (3, 2)
    for bad in ({}, {"LECTERN_MODEL": "m", "LECTERN_DEVICE": "x"}, {"LECTERN_MODEL": "m", "LECTERN_THREADS": "0"}):
        with pytest.raises(server.ConfigError):
            server.ServerConfig.from_env(bad)

    def read(content, catalog):
        if content == b"bad":
            raise ValueError("no image")
        return {"tags": [k.tag_id for k in catalog.kinds], "bytes": len(content)}

    catalog, image = json.loads(DIGITS.to_json()), lambda b: base64.b64encode(b).decode()
    for reader, ready in ((read, True), (None, False)):
        running = server.make_server(config, reader, [{"name": "m", "bytes": 1}])
        threading.Thread(target=running.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{running.server_port}"
        assert ask(f"{url}/ping") == (200, {"status": "ok"}) and ask(f"{url}/v1/health") == (401, "unauthorized")
        assert ask(f"{url}/v1/health", token="secret")[1]["ready"] == ready and ask(f"{url}/v1/models", token="secret")[1] == {"models": [{"name": "m", "bytes": 1}]}
        assert ask(f"{url}/v1/none", token="secret") == (404, "not_found")
        assert ask(f"{url}/v1/read", {"catalog": catalog, "image": image(b"abc")}, "secret") == ((200, {"tags": ["pair"], "bytes": 3}) if ready else (503, "model_unavailable"))
        assert ask(f"{url}/v1/read", {"catalog": {}, "image": image(b"abc")}, "secret") == (400, "bad_catalog") and ask(f"{url}/v1/read", {"x": 1}, "secret") == (400, "bad_request")
        assert ask(f"{url}/v1/read", {"catalog": catalog, "image": "?"}, "secret") == (400, "bad_image") and ask(f"{url}/v1/read", {"catalog": catalog, "image": "a" * 3000}, "secret") == (413, "too_large")
        if ready:
            assert ask(f"{url}/v1/read", {"catalog": catalog, "image": image(b"bad")}, "secret") == (400, "bad_image")
        running.shutdown()

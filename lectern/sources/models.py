"""Model files: manifests, verified downloads into a cache, and shipping to executors."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import SparkSession


class ModelError(RuntimeError):
    """A manifest or a model file is not what it should be."""


@dataclass(frozen=True)
class ModelFile:
    """Where a file comes from and what it must be."""

    name: str
    url: str
    sha256: str
    size: int


@dataclass(frozen=True)
class Manifest:
    """A model: its files, detection parameters and character classes (class 0 is blank)."""

    name: str
    files: tuple[ModelFile, ...]
    detection: dict[str, float]
    charset: str
    space: bool

    @property
    def classes(self) -> list[str]:
        """Class names in order."""
        return ["", *self.charset, *([" "] if self.space else [])]

    @property
    def size(self) -> int:
        """Bytes of all files."""
        return sum(f.size for f in self.files)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        """Load a manifest; anything missing is a ModelError."""
        try:
            d = json.loads(text)
            files = tuple(ModelFile(f["name"], f["url"], f["sha256"].lower(), int(f["size"])) for f in d["files"])
            return cls(d["name"], files, {k: float(v) for k, v in d["detection"].items()}, d["charset"], bool(d.get("space", True)))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ModelError(f"bad manifest: {e!r}") from None


def manifests(folder: str | Path) -> list[Manifest]:
    """All manifests of a folder, smallest model first."""
    return sorted((Manifest.from_json(p.read_text(encoding="utf-8")) for p in Path(folder).glob("*.json")), key=lambda m: (m.size, m.name))


def cache_folder() -> Path:
    """LECTERN_CACHE, else a folder under the user's cache."""
    return Path(os.environ.get("LECTERN_CACHE") or Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "lectern")


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(manifest: Manifest, opener: Callable[[str], BinaryIO], folder: Path | None = None) -> Iterator[Path]:
    """Paths of the model's files; missing or wrong ones are fetched beside their place, checked and moved there."""
    target = (folder or cache_folder()) / manifest.name
    target.mkdir(parents=True, exist_ok=True)
    for f in manifest.files:
        path = target / f.name
        if not (path.is_file() and path.stat().st_size == f.size and _digest(path) == f.sha256):
            part = path.with_name(path.name + ".part")
            with opener(f.url) as source, part.open("wb") as out:
                shutil.copyfileobj(source, out)
            if part.stat().st_size != f.size or _digest(part) != f.sha256:
                part.unlink()
                raise ModelError(f"{f.name}: size or SHA-256 differs from the manifest")
            part.replace(path)
        yield path


def ship(spark: SparkSession, paths: list[Path]) -> list[str]:
    """Send files to every executor; there SparkFiles.get(name) finds them."""
    for p in paths:
        spark.sparkContext.addFile(str(p))
    return [p.name for p in paths]

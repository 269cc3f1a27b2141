"""Catalogs of identifier kinds: strict loading, and kinds as column expressions."""

from __future__ import annotations

import json
import re

from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import grammar
from lectern.functions.binding import let
from lectern.grammar import Automaton, PatternError

SCHEMA_VERSION = "1.0"
KIND_ID = r"[A-Za-z][A-Za-z0-9_-]{0,63}"
MAX_HEADER = 200


class CatalogError(ValueError):
    """A catalog document is wrong; location names the place, such as tags[1].pattern."""

    def __init__(self, message: str, location: str = "") -> None:
        self.location = location
        super().__init__(f"{location}: {message}" if location else message)


@dataclass(frozen=True)
class Kind:
    """One kind of identifier: what its texts look like and, maybe, the header printed beside it."""

    tag_id: str
    pattern: str
    header: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.tag_id, str) or not re.fullmatch(KIND_ID, self.tag_id):
            raise CatalogError("an id is a letter and up to 63 letters, digits, _ or -", "id")
        if self.header is not None and not (isinstance(self.header, str) and self.header.strip() and len(self.header) <= MAX_HEADER):
            raise CatalogError(f"a header is 1 to {MAX_HEADER} characters, not all blank", "header")
        try:
            grammar.compile_pattern(self.pattern)
        except TypeError as e:
            raise CatalogError(str(e), "pattern") from None

    @cached_property
    def automaton(self) -> Automaton:
        """The compiled pattern."""
        return grammar.compile_pattern(self.pattern)


@dataclass(frozen=True)
class Catalog:
    """An ordered set of kinds; the first that fits a text names it."""

    name: str
    kinds: tuple[Kind, ...] = ()
    per_individual: int = 1
    _by_id: dict[str, Kind] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise CatalogError("a name is a non-empty string", "name")
        if isinstance(self.per_individual, bool) or not isinstance(self.per_individual, int) or self.per_individual < 1:
            raise CatalogError("a whole number from 1 on", "tags_per_individual")
        for i, kind in enumerate(self.kinds):
            if self._by_id.setdefault(kind.tag_id, kind) is not kind:
                raise CatalogError(f"the id {kind.tag_id!r} is taken", f"tags[{i}].id")

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """Load a document; duplicate keys, NaN and infinities are faults."""

        def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
            found: dict[str, Any] = {}
            for key, value in pairs:
                if key in found:
                    raise CatalogError(f"the key {key!r} stands twice")
                found[key] = value
            return found

        def constant(name: str) -> None:
            raise CatalogError(f"{name} is no JSON number")

        try:
            data = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
        except json.JSONDecodeError as e:
            raise CatalogError(f"no JSON: {e.msg}") from None
        return cls.from_dict(data)

    @classmethod
    def from_file(cls, path: str | Path) -> Catalog:
        """Load a UTF-8 file."""
        return cls.from_json(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def from_dict(cls, data: Any) -> Catalog:
        """Load a document that is parsed already."""
        _shape(data, {"schema_version": True, "name": True, "tags_per_individual": True, "tags": True}, "")
        if data["schema_version"] != SCHEMA_VERSION:
            raise CatalogError(f"only {SCHEMA_VERSION} is known", "schema_version")
        if not isinstance(data["tags"], list):
            raise CatalogError("tags is an array", "tags")
        kinds = []
        for i, raw in enumerate(data["tags"]):
            at = f"tags[{i}]"
            _shape(raw, {"id": True, "pattern": True, "header": False}, at)
            if "header" in raw and raw["header"] is None:
                raise CatalogError("null is no header; leave the key out", f"{at}.header")
            try:
                kinds.append(Kind(raw["id"], raw["pattern"], raw.get("header")))
            except PatternError as e:
                raise CatalogError(str(e.at(f"{at}.pattern")), f"{at}.pattern") from e
            except CatalogError as e:
                raise CatalogError(str(e), f"{at}.{e.location}") from None
        return cls(data["name"], tuple(kinds), data["tags_per_individual"])

    def to_dict(self) -> dict[str, Any]:
        """The document this catalog loads from."""
        tags = [{"id": k.tag_id, "pattern": k.pattern} | ({"header": k.header} if k.header is not None else {}) for k in self.kinds]
        return {"schema_version": SCHEMA_VERSION, "name": self.name, "tags_per_individual": self.per_individual, "tags": tags}

    def to_json(self) -> str:
        """The document as JSON."""
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def kind(self, tag_id: str) -> Kind:
        """The kind with that id; KeyError without one."""
        return self._by_id[tag_id]

    def match(self, text: str) -> str | None:
        """The id of the first kind whose pattern fits the whole text, on the driver."""
        return next((k.tag_id for k in self.kinds if k.automaton.matches(text)), None)

    def kind_of(self, text: Column) -> Column:
        """match() as an expression; CASE stops at the first kind that fits."""
        out: Column | None = None
        for k in self.kinds:
            hit = grammar.matches(text, k.pattern)
            out = F.when(hit, k.tag_id) if out is None else out.when(hit, k.tag_id)
        return F.lit(None).cast("string") if out is None else out

    def fits(self, text: Column) -> Column:
        """Whether some kind fits, never null."""
        return self.kind_of(text).isNotNull()

    def best_kind(self, text: Column, current: Column, seen: Column) -> Column:
        """Among fitting kinds: header in the array seen, then no header, then header unseen.

        current stays where it is among the best; else the first of them in order. Texts
        that fit nothing keep current.
        """
        if not self.kinds:
            return current
        ranks = F.array(*(F.when(grammar.matches(text, k.pattern), F.lit(1) if k.header is None else F.when(F.array_contains(seen, k.tag_id), 0).otherwise(2)) for k in self.kinds))
        names = F.array(*(F.lit(k.tag_id) for k in self.kinds))

        def pick(rank: Column) -> Column:
            winners = F.filter(names, lambda _, i: F.get(rank, i) == F.array_min(rank))
            keep = F.array_min(rank).isNull() | F.coalesce(F.array_contains(winners, current), F.lit(False))
            return F.when(keep, current).otherwise(F.try_element_at(winners, F.lit(1)))

        return let(ranks, pick)

    def kinds_frame(self, spark: SparkSession) -> DataFrame:
        """One row per kind, with its length bounds and regular expression."""
        rows = [(i, k.tag_id, k.pattern, k.header, grammar.regex(k.pattern), k.automaton.span.low, k.automaton.span.high) for i, k in enumerate(self.kinds)]
        return spark.createDataFrame(rows, "ord int, tag_id string, pattern string, header string, regex string, min_len int, max_len int")


def _shape(raw: Any, keys: dict[str, bool], at: str) -> None:
    if not isinstance(raw, dict):
        raise CatalogError("an object is expected", at)
    dot = f"{at}." if at else ""
    for key in raw:
        if key not in keys:
            raise CatalogError("this key is unknown", f"{dot}{key}")
    for key, needed in keys.items():
        if needed and key not in raw:
            raise CatalogError("this key is missing", f"{dot}{key}")



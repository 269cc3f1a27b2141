"""Personal data: pattern spans, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers;
each distinct value is a protected entity. Over whole texts and the whole corpus,
a term that shares texts with an entity discloses it by PMI(term; entity) /
IC(entity): the share of the information needed to name the entity that seeing
the term supplies. Terms past the threshold become spans of kind term wherever
they stand, to be generalised or removed like the patterns' own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as W
from lectern.llm.shared import Stages

KINDS = ("email", "ip", "card", "phone")
#: Words on either side that are a context, different contexts that count as evidence, and the share of information that discloses.
NEAR = 8
SUPPORT = 3
THRESHOLD = 0.8
#: Texts an entity may be in before its own limit on common terms is looked up; common terms and such entities known to each task; rows in a batch.
LIGHT = 100
KNOWN = 200_000
BATCH_ROWS = 100_000
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four patterns, by kind as listed, then start; linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, done := m.end()))
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return W.hash_text(word, lower=True)


def _fingerprint(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def entity_of(text: str, span: tuple[str, int, int]) -> int:
    """A 64-bit number of the protected value."""
    kind, a, b = span
    value = text[a:b].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[a:b])
    return _fingerprint(f"{kind}:{value}")


def _entities(df: DataFrame, text: str) -> DataFrame:
    """body and entities (entity, spans) of the texts that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, found = [], []
            for x in batch.column(0):
                body = x.as_py() or ""
                count: dict[int, int] = {}
                for s in base_spans(body):
                    e = entity_of(body, s)
                    count[e] = count.get(e, 0) + 1
                if count:
                    bodies.append(body)
                    found.append([{"entity": e, "spans": n} for e, n in count.items()])
            kind = pa.list_(pa.struct([("entity", pa.int64()), ("spans", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()), pa.array(found, kind)], names=["body", "entities"])

    return df.select(text).mapInArrow(run, "body string, entities array<struct<entity:long,spans:long>>")


def evidence(text: str, wanted: Callable[[int], bool], near: int = NEAR) -> Iterator[tuple[int, int, int, int]]:
    """(entity, term hash, context, 1 once for each pair or 0) of every term of a text with every wanted entity in it.

    The context of a term within near words of the entity is the words around the
    entity; of a term farther off, those around its first place and the entity.
    """
    spans = base_spans(text)
    held: dict[int, list[tuple[int, int]]] = {}
    for s in spans:
        if wanted(e := entity_of(text, s)):
            held.setdefault(e, []).append(s[1:])
    if not held:
        return
    words = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    gone: set[int] = set()
    for _, a, b in spans:
        gone.update(range(bisect_right(ends, a), bisect_left(starts, b)))
    terms = {i: _hash(w) for i, (a, b, w) in enumerate(words) if b - a >= 3 and not w.isdigit() and i not in gone}
    places: dict[int, int] = {}
    for i, h in terms.items():
        places.setdefault(h, i)
    around: dict[int, int] = {}
    for e, own in held.items():
        seen: set[int] = set()
        first = None
        for a, b in own:
            lo, hi = bisect_right(ends, a), bisect_left(starts, b)
            window = [*range(max(0, lo - near), lo), *range(hi, min(len(words), hi + near))]
            mark = _fingerprint(" ".join(words[i][2] for i in window))
            first = mark if first is None else first
            for h in {terms[i] for i in window if i in terms}:
                yield e, h, mark, int(h not in seen)
                seen.add(h)
        for h, i in places.items():
            if h not in seen:
                if h not in around:
                    around[h] = _fingerprint(" ".join(w[2] for w in words[max(0, i - near) : i + near + 1]))
                yield e, h, around[h] ^ first, 1


def _pairs(held: DataFrame, bits: np.ndarray, common: dict[int, int], heavy: dict[int, int], light: int, total: int, threshold: float) -> DataFrame:
    """evidence of texts, without pairs whose term stands in too many texts to disclose the entity whatever they share."""

    def limit(n_e: int) -> float:
        return n_e * 2 ** ((1 - threshold) * max(math.log2(total / n_e), 1e-9)) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, rows = {}, []
        wanted = lambda e: bits[(e & 0x7FFFFF) >> 3] >> (e & 7) & 1 == 1
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["entity", "term", "mark", "docs"])
        for batch in batches:
            for x in batch.column(0):
                for row in evidence(x.as_py(), wanted):
                    e, h = row[:2]
                    n_t = common.get(h)
                    if n_t is not None:
                        if e not in limits:
                            limits[e] = limit(heavy.get(e, light))
                        if n_t > limits[e]:
                            continue
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield pack()
                        rows = []
        if rows:
            yield pack()

    return held.select("body").mapInArrow(run, "entity long, term long, mark long, docs long")


def _frequencies(df: DataFrame, text: str) -> DataFrame:
    """Texts that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in W.slices(batch.column(0)):
                starts, ends, first = W.words(buf, off, W.NOT_ALNUM)
                term, which = np.unique(W.hashes(buf, starts, ends, lower=True), return_inverse=True)
                held = np.unique(W.owner(first) * max(len(term), 1) + which) % max(len(term), 1)
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(np.bincount(held, minlength=len(term)).astype(np.int64))], names=["term", "n"])

    return df.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _filter_bits(numbers: Column, rows: DataFrame) -> np.ndarray:
    """2**23 bits, set at the low bits of each number; built by aggregation, 256 rows to the driver at most."""
    low = numbers.bitwiseAND(F.lit(0x7FFFFF))
    rows = (
        rows.select((low / 32768).cast("int").alias("part"), (low % 32768).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros((256, 4096), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def disclosing(df: DataFrame, text: str, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame | None:
    """(entity, term) pairs whose term discloses the entity, or None where nothing has enough evidence.

    Evidence is different contexts: copies of a passage count once. The share is
    over whole documents, copies too: those with the pair, the term and the entity.
    Entities with fewer places than support and terms in too many documents are
    passed over early, which loses no pair.
    """
    stages = Stages(df.sparkSession, "pii")
    held = stages.save(_entities(df, text), "held")
    entities = held.select(F.inline("entities")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.sum("spans").alias("spans"))
    entities = stages.save(entities.where(F.col("spans") >= support).select("entity", "n_e"), "entities")
    bits = _filter_bits(F.col("entity"), entities)
    if not bits.any():
        return None
    total = df.count()
    terms = stages.save(_frequencies(df, text), "terms")

    def most(rows: DataFrame, key: str, n: str, above: float) -> tuple[dict[int, int], int]:
        """The KNOWN most frequent above a bound, and the largest count left out."""
        top = rows.where(F.col(n) > above).orderBy(F.desc(n)).limit(KNOWN).toArrow().to_pydict()
        return dict(zip(top[key], top[n], strict=True)), (top[n][-1] if len(top[n]) == KNOWN else math.floor(above))

    heavy, light = most(entities, "entity", "n_e", LIGHT)
    common, _ = most(terms, "term", "n_t", min(light, total))
    pairs = _pairs(held, bits, common, heavy, min(light, total), total, threshold)
    pairs = pairs.groupBy("entity", "term", "mark").agg(F.sum("docs").alias("docs")).groupBy("entity", "term").agg(F.sum("docs").alias("n_et"), F.count(F.lit(1)).alias("n_marks"))
    joined = pairs.where(F.col("n_marks") >= support).join(entities, "entity").join(terms, "term")
    information = F.greatest(F.log2(F.lit(float(total)) / F.col("n_e")), F.lit(1e-9))
    share = 1 + F.log2(F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))) / information
    return joined.where(share >= threshold).select("entity", "term")


def sanitise(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), support: int = SUPPORT, threshold: float = THRESHOLD, manner: str = "mask") -> DataFrame:
    """One row per input row: the columns of keep, base and added spans (kind, start, end in code points), sanitised text.

    added: every place of a disclosing term, in texts without its entity too, but
    not where a pattern's span is. manner: one of MANNERS, how spans leave the text.
    Null texts count as empty and have no span; a text of any length is read whole;
    repeated rows count as documents of their own; an empty table gives an empty
    result. Only keep and text are read, so other columns cannot clash. Each task is sent the disclosing terms, 8
    bytes each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if manner not in MANNERS:
        raise ValueError(f"manner is one of {', '.join(MANNERS)}")
    keep = list(keep)
    full = StructType([df.schema[c] for c in keep] + StructType.fromDDL(MARKED).fields)
    schema = to_arrow_schema(full)
    pairs = disclosing(df, text, support, threshold)
    terms = np.zeros(0, np.int64) if pairs is None else np.sort(pairs.select("term").distinct().toArrow()["term"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in W.slices(batch.column(len(keep))):
                at = _places(buf, off, terms)
                cols: list[list] = [[], [], []]
                for i in range(lo, hi):
                    body = batch.column(len(keep))[i].as_py() or ""
                    base = base_spans(body)
                    added = [("term", a, b) for a, b in _outside(at.get(i - lo, []), base)]
                    for to, x in zip(cols, (base, added), strict=False):
                        to.append([{"kind": k, "start": a, "end": b} for k, a, b in x])
                    cols[2].append(redact(body, [*base, *added], manner))
                kept = [batch.column(i).slice(lo, hi - lo).cast(schema.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, schema.field(len(keep) + i).type) for i, c in enumerate(cols)], schema=schema)

    return df.select(*keep, text).mapInArrow(run, full)


MARKED = "base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>, sanitised string"


def _places(buf: np.ndarray, off: np.ndarray, terms: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Starts and ends in code points of the words among terms (sorted hashes), by text number."""
    if not len(terms):
        return {}
    starts, ends, first = W.words(buf, off, W.NOT_ALNUM)
    h = W.hashes(buf, starts, ends, lower=True).astype(np.int64)
    hit = np.flatnonzero(terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] == h)
    if not len(hit):
        return {}
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    text = W.owner(first)[hit]
    out: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip(text.tolist(), (points[starts[hit]] - points[off[text]]).tolist(), (points[ends[hit]] - points[off[text]]).tolist(), strict=True):
        out.setdefault(i, []).append((a, b))
    return out


def _outside(places: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Those of places, in order, that overlap no span."""
    ends = [b for _, b in places]
    starts = [a for a, _ in places]
    gone: set[int] = set()
    for _, a, b in spans:
        gone.update(range(bisect_right(ends, a), bisect_left(starts, b)))
    return [x for i, x in enumerate(places) if i not in gone]


#: How spans leave the text: their kind in their place, a more general value of the kind, or nothing.
MANNERS = ("mask", "generalise", "remove")


def general(kind: str, value: str) -> str:
    """A value that many share: an address's last domain, an IP's first number, a card's first digit, a phone's country code, a term's shape."""
    if kind == "email":
        return f"*@*.{value.rpartition('.')[2]}"
    if kind == "ip":
        return f"{value.partition('.')[0]}.*.*.*"
    if kind == "card":
        return f"{value[0]}***"
    if kind == "phone":
        return f"{re.split('[^0-9]', value[1:])[0][:3]}".join(("+", "***"))
    return "[CODE]" if any(c.isdigit() for c in value) else "[NAME]" if value[:1].isupper() else "[TERM]"


def redact(text: str | None, spans: list[tuple[str, int, int]], manner: str = "mask") -> str:
    """text with each span masked, generalised or removed; overlapping spans become one."""
    out, at, body = [], 0, text or ""
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [body[at:a], f"[{kind.upper()}]" if manner == "mask" else general(kind, body[a:b]) if manner == "generalise" else ""]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]

"""Scores, statuses and the rules that keep a reading from being accepted silently.

All are plain column expressions over codegen-friendly built-ins. Thresholds are
arguments: readers differ in them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.functions.binding import let

ACCEPT, REVIEW = 0.9, 0.25
# Confidences of provider answers.
CERTAIN_FITS, OTHER_FITS, ALTERNATIVE_FITS, NO_FIT = 0.95, 0.6, 0.4, 0.3
DECAY, UNREADABLE_FACTOR = 0.9, 0.3
# Where local readings become sure, and what one that is not can reach.
AGREEMENT_FLOOR, DISAGREEMENT_CEILING = 0.3, 0.89
# Characters that read as another one upside down, and those one stroke apart.
TURNED_SELF = "018HINOSXZlosxz-/ "
TURNED, TURNED_TO = "69MWbqdpnu", "96WMqbpdun"
STROKE, STROKE_TO = "S5O0I1B8Z2G6", "5S0O1I8B2Z6G"
# Python's white space, which is wider than Java's \s
SPACE = r"[\t-\r\x1c-\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def without_spaces(text: Column) -> Column:
    """text without any white space."""
    return F.regexp_replace(text, SPACE, "")


def collapsed(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def check_thresholds(accept: float, review: float) -> None:
    """ValueError unless 0 <= review <= accept <= 1."""
    if not 0 <= review <= accept <= 1:
        raise ValueError("thresholds must satisfy 0 <= review <= accept <= 1")


def status(confidence: Column, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """accepted, review or unreadable."""
    check_thresholds(accept, review)
    return F.when(confidence >= accept, "accepted").when(confidence >= review, "review").otherwise("unreadable")


def local_score(probability: Column, agrees: Column) -> Column:
    """Confidence of a local reading: high only where the free reading says the same."""
    sure = agrees & (probability >= AGREEMENT_FLOOR)
    return F.when(sure, 0.9 + 0.1 * probability).otherwise(F.least(probability, F.lit(DISAGREEMENT_CEILING)))


def upside_down(text: Column) -> Column:
    """text as it reads turned by half; null where a character has no turned form."""
    known = "".join(f"\\x{{{ord(c):X}}}" for c in TURNED_SELF + TURNED)
    return F.when(text.rlike(rf"\A[{known}]*\z"), F.translate(F.reverse(text), TURNED, TURNED_TO))


def turned_reading(text: Column, catalog: Catalog) -> Column:
    """The upside-down reading where it differs and fits the catalog, else null."""
    return let(upside_down(text), lambda turned: F.when((turned != text) & catalog.fits(turned), turned))


def other_kind_readings(text: Column, tag_id: Column, catalog: Catalog) -> Column:
    """Upper-case readings one look-alike character away that are of another kind, in order."""

    def variants(upper: Column) -> Column:
        def variant(i: Column) -> Column:
            char = F.substring(upper, i, F.lit(1))
            swapped = F.concat(F.substring(upper, F.lit(1), i - 1), F.translate(char, STROKE, STROKE_TO), F.substring(upper, i + 1, F.length(upper)))
            return F.when(F.contains(F.lit(STROKE), char), swapped)

        places = F.when(F.length(upper) > 0, F.sequence(F.lit(1), F.length(upper))).otherwise(F.array().cast("array<int>"))
        swapped = F.filter(F.transform(places, lambda i: variant(i)), lambda v: v.isNotNull())
        return F.array_distinct(F.filter(swapped, lambda v: let(catalog.kind_of(v), lambda k: k.isNotNull() & ~k.eqNullSafe(tag_id))))

    return let(F.upper(text), variants)


def without_stray_spaces(text: Column, catalog: Catalog) -> Column:
    """text where it fits, else text without spaces where that fits, else text."""
    return let(without_spaces(text), lambda compact: F.when(catalog.fits(text), text).when(catalog.fits(compact), compact).otherwise(text))


def fit_code(content: Column, catalog: Catalog) -> Column:
    """array<struct<text, tag_id>>: the readings of a decoded code that fit.

    The whole content, else without spaces, else each part between separators, in
    upper case if only that fits; each reading once, in order.
    """

    def fit(text: Column) -> Column:
        return let(catalog.kind_of(text), lambda k: F.when(k.isNotNull(), F.struct(text.alias("text"), k.alias("tag_id"))))

    def one(text: Column) -> Column:
        return let(fit(text), lambda f: F.when(f.isNotNull(), F.array(f)))

    parts = F.transform(F.split(content, "[^A-Za-z0-9._-]+"), lambda p: F.coalesce(fit(p), let(F.upper(p), fit)))
    return F.coalesce(one(content), let(without_spaces(content), one), F.array_distinct(F.filter(parts, lambda f: f.isNotNull())))


def normalised_header(text: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def tag_likelihood(text: Column) -> Column:
    """struct<likelihood, kind>: how much a text without a fitting kind looks like an identifier."""

    def verdict(likelihood: Column | float, kind: Column | str) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_column(likelihood).alias("likelihood"), as_column(kind).alias("kind"))

    def bonus(condition: Column, points: float) -> Column:
        return F.when(condition, points).otherwise(0.0)

    def judged(m: Column) -> Column:
        value, compact, size, digits, letters, words = (m[c] for c in ("value", "compact", "size", "digits", "letters", "words"))
        points = (
            F.lit(0.55) + F.when(size.between(3, 16), 0.15).otherwise(-0.3) + bonus(words > 3, -0.3)
            + bonus(compact.rlike(r"\A[A-Z]{1,6}[-. /]?[\p{Nd}]"), 0.15) + bonus(compact.rlike(r"[\p{Nd}][-/.][\p{Nd}]"), 0.1)
            + bonus(digits < 2, -0.25) + bonus(letters > 2 * digits, -0.2)
        )
        ruler = value.rlike(r"\A[\p{Nd}]{1,2}( [\p{Nd}]{1,2}){2,}\z")
        scored = let(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), points)), 2), lambda p: verdict(p, F.when(p >= 0.5, "id").otherwise("noise")))
        return F.when(size < 2, verdict(0.02, "noise")).when((digits == 0) & (letters >= 4), verdict(0.1, "header")).when((digits == 0) | ruler, verdict(0.05, "noise")).otherwise(scored)

    def measured(value: Column, compact: Column) -> Column:
        count = lambda kept: F.length(F.regexp_replace(compact, kept, ""))
        words = F.when(value == "", 0).otherwise(F.size(F.split(value, " ")))
        return F.struct(value.alias("value"), compact.alias("compact"), F.length(compact).alias("size"), count(r"[^\p{Nd}]").alias("digits"), count(r"[^\p{L}]").alias("letters"), words.alias("words"))

    return let(collapsed(F.upper(text)), lambda value: let(F.replace(value, F.lit(" "), F.lit("")), lambda compact: let(measured(value, compact), judged)))


CANDIDATES = "array<struct<text:string,confidence:double>>"


def _ranked(items: Column) -> Column:
    """array<struct<text, confidence>> by falling confidence, ties in their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-x["confidence"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def provider_decision(text: Column, legibility: Column, alternatives: Column, catalog: Catalog, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """struct<tag_id, text, confidence, status, candidates> of one answer of a vision provider.

    Gaps are dropped where only that fits; an answer that also fits upside down is
    never certain; each reading is scored by whether and where it fits, the best
    wins, and text outside the catalog is never accepted.
    """
    check_thresholds(accept, review)

    def turned(first: Column) -> Column:
        return let(turned_reading(first, catalog), lambda other: readings(first, other))

    def readings(first: Column, other: Column) -> Column:
        rest = F.transform(alternatives, lambda a: without_stray_spaces(a, catalog))
        rest = let(rest, lambda r: F.when(other.isNull() | F.array_contains(r, other), r).otherwise(F.concat(r, F.array(other))))
        legible = F.when(other.isNotNull() & (legibility == "certain"), "uncertain").otherwise(legibility)
        listed = F.concat(F.filter(F.array(first), lambda t: t != ""), rest)
        scored = F.transform(listed, lambda t, i: F.struct(t.alias("text"), score(t, i, legible).alias("confidence")))
        return let(_ranked(scored), lambda ranked: let(best(ranked), lambda b: decide(ranked, b)))

    def score(reading: Column, i: Column, legible: Column) -> Column:
        leading = F.when(legible == "certain", CERTAIN_FITS).otherwise(OTHER_FITS)
        fitting = F.when(i > 0, ALTERNATIVE_FITS * F.pow(F.lit(DECAY), i - 1)).otherwise(leading)
        base = F.when(catalog.fits(reading), fitting).otherwise(NO_FIT * F.pow(F.lit(DECAY), i))
        return base * F.when(legible == "unreadable", UNREADABLE_FACTOR).otherwise(1.0)

    def best(ranked: Column) -> Column:
        head = F.try_element_at(ranked, F.lit(1))
        return F.struct(head["text"].alias("text"), F.coalesce(head["confidence"], F.lit(0.0)).alias("confidence"), catalog.kind_of(head["text"]).alias("kind"))

    def decide(ranked: Column, b: Column) -> Column:
        confidence, plain = b["confidence"], status(b["confidence"], accept, review)
        decided = F.when((plain == "accepted") & b["kind"].isNull(), "review").otherwise(plain)
        kept = (decided != "unreadable") & b["text"].isNotNull()
        others = F.when(kept, F.slice(ranked, 2, 1 << 30)).otherwise(ranked)
        candidates = F.transform(others, lambda x, i: F.struct(x["text"].alias("text"), (x["confidence"] * (1 - confidence) / (i + 1)).alias("confidence")))
        return F.struct(
            b["kind"].alias("tag_id"), F.when(kept, b["text"]).alias("text"), F.when(kept, confidence).otherwise(0.0).alias("confidence"),
            decided.alias("status"), candidates.alias("candidates"),
        )

    return let(without_stray_spaces(text, catalog), turned)


def local_decision(readings: Column, agrees: Column, catalog: Catalog, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """struct<tag_id, text, confidence, status, candidates> of a line's readings array<struct<text, probability, tag_id>>.

    The first reading is the line's; a fitting upside-down or look-alike reading caps
    its confidence and becomes a candidate. Unreadable lines keep no text and name
    the first fitting kind.
    """
    check_thresholds(accept, review)
    item = lambda t, p: F.struct(t.alias("text"), p.alias("confidence"))

    def doubts(best: Column) -> Column:
        swapped = other_kind_readings(best["text"], best["tag_id"], catalog)
        more = F.array_distinct(F.concat(F.array_compact(F.array(turned_reading(best["text"], catalog))), swapped))
        return let(more, lambda found: capped(best, found))

    def capped(best: Column, found: Column) -> Column:
        plain = local_score(best["probability"], agrees)
        return let(F.when(F.size(found) > 0, F.least(plain, F.lit(OTHER_FITS))).otherwise(plain), lambda c: decide(best, found, c))

    def decide(best: Column, found: Column, confidence: Column) -> Column:
        text, decided = best["text"], status(confidence, accept, review)
        kept = decided != "unreadable"
        rest = F.transform(F.slice(readings, 2, 1 << 30), lambda r: item(r["text"], r["probability"]))
        fresh = F.filter(found, lambda t: ~F.exists(F.slice(readings, 2, 1 << 30), lambda r: r["text"] == t))
        own = F.when(kept, F.array().cast(CANDIDATES)).otherwise(F.array(item(text, best["probability"])))
        others = F.concat(own, rest, F.transform(fresh, lambda t: item(t, F.lit(0.0))))
        ceiling = F.when(kept, confidence).otherwise(1.0)
        candidates = _ranked(F.transform(others, lambda o: item(o["text"], F.least(o["confidence"], ceiling))))
        return F.struct(
            F.when(kept, best["tag_id"]).otherwise(catalog.kind_of(text)).alias("tag_id"), F.when(kept, text).alias("text"),
            F.when(kept, confidence).otherwise(0.0).alias("confidence"), decided.alias("status"), candidates.alias("candidates"),
        )

    return let(F.try_element_at(readings, F.lit(1)), doubts)


def code_decision(fits: Column, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """struct<tag_id, text, confidence, status, candidates> of a code's non-empty fits: one fit is certain, several are not."""
    confidence = F.when(F.size(fits) == 1, 1.0).otherwise(OTHER_FITS)
    first = F.try_element_at(fits, F.lit(1))
    rest = F.transform(F.slice(fits, 2, 1 << 30), lambda f: F.struct(f["text"].alias("text"), F.lit(ALTERNATIVE_FITS).alias("confidence")))
    return F.struct(first["tag_id"].alias("tag_id"), first["text"].alias("text"), confidence.alias("confidence"), status(confidence, accept, review).alias("status"), rest.alias("candidates"))


# Error codes that mean a spent quota, and statuses worth a retry.
QUOTA_CODES = ("insufficient_quota", "billing_error")
RETRY_STATUSES = (408, 409, 429, 500, 502, 503, 504, 529)


def failure_reason(http_status: Column, error_code: Column) -> Column:
    """Why a provider refused: quota, authentication, rate_limit, server or bad_request; network without a status."""
    return (
        F.when(http_status.isNull(), "network")
        .when((http_status == 402) | F.coalesce(error_code.isin(*QUOTA_CODES), F.lit(False)), "quota")
        .when(http_status.isin(401, 403), "authentication")
        .when(http_status == 429, "rate_limit")
        .when(http_status.isin(*RETRY_STATUSES) | (http_status >= 500), "server")
        .otherwise("bad_request")
    )


def retryable(reason: Column) -> Column:
    """Whether another attempt may help."""
    return reason.isin("rate_limit", "server", "network")


def retry_wait(reason: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt without jitter: what the answer asks for, else doubling, at most a minute."""
    base = F.when(reason == "rate_limit", 5.0).otherwise(1.0)
    return F.least(F.coalesce(retry_after.cast("double"), base * F.pow(F.lit(2.0), attempt)), F.lit(60.0))

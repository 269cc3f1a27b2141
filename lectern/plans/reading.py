"""From recognised lines, decoded codes and provider answers to one result per photo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.catalog import Catalog
from lectern.functions import decision as D
from lectern.functions import geometry as G
from lectern.operators import decode, front, headers
from lectern.operators.vision import CodeDecoder, Detector, Recognizer
from lectern.sources.images import Codec, codec
from lectern.sources.results import CANDIDATES, OTHER, TAG

LEAST, TOP, LOCAL_CANDIDATE = 0.01, 3, 0.05
ENGINE = "0.1"


def turns_for(width: Column, height: Column) -> Column:
    """Turns to try for a line: upright and upside down, and quarter turns where it is tall."""
    return F.when(height > 1.2 * width, F.array(*map(F.lit, (0, 180, 90, 270)))).otherwise(F.array(F.lit(0), F.lit(180)))


def read_lines(crops: DataFrame, classes: list[str], catalog: Catalog) -> DataFrame:
    """crops (photo, line_no, turn, turn_ord, quad, probs) to lines: readings, agrees, plain text, quad and angle.

    A text keeps its best probability over turns and kinds, the first of them in a tie;
    texts rank by probability, ties by first appearance. Lines whose best reading is
    under LEAST are without readings. A line's few turns meet in one array, so lines
    shuffle once and their matrices never do.
    """
    free = decode.greedy(F.col("probs"), classes)
    decoded = crops.withColumns({"free": free, "found": decode.all_kinds(F.col("probs"), classes, catalog, top=TOP)})
    sure = F.pow(F.col("free.probability"), 1 / F.greatest(F.lit(1), F.length("free.text")))
    turn = F.struct("turn_ord", "turn", "quad", F.col("free.text").alias("free_text"), sure.alias("sure"), "found")
    lines = decoded.groupBy("photo", "line_no").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    reading = lambda c: F.transform(c["found"], lambda r, i: F.struct(
        r["text"].alias("text"), (-r["probability"]).alias("key"), F.struct(c["turn_ord"].alias("t"), r["kind_ord"].alias("k"), i.alias("i")).alias("ord"),
        r["probability"].alias("probability"), r["tag_id"].alias("tag_id"), c["turn"].alias("turn"), c["free_text"].alias("free_text"),
    ))
    heads = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["text"] != x["text"]))
    lines = lines.withColumn("all", F.array_sort(F.flatten(F.transform("turns", reading))))
    lines = lines.withColumn("came", F.array_sort(F.transform("all", lambda x: F.struct(x["text"].alias("text"), x["ord"].alias("ord")))))
    ranked = F.zip_with(heads(F.col("all")), heads(F.col("came")), lambda x, y: F.struct(x["key"].alias("key"), y["ord"].alias("ord"), x.alias("r")))
    lines = lines.withColumn("ranked", F.transform(F.slice(F.array_sort(ranked), 1, TOP), lambda x: x["r"])).drop("all", "came")
    best, first = F.get("ranked", F.lit(0)), F.get("turns", F.lit(0))
    plain = F.get(F.array_sort(F.transform("turns", lambda c: F.struct((-c["sure"]).alias("key"), c["turn_ord"].alias("ord"), c["free_text"].alias("text"), c["sure"].alias("sure"), c["turn"].alias("turn")))), F.lit(0))
    lines = lines.select("photo", "line_no", first["quad"].alias("quad"), plain.alias("plain"), best.alias("won"), F.when(best["probability"] >= LEAST, F.transform("ranked", lambda r: F.struct(r["text"].alias("text"), r["probability"].alias("probability"), r["tag_id"].alias("tag_id")))).alias("readings"))
    agrees = F.replace("won.free_text", F.lit(" "), F.lit("")) == F.col("won.text")
    turned = F.when(F.col("readings").isNotNull(), F.col("won.turn")).otherwise(F.col("plain.turn"))
    return lines.select(
        "photo", "line_no", "readings", agrees.alias("agrees"), F.col("plain.text").alias("plain_text"), F.col("plain.sure").alias("plain_confidence"),
        G.rotated(F.col("quad"), turned).alias("quad"), G.turned_angle(G.top_edge_angle(F.col("quad")), turned.cast("double")).alias("angle"),
    )


def read_local(photos: DataFrame, classes: list[str], catalog: Catalog, detector: Callable[[], Detector], recognizer: Callable[[], Recognizer], decoder: Callable[[], CodeDecoder] | None = None, open_reading: bool = False, model: str = "local", save: Callable[[DataFrame], DataFrame] = lambda rows: rows, make: Callable[[], Codec] = codec) -> DataFrame:
    """Results (image, ..., error) of photos (image, content) by injected models: lines, codes, decisions and assembly; failed photos keep their error.

    save cuts the plan after the models have run (a written table): without it each use
    of the result runs them again.
    """
    crops = save(front.recognised(photos, detector, recognizer, make=make))
    lines = read_lines(crops.where("error IS NULL").drop("error", "score"), classes, catalog)
    tags, others = [local_tags(lines, catalog)], []
    if decoder is not None:
        codes = save(front.decoded(photos, decoder, make=make)).where("error IS NULL")
        fitted, rest = code_tags(codes, catalog)
        tags = [fitted, without_decoded(tags[0], fitted)]
        others.append(rest)
    if open_reading:
        free = lines.where("readings IS NULL")
        others.append(other_texts(free.select("photo", F.col("line_no").alias("ord"), F.col("plain_text").alias("text"), F.col("plain_confidence").alias("confidence"), "quad", "angle")))
    named = photos.select(F.col("image").alias("photo")).withColumn("timings_ms", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    done = assemble(named, tags, others if open_reading else [], model)
    failed = crops.where("error IS NOT NULL").groupBy(F.col("photo").alias("image")).agg(F.min("error").alias("error"))
    return done.join(failed, "image", "left")


def _tag(decided: Column, polygon: Column, angle: Column, source: str, digits: int | None) -> Column:
    number = (lambda c: F.round(c, digits)) if digits else (lambda c: c)
    candidates = F.transform(decided["candidates"], lambda c: F.struct(c["text"].alias("text"), number(c["confidence"]).alias("confidence")))
    return F.struct(
        decided["tag_id"].alias("tag_id"), decided["text"].alias("text"), number(decided["confidence"]).alias("confidence"), decided["status"].alias("status"),
        polygon.alias("polygon"), F.pmod(F.round(angle, 1), F.lit(360.0)).alias("angle"), candidates.alias("candidates"), F.lit(source).alias("source"),
    ).cast(TAG)


def local_tags(lines: DataFrame, catalog: Catalog, accept: float = D.ACCEPT, review: float = D.REVIEW) -> DataFrame:
    """(photo, ord, tag) of the lines with readings; kinds follow the photo's headers."""
    read = headers.with_kinds(lines, catalog).where(F.col("readings").isNotNull())
    decided = read.withColumn("d", D.local_decision(F.col("readings"), F.col("agrees"), catalog, accept, review))
    return decided.select("photo", F.col("line_no").alias("ord"), _tag(F.col("d"), F.col("quad"), F.col("angle"), "local", 4).alias("tag"))


def code_tags(codes: DataFrame, catalog: Catalog, accept: float = D.ACCEPT, review: float = D.REVIEW) -> tuple[DataFrame, DataFrame]:
    """Codes (photo, ord, text, quad, angle): (photo, ord, tag) of those that fit, (photo, ord, other) of the rest."""
    fitted = codes.withColumn("fits", D.fit_code(F.col("text"), catalog))
    decided = fitted.where(F.size("fits") > 0).withColumn("d", D.code_decision(F.col("fits"), accept, review))
    tags = decided.select("photo", "ord", _tag(F.col("d"), F.col("quad"), F.col("angle"), "barcode", None).alias("tag"))
    return tags, other_texts(fitted.where(F.size("fits") == 0).withColumn("confidence", F.lit(1.0)))


def other_texts(texts: DataFrame) -> DataFrame:
    """(photo, ord, other) of free texts (photo, ord, text, confidence, quad, angle); blank ones go."""
    rows = texts.withColumn("value", D.collapsed(F.col("text"))).where("value <> ''").withColumn("l", D.tag_likelihood(F.col("value")))
    other = F.struct(F.col("value").alias("text"), F.round("confidence", 4).alias("confidence"), F.col("l.likelihood").alias("tag_likelihood"), F.col("l.kind").alias("kind_guess"), F.col("quad").alias("polygon"), F.pmod(F.round("angle", 1), F.lit(360.0)).alias("angle"))
    return rows.select("photo", "ord", other.cast(OTHER).alias("other"))


def provider_tags(answers: DataFrame, catalog: Catalog, accept: float = D.ACCEPT, review: float = D.REVIEW) -> DataFrame:
    """(photo, ord, tag) of provider answers (photo, ord, text, legibility, alternatives, box, angle)."""
    decided = answers.withColumn("d", D.provider_decision(F.col("text"), F.col("legibility"), F.col("alternatives"), catalog, accept, review))
    polygon = G.box_quad(*(F.get("box", F.lit(i)) for i in range(4)), F.col("angle"))
    return decided.select("photo", "ord", _tag(F.col("d"), polygon, F.col("angle").cast("double"), "fallback", 3).alias("tag"))


def without_decoded(tags: DataFrame, codes: DataFrame) -> DataFrame:
    """tags whose text no code tag of the photo has."""
    known = codes.where(F.col("tag.text").isNotNull()).select("photo", F.col("tag.text").alias("_text")).distinct()
    keyed = tags.withColumn("_text", F.col("tag.text"))
    return keyed.join(known, ["photo", "_text"], "left_anti").drop("_text")


def doubtful(tags: DataFrame) -> DataFrame:
    """Tags worth a second reading; filter before asking, because no filter passes a provider call."""
    return tags.where(F.col("tag.status") != "accepted")


def with_fallback(tags: DataFrame, answers: DataFrame, catalog: Catalog, accept: float = D.ACCEPT, review: float = D.REVIEW) -> DataFrame:
    """Local tags, replaced where a second reading (photo, line, ord, text, legibility, alternatives, box, angle) fits.

    The first certain fitting answer wins, else the first fitting one; position and
    angle stay local; local texts become weak candidates. Candidates of equal
    confidence are ordered by text.
    """
    fitted = answers.withColumn("text", D.without_stray_spaces(F.col("text"), catalog)).where(catalog.fits(F.col("text")))
    chosen = fitted.groupBy("photo", F.col("line").alias("ord")).agg(F.min_by(F.struct("text", "legibility", "alternatives"), F.struct(F.col("legibility") != "certain", "ord")).alias("a"))
    joined = tags.join(chosen, ["photo", "ord"], "left")
    d = D.provider_decision(F.col("a.text"), F.col("a.legibility"), F.col("a.alternatives"), catalog, accept, review)
    joined = joined.withColumn("d", F.when((F.col("tag.status") != "accepted") & F.col("a").isNotNull(), d))
    texts = F.concat(F.array_compact(F.array("tag.text")), F.transform("tag.candidates", lambda c: c["text"]))
    weak = F.transform(F.filter(texts, lambda t: ~t.eqNullSafe(F.col("d.text"))), lambda t: F.struct(t.alias("text"), F.round(F.least(F.lit(LOCAL_CANDIDATE), F.col("d.confidence")), 4).alias("confidence")))
    own = F.transform("d.candidates", lambda c: F.struct(c["text"].alias("text"), F.round(c["confidence"], 3).alias("confidence")))
    merged = F.array_sort(F.transform(F.array_distinct(F.concat(own, weak)), lambda c: F.struct((-c["confidence"]).alias("k"), c["text"].alias("text"), c["confidence"].alias("confidence"))))
    candidates = F.transform(merged, lambda c: F.struct(c["text"].alias("text"), c["confidence"].alias("confidence"))).cast(CANDIDATES)
    rescued = F.struct(F.col("d.tag_id").alias("tag_id"), F.col("d.text").alias("text"), F.col("d.confidence").alias("confidence"), F.col("d.status").alias("status"), F.col("tag.polygon").alias("polygon"), F.col("tag.angle").alias("angle"), candidates.alias("candidates"), F.lit("fallback").alias("source")).cast(TAG)
    return joined.select("photo", "ord", F.when(F.col("d").isNotNull(), rescued).otherwise(F.col("tag")).alias("tag"))


def assemble(photos: DataFrame, tags: list[DataFrame], others: list[DataFrame], model: str, usage: DataFrame | None = None) -> DataFrame:
    """One result row per photo of photos (photo, timings_ms): nested tags, other texts and usage.

    Tags keep the order of their sources and ordinals; other texts fall by likelihood.
    """
    def nested(parts: list[DataFrame], value: str) -> DataFrame | None:
        if not parts:
            return None
        rows = parts[0].withColumn("part", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            rows = rows.unionByName(p.withColumn("part", F.lit(i)))
        order = F.struct((-F.col("other.tag_likelihood")).alias("k"), "part", "ord", value) if value == "other" else F.struct("part", "ord", value)
        return rows.groupBy("photo").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x[value]).alias(value))

    out = photos.withColumns({"engine_version": F.lit(ENGINE), "model_version": F.lit(model)})
    for parts, value, kind, name in ((tags, "tag", TAG, "tags"), (others, "other", OTHER, "other_texts")):
        rows = nested(parts, value)
        if rows is None:
            out = out.withColumn(name, F.lit(None).cast(f"array<{kind}>") if value == "other" else F.array().cast(f"array<{kind}>"))
        else:
            out = out.join(rows, "photo", "left").withColumn(name, F.coalesce(value, F.array().cast(f"array<{kind}>"))).drop(value)
    if usage is not None:
        out = out.join(usage.select("photo", F.struct("calls", "input_tokens", "output_tokens").alias("api_usage")), "photo", "left")
    else:
        out = out.withColumn("api_usage", F.lit(None).cast("struct<calls:long,input_tokens:long,output_tokens:long>"))
    return out.select(F.col("photo").alias("image"), "engine_version", "model_version", "tags", "timings_ms", "other_texts", "api_usage")

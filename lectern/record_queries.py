"""Registered queries of the grammar's parts, catalogs, labels, predictions, providers and records, with SQL that checks them.

Where an operator works on a document or a pattern instead of a table, its SQL states
the outcome row by row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import grammar
from lectern.catalog import Catalog, CatalogError, Kind
from lectern.functions import decision as D
from lectern.functions import geometry as G
from lectern.operators import answers, vision
from lectern.plans import evaluation
from lectern.queries import _CALLS, _CALLS_DUCK, _LOADED, LOT, TEXTS, _duck, _records, _sql, _texts, query, scratch
from lectern.sources import labels as L
from lectern.sources import providers as P
from lectern.sources import results as R


def _quote(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of stated rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + f") t({columns})"


# Grammar: patterns with what they mean, worked out by hand

_SPANS = [
    (r"GJ\d{5}", 7, 7, 8, 52), ("(a|bc)d", 2, 3, 4, 4), ("[a-c]{1,2}", 1, 2, 3, 6), ("a{2}b{0,1}", 2, 3, 4, 3), (r"\-x", 2, 2, 3, 2), ("((ab){2}|abab)", 4, 4, 5, 4),
    ("[-a]", 1, 1, 2, 2), (r"[\]x]", 1, 1, 2, 2), ("a|ab|abc", 1, 3, 4, 3), ("(a|b){2}", 2, 2, 3, 4), ("x{64}", 64, 64, 65, 64), ("(x{64}){4}", 256, 256, 257, 256),
]


@query("g2_spans", _values(_SPANS, "pattern, shortest, longest, states, edges"))
def g2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of lengths, and the size of the minimal automata."""
    made = [(p, grammar.compile_pattern(p)) for p, *_ in _SPANS]
    return spark.createDataFrame([(p, a.span.low, a.span.high, len(a.steps), len(a.edges())) for p, a in made], "pattern string, shortest int, longest int, states int, edges int")


_EQUAL = [("ab|ac", "a[bc]", 1), ("a{2}", "aa", 1), ("(a|b){2}", "[ab]{2}", 1), ("a{1,2}", "a|aa", 1), (r"\d", "[0-9]", 1), ("(ab){0,1}c", "abc|c", 1), ("a(b|c)|ad", "a[b-d]", 1), ("a{1,2}", "a{1,3}", 0), ("ab", "ba", 0)]


@query("g13_equal_languages", _values(_EQUAL, "one, two, same"))
def g13_equal_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal languages have equal minimal automata."""
    return spark.createDataFrame([(a, b, int(grammar.compile_pattern(a) == grammar.compile_pattern(b))) for a, b, _ in _EQUAL], "one string, two string, same int")


# Patterns with a fault, its code and its place.
FAULTS = [
    ("", "empty_pattern", 0), ("a{0,1}", "matches_empty", 0), ("(x{64}){5}", "too_long", 0), ("(a", "unbalanced_paren", 0), ("a)", "unbalanced_paren", 1), ("[ab", "unbalanced_bracket", 0),
    ("a{2", "unbalanced_brace", 1), ("()", "empty_group", 1), ("(a|)", "empty_alternative", 3), ("[]", "empty_class", 1), ("(((((((((((((((((a", "nested_too_deep", 16), (r"MD\d+", "unbounded_quantifier", 4),
    ("a?", "unsupported_quantifier", 1), ("a{3,2}", "invalid_quantifier", 1), ("a{65}", "repeat_too_large", 1), ("^MD", "anchor", 0), ("M.", "wildcard", 1), ("a]", "unescaped_special", 1),
    ("(?:a)", "group_extension", 1), (r"\w", "unsupported_escape", 0), (r"(a)\1", "backreference", 3), ("[^a]", "negated_class", 1), ("[z-a]", "invalid_range", 1), ("[ -ʠ]", "class_too_large", 1),
    ("a\u0007", "control_character", 1), ("abcdef", "too_complex", 0), (r"MD\d{5}", None, None),
]


@query("g17_all_codes", _values(FAULTS, "pattern, code, position"))
def g17_all_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of the grammar's faults, and where the fault is; too_complex under a small bound."""
    rows = []
    for pattern, wanted, _ in FAULTS:
        try:
            grammar.build(grammar.parse(pattern), pattern, 3) if wanted == "too_complex" else grammar.compile_pattern(pattern)
            rows.append((pattern, None, None))
        except grammar.PatternError as e:
            rows.append((pattern, e.code, e.position))
    return spark.createDataFrame(rows, "pattern string, code string, position int")


def walk(text: Column, pattern: str) -> Column:
    """Whether text is in the language, by walking the automaton inside an expression."""
    a = grammar.compile_pattern(pattern)
    steps = F.array(*(F.create_map(*(F.lit(x) for c, j in sorted(s.items()) for x in (c, j))) if s else F.create_map().cast("map<string,int>") for s in a.steps))
    end = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.when(s.isNull(), s).otherwise(F.try_element_at(F.get(steps, s), c)))
    return F.coalesce(end.isin(*a.accepting), F.lit(False))


def _construct(name: str, doc: str, pattern: str, meaning: str) -> None:
    """A query that walks a pattern's automaton over texts and matches its expression; meaning: the pattern as SQL writes it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("text")
        return _texts(spark, sf_dir).select("id", walk(text, pattern).alias("walked"), grammar.matches(text, pattern).alias("matched"))

    run.__name__, run.__doc__ = name, doc
    test = f"regexp_full_match(text, {_quote(meaning)})"
    query(name, f"SELECT id, {test} AS walked, {test} AS matched FROM {_duck(TEXTS, 'part')} t")(run)


_construct("g3_alternation", "One of several sequences.", r"\d{4}|Brand#\d{1,2}|FWS\d{4}", "[0-9]{4}|Brand#[0-9]{1,2}|FWS[0-9]{4}")
_construct("g4_sequence", "Parts one after the other.", r"FW5\d{4}", "FW5[0-9]{4}")
_construct("g5_quantifier", "Bounded repetition.", r"[A-Z]{2,3}\d{4,5}", "[A-Z]{2,3}[0-9]{4,5}")
_construct("g6_atoms", "Plain characters, spaces too.", "1 2 3 4 5 6|PROMO", "1 2 3 4 5 6|PROMO")
_construct("g7_group", "Groups in groups.", r"((GJ|FW)(S|5){0,1}){1,2}\d{4,5}", "((GJ|FW)(S|5){0,1}){1,2}[0-9]{4,5}")
_construct("g8_escape", "Escaped characters.", r"\d{1,2}\/\d{1,3}|mdx\-\d{1,2}", "[0-9]{1,2}/[0-9]{1,3}|mdx-[0-9]{1,2}")
_construct("g9_class", "Classes with ranges and a hyphen for itself.", r"[a-z-]{2,4}[\dA-C]{0,5}", "[a-z-]{2,4}[0-9A-C]{0,5}")


# Catalogs

_GOOD = {"schema_version": "1.0", "name": "m", "tags_per_individual": 1, "tags": [{"id": "primary", "pattern": r"MD\d{5}"}, {"id": "b", "pattern": r"[A-Z]{2}-\d{3,4}", "header": "H"}]}
_BAD = [
    ({}, None), ({"schema_version": "2"}, "schema_version"), ({"extra": 1}, "extra"), ({"tags": {}}, "tags"), ({"name": ""}, "name"), ({"tags_per_individual": True}, "tags_per_individual"),
    ({"tags": [{"id": "a", "pattern": "MD\\d+"}]}, "tags[0].pattern"), ({"tags": [{"id": "a", "pattern": "A"}, {"id": "a", "pattern": "B"}]}, "tags[1].id"), ({"tags": [{"id": "1", "pattern": "A"}]}, "tags[0].id"),
    ({"tags": [{"id": "a", "pattern": "A", "header": " "}]}, "tags[0].header"), ({"tags": [{"id": "a"}]}, "tags[0].pattern"), ({"tags": [5]}, "tags[0]"),
]
_TEXTS = [*((json.dumps(_GOOD | change), where) for change, where in _BAD), ('{"a": 1, "a": 2}', ""), ('{"a": NaN}', ""), ("{", "")]


@query("c1_located_faults", _values([(i, where) for i, (_, where) in enumerate(_TEXTS)], "document, location"))
def c1_located_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where catalog documents are wrong; duplicate keys, NaN and broken JSON have no place."""
    rows: list[tuple[int, str | None]] = []
    for i, (text, _) in enumerate(_TEXTS):
        try:
            Catalog.from_json(text)
            rows.append((i, None))
        except CatalogError as e:
            rows.append((i, e.location))
    return spark.createDataFrame(rows, "document int, location string")


@query("c6_round_trip", _values([(i, k.tag_id, k.pattern, k.header, k.pattern) for i, k in enumerate((Kind("primary", r"MD\d{5}"), Kind("b", r"[A-Z]{2}-\d{3,4}", "H")))], "ord, tag_id, pattern, header, looked_up"))
def c6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a catalog that was written and loaded again, and looked up by id."""
    made = Catalog.from_json(Catalog.from_dict(_GOOD).to_json())
    return spark.createDataFrame([(i, k.tag_id, k.pattern, k.header, made.kind(k.tag_id).pattern) for i, k in enumerate(made.kinds)], "ord int, tag_id string, pattern string, header string, looked_up string")


@query("v6_single_kind", f"SELECT id, regexp_full_match(text, 'FWS[0-9]{{4}}') AS ok FROM {_duck(TEXTS, 'part')} t")
def v6_single_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against one kind."""
    return _texts(spark, sf_dir).select("id", grammar.matches(F.col("text"), LOT.kind("fws").pattern).alias("ok"))


# Photos, labels and predictions

_NAMES = "SELECT p_partkey AS id, concat(p_brand, CASE p_partkey % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.txt' WHEN 3 THEN '.a.png' WHEN 4 THEN '.Tiff' WHEN 5 THEN '' ELSE '.jpg.gz' END) AS name FROM {part}"


@query("s1_photo_names", f"SELECT id, regexp_full_match(lower(name), '.*\\.(jpg|jpeg|png|webp|tif|tiff)') AS photo FROM {_duck(_NAMES, 'part')} n")
def s1_photo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are photos, by suffix."""
    return _sql(spark, sf_dir, _NAMES, "part").select("id", R.is_photo(F.col("name")).alias("photo"))


def _loaded(rows: DataFrame) -> DataFrame:
    return L.load(rows).select("image", "session", "split", F.size("tags").cast("long").alias("n_tags"), F.size(F.filter("tags", lambda t: t["text"].isNotNull())).cast("long").alias("n_readable"))


@query("s5_labels_jsonl", _LOADED)
def s5_labels_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON lines, with blank lines, and loaded again."""
    path = scratch(spark, "labels")
    rows = _records(spark, sf_dir).withColumn("line", F.to_json(F.struct("image", "session", "split", "text", "verified")))
    rows.orderBy("line_no").select(F.concat("line", F.when(F.col("line_no") % 9 == 0, "\n").otherwise("")).alias("value")).coalesce(1).write.text(path)
    return _loaded(L.read_jsonl(spark, path))


@query("s6_labels_csv", _LOADED)
def s6_labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as CSV with quoted separators and line breaks, and loaded again; examples do not count."""
    path = scratch(spark, "labels")
    noted = F.when(F.col("line_no") % 5 == 0, "a; \"quoted\"\nnote").otherwise("").alias("no;te")
    rows = _records(spark, sf_dir).orderBy("line_no").select("image", "session", "split", "text", noted, "verified")
    example = spark.createDataFrame([("EXEMPLE_1.jpg", "s", "", "X", "", "x"), ("", "s", "", "X", "", "x")], rows.schema)
    rows.unionByName(example).coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return _loaded(L.read_csv(spark, path))


_RUNS = "SELECT p_partkey AS id, concat('p', CAST(p_partkey AS STRING), '.jpg') AS image, p_size FROM {part}"


@query("e10_run_dataset", f"""SELECT image, CASE WHEN p_size % 10 = 0 AND id % 2 = 0 THEN 'forced' WHEN p_size % 3 = 0 AND id % 2 = 1 THEN 'second' WHEN p_size % 3 = 0 THEN 'second' ELSE 'first' END AS read_by,
    CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 AND NOT (p_size % 10 = 0 AND id % 2 = 0) THEN 'down' END AS error FROM {_duck(_RUNS, 'part')} r""")
def e10_run_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset read in three runs: failures are read again, results are not, and forcing some photos keeps the others."""
    table, photos = scratch(spark, "predictions"), _sql(spark, sf_dir, _RUNS, "part").select("image", "id", "p_size")

    def reader(name: str, fails: Column) -> object:
        return lambda rows: rows.select("image", F.lit(name).alias("read_by"), F.when(fails, "down").alias("error"))

    third = F.col("p_size") % 3 == 0
    R.read_missing(photos, table, "b", reader("first", third))
    R.read_missing(photos, table, "b", reader("second", third & (F.col("p_size") % 4 == 0)))
    R.read_missing(photos.where("p_size % 10 = 0 AND id % 2 = 0"), table, "b", reader("forced", F.lit(False)), force=True)
    return R.predictions(spark, table, "b").select("image", "read_by", "error")


# Records

_FIELDS = "SELECT p_partkey AS id, p_size, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_brand END AS text, CAST(p_size AS DOUBLE) / 40 AS c, CASE p_size % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'word' ELSE 'id' END AS kind FROM {part}"


@query("v2_record_rules", f"""WITH x AS (SELECT *, text IS NULL OR text = '' AS blank FROM {_duck(_FIELDS, 'part')} f),
    r AS (SELECT id, array_to_string(list_filter([CASE WHEN blank THEN 'text_given' END, CASE WHEN c > 1 THEN 'confidence_in_range' END], lambda v: v IS NOT NULL), ',') AS candidate,
        array_to_string(list_filter([CASE WHEN blank THEN 'text_given' END, CASE WHEN c > 1 THEN 'likelihood_in_range' END, CASE WHEN kind = 'word' THEN 'known_kind' END, CASE WHEN p_size % 7 = 0 THEN 'four_finite_points' END, CASE WHEN c * 400 >= 360 THEN 'angle_in_circle' END], lambda v: v IS NOT NULL), ',') AS other,
        array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'calls_counted' END, CASE WHEN p_size % 6 = 0 THEN 'output_tokens_counted' END], lambda v: v IS NOT NULL), ',') AS usage,
        array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'width_positive' END, CASE WHEN p_size % 3 = 1 THEN 'quarter_turn' END], lambda v: v IS NOT NULL), ',') AS image FROM x)
    SELECT r.*, array_to_string(list_filter([CASE WHEN x.blank THEN 'engine_named' END, CASE WHEN other <> '' THEN 'other_texts_hold' END, CASE WHEN usage <> '' THEN 'usage_holds' END, CASE WHEN p_size = 9 THEN 'timings_hold' END], lambda v: v IS NOT NULL), ',') AS result FROM r JOIN x ON r.id = x.id""")
def v2_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that candidates, other texts, token counts, images and whole results break."""
    rows = _sql(spark, sf_dir, _FIELDS, "part")
    point = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    size, joined = F.col("p_size"), lambda c: F.array_join(c, ",")
    candidate = F.struct("text", F.col("c").alias("confidence"))
    other = F.struct("text", F.lit(0.5).alias("confidence"), F.col("c").alias("tag_likelihood"), F.col("kind").alias("kind_guess"), F.when(size % 7 == 0, F.array(point)).otherwise(F.array(*[point] * 4)).alias("polygon"), (F.col("c") * 400).alias("angle")).cast(R.OTHER)
    usage = F.struct((size - 5).cast("long").alias("calls"), F.lit(3).cast("long").alias("input_tokens"), F.when(size % 6 != 0, size.cast("long")).alias("output_tokens"))
    image = F.struct((size - 9).alias("width"), F.lit(1).alias("height"), (size % 3 * 45 * F.when(size % 3 == 2, 2).otherwise(1)).alias("exif_rotation"))
    result = F.struct(F.col("text").alias("engine_version"), F.lit("m").alias("model_version"), F.array().cast(f"array<{R.TAG}>").alias("tags"), F.array("other").alias("other_texts"), F.col("usage").alias("api_usage"), F.create_map(F.lit("read"), F.when(size == 9, -1.0).otherwise(1.0)).alias("timings_ms"))
    rows = rows.withColumns({"other": other, "usage": usage})
    return rows.select(
        "id", joined(R.candidate_violations(candidate)).alias("candidate"), joined(R.other_text_violations(F.col("other"))).alias("other"), joined(R.usage_violations(F.col("usage"))).alias("usage"),
        joined(R.image_violations(image)).alias("image"), joined(R.result_violations(result)).alias("result"),
    )


@query("v16_cached_results", f"SELECT id, text, round(size / 100.0, 2) AS confidence, CASE WHEN size % 2 = 0 THEN 'read' END AS stage, size % 3 = 0 AS billed FROM {_duck(TEXTS, 'part')} t")
def v16_cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON and back: keys without a value are left out and come back as none."""
    tag = F.struct(F.lit("k").alias("tag_id"), "text", (F.col("size") / 100).alias("confidence"))
    timing = F.when(F.col("size") % 2 == 0, F.create_map(F.lit("read"), F.lit(1.5)))
    usage = F.when(F.col("size") % 3 == 0, F.struct(F.lit(1).alias("calls"), F.lit(2).alias("input_tokens"), F.lit(3).alias("output_tokens")))
    rows = _texts(spark, sf_dir).select("id", R.parse_results(R.result_json(F.struct(F.array(tag).alias("tags"), timing.alias("timings_ms"), usage.alias("api_usage")))).alias("r"))
    first = F.get("r.tags", F.lit(0))
    return rows.select("id", first["text"].alias("text"), F.round(first["confidence"], 2).alias("confidence"), F.get(F.map_keys("r.timings_ms"), F.lit(0)).alias("stage"), F.col("r.api_usage").isNotNull().alias("billed"))


@query("e18_report", """SELECT * FROM (VALUES ('exact_match_rate', '0.3333'), ('photos', '7'), ('seconds_per_photo', '1.24'), ('silent_error_rate', '0.0'), ('cost', '0.66'), ('markdown', '| exact match rate | 33.33% |')) t(name, value)""")
def e18_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of stated sums: rates to four decimals, cost per 1,000 photos that were read, a line of Markdown."""
    total = {"photos": 7, "failed_photos": 2, "exact_match_rate": 1 / 3, "silent_error_rate": 0.0, "seconds_per_photo": 1.2375, "total": True, "session": None, "seconds": 6.2}
    document = evaluation.report(total, [], dataset="d", tokens={"input": 9000, "output": 1600}, price_per_million_tokens={"input": 0.2, "output": 0.95})
    rows = [(k, str(document["metrics"][k])) for k in ("exact_match_rate", "photos", "seconds_per_photo", "silent_error_rate")] + [("cost", str(document["cost_per_1000_photos_usd"]))]
    rows += [("markdown", line) for line in evaluation.markdown(document).splitlines() if line.startswith("| exact match rate")]
    return spark.createDataFrame(rows, "name string, value string")


# Providers

_PLACES = {
    "messages": ("$.messages[0].content[0].source.data", "$.messages[0].content[1].text", "$.model", ""),
    "responses": ("$.input[0].content[1].image_url", "$.input[0].content[0].text", "$.model", "data:image/jpeg;base64,"),
    "content": ("$.contents[0].parts[0].inline_data.data", "$.contents[0].parts[1].text", "$.contents[0].role", ""),
    "chat": ("$.messages[0].content[1].image_url.url", "$.messages[0].content[0].text", "$.model", "data:image/jpeg;base64,"),
}


@query("s13_requests", " UNION ALL ".join(f"SELECT '{name}' AS api, id, concat({_quote(prefix)}, base64(encode(text))) AS image, 'Read this.' AS asked, {_quote('user' if name == 'content' else 'm1')} AS named FROM {_duck(TEXTS, 'part')} t" for name, (*_, prefix) in _PLACES.items()))
def s13_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where image, instructions and model stand in the requests of the four providers."""
    parts = []
    for name, (image, asked, named, _) in _PLACES.items():
        body = P.APIS[name].body(F.col("text").cast("binary"), F.lit("Read this."), "m1")
        parts.append(_texts(spark, sf_dir).select(F.lit(name).alias("api"), "id", body.alias("body")).select("api", "id", F.get_json_object("body", image).alias("image"), F.substring_index(F.get_json_object("body", asked), "\n\nAnswer", 1).alias("asked"), F.get_json_object("body", named).alias("named")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_BODIES = {
    "messages": """concat('{{"model":"m2","stop_reason":"', CASE k % 4 WHEN 0 THEN 'refusal' WHEN 1 THEN 'max_tokens' ELSE 'end_turn' END, '","content":[{{"type":"thinking"}}', CASE WHEN k % 4 = 2 THEN '' ELSE ',{{"type":"text","text":"T"}}' END, '],"usage":{{"input_tokens":', k, ',"output_tokens":7}}}}')""",
    "responses": """concat('{{"model":"m2","status":"', CASE WHEN k % 4 < 2 THEN 'incomplete' ELSE 'completed' END, '","incomplete_details":{{"reason":"', CASE k % 4 WHEN 0 THEN 'content_filter' ELSE 'max_output_tokens' END, '"}},"output":[{{"type":"message","content":[', CASE WHEN k % 4 = 2 THEN '' ELSE '{{"type":"output_text","text":"T"}}' END, ']}}],"usage":{{"input_tokens":', k, ',"output_tokens":7}}}}')""",
    "content": """concat('{{"modelVersion":"m2","candidates":[{{"finishReason":"', CASE k % 4 WHEN 0 THEN 'SAFETY' WHEN 1 THEN 'MAX_TOKENS' ELSE 'STOP' END, '","content":{{"parts":[{{"text":"no","thought":true}}', CASE WHEN k % 4 = 2 THEN '' ELSE ',{{"text":"T"}}' END, ']}}}}],"usageMetadata":{{"promptTokenCount":', k, ',"candidatesTokenCount":4,"thoughtsTokenCount":3}}}}')""",
    "chat": """concat('{{"model":"m2","choices":[{{"finish_reason":"', CASE k % 4 WHEN 0 THEN 'content_filter' WHEN 1 THEN 'length' ELSE 'stop' END, '","message":{{"content":"', CASE WHEN k % 4 = 2 THEN ' ' ELSE 'T' END, '"}}}}],"usage":{{"prompt_tokens":', k, ',"completion_tokens":7}}}}')""",
}


@query("s13_replies", " UNION ALL ".join(f"SELECT '{name}' AS api, event_id, CASE WHEN k % 4 = 3 THEN 'T' END AS text, CASE WHEN k % 4 = 3 THEN 'm2' END AS model, CASE WHEN k % 4 = 3 THEN k END AS input_tokens, CASE WHEN k % 4 = 3 THEN 7::BIGINT END AS output_tokens, CASE k % 4 WHEN 0 THEN 'refused' WHEN 1 THEN 'truncated' WHEN 2 THEN 'invalid_response' END AS error FROM {_CALLS_DUCK} c" for name in _BODIES))
def s13_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, model and tokens in the answers of the four providers; refused, cut off and empty ones are errors."""
    parts = []
    for name, body in _BODIES.items():
        rows = _sql(spark, sf_dir, f"SELECT event_id, {body} AS body FROM ({_CALLS}) c", "events")
        parts.append(rows.select(F.lit(name).alias("api"), "event_id", P.APIS[name].reply(F.col("body"), "m1").alias("r")).select("api", "event_id", "r.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s14_waits", f"SELECT event_id, least(coalesce(CASE WHEN k % 3 = 0 THEN k::DOUBLE END, CASE WHEN k % 2 = 0 THEN 5.0 ELSE 1.0 END * pow(2, k % 5)), 60.0) AS seconds FROM {_CALLS_DUCK} c")
def s14_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds before another attempt, as asked for or doubling."""
    rows = _sql(spark, sf_dir, _CALLS, "events")
    reason = F.when(F.col("k") % 2 == 0, "rate_limit").otherwise("server")
    return rows.select("event_id", D.retry_wait(reason, F.col("k") % 5, F.when(F.col("k") % 3 == 0, F.col("k"))).alias("seconds"))


_ASKED = Catalog("c", (Kind("a", r"A\d"), Kind("b", "B{2}")))


@query("x1_instructions", "SELECT * FROM (VALUES ('kinds', 'Identifiers follow one of these patterns:|- a: A\\d|- b: B{2}'), ('kinds_none', ''), ('boxes', 'y0, x0, y1, x1 in thousandths; the image is 30 by 20 pixels')) t(part, said)")
def x1_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What instructions say about kinds and boxes; without kinds nothing about kinds."""
    said, plain = (answers.instructions(c, "normalized_yxyx", 30, 20).split("\n\n") for c in (_ASKED, Catalog("none")))
    kinds = lambda parts: "".join(p for p in parts if "patterns" in p).replace("\n", "|")
    box = next(p for p in said if "box" in p).split(" as ")[1].split(" pixels")[0] + " pixels"
    return spark.createDataFrame([("kinds", kinds(said)), ("kinds_none", kinds(plain)), ("boxes", box)], "part string, said string")


# Geometry


@query("s3_exif_turn", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 90 WHEN 6 THEN 90 WHEN 7 THEN 270 ELSE 0 END AS turn FROM lineitem")
def s3_exif_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clockwise turns of EXIF orientations."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", G.exif_turn(F.col("l_linenumber")).alias("turn"))


@query("m10_padded_crop", "SELECT l_orderkey, l_linenumber, greatest(l_quantity - 3, 0.0) AS x0, greatest(l_tax * 100 - 3, 0.0) AS y0, least(l_quantity + 23, 60.0) AS x1, least(l_tax * 100 + 13, 15.0) AS y1 FROM lineitem")
def m10_padded_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upright box around a quad, padded, inside the image."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double") * 100
    quad = F.array(G.point(x, y), G.point(x + 20, y), G.point(x + 20, y + 10), G.point(x, y + 10))
    return rows.select("l_orderkey", "l_linenumber", G.padded_crop(quad, F.lit(3.0), F.lit(60), F.lit(15)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


_POINTS = "WITH p AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(16) t(i))"


@query("m4_hulls", _POINTS + """, e AS (SELECT u.vec_id, u.i, u.x * v.y - v.x * u.y AS twice FROM p u JOIN p v ON u.vec_id = v.vec_id AND u.i <> v.i JOIN p z ON u.vec_id = z.vec_id AND z.i <> u.i AND z.i <> v.i
        GROUP BY u.vec_id, u.i, v.i, u.x, u.y, v.x, v.y HAVING min((v.x - u.x) * (z.y - u.y) - (v.y - u.y) * (z.x - u.x)) > 0)
    SELECT vec_id, count(*) AS corners, round(sum(twice) / 2, 6) AS area FROM e GROUP BY vec_id""")
def m4_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and area of the hulls of sixteen points a vector."""
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(F.get("embedding", 2 * i).cast("double"), F.get("embedding", 2 * i + 1).cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vision.hulls(points).alias("h"))
    after = F.concat(F.slice("h", 2, 99), F.slice("h", 1, 1))
    twice = F.aggregate(F.zip_with("h", after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("h").cast("long").alias("corners"), F.round(twice / 2, 6).alias("area"))


@query("m3_least_rectangles", _POINTS + """, e AS (SELECT DISTINCT u.vec_id, (v.x - u.x) / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2) AS dx, (v.y - u.y) / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2) AS dy FROM p u JOIN p v ON u.vec_id = v.vec_id AND u.i <> v.i JOIN p z ON u.vec_id = z.vec_id
        GROUP BY u.vec_id, u.x, u.y, v.x, v.y HAVING min((v.x - u.x) * (z.y - u.y) - (v.y - u.y) * (z.x - u.x)) >= 0),
    r AS (SELECT e.vec_id, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy)) * (max(y * dx - x * dy) - min(y * dx - x * dy)) AS area FROM e JOIN p ON e.vec_id = p.vec_id GROUP BY e.vec_id, dx, dy)
    SELECT vec_id, round(min(area), 6) AS area, 4 AS corners FROM r GROUP BY vec_id""")
def m3_least_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least rectangles around sixteen points a vector, by the corners they give."""
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(F.get("embedding", 2 * i).cast("double"), F.get("embedding", 2 * i + 1).cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vision.rectangles(points).alias("q"))
    x, y = (lambda i: F.element_at("q", i)["x"]), (lambda i: F.element_at("q", i)["y"])
    twice = sum((x(i) * y(i % 4 + 1) - x(i % 4 + 1) * y(i) for i in range(1, 5)), F.lit(0.0))
    return rows.select("vec_id", F.round(F.abs(twice) / 2, 6).alias("area"), F.size("q").alias("corners"))

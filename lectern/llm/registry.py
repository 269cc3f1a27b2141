"""Queries and SQL of this subpackage, for the driver's registry."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exactdup, licenses, lm, media, mixing, neardup, packing, pii, substrings, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under an n-gram trie; fold 1 is held out."""
    return lm.score(_documents(spark, sf_dir), _fold() != 1)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file, read back through signature sniffing."""
    return media.store(_documents(spark, sf_dir)).drop("media", "embedded")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups by 3-word shingles at a similarity of 85 percent."""
    return neardup.near_groups(_documents(spark, sf_dir), width=3, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document's tokens."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has too are removed."""
    return substrings.dedup(_documents(spark, sf_dir)).drop("kept_text", "removed")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and the licences they state, for every document."""
    found = licenses.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans and disclosing terms."""
    found = pii.sanitise(_documents(spark, sf_dir))

    def joined(column: str) -> Column:
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    spans = F.concat_ws(",", F.filter(F.array(joined("base"), joined("added")), lambda s: s != ""))
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), spans.alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document; labels of fold 0 are held out."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, _fold() != 0)
    return toxicity.score(docs, model).select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted", "sentences", "offending")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and where the mixture of sources reads every document."""
    return mixing.schedule(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exactdup.exact_groups(_documents(spark, sf_dir), keep="largest")


QUERIES = {f.__name__: f for f in (op1_lm, op2_media, op3_near_dedup, op4_packing, op5_substrings, op6_licenses, op7_pii, op8_toxicity, op9_mixing, op10_exact_dedup)}

ORACLES = {
    "op2_media": r"""
        WITH p AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        q AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 64 ELSE n + (64 - n % 64) % 64 END AS size, h || repeat('00', (CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END)::BIGINT) AS h FROM p),
        w AS (SELECT *, printf('%08x', 36 + size) AS whole, printf('%08x', size) AS data, regexp_extract_all(h, '..') AS bytes FROM q),
        m AS (SELECT *, unhex('52494646' || whole[7:8] || whole[5:6] || whole[3:4] || whole[1:2] || '57415645666D74201000000001000100401F0000401F00000100080064617461' || data[7:8] || data[5:6] || data[3:4] || data[1:2] || h) AS media,
              flatten(list_transform(bytes[-64:], lambda b: [('0x' || b)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS steps,
              len(regexp_extract_all(array_to_string(list_transform(bytes, lambda b: CASE WHEN b < '80' THEN '0' ELSE '1' END), ''), '0+|1+')) - 1 AS crossings FROM w)
        SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
               xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT) AS tail_crc32,
               octet_length(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256, 'application/octet-stream' AS declared_type, 'audio/wav' AS media_type, true AS corrected,
               'audio/wav;sum=' || list_sum(list_transform(bytes, lambda b: ('0x' || b)::BIGINT)) || ';crossings=' || crossings || ';embedded=0' AS feature
        FROM m""",
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) > 2 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
              WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
        t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
              HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept
        FROM s LEFT JOIN c ON doc_id = a""",
    "op5_substrings": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
        v AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM s),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM v),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f WHERE again),
        r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
        SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id""",
    "op6_licenses": licenses.oracle(),
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}

"""Operators return what they make, not only its digests, and miss nothing that the whole job has."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
from lectern.llm import licenses, lm, media, packing, pii, substrings
from llm.test_llm import SCHEMA, WORD, by_id, corpus, rows_of


def test_pack_returns_the_ids(spark):
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path("word_bpe_49k.json"), corpus(7, 30)
    pieces = collections.defaultdict(dict)
    for r in packing.pack(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), path).collect():
        assert len(r["ids"]) == r["length"]
        pieces[r["doc_id"]][r["start"]] = r["ids"]
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert [x for _, ids in sorted(pieces[i].items()) for x in ids] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_dedup_returns_the_kept_text_and_the_removed_runs(spark):
    texts = [*corpus(4, 60), "z " * 200, "z " * 120]
    got = by_id(substrings.dedup(spark.createDataFrame(rows_of(texts), SCHEMA)))
    assert any(r["removed"] for r in got.values()) and any(r["n_words"] and not r["removed"] for r in got.values())
    for i, t in enumerate(texts):
        r, words = got[i], WORD.findall(t or "")
        gone = {k for a, b in r["removed"] for k in range(a, b)}
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()


def test_store_returns_the_files(spark, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 100)
    gray = "P5\n2 2\n100\nabcd"
    texts = [None, "", "é" * 100, f"before {gray} after", "x"]
    got = by_id(media.store(spark.createDataFrame(rows_of(texts), SCHEMA)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert media.samples_of(got[i]["media"])[: len(raw)] == raw and hashlib.sha256(got[i]["media"]).hexdigest() == got[i]["media_sha256"]
        assert [(e["type"], bytes(e["content"])) for e in got[i]["embedded"]] == ([("image/x-portable-graymap", gray.encode())] if i == 3 else [])


def test_sanitise_returns_the_text(spark):
    got = by_id(pii.sanitise(spark.createDataFrame(rows_of(["mail a@b.example now", None, "é 1.2.3.4"]), SCHEMA)))
    assert [got[i]["sanitised"] for i in range(3)] == ["mail [EMAIL] now", "", "é [IP]"]


def test_copies_do_not_hide_a_disclosing_term(spark):
    told = [f"north{i} call Zanzibarov at zz@corp.example south{i}" for i in range(3)]
    rows = [*told[:1] * 30, *told[1:], *["nothing to see here"] * 200]
    got = by_id(pii.sanitise(spark.createDataFrame(rows_of(rows), SCHEMA)))
    assert all([rows[i][s["start"] : s["end"]] for s in got[i]["added"]] == (["call", "Zanzibarov"] if i < 32 else []) for i in range(len(rows)))


def test_terms_far_from_their_entity_and_without_it(spark):
    body = lambda i: " ".join(f"plain{i}x{k}" for k in range(30))
    rows = [f"Zanzibarov notes {body(i)} zanzibarov\n{body(i + 50)} zz@corp.example" for i in range(4)]
    rows += ["seen Ünder Zanzibarov, only", "Zanzibarov", *["nothing to see here"] * 100, None]
    got = by_id(pii.sanitise(spark.createDataFrame(rows_of(rows), SCHEMA)))
    added = [[rows[i][s["start"] : s["end"]] for s in got[i]["added"]] for i in range(len(rows))]
    assert added == [["Zanzibarov", "notes", "zanzibarov"]] * 4 + [["Zanzibarov"], ["Zanzibarov"]] + [[]] * 101
    assert got[4]["sanitised"] == "seen Ünder [TERM], only" and got[0]["sanitised"].endswith("[EMAIL]")


def test_early_pruning_loses_no_pair(spark, monkeypatch):
    rows = [f"Zanzibarov {'often' if i % 2 else 'seldom'} word{i} far {'x ' * 20} zz@corp.example {i}" for i in range(40)] + [f"far often {i}" for i in range(300)]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)
    want = {tuple(r) for r in pii.disclosing(df, "text").collect()}
    monkeypatch.setattr(pii, "LIGHT", 1)
    assert {tuple(r) for r in pii.disclosing(df, "text").collect()} == want and {t for _, t in want} == {pii._hash("zanzibarov"), pii._hash("seldom")}


def test_licenses_of_both_splits(spark):
    s = licenses.SENTENCES
    header = s["apache-2-header"].replace("you may", "\n# you may").replace("except in", "except\n# in")
    grant = s["mit-grant"].replace(" copies", "\ncopies")
    texts = [
        f"# Copyright 2020 X\n# All rights reserved.\n# {header}\n#\n# {s['apache-2-copy']}\n#\n# {s['apache-2-as-is'].replace('software', chr(10) + '# software')}\n",
        f"Heading\nReleased under the MIT License.\n\n{grant}\n\n{s['mit-notice']}\n{s['cc0'].replace('author', chr(10) + 'author')}",
        f"notes\n#\n# {grant}\n#\n# more",
    ]
    got = by_id(licenses.scan(spark.createDataFrame(rows_of(texts), SCHEMA)))
    assert [got[i]["sentence_ids"] for i in range(3)] == [["copyright", "all-rights", "apache-2-header", "apache-2-copy", "apache-2-as-is"], ["mit-released", "mit-grant", "mit-notice", "cc0"], ["mit-grant"]]
    assert [got[i]["licenses"] for i in range(3)] == [["Apache-2.0", "all-rights-reserved"], ["MIT", "CC0-1.0"], ["MIT"]]


def test_codes_reach_the_least_probability():
    for tokens in (10, 10**7, 10**9, 10**12):
        step, counts = lm.step_for(tokens), np.unique(np.geomspace(1, tokens, 500).astype(np.int64))
        p = (counts - lm.DISCOUNT) / tokens
        assert np.abs(np.log10(lm.probabilities(step)[lm.quantise(p, step)] / p)).max() <= 0.5 * step + 1e-9


def brute_disclosing(texts, support, threshold):
    """(entity, term) pairs, counted document by document, with contexts as the words themselves."""
    total, word = len(texts), re.compile(pii._TERM.pattern)
    n_e, places, n_t, n_et, marks = (collections.Counter() for _ in range(5))
    seen = collections.defaultdict(set)
    for body in (t or "" for t in texts):
        spans = pii.base_spans(body)
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(body)]
        n_t.update({w for w in re.split("[^a-z0-9\\x80-\\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in body)) if w})
        usable = {i: w for i, (a, b, w) in enumerate(words) if b - a >= 3 and not w.isdigit() and not any(a < y and b > x for _, x, y in spans)}
        held = collections.defaultdict(list)
        for s in spans:
            held[pii.entity_of(body, s)].append(s)
        for e, own in held.items():
            n_e[e] += 1
            places[e] += len(own)
            close, first = set(), None
            for _, a, b in own:
                lo, hi = sum(y <= a for _, y, _ in words), next((i for i, (x, _, _) in enumerate(words) if x >= b), len(words))
                window = [*range(max(0, lo - pii.NEAR), lo), *range(hi, min(len(words), hi + pii.NEAR))]
                context = tuple(words[i][2] for i in window)
                first = context if first is None else first
                for i in window:
                    if i in usable:
                        seen[e, usable[i]].add(context)
                        close.add(usable[i])
            for w in set(usable.values()):
                n_et[e, w] += 1
                if w not in close:
                    i = min(j for j, x in usable.items() if x == w)
                    seen[e, w].add((tuple(x[2] for x in words[max(0, i - pii.NEAR) : i + pii.NEAR + 1]), first))
    share = lambda e, w: 1 + math.log2(min(n_et[e, w] / n_t[w], 1)) / max(math.log2(total / n_e[e]), 1e-9)
    return {(e, pii._hash(w)) for e, w in n_et if places[e] >= support and len(seen[e, w]) >= support and share(e, w) >= threshold}


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(8)
    people = [(f"Name{i}ov", f"p{i}@corp.example", f"10.0.0.{i}") for i in range(6)]
    common = [f"word{i}" for i in range(40)]
    texts = [None, "", "plain text only"]
    for _ in range(260):
        words = rng.choices(common, k=rng.randint(5, 40))
        for name, mail, ip in rng.sample(people, rng.choice((0, 0, 1, 1, 2))):
            for x in (name, rng.choice((mail, ip)), *rng.choices((name, mail, "agent"), k=rng.randint(0, 2))):
                words.insert(rng.randrange(len(words) + 1), x)
        texts.append(" ".join(words))
    texts += [texts[20]] * 15
    for threshold in (0.5, 0.8):
        found = pii.disclosing(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3), "text", threshold=threshold)
        want = brute_disclosing(texts, pii.SUPPORT, threshold)
        assert want and {tuple(r) for r in found.collect()} == want


def test_manners_of_sanitising(spark):
    told = [f"north{i} call Zanzibarov or agent7 at zz@corp.example, +44 20 7946 0018 south{i}" for i in range(4)]
    df = spark.createDataFrame(rows_of([*told, "10.2.3.4 paid 4111 1111 1111 1111", *["nothing to see here"] * 200]), SCHEMA)
    general = by_id(pii.sanitise(df, manner="generalise"))
    assert general[0]["sanitised"] == "north0 [TERM] [NAME] or [CODE] at *@*.example, +44*** south0" and general[4]["sanitised"] == "10.*.*.* paid 4***"
    assert by_id(pii.sanitise(df, manner="remove"))[4]["sanitised"] == " paid "


def test_clashing_columns_and_repeats(spark):
    """Columns named like the operators' own, null in any column, a long text, repeated rows and ids."""
    from lectern.llm import exactdup, mixing, neardup

    names = ["row", "id", "digest", "_gone", "_p", "_c", "_key", "_copies", "source", "rep", "whole", "n"]
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(1, "a b c d e f g", *["x"] * 12), (1, "a b c d e f g", *["x"] * 12), (2, "a b c d e f g", *["y"] * 12), (3, None, *[None] * 12), (None, "", *["z"] * 12), (4, long, *["x"] * 12), (5, long + " tail", *["x"] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    once = exactdup.exact_dedup(df, keep="largest")
    assert once.columns == df.columns and sorted((r["doc_id"], r["row"]) for r in once.collect()) == [(2, "y"), (3, None), (4, "x"), (5, "x")]
    near = neardup.near_dedup(df)
    assert near.columns == df.columns and sorted((r["doc_id"] or 0, r["rep"] or "") for r in near.collect()) == [(0, "z"), (1, "x"), (1, "x"), (3, ""), (4, "x")]
    mixed = mixing.mix(df, limit=1.0)
    assert mixed.columns == df.columns and {(r["doc_id"], r["_copies"]) for r in mixed.collect()} == {(r[0], r[2]) for r in rows}
    found = by_id(licenses.scan(df, keep=("doc_id", "n")))
    assert len(found) == 6 and found[4]["n_sentences"] == 1 and by_id(media.store(df))[4]["n_bytes"] == len(long)
    packed = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.where("doc_id = 4").agg({"length": "sum"}).first()[0] == packed.where("doc_id = 4").first()["doc_tokens"] > 40_000
    assert packed.where("doc_id = 1 AND start = 0").count() == 2 and packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sniffing_awkward_values(spark):
    gray = b"P5\n2 2\n100\nabcd"
    long = bytes(range(256)) * 4000
    rows = [(1, bytearray(gray), "image/png"), (1, bytearray(gray), "image/png"), (2, bytearray(long + gray), None), (3, None, "x"), (4, bytearray(b""), None)]
    df = spark.createDataFrame(rows, "doc_id long, content binary, detected_type string")
    got = sorted(media.sniff(df, "content", "detected_type", ("doc_id",)).collect())
    assert [(r["doc_id"], r["detected_type"], r["corrected"], [(e["start"], e["length"]) for e in r["embedded"]]) for r in got] == [
        (1, "image/x-portable-graymap", True, []), (1, "image/x-portable-graymap", True, []), (2, None, False, [(len(long), len(gray))]), (3, None, False, []), (4, None, False, []),
    ]
    assert media.sniff(df.limit(0), "content").count() == 0


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"word{i % 5000}" for i in range(120_000)) + " mail a@b.example now"
    df = spark.createDataFrame(rows_of([long, "short"]), SCHEMA)
    got = by_id(pii.sanitise(df.union(df)))
    assert [s["kind"] for s in got[0]["base"]] == ["email"] and got[0]["sanitised"].endswith("[EMAIL] now")
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.sanitise(df.union(df)).count() == 4
    from lectern.llm import exactdup, mixing

    groups = exactdup.exact_groups(df.union(df)).collect()
    assert sorted((r["doc_id"], r["group_size"], r["kept"]) for r in groups) == [(0, 2, True), (0, 2, True), (1, 2, True), (1, 2, True)] and exactdup.exact_groups(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.schedule(df).collect()} == {0: 120_003, 1: 1}

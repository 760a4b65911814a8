"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from codestrata.llm import embeddings, licenses, linededup, mixing, packing, quality, simhash, toxicity, urlfilter, warczip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "\n" + "x" * 5_000
ROWS = [
    (1, "a b c d e\nLicensed under the MIT License.\n" + "L" * 45, "en", "s1", 1),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, LONG, "de", "s2", 5),
    (5, "a b c d e\nLicensed under the MIT License.\n" + "l" * 45, "en", None, 1),
    (5, "a b c d e\nLicensed under the MIT License.\n" + "l" * 45, "en", None, 1),
    (None, "no id here", "en", "s2", 1),
    (6, " \n\t\r\n", "fr", "s3", 1),
    (7, "é€😀 <|endoftext|> \x0b tab\tx", "es", "s3", 1),
]
CLASH = ["score", "kept", "size", "line", "fp", "id", "row", "rank", "n", "word", "__x", "__d", "__t", "__doc", "__tid", "__dropped", "__source", "__cut", "__copies", "__row", "key", "text_key", "copies", "dropped", "tid", "s", "of", "whole"]
PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


def per_doc(docs, labels):
    return {
        "toxicity": toxicity.report(docs, labels),
        "simhash": simhash.simhash_components(docs),
        "licenses": licenses.scan(docs),
        "quality": quality.report(docs, labels),
        "lines": linededup.line_report(docs),
        "mixing": mixing.mix_report(docs),
    }


@pytest.mark.parametrize("name", ["toxicity", "simhash", "licenses", "quality", "lines", "mixing"])
def test_a_row_per_row(docs, labels, name):
    rows = per_doc(docs, labels)[name].collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", ["toxicity", "simhash", "licenses", "quality", "lines", "mixing"])
def test_empty_table(docs, labels, name):
    assert per_doc(docs.limit(0), labels.limit(0))[name].count() == 0


def test_stages_keep_columns(docs, labels):
    for out in (toxicity.keep(docs, labels), linededup.dedup_lines(docs), simhash.keep_one(docs), mixing.mix(docs)):
        assert out.columns == docs.columns and out.schema == docs.schema
        assert out.filter("score = 'clash'").count() == out.count() > 0
    for out in (toxicity.keep(docs.limit(0), labels), linededup.dedup_lines(docs.limit(0)), simhash.keep_one(docs.limit(0)), mixing.mix(docs.limit(0))):
        assert out.count() == 0 and out.columns == docs.columns


def test_near_dedup_keeps_one_of_each(docs):
    rows = simhash.keep_one(docs).collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(5) == 0 and ids.count(1) == 1 and {4, 7} <= set(ids) and None in ids  # 5 differs from 1 by letter case only
    assert sum(i in (2, 3, 6) for i in ids) == 1  # empty texts are linked


def test_near_dedup_decides_rows_without_id_by_text(spark):
    from test_methods import near_texts, text_of

    r = random.Random(11)
    a, b, c = near_texts(3, r)
    alone, held = text_of(120, r), text_of(120, r)
    rows = [(1, held, "named"), (None, held, "copy"), (None, alone, "alone"), (None, alone.upper(), "alone"), (None, a, "near"), (None, b, "near"), (None, c, "near"), (2, "", "empty"), (None, "", "copy"), (None, None, "copy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r["source"] for r in simhash.keep_one(df).collect())
    assert got == ["alone", "empty", "named", "near"]
    assert sorted(r["source"] for r in simhash.keep_one(df.filter("doc_id is null")).collect()) == ["alone", "copy", "copy", "near"]  # held, and the empty texts


def test_near_dedup_keeps_unique_texts_without_id(spark):
    rows = [(1, "one text of its own", "a"), (None, "one text of its own", "b"), (None, "another text that nobody copies", "c"), (2, "a third text, quite unlike the rest", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __d string")
    assert sorted(r["__d"] for r in simhash.keep_one(df).collect()) == ["a", "c", "d"]


def test_near_dedup_orders_repeated_rows(spark):
    rows = [(1, "same text here", "z"), (1, "same text here", "b"), (1, "same text here", "k"), (None, "alone", "y"), (None, "alone", "x"), (4, None, "u"), (4, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for part in (1, 5):
        assert sorted(r["source"] for r in simhash.keep_one(df.repartition(part)).collect()) == ["b", "u", "x"]  # null columns are left out of the JSON


def test_long_document_of_lines(spark):
    lines = [f"this long line number {i} is in several of the documents" if i % 2 else f"own {i}" for i in range(100_000)]
    rows = [(d, "\n".join(lines)) for d in range(5)]
    began = time.perf_counter()
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert time.perf_counter() - began < 60
    assert {r["doc_id"]: r["text"] for r in got} == {d: t if d == 4 else "\n".join(lines[::2]) for d, t in rows}


def test_packing(docs):
    rows = packing.pack(docs, PATH).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and next(r for r in rows if r["doc_id"] == 2)["length"] == 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [-0.0, 1.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "w", "v", "label", "key")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), 11: (2, 11, True), 12: (2, 11, False), None: (2, 11, False), **{k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)}}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    big = "y" * 1000
    rows = [(1, "http://A.com/x", big), (2, None, big), (3, "", None), (4, "http://b.com", ""), (5, "u", "small"), (6, "u", "small"), (7, "http://c.com/é", "é" * 600), (2, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "rule", "n", "line")})
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warczip.round_trip(df).collect() if r["page_id"] != 2)
    assert got == [(1, 1000, "revisit", 2), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 1200, "response", None)]
    assert warczip.round_trip(df.limit(0)).count() == 0
    judged = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    assert judged[1]["host"] == "a.com" and judged[2]["host"] == "" and judged[2]["verdict"] == "allow" and judged[3]["path"] == ""
    assert urlfilter.judge(df).count() == len(rows) and urlfilter.judge(df.limit(0)).count() == 0


def test_packages_are_bounded_and_read_apart(spark, tmp_path):
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * 3000) for i in range(60)] + [(100 + i, "http://same", "s" * 2000) for i in range(40)] + [(200 + i, "http://short", "") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = warczip.write_packages(df, f"file://{tmp_path}/packages", package=10_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() >= 8
    back = warczip.read_packages(manifest)
    assert back.rdd.getNumPartitions() == manifest.count()
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back.collect()}
    top = {x: max(i for i in range(60) if i % 26 == x) for x in range(26)}
    assert got == {i: ("response", None, 3000) if top[i % 26] == i else ("revisit", top[i % 26], 3000) for i in range(60)} | {100 + i: ("response", None, 2000) if i == 39 else ("revisit", 139, 2000) for i in range(40)} | {200 + i: ("response", None, 0) for i in range(40)}


def test_no_worker_is_left_out(spark):
    """The subpackage sets nothing that points outside the folder executors share."""
    assert spark.conf.get("spark.checkpoint.dir") and os.path.isdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert np.bitwise_count(np.uint64(7)) == 3

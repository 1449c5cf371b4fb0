"""Landed files as they come: quotes over lines, bad bytes, repeats over files, broken lines, changed documents."""

import hashlib

from retrospect.sources import changes, landing
from pyspark.sql import functions as F

HEADER = b"Date,Release Date,Type,Text\n"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(HEADER + b'2024-01-01,x,Statement,"first, ""quoted""\nover lines"\n2024-01-01,x,Minute,plain\n2024-02-01,x,Statement,bad\xe9byte\n')
    (tmp_path / "2.csv").write_bytes(HEADER + b'2024-01-01,x,Statement,earlier\n2024-01-01,x,Statement,""\n,x,Minute,none\n2024-01-01,x,Memo,other\n2024-01-01,x\na,b,Minute,d,e\n')
    (tmp_path / "3.csv").write_bytes(HEADER)
    accepted, rejected = landing.landed_corpus(spark, str(tmp_path))
    folded = changes.folded_corpus(accepted.withColumn("ordinal", F.struct("file", "position"))).collect()
    assert {(r.date, r.Statement, r.Minute) for r in folded} == {("2024-01-01", "", "plain"), ("2024-02-01", "bad�byte", None)}
    assert sorted(r.reason for r in rejected.collect()) == ["COLUMNS", "COLUMNS", "KIND", "NO_DATE"]
    text = {r.text for r in accepted.collect()}
    assert 'first, "quoted"\nover lines' in text


def test_feed_lines(spark, tmp_path):
    lines = [
        '{"series_id": "a", "date": "2024-01-01", "value": "."}', '{"series_id": "a", "date": "2024-13-01", "value": "1"}', "{", "",
        '{"series_id": "a", "value": "1"}', '{"series_id": "a", "date": "2024-01-02", "value": "x7", "realtime_start": "2024-01-03", "more": 1}',
    ]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    accepted, rejected = landing.landed_feed(spark, str(tmp_path))
    parsed = {(str(r.date), r.value_raw, r.value, r["mode"]) for r in changes.parsed_feed(accepted).collect()}
    assert parsed == {("2024-01-01", ".", None, "OBSERVATION_DATE_PROXY"), ("2024-01-02", "x7", None, "VINTAGE")}
    assert sorted(r.reason for r in rejected.collect()) == ["NO_KEY", "PARSE", "PARSE"]


def test_binary_documents(spark, tmp_path):
    contents = {"a.pdf": b"\x00\xff", "b.pdf": b"", "c.pdf": b"changed", "d.pdf": b"new"}
    (tmp_path / "deep").mkdir()
    for name, content in contents.items():
        (tmp_path / "deep" / name).write_bytes(content)
    hashes = {n: hashlib.sha256(c).hexdigest() for n, c in contents.items() if n != "d.pdf"} | {"c.pdf": "0" * 64, "e.pdf": "1" * 64}
    listed = spark.createDataFrame(list(hashes.items()), "document_id string, sha256 string")
    accepted, rejected = landing.landed_documents(spark, str(tmp_path), listed)
    assert {(r.document_id, bytes(r.content)) for r in accepted.collect()} == {("a.pdf", b"\x00\xff")}
    assert {(r.document_id, r.reason) for r in rejected.collect()} == {("c.pdf", "CHANGED"), ("d.pdf", "UNLISTED"), ("e.pdf", "ABSENT"), ("b.pdf", "ABSENT")}  # b.pdf has no byte

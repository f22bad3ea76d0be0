"""Readers and writers on small files."""

import json
import os

import pytest

from pactlens.config import CascadeConfig
from pactlens.operators import explain, mining
from pactlens.plans import analyze
from pactlens.sources import clauses, documents, labeled
from workloads import registry

CSV = '''sentence,label
"Pays, ""late""
fees.",Penalty

"  ",Penalty
Benign one.,None
No label.,
'''


def test_read_labeled(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(CSV, encoding="utf-8")
    rows = labeled.read_labeled(spark, str(path)).orderBy("seq").collect()
    assert [(r["sentence"], r["label"]) for r in rows] == [('Pays, "late" fees.', "Penalty"), ("Benign one.", "None")]
    with pytest.raises(RuntimeError):
        labeled.load_training_data(spark, str(path))
    assert labeled.load_training_data(spark, str(path), min_rows=2).count() == 2
    bad = tmp_path / "b.csv"
    bad.write_text("text,label\na,b\n", encoding="utf-8")
    with pytest.raises(ValueError):
        labeled.read_labeled(spark, str(bad))


def test_corpus_written_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c\nd', "None", "cuad")], "sentence string, label string, source string")
    out = str(tmp_path / "deep" / "corpus")
    labeled.write_corpus(df, out)
    row = labeled.read_labeled(spark, out).first()
    assert (row["sentence"], row["label"], row["source"]) == ('a "b", c d', "None", "cuad")


def test_qa_json_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    obj = {"data": [{"paragraphs": [{"context": "c", "qas": [{"question": "Venue?", "answers": [{"text": "v"}]}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(obj, indent=2))
    (tmp_path / "sub" / "b.JSON").write_text(json.dumps(obj))
    (tmp_path / "c.txt").write_text("no")
    files = clauses.read_qa_json(spark, str(tmp_path))
    assert mining.qa_answers(mining.qa_paragraphs(files)).count() == 2
    with pytest.raises(Exception):
        clauses.read_qa_json(spark, str(tmp_path / "sub" / "nothing"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(RuntimeError):
        clauses.read_qa_json(spark, str(tmp_path / "empty"))


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('Document Name,Insurance\n"D, 1","Keep\ncover."\n', encoding="utf-8")
    cells = mining.wide_clauses(clauses.read_wide_clauses(spark, str(path)), ())
    assert sorted((r["clause"], r["text"]) for r in cells.collect()) == [
        ("Document Name", "D, 1"), ("Insurance", "Keep cover.")]


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("grüß".encode() + b"\xff\xfe ok")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.docx").write_bytes(b"x")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "big.txt").write_bytes(b"x" * 50)
    got = {os.path.basename(r["path"]): (r["text"], r["error"]) for r in
           documents.ingest_files(spark, str(tmp_path), max_bytes=40).collect()}
    assert got["a.TXT"] == ("grüß ok", None)
    assert got["b.pdf"] == (None, None)
    assert got["c.docx"][1] and got["noext"][1]
    assert got["big.txt"] == (None, documents.ERR_TOO_LARGE)


def test_concat_pages(spark):
    rows = [(1, 1, "b"), (1, 0, "a"), (1, 2, None), (1, 3, "c"), (2, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    got = sorted(tuple(r) for r in documents.concat_pages(pages).collect())
    assert got == [(1, "abc"), (2, "")]


def test_valid_replacement_characters_stay(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes(b"a\xef\xbf\xbdb\xffc")
    assert documents.ingest_files(spark, str(tmp_path)).first()["text"] == "a\ufffdbc"


@pytest.mark.parametrize("multi_line", [True, False])
def test_rows_of_files_count_in_the_order_of_their_names(spark, tmp_path, multi_line):
    (tmp_path / "a b.csv").write_text("sentence,label\nsame,first\n")
    (tmp_path / "b.csv").write_text("sentence,label\n" + "".join(f"s{i},x\n" for i in range(3000)) + "same,second\n")
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = labeled.read_labeled(spark, str(tmp_path), multi_line)
        got = [r["sentence"] for r in rows.orderBy("seq").collect()]
        assert got == ["same", *[f"s{i}" for i in range(3000)], "same"]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_files_read_back_in_order(spark, tmp_path):
    """Packed CSV files hold the same rows, line breaks and order of first occurrence, on less disk."""
    rows = [(f'clause "{i}",\nsays the {i % 7} party', f"L{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "sentence string, label string").coalesce(2)
    for name, packed in (("plain", None), ("packed", "gzip")):
        labeled.write_corpus(df, str(tmp_path / name), compression=packed)
    plain, packed = ([(r["sentence"], r["label"]) for r in labeled.read_labeled(spark, str(tmp_path / name)).orderBy("seq").collect()]
                     for name in ("plain", "packed"))
    assert packed == plain and len(plain) == 2000
    size = {name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*")) for name in ("plain", "packed")}
    assert size["packed"] < size["plain"] / 3


def test_first_seen_files_are_packed(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "scratch_dir", lambda spark, name: str(tmp_path / name))
    assert registry.registry()["first_seen_files"](spark, sf).count() > 0
    assert {f.name[-7:] for f in (tmp_path / "ordered").glob("*/part-*")} == {".csv.gz"}


def test_requests_and_inputs(spark):
    rows = [(" s ", "Penalty", "High"), ("", "Penalty", "High"), ("s", None, "High"), ("x" * 8001, "P", "H"), ("x" * 8000, "P", "H")]
    got = [r["error"] for r in explain.validate_requests(
        spark.createDataFrame(rows, "sentence string, risk_type string, severity string").coalesce(1)).collect()]
    assert [bool(e) for e in got] == [False, True, True, True, False]
    rows = [("a.txt", None), ("a.exe", "text"), ("", "text"), (None, " "), ("txt", "t")]
    got = documents.validate_inputs(spark.createDataFrame(rows, "file_name string, text string").coalesce(1)).collect()
    assert [r["input_kind"] for r in got] == ["file", None, "text", None, None]
    assert [bool(r["error"]) for r in got] == [False, True, False, True, True]


def test_explanation_sources(spark):
    risks = spark.createDataFrame([(1, "Penalty", "High"), (2, "Penalty", "Low"), (3, "Other", "Low")],
                                  "id long, risk_type string, severity string")
    answers = spark.createDataFrame([(1, " because "), (2, " "), (9, "x")], "id long, answer string")
    got = {r["id"]: (r["explanation"], r["source"]) for r in
           explain.explain_with_fallback(risks, answers, ("id",)).collect()}
    assert got[1] == ("because", "llm") and got[2][1] == "llm" and got[3][1] == "template"


def test_reports_agree_between_paths(spark):
    docs = spark.createDataFrame([(1, "You must pay a fine. Hello."), (2, ""), (3, None)], "doc_id long, text string")
    schema = "doc_id long, sent_idx int, scores array<struct<label:string,score:double>>"
    none = spark.createDataFrame([], schema)
    keyword = CascadeConfig(mode="keyword")
    inline = {r["doc_id"]: r["summary"] for r in analyze.analyze_report(docs, keyword).collect()}
    joined = {r["doc_id"]: r["summary"] for r in analyze.analyze_report(docs, keyword, tier1=none, tier2=none).collect()}
    assert inline == joined
    assert inline[1]["risk_percentage"] == 50.0 and inline[2]["total_sentences"] == 0
    summary = {r["doc_id"]: r["total_sentences"] for r in analyze.summarize_documents(docs, keyword).collect()}
    assert summary == {1: 2, 2: 0, 3: 0}


@pytest.mark.parametrize("multi_line", [True, False])
def test_columns_are_found_by_name_in_each_file(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("sentence,label\none sentence,Penalty\n")
    (tmp_path / "b [x].csv").write_text('\n"label",sentence\nPenalty,two sentence\nNone\n')
    (tmp_path / "c+d.csv").write_text("﻿source,sentence,note,label\ncuad,three sentence,n,None\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("label,sentence,label\nold,four sentence,new\n")
    rows = labeled.read_labeled(spark, str(tmp_path), multi_line).orderBy("seq").collect()
    assert [(r["sentence"], r["label"], r["source"]) for r in rows] == [
        ("one sentence", "Penalty", None), ("two sentence", "Penalty", None), ("three sentence", "None", "cuad"), ("four sentence", "new", None)]
    assert labeled.load_training_data(spark, str(tmp_path), 4, multi_line).count() == 4
    (tmp_path / "f.csv").write_text("sentence,class\na,b\n")
    with pytest.raises(ValueError, match="f.csv"):
        labeled.read_labeled(spark, str(tmp_path), multi_line)
    # Without the check, rows of a file that has no label are blank there.
    assert labeled.load_training_data(spark, str(tmp_path), 4, multi_line).count() == 4


def test_files_of_one_header_are_read_once(spark, tmp_path):
    for name, text in (("a", "sentence,label\nx,A\n"), ("b", "label,sentence\nB,y\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    read = labeled.read_labeled(spark, str(tmp_path))
    scans = [r for r in read.select("sentence", "seq").collect()]
    assert len(scans) == 2 and len(read.inputFiles()) == 2


def test_wide_files_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Document Name,Insurance\nD,Keep cover.\n")
    (tmp_path / "b.csv").write_text("Insurance,Extra,Document Name\nNo cover.,x,E\n")
    cells = mining.wide_clauses(clauses.read_wide_clauses(spark, str(tmp_path)), ())
    assert sorted((r["clause"], r["text"]) for r in cells.collect()) == [
        ("Document Name", "D"), ("Document Name", "E"), ("Insurance", "Keep cover."), ("Insurance", "No cover.")]

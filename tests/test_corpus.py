"""Corpus operators against small hand-made tables and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pactlens.operators import corpus, evaluate, mining
from pactlens.plans import build_corpus
from pactlens.sources.clauses import QA_SCHEMA

SCHEMA = "sentence string, label string, source_rank int, seq long"


def frame(spark, pairs):
    return spark.createDataFrame([(s, l, 0, i) for i, (s, l) in enumerate(pairs)], SCHEMA)


def pairs_of(df):
    return sorted((r["sentence"], r["label"]) for r in df.collect())


def test_conflict_strategies(spark):
    df = frame(spark, [("s", "A"), ("s", "None"), ("s", "B"), ("t", "A"), ("t", "B"), ("t", "B"), ("u", "None")])
    assert pairs_of(corpus.resolve_conflicts(df, "prefer_non_none")) == [("s", "A"), ("t", "A"), ("u", "None")]
    assert pairs_of(corpus.resolve_conflicts(df, "majority")) == [("s", "A"), ("t", "B"), ("u", "None")]
    assert pairs_of(corpus.resolve_conflicts(corpus.distinct_pairs(df), "majority")) == [
        ("s", "A"), ("t", "A"), ("u", "None")]
    assert pairs_of(corpus.resolve_conflicts(df, "keep_all")) == [
        ("s", "A"), ("s", "B"), ("s", "None"), ("t", "A"), ("t", "B"), ("u", "None")]
    with pytest.raises(ValueError):
        corpus.resolve_conflicts(df, "other")


def test_distinct_pairs_resolve_as_rows_do(spark):
    """Pairs resolved in a window give what their rows give by joins: with NULL keys, labels and orders, and orders of two labels."""
    rng = random.Random(5)
    rows = [(rng.choice([f"s{rng.randrange(40)}", None]), rng.choice(["A", "B", "None", None]), rng.randrange(3),
             rng.choice([i, i // 2, None])) for i in range(400)]
    pairs = corpus.distinct_pairs(spark.createDataFrame(rows, SCHEMA).filter("seq IS NOT NULL OR sentence != 's1'")).cache()
    unordered = spark.createDataFrame([("only", "A", 0, None)], SCHEMA)
    for strategy in ("prefer_non_none", "majority", "keep_all"):
        for df in (pairs.filter("sentence IS NOT NULL AND label IS NOT NULL").dropDuplicates(["source_rank", "seq"]), unordered):
            want, got = (corpus.resolve_conflicts(df, strategy, distinct=d).collect() for d in (False, True))
            assert sorted((r["sentence"], r["label"]) for r in got) == sorted((r["sentence"], r["label"]) for r in want)
    pairs.unpersist()
    null = spark.createDataFrame([(None, "A", 0, 1), (None, "None", 0, 0), ("s", None, 0, 2), ("s", "B", 0, 2)], SCHEMA)
    for strategy in ("prefer_non_none", "majority"):
        want, got = (corpus.resolve_conflicts(null, strategy, distinct=d).collect() for d in (False, True))
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_first_seen_does_not_depend_on_row_order(spark):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(20)}", rng.choice(["A", "B", "None"]), rng.randrange(3), i) for i in range(300)]
    first = {}
    for s, l, r, i in sorted(rows, key=lambda x: (x[2], x[3])):
        first.setdefault(s, l)
    for n in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        assert dict(pairs_of(corpus.dedup_first(df))) == first
        stats = corpus.dedup_stats(df).first()
        assert (stats["rows_before"], stats["rows_after"]) == (300, len(first))


def test_merge_sources(spark):
    a = spark.createDataFrame([("x", "A", 0)], "sentence string, label string, seq long")
    b = spark.createDataFrame([("x", "B", 0, "tagged")], "sentence string, label string, seq long, source string")
    merged = corpus.merge_corpora([("original", a), ("gone", None), ("cuad", b)])
    assert sorted((r["source"], r["source_rank"]) for r in merged.collect()) == [("original", 0), ("tagged", 2)]
    with pytest.raises(ValueError):
        corpus.merge_corpora([("gone", None)])
    final = build_corpus.merged_training_corpus([("original", a), ("cuad", b)])
    assert pairs_of(final) == [("x", "A")]


def test_clean_rows(spark):
    df = spark.createDataFrame([("  a   b ", " L "), (" ", "L"), ("a", None)], "sentence string, label string")
    assert pairs_of(corpus.clean_rows(df, "sentence", "label")) == [("a b", "L")]


QA_ROWS = [{"data": [
    {"paragraphs": [
        {"context": "Venue is here. The fee is late. Plain words. All of it. Ends now.",
         "qas": [
             {"question": "What is the Governing Law?", "answers": [{"text": " Venue is here. "}, {"text": "N/A"}]},
             {"question": "Late payment?", "answers": [{"text": "fee is late"}, {"text": "All of it. Ends now."}]},
             {"question": "Who signs?", "answers": [{"text": "Plain words"}]},
             {"question": None, "answers": None}]},
        {"context": "", "qas": [{"question": "Audit?", "answers": [{"text": "lost"}]}]},
        {"context": "Venue is here. Kept.", "qas": []}]},
    {"paragraphs": None}]}]


def test_qa_corpus(spark):
    files = spark.createDataFrame(QA_ROWS, QA_SCHEMA)
    paragraphs = mining.qa_paragraphs(files)
    answers = mining.qa_answers(paragraphs)
    assert sorted((r["label"], r["answer"]) for r in answers.collect()) == [
        ("Arbitration", "Venue is here."), ("Penalty", "All of it. Ends now."), ("Penalty", "fee is late")]
    assert pairs_of(mining.qa_positives(answers)) == [
        ("All of it.", "Penalty"), ("Ends now.", "Penalty"), ("Venue is here.", "Arbitration"),
        ("fee is late", "Penalty")]
    # A snippet of two sentences excludes neither of them; unmapped questions exclude nothing.
    assert sorted(r["sentence"] for r in mining.qa_negatives(paragraphs).collect()) == [
        "All of it.", "Ends now.", "Plain words."]
    built = build_corpus.corpus_from_qa(files, 0.5)
    assert built.filter("label = 'None'").count() == 2 and built.count() == 6


def test_answers_are_found_through_the_index(spark):
    """The index excludes what the test in the row excludes: short and long answers, repeats, other paragraphs, wide characters."""
    rng = random.Random(8)
    words = ["fee", "cap", "\U0001f600\U0001f600", "straße", "law", "party", "of", "the", "termination"]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    def paragraph():
        context = ". ".join(text(rng.randrange(1, 12)) for _ in range(30))
        answers = [rng.choice(context.split(". "))[rng.randrange(4):][:rng.randrange(1, 40)] for _ in range(6)]
        answers += [text(3), " ", "n/a", "of", None, "a. b", "fee cap law party of the fee"]
        return {"context": context, "qas": [{"question": "Late payment?", "answers": [{"text": a} for a in answers]},
                                            {"question": "Who signs?", "answers": [{"text": "the"}]}, {"question": None, "answers": None}]}

    paragraphs = [paragraph() for _ in range(12)]
    paragraphs += paragraphs[:3] + [{**paragraphs[0], "qas": paragraphs[1]["qas"]}]
    paragraphs += [{"context": "Plain words here. " * 3, "qas": [{"question": "Late payment?", "answers": None}]}]
    files = spark.createDataFrame([{"data": [{"paragraphs": paragraphs}]}], QA_SCHEMA)
    rows = mining.qa_paragraphs(files)
    want = sorted(r["sentence"] for r in mining.qa_negatives(rows).collect())
    assert want
    for work in (0, 20_000, 10**9):
        assert sorted(r["sentence"] for r in mining.qa_negatives(rows, work).collect()) == want


def test_long_paragraph_with_many_answers(spark):
    """One paragraph of 20,000 sentences and 4,000 answers: a third of them occur, each in one sentence."""
    sents = [f"Clause {i * 7919 % 1_000_003:07d} binds the parties to the fee." for i in range(20_000)]
    answers = [f"{i * 7919 % 1_000_003 if i % 3 == 0 else 1_000_003 + i:07d} binds the parties" for i in range(4_000)]
    one = {"context": " ".join(sents), "qas": [{"question": "Late payment?", "answers": [{"text": a} for a in answers]}]}
    rows = mining.qa_paragraphs(spark.createDataFrame([{"data": [{"paragraphs": [one]}]}], QA_SCHEMA))
    got = {r["sentence"] for r in mining.qa_negatives(rows, mining.IN_ROW_WORK).collect()}
    assert got == {s for i, s in enumerate(sents) if i >= 4_000 or i % 3}


def test_wide_corpus(spark):
    wide = spark.createDataFrame(
        [("c1", "Cap is low. <omitted> Cap is low.", "Alpha  Inc. Must pay.", None), ("c2", " <omitted> ", "Alpha Inc.", "x")],
        "id string, `Cap On Liability` string, Parties string, Extra string")
    cells = mining.wide_clauses(wide, ("id",))
    assert sorted((r["id"], r["clause"], r["text"]) for r in cells.collect()) == [
        ("c1", "Cap On Liability", "Cap is low. Cap is low."), ("c1", "Parties", "Alpha Inc. Must pay."),
        ("c2", "Parties", "Alpha Inc.")]
    assert pairs_of(mining.wide_positives(cells)) == [("Cap is low.", "Liability")]
    assert [r["sentence"] for r in mining.wide_negatives(cells).collect()] == ["Alpha Inc."]
    assert pairs_of(build_corpus.corpus_from_wide(wide, ("id",), 1.0)) == [
        ("Alpha Inc.", "None"), ("Cap is low.", "Liability")]


def test_titles_and_provisions(spark):
    text = "This answer is longer than twenty characters."
    qas = [("a__Venue", ([text, " short one "],)), ("b__Unknown", ([text],)), ("noparts", ([text],)), ("c__Insurance__x", (["y" * 21],))]
    df = spark.createDataFrame([("train", qas)], "split string, qas array<struct<id:string,answers:struct<text:array<string>>>>")
    assert pairs_of(corpus.map_titles(df)) == [(text, "Arbitration"), ("y" * 21, "Obligation")]
    rows = spark.createDataFrame([("a ", 0), ("b", -1), (" ", 0), ("c", 9), ("d", 1)], "text string, label int")
    assert pairs_of(corpus.map_provisions(rows, ["Fees", "Notices"])) == [("a", "Penalty")]


def test_question_rules(spark):
    rows = [("Governing Law of termination", "Arbitration"), ("Renewal interest", "Termination"),
            ("define", "Penalty"), ("warranty notice", "Liability"), ("Payment", "Obligation"), ("Other", None), (None, None)]
    df = spark.createDataFrame(rows, "q string, want string")
    for r in df.select("want", corpus.question_category(F.col("q")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_label_index_is_alphabetical(spark):
    df = frame(spark, [("a", "Penalty"), ("b", "None"), ("c", "Arbitration"), ("d", "None")])
    got = {(r["sentence"], r["label_idx"]) for r in corpus.label_index(df).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 0), ("d", 1)}


def test_ece_and_reliability(spark):
    rng = random.Random(3)
    data = [(rng.random(), rng.random() < 0.6) for _ in range(500)] + [(1.0, True), (0.0, False), (0.1, True)]
    bins = {}
    for c, ok in data:
        bins.setdefault(min(int(c * 10), 9), []).append((c, ok))
    want = sum(len(b) / len(data) * abs(sum(c for c, _ in b) / len(b) - sum(ok for _, ok in b) / len(b))
               for b in bins.values())
    df = spark.createDataFrame(data, "confidence double, correct boolean")
    assert evaluate.ece(df).first()["ece"] == pytest.approx(round(want, 4))
    assert {r["bin"]: r["n"] for r in evaluate.reliability_bins(df).collect()} == {b: len(v) for b, v in bins.items()}
    assert evaluate.ece(df.limit(0)).first()["ece"] == 0.0


def test_report_with_absent_classes(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "y_true string, y_pred string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in
           evaluate.classification_report(df).collect()}
    assert got == {"A": (0.5, 0.5, 0.5, 2), "B": (0.0, 0.0, 0.0, 0), "C": (0.0, 0.0, 0.0, 1)}
    row = evaluate.f1_summary(df).first()
    assert (row["accuracy"], row["macro_f1"], row["weighted_f1"], row["n"]) == (0.333333, 0.166667, 0.333333, 3)


def test_keys_are_told_apart_by_two_independent_hashes(spark):
    """The second hash is no function of the first: it starts from a seed of its own."""
    import xxhash
    first, second = spark.range(1).select(F.lit("a text").alias("t")).select(*corpus._key_hash("t")).first()
    unsigned = [x % (1 << 64) for x in (first, second)]
    seed = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    assert unsigned[0] == xxhash.xxh64_intdigest(b"a text", 42)
    assert unsigned[1] == xxhash.xxh64_intdigest(b"a text", seed)


def test_sentence_index_moves_no_runs(spark):
    """The index of a paragraph stays in its task: one shuffle, of the distinct sentences, and no join."""
    rows = spark.sql("SELECT 'One here. Two there.' AS context, array(named_struct('question', 'Is there a penalty', "
                     "'answers', array(named_struct('text', 'Two there')))) AS qas")
    free = mining.qa_negatives(rows, 0)
    text = free._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1
    assert [r["sentence"] for r in free.collect()] == ["One here."]


def test_free_sentences_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice((b"ab", b"abcdefg "))
        texts = [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(10)]
        answers = [bytes(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(4)] + [t[3:20] for t in texts[:3] if len(t) > 3]
        assert mining.free_sentences(texts, answers) == [t for t in texts if not any(a in t for a in answers)]

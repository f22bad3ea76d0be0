"""Engine inputs derived from the given tables.

The given texts hold almost no legal vocabulary, so each sentence of `documents`
is extended by a clause fragment picked by arithmetic on its key. Everything is a
plain expression over whole tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.risk import keyword_risk
from pactlens.functions.text import sentences
from pactlens.operators.hold import hold
from pactlens.operators.segment import segment_sentences
from pactlens.operators.sizing import spread
from pactlens.sources.scratch import store
from pactlens.taxonomy import NONE_COLUMNS, POSITIVE_COLUMNS, PROVISION_TO_LABEL, TITLE_TO_LABEL

SUBJECTS = ("The supplier", "Either party", "The customer", "The contractor", "Each licensee")
MODALS = ("must", "shall", "is required to", "is obligated to", "will", "should", "may", "might",
          "could", "does not", "shall not")
PREDICATES = (
    "indemnify and hold harmless the other party", "be responsible for all damages",
    "pay liquidated damages", "pay interest on each late payment", "terminate this agreement",
    "cancel upon breach", "comply with each mandatory requirement", "keep records",
    "submit to binding arbitration", "accept the governing law and venue", "deliver the goods",
    "define the revenue figures", "attend meetings")
TAILS = ("", "without notice", "immediately", "and waives all claims", "with unlimited exposure",
         "and is not liable", "in its sole discretion", "unless exempt", "where not required",
         "and has no obligation", "irrevocably", "and forfeits the deposit", "forthwith",
         "on the console", "with absolute effect", "excluded from scope", "and is not obligated")
LABELS = ("Arbitration", "Liability", "None", "Obligation", "Penalty", "Termination")
SOURCES = ("original", "cuad", "ledgar")
UNMAPPED_TITLES = ("Parties", "Agreement Date", "Effective Date", "Document Name", "Most Favored Nation",
                   "Joint Ip Ownership", "Source Code Escrow")
UNMAPPED_PROVISIONS = ("Counterparts", "Headings", "Notices", "Amendments", "Waivers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def clause_hash(doc_id: Column, sent_idx: Column) -> Column:
    return doc_id * F.lit(31) + sent_idx * F.lit(17)


def predicate_of(h: Column) -> Column:
    return pick(PREDICATES, h % 13)


def tail_of(h: Column) -> Column:
    return pick(TAILS, F.floor(h / 13) % 17)


def fragment(h: Column) -> Column:
    return F.concat_ws(" ", pick(SUBJECTS, h % 5), pick(MODALS, h % 11), predicate_of(h), tail_of(h))


def with_fragment(keyed: DataFrame) -> DataFrame:
    h = F.col("h")
    return keyed.withColumn("sentence", F.concat_ws(" ", F.col("sentence"), fragment(h)))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, h, sentence) over all sentences of all documents."""
    return clauses_of(table(spark, sf_dir, "documents"))


def clauses_of(docs: DataFrame) -> DataFrame:
    segs = segment_sentences(docs)
    return with_fragment(segs.withColumn("h", clause_hash(F.col("doc_id"), F.col("sent_idx"))))


def clause_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, clauses ARRAY<STRUCT<sent_idx, h, frag, sentence>>) without exploding."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def clause(s, i):
        h = clause_hash(F.col("doc_id"), i)
        return F.struct(i.alias("sent_idx"), h.alias("h"), fragment(h).alias("frag"),
                        F.concat_ws(" ", s, fragment(h)).alias("sentence"))

    return docs.select("doc_id", F.transform(sentences(F.col("text")), clause).alias("clauses"))


def clause_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the clauses of a document joined into one text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", clause_text(F.col("doc_id"), F.col("text")).alias("text"))


def _score_array(label: Column, score: Column) -> Column:
    rest = F.transform(
        F.filter(F.array(*[F.lit(v) for v in LABELS]), lambda other: other != label),
        lambda other: F.struct(other.alias("label"), F.lit(0.0).alias("score")))
    return F.concat(F.array(F.struct(label.alias("label"), score.alias("score"))), rest)


def tier1_scores(keyed: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, scores); rows with h % 19 = 0 have no score (tier failure)."""
    h = F.col("h")
    label = F.when(h % 23 == 0, F.lit("LABEL_0")).otherwise(pick(LABELS, h % 6))
    score = ((h * 37) % 997) / F.lit(997.0)
    return keyed.filter(h % 19 != 0).select("doc_id", "sent_idx", _score_array(label, score).alias("scores"))


def tier2_scores(keyed: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, scores); rows with h % 29 = 0 are missing, h % 31 = 0 score 0.0."""
    h = F.col("h")
    label = pick(LABELS, F.floor(h / 6) % 6)
    score = F.when(h % 31 == 0, F.lit(0.0)).otherwise(((h * 53) % 991) / F.lit(991.0))
    return keyed.filter(h % 29 != 0).select("doc_id", "sent_idx", _score_array(label, score).alias("scores"))


def labelled_sources(spark: SparkSession, sf_dir: str) -> dict:
    """Three overlapping labelled corpora (sentence, label, seq) keyed by source name."""
    lowered = hold(clauses(spark, sf_dir), _l=F.lower("sentence"))
    labelled = hold(lowered, label=F.coalesce(keyword_risk(F.col("_l")), F.lit("None")))
    # Written once: the three corpora, and operators that read them twice, do not cut and label the texts again.
    rows = store(labelled.select(
        "doc_id", "h", "sentence", (F.col("doc_id") * 1000000 + F.col("sent_idx")).alias("seq"), "label"), "labelled", "zstd")
    h = F.col("h")
    home = F.col("doc_id") % 3
    out = {}
    for rank, name in enumerate(SOURCES):
        distance = (F.lit(rank + 3) - home) % 3
        keep = (distance == 0) | ((distance == 1) & (h % 5 == 0)) | ((distance == 2) & (h % 10 == 0))
        flipped = (F.when(distance == 0, h % 7 == 0).when(distance == 1, F.lit(False))
                   .otherwise(h % 4 == 0))
        out[name] = rows.filter(keep).select(
            "sentence", F.when(flipped, F.lit("None")).otherwise(F.col("label")).alias("label"), "seq")
    return out


def messy(text: Column) -> Column:
    """Text with stray whitespace and omission markers."""
    return F.concat(F.lit(" \t"), F.replace(text, F.lit(". "), F.lit(".  <omitted>\n")), F.lit("　"))


def clause_text(doc_id: Column, text: Column) -> Column:
    """The clauses of one document as one text."""
    return F.array_join(F.transform(sentences(text), lambda s, i: F.concat_ws(
        " ", s, fragment(clause_hash(doc_id, i)))), ". ")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_idx, answer): external answers for a third of the clauses, some blank."""
    h = F.col("h")
    answer = F.when(h % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" In short: "), F.col("sentence")))
    return clauses(spark, sf_dir).filter(h % 3 == 0).select("doc_id", "sent_idx", answer.alias("answer"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanation requests, some with a blank field, some too long."""
    h = F.col("h")
    return clauses(spark, sf_dir).select(
        "doc_id", "sent_idx",
        F.when(h % 11 == 0, F.lit("  ")).when(h % 101 == 0, F.repeat("sentence", 120))
        .otherwise(F.col("sentence")).alias("sentence"),
        F.when(h % 13 != 0, F.concat(F.lit(" "), pick(LABELS, h % 6))).alias("risk_type"),
        F.when(h % 17 == 0, F.lit("")).otherwise(F.lit("High\n")).alias("severity"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, text) with and without usable file names and texts."""
    d = F.col("doc_id")
    name = (F.when(d % 6 == 0, F.lit("")).when(d % 6 == 1, F.concat(F.lit("c"), d, F.lit(".TXT")))
            .when(d % 6 == 2, F.lit("a.b.pdf")).when(d % 6 == 3, F.lit("x.docx")).when(d % 6 == 4, F.lit("pdf")))
    body = F.when(d % 7 == 0, F.lit(" \n　")).when(d % 7 != 1, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"), body.alias("text"))


def titled_qas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, qas ARRAY<STRUCT<id, answers STRUCT<text ARRAY<STRING>>>>)."""
    titles = tuple(TITLE_TO_LABEL) + UNMAPPED_TITLES

    def qa(c):
        h = c["h"]
        key = F.concat(F.col("doc_id"), F.lit("-"), c["sent_idx"])
        return F.struct(
            F.when(h % 41 == 0, key).otherwise(F.concat(key, F.lit("__"), pick(titles, h % 40))).alias("id"),
            F.struct(F.array(F.concat(F.lit("  "), c["sentence"], F.lit("\n")), F.lit("Up to twenty chars. "))
                     .alias("text")).alias("answers"))

    split = F.when(F.col("doc_id") % 2 == 0, F.lit("train")).otherwise(F.lit("test"))
    return clause_array(spark, sf_dir).select(split.alias("split"), F.transform("clauses", qa).alias("qas"))


def provisions(spark: SparkSession, sf_dir: str) -> tuple:
    """(rows with text and label index, label names)."""
    h = F.col("h")
    rows = clauses(spark, sf_dir).select(
        "doc_id", "sent_idx",
        F.when(h % 43 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "sentence")).alias("text"),
        F.when(h % 37 == 0, F.lit(-1)).otherwise((h % 30).cast("int")).alias("label"))
    return rows, list(PROVISION_TO_LABEL) + list(UNMAPPED_PROVISIONS)


def wide_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and fifteen clause columns filled from the clauses by sent_idx % 15."""
    names = (*POSITIVE_COLUMNS, *NONE_COLUMNS)
    rows = clause_array(spark, sf_dir)

    def cell(k, name):
        last = F.size("clauses") - 1  # the k-th clause of each fifteen, by its place
        own = F.when(last >= k, F.transform(F.sequence(F.lit(k), last, F.lit(15)), lambda i: F.get("clauses", i)["sentence"]))
        return F.array_join(F.coalesce(own, F.array().cast("array<string>")), ". <omitted>\n").alias(name)

    rows = rows.select("doc_id", F.inline(F.array(F.struct(F.col("clauses").alias("clauses")))))
    return rows.select("doc_id", *[cell(k, name) for k, name in enumerate(names)])


def qa_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(data ...): one nested QA object per document."""
    def qa(c):
        h = c["h"]
        answer = F.when(h % 12 == 0, F.lit(" N/A ")).when(h % 8 == 0, c["sentence"]).otherwise(c["frag"])
        return F.struct(
            F.concat_ws(" ", predicate_of(h), tail_of(h)).alias("question"),
            F.array(F.struct(answer.alias("text"))).alias("answers"))

    rows = clause_array(spark, sf_dir)
    context = F.array_join(F.transform("clauses", lambda c: c["sentence"]), ". ")
    qas = F.transform(F.filter("clauses", lambda c: c["h"] % 4 == 0), qa)
    paragraph = F.struct(context.alias("context"), qas.alias("qas"))
    return rows.select(F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): conversation turns as pages, some NULL."""
    c = table(spark, sf_dir, "conversations")
    text = F.when((F.col("conv_id") + F.col("turn")) % 9 != 0, F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), text.alias("text"))

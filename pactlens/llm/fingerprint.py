"""Fingerprints of whole texts by SimHash, and a search by permuted block tables. Built-in expressions only.

A term is a word and its successor (the last word stands alone), A-Z lowered; its weight is its count times its
letters, so the short words that all texts share weigh little. Each term's 64-bit hash votes with its weight for
or against each bit; the fingerprint has the bits with more votes for than against.

For a search within `radius` bits the 64 are cut into BLOCKS blocks. Fingerprints at most `radius`
bits apart agree in BLOCKS - radius of them at least, so there is a table for each choice of so many
blocks, keyed by these blocks moved to the front, and two such fingerprints share a key in one table or more.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.order import numbered
from pactlens.llm.words import lower_ascii, words
from pactlens.operators.hold import hold
from pactlens.sources.scratch import store

BITS = 64
RADIUS = 3
BLOCKS = 6
QUERY_EVERY = 100  # keys divisible by this are searched
_LOW = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def terms(found: Column) -> Column:
    """ARRAY<STRUCT<h, w>> from words: hash and letters of each word with its successor."""
    def term(a: Column, b: Column) -> Column:
        return F.struct(F.xxhash64(a, b).alias("h"), (F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0))).cast("bigint").alias("w"))

    return F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), term)


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., fp long) of each text; a text without words has fingerprint zero.

    Votes are sums over the exploded terms. Two counters of 32 bits share a long: a text's letters,
    each counted twice, stay below 2 ** 32.
    """
    found = hold(texts, _found=words(lower_ascii(F.col(text))))
    votes = found.select(*keys, F.inline_outer(terms(F.col("_found"))))
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair) * F.col("w")).alias(f"_s{i}") for i in range(32)]
    counted = votes.groupBy(*keys).agg(F.sum("w").alias("_all"), *sums)

    def bit(i: int) -> Column:
        total = F.col(f"_s{i % 32}")
        votes_for = total.bitwiseAND(F.lit(_LOW)) if i < 32 else F.shiftrightunsigned(total, 32)
        return F.when(2 * votes_for > F.col("_all"), F.lit(_signed(1 << i))).otherwise(F.lit(0))

    fp = bit(0)
    for i in range(1, BITS):
        fp = fp.bitwiseOR(bit(i))
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits of each table's blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("there must be more blocks than the radius has bits")
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(low, high)) for low, high in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def _front(fp: Column, mask: int) -> Column:
    """The masked bits, block by block, as the leading bits of the permuted fingerprint."""
    out, width, i = F.lit(0).cast("bigint"), 0, 0
    while mask >> i:
        if not mask >> i & 1:
            i += 1
            continue
        size = 1
        while mask >> (i + size) & 1:
            size += 1
        run = F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(_signed((1 << size) - 1)))
        out = out.bitwiseOR(F.shiftleft(run, width))
        i, width = i + size, width + size
    return out


def block_tables(fps: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """(nth, front, fp, keep...): a row for each table."""
    rows = F.array(*[F.struct(F.lit(i).alias("nth"), _front(F.col("fp"), m).alias("front")) for i, m in enumerate(masks)])
    return fps.select(F.inline(rows), "fp", *keep)


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, bits): for each fingerprint of `queries` all of `index` at most `radius` bits apart, itself too.

    Both are tables of distinct `fp`. A pair that meets in several tables is taken in the first one.
    """
    masks = _masks(radius, blocks)
    asked = block_tables(queries.select("fp"), masks).withColumnRenamed("fp", "query")
    met = asked.join(block_tables(index.select("fp"), masks), ["nth", "front"])
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    bits = F.bit_count(apart)
    return met.filter((bits <= radius) & (first == F.col("nth"))).select("query", "fp", bits.alias("bits"))


IDS = ("h1", "h2")  # names of a distinct (key, text); never NULL, so joins keep one partitioning


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.xxhash64("key", "text").alias("h1"), F.xxhash64(F.lit(1), "key", "text").alias("h2"))


def _plans(docs: DataFrame) -> DataFrame:
    """A row for each distinct (key, text): its size, copies, successor and predecessor in descending order of keys.

    The successor of the last is the first. Copies follow one another, so all but one of them are their
    own successor.
    """
    rows = _named(docs).select("key", *IDS, F.char_length("text").cast("bigint").alias("n_chars"))
    rows = rows.groupBy(*IDS).agg(F.first("key").alias("key"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    placed = store(numbered(rows, ("key", *IDS), None, "ids"), "places")

    def beside(step: int, name: str, *columns: str) -> DataFrame:
        # Ascending places: the successor in descending order is one place below.
        return placed.select(F.pmod(F.col("pos") + step, F.col("n")).alias("pos"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return placed.join(beside(1, "next", *IDS), "pos").join(beside(-1, "last", *IDS, "n_chars"), "pos").drop("n", "pos")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within of every row.

    A text's edited form has its last floor(n_chars / 2) code points replaced by as many, or all, of the next
    row's text in descending order of keys; after the last row comes the first. NULL keys come last; rows with one key
    are ordered by hashes of their texts. `n_within` counts, for keys that `every` divides, the rows whose
    fingerprint is at most `radius` bits away, this one included; else it is NULL. NULL texts are empty, have fingerprint
    zero and count as rows like others; an empty table gives no rows; other columns of `docs` are not read.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    plans = store(_plans(own), "plans")
    once = _named(own).groupBy(*IDS).agg(F.first("text").alias("text")).join(plans, list(IDS))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    tails = once.select(
        F.col("last_h1").alias("h1"), F.col("last_h2").alias("h2"),
        F.substring("text", F.lit(1), F.floor(F.col("last_n_chars") / 2).cast("int")).alias("tail"))
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    tried = hold(once.join(tails, list(IDS)), edit=F.concat(head, "tail"), itself=F.concat(head, F.substring("text", F.lit(1), half)))

    def form(which: int, value: str) -> Column:
        return F.struct(F.lit(which).alias("which"), F.unhex(F.sha2(value, 256)).alias("digest"), F.col(value).alias("form"))

    forms = tried.select(*IDS, F.inline(F.array_compact(F.array(
        form(0, "text"), form(1, "edit"), F.when(F.col("copies") > 1, form(2, "itself"))))))
    prints = simhash(forms, [*IDS, "which", "digest"], "form")
    texts = store(prints.groupBy(*IDS).agg(*[
        F.max(F.when(F.col("which") == i, F.struct("fp", "digest"))).alias(n) for i, n in enumerate(("text", "edit", "itself"))]), "prints")
    rows = store(plans.join(texts, list(IDS)), "prints")

    index = rows.groupBy(F.col("text.fp").alias("fp")).agg(F.sum("copies").alias("copies"), F.max(F.coalesce(F.col("key") % every == 0, F.lit(False))).alias("asked"))
    near = within(index.filter("asked"), index, radius).join(index.select("fp", "copies"), "fp")
    near = near.groupBy(F.col("query").alias("_fp")).agg(F.sum("copies").alias("_within"))

    following = rows.select(*[F.col(c).alias(f"next_{c}") for c in IDS], F.col("text.fp").alias("_next"))
    joined = rows.join(following, [f"next_{c}" for c in IDS])
    joined = joined.join(near, F.col("text.fp") == F.col("_fp"), "left")

    def row(n: Column, edit: str, beside_fp: Column) -> Column:
        return F.struct(n.alias("n"), F.col(f"{edit}.digest").alias("digest"), F.col(f"{edit}.fp").alias("edited"), beside_fp.alias("next"))

    def shown(fp: Column) -> Column:
        return F.lpad(F.lower(F.hex(fp)), 16, "0")

    several = F.when(F.col("copies") > 1, row(F.col("copies") - 1, "itself", F.col("text.fp")))
    out = joined.select("key", "n_chars", F.col("text.fp").alias("fp"), "_within",
                        F.inline(F.array_compact(F.array(row(F.lit(1).cast("bigint"), "edit", F.col("_next")), several))))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_copy"))
    return out.select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next")).alias("near_next"),
        F.when(F.col("key") % every == 0, F.col("_within")).alias("n_within"))

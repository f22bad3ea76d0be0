"""The operators for training data against brute force, and on awkward rows."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlens.llm import (
    bloom, components, decontaminate, language, lm, mixing, neardup, paragraphs, quality, queries, sharding, simhash, substrings,
    urlfilter, words)
from tests.llm import brute
from workloads import check

LONG = "Aye " + "lorem ipsum dolor sit amet consectetur " * 3000
COPY = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, None, "en", "a", 1), (2, "", "en", None, 2), (3, " \t\n", None, "b", 3), (4, "One", "en", "a", 4),
    (5, LONG, "de", "b", 5), (6, COPY, "en", "a", 6), (7, COPY, "en", "c", 7), (8, COPY + " tail here", "fr", "c", 8),
    (None, "no key at all here", "en", "a", 9), (10, "Größe éclair ñandú 漢字 🙂 " + COPY, "es", "b", 10),
    (11, "a\n\nb\na\nA# $ % x\n" + COPY.upper(), "en", None, 11), (12, "12 345 " * 40, "en", "b", 12)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `key` string, slot string, size string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and long texts, copies, and columns named like results; no key twice."""
    return spark.createDataFrame([(*r, 1, "k", "s", "z") for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def repeated(awkward):
    return awkward.union(awkward)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(table):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table.collect()]


def plain(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- helpers --------------------------------------------------------------------------------


def test_pieces_keep_words_together():
    texts = [None, "", "Ab c", "x" * 50 + " y\nz " * 30, " ", "é😀 q"]
    for size in (8, 64, 1 << 20):
        got = collections.defaultdict(list)
        for piece in words.pieces(pa.array(texts), size):
            for r, s, e in zip(piece.row, piece.start, piece.end):
                got[r].append(piece.data[s:e].tobytes())
        assert [got[i] for i in range(len(texts))] == [brute.words(t) for t in texts]


def test_hashes_depend_on_the_word_alone():
    piece = next(words.pieces(pa.array(["one two", "two one ONE"])))
    h = piece.hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] != h[0]


def test_bloom_filter_reads_counts_back(spark):
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(1, 500, 5000)
    segments = 3
    filled = bloom.fill_segments(np.concatenate((keys, keys)), np.concatenate((counts, counts)), segments, 1 << 12)
    whole = bloom.Filter.of({s: b.tobytes() for s, b in filled.items()}, segments, 1 << 12)
    want = bloom.levels(2 * counts)
    got = whole.levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (whole.levels(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.05
    values = bloom.level_value(20)
    assert values[0] == 0 and values[1] == 1 and (np.diff(values) >= 0).all()


def test_components(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(40)] + [(random.randrange(100, 200), random.randrange(100, 200)) for _ in range(60)]
    sets = brute.Sets()
    for a, b in edges:
        sets.join(a, b)
    got = dict(plain(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {n: sets.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: language-model scores ------------------------------------------------------------------


def check_scores(df, docs):
    got = sorted(plain(df, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), key=str)
    want = sorted(brute.base_scores(docs), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])


def test_scores(spark, table, rows, awkward, repeated, empty):
    docs = [(k, t) for k, t, *_ in rows]
    scored = lm.score_texts(table)
    check_scores(scored, docs)
    held = scored.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    # Several groups of segments, and few broadcast words, give the scores of one group.
    one, several = (dict(plain(lm.score_texts(table, group=g, words=1 << 10, hot_words=h), "doc_id", "score")) for g, h in ((10**6, 10**6), (2, 50)))
    assert several == pytest.approx(one)
    for df in (awkward, repeated):
        check_scores(lm.score_texts(df, hot_words=3), plain(df, "doc_id", "text"))
    assert lm.score_texts(empty).count() == 0


def test_scores_are_probabilities(spark, rows):
    """The scores of the plain model, whose kinds, unseen ones too, sum to one; random letters score below prose."""
    rng = random.Random(4)
    docs = [(k, t) for k, t, *_ in rows]
    prose = " ".join(next(t for k, t in docs if brute.crc(k) % 7 == 2 and len((t or "").split()) > 60).split()[:60])
    junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60))
    ids = [i for i in range(10**6, 10**6 + 100) if brute.crc(i) % 7 == 2][:2]
    docs += [(ids[0], prose), (ids[1], junk)]
    got = lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"))
    by_key = {k: (s, b) for k, s, b in plain(got, "doc_id", "score", "base_score")}
    want, total = brute.model_scores(docs, got.first()["mu"])
    assert total == pytest.approx(1.0)
    assert [by_key[k][0] for k, _ in docs] == pytest.approx(want, rel=0.03)
    assert by_key[ids[1]][0] < by_key[ids[0]][0]
    # A word never seen has a share of the unseen mass, no more than the rarest known one.
    p = lm.unigrams(np.array([0.0, 1.0, 2.0]), 500.0, 600, 100, 200)
    assert p[0] < p[1] < p[2] and p[0] == pytest.approx(100 / 600 / 201)


# --- 2: SimHash --------------------------------------------------------------------------------


def test_simhash(spark, table, rows, awkward, repeated, empty):
    got = {k: (f, c) for k, f, c in plain(simhash.groups(table), "doc_id", "fingerprint", "component_id")}
    assert got == brute.simhash([(k, t) for k, t, *_ in rows])
    known = [(k, t) for k, t, *_ in AWKWARD if k is not None]
    for df in (awkward, repeated):
        rows_ = plain(simhash.groups(df), "doc_id", "fingerprint", "component_id")
        want = brute.simhash(known)
        assert len(rows_) == df.count() and {r[0]: r[1:] for r in rows_ if r[0] is not None} == want
    assert simhash.groups(empty).count() == 0
    kept = simhash.keep_one(repeated)
    assert sorted(plain(kept, "doc_id"), key=str) == sorted({(c,) for _, c in brute.simhash(known).values()} | {(None,)}, key=str)
    assert kept.columns == repeated.columns


def test_simhash_links_of_long_lists(spark):
    """A dense ball of fingerprints, with lists cut short so that they are split."""
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    near = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(150)}
    prints = sorted(near | {rng.getrandbits(63) for _ in range(50)})
    sets = brute.Sets()
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    want = {p: sets.find(p) for p in prints}
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    for longest in (5, 10_000):
        found = dict(plain(components.components(simhash.links(fps, longest=longest)), "node", "component"))
        assert {p: found.get(p, p) for p in prints} == want


def test_near_dedup_at_four_fifths(spark):
    """Planted copies at a cosine of 0.8 or more leave, texts below stay; against brute force, with keys and texts repeated."""
    rng = random.Random(4)
    docs = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        docs.append((2 * i, " ".join(w)))
        for at in range(5, 200, 200 // (1 + i % 12))[:1 + i % 12]:
            w[at] = "changed"
        docs.append((2 * i + 1, " ".join(w)))
    docs += [(90, None), (91, " "), (92, "Two words"), (93, "two  words"), (None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l")]

    def shingles(text):
        w = brute.words(text)
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    sets, links, all_ = brute.Sets(), 0, [shingles(t) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if len(all_[i] & all_[j]) >= 0.8 * (len(all_[i]) * len(all_[j])) ** 0.5 - 1e-9:
                sets.join(i, j)
                links += 1
    want = [docs[i] for i in range(len(docs)) if sets.find(i) == i]
    assert links >= 20 and len(want) > 45
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for most in (600, paragraphs.GROUP_SHINGLES):
        got = plain(neardup.keep_one(df, most=most), "doc_id", "text")
        assert sorted(got, key=str) == sorted(want, key=str)


def test_near_dedup_of_awkward_rows(spark, awkward, repeated, empty):
    """Nulls, copies, empty tables, and columns named like those of the search."""
    texts = {t for _, t, *_ in AWKWARD}
    for df in (awkward, repeated):
        odd = df.selectExpr("*", "1 as _n", "'x' as _pid", "2 as _k", "3 as pid", "4 as `check`", "5 as row", "6 as component", "7 as `a b`")
        kept = neardup.keep_one(odd)
        assert kept.columns == odd.columns and kept.schema == odd.schema
        rows = plain(kept, "doc_id", "text", "_n", "_pid", "pid")
        assert len(rows) == len(set(rows)) and {r[2:] for r in rows} == {(1, "x", 3)}
        # Texts without words are one, as are the copies, with a few words more or in capitals; all else stays.
        assert {r[0] for r in rows} == {1, 4, 5, 6, None, 12} and {r[1] for r in rows} <= texts
    assert neardup.keep_one(empty).columns == empty.columns and neardup.keep_one(empty).count() == 0


# --- 3: decontamination ------------------------------------------------------------------------


def test_contamination(spark, sf, table, rows, awkward, empty):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = collections.defaultdict(set)
    for item, text in plain(items, "item_id", "text"):
        w = brute.words(text)
        for i in range(len(w) - 9):
            index[tuple(w[i:i + 10])].add(item)
    want = {(k, i) for k, t, *_ in rows for w in [brute.words(t)] for j in range(len(w) - 9) for i in index.get(tuple(w[j:j + 10]), ())}
    found = decontaminate.contaminated(table, items)
    assert want and set(plain(found, "doc_id", "item_id")) == want
    clean = decontaminate.clean_documents(table, items)
    assert {k for k, in plain(clean, "doc_id")} == {r[0] for r in rows} - {k for k, _ in want}
    assert decontaminate.contaminated(awkward, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(table, items.limit(0)).count() == 0


def test_window_hashes_are_computed_once(spark):
    """The generator of a window's keys reads hashes; of each kind and width one is computed, and all widths are found."""
    docs = spark.createDataFrame([(1, 10, "one two three four five six seven eight nine"), (2, 20, "Two three Four")],
                                 "key long, rid long, text string")
    tokens = {w: f"xxhash64({', '.join(f'xxhash64({t!r})' for t in text.split())}) AS h" for w, text in (
        (3, "two three four"), (8, "two three four five six seven eight nine"))}
    known = spark.sql(" UNION ALL ".join(f"SELECT {h}, {w} AS width" for w, h in tokens.items()))
    hits = decontaminate._hits(docs, known, [3, 8])
    generators = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(array(" in line]
    assert generators and not any("xxhash64" in line for line in generators)
    # Number words have a template of their own, so these are hits by the raw tokens alone.
    assert {tuple(r) for r in hits.collect()} == {(1, 10, 1, 3), (1, 10, 1, 8), (2, 20, 0, 3)}



def test_templates_and_slots(spark):
    items = spark.createDataFrame([
        (1, "In the shop Maria buys 12 apples and 30 pears, then she gives 12 apples to her friend at home."),
        (2, "two plus two is four"), (3, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Quiz! In the shop Petra buys 7 apples and 5 pears, then she gives 7 apples to her friend at home."),   # other parameters
        (2, "Quiz! In the shop Petra buys 7 apples and 5 pears, then she gives 8 apples to her friend at home."),   # inconsistent
        (3, "In a shop one can buy apples and pears and give some of them to a friend."),
        (4, "They say TWO plus two, is four!"), (5, "In the shop Maria buys 12 apples and 30 pears, then she gives 12 apples to her friend at home."),
        (6, None)], "doc_id long, text string")
    got = {r[:2]: r[2] for r in plain(decontaminate.contaminated(docs, items), "doc_id", "item_id", "n_changed")}
    assert set(got) == {(1, 1), (4, 2), (5, 1)} and got[5, 1] == 0 and got[1, 1] == 3


def test_conflicting_slots_and_repeated_keys(spark):
    """Verbatim windows count beside a conflict, values may fall together, texts of one key are apart."""
    items = spark.createDataFrame([
        (1, "In the shop Maria buys 12 apples and 30 pears, then she gives 12 apples to her friend at home")], "item_id long, text string")
    other = "In the shop Petra buys {} apples and {} pears, then she gives {} apples to her friend at home"
    docs = spark.createDataFrame([
        (1, "In the shop Maria buys 12 apples and 30 pears, then she gives 13 apples to her friend at home"),
        (2, other.format(7, 7, 7)), (3, other.format(7, 5, 8)),
        (None, other.format(7, 5, 7)), (None, other.format(8, 5, 8)), (None, "Nothing of it is in this one")], "doc_id long, text string")
    got = {r[0]: r[1:] for r in plain(decontaminate.contaminated(docs, items), "doc_id", "n_windows", "n_changed")}
    assert set(got) == {1, 2, None} and got[1][1] == 1 and got[2][1] == 3 and got[None] == (2 * got[2][0], 3)
    clean = plain(decontaminate.clean_documents(docs, items), "doc_id", "text")
    assert sorted(clean, key=str) == sorted([(3, other.format(7, 5, 8)), (None, "Nothing of it is in this one")], key=str)


def test_items_of_few_literals(spark):
    """Arithmetic, lists of names and items of one to four tokens are found verbatim, and only so."""
    texts = {1: "What is 12 + 45 - 7 * 3 ?", 2: "we met Anna, Berta, Clara, Dora, Emil, Fritz, Gerda, Hans, Ida", 3: "Name three primes", 4: "Why?",
             5: "in 1914 1918 1939 1945 1949 1961 1989 1990"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = spark.createDataFrame(
        [(i, f"Something before. {t} Something after it.") for i, t in texts.items()]
        + [(11, "What is 13 + 45 - 7 * 3 ?"), (13, "Name four primes"), (15, "in 1914 1918 1939 1944 1949 1961 1989 1990"), (16, "")],
        "doc_id long, text string")
    got = plain(decontaminate.contaminated(docs, items), "doc_id", "item_id", "n_changed")
    assert sorted(got) == [(i, i, 0) for i in texts]


def test_names_and_numbers_of_all_forms(spark):
    """Accents, inner capitals, apostrophes and acronyms are names, number words numbers; texts of one letter case match verbatim."""
    text = "in the market {} sells {} old apples to all her friends"
    items = spark.createDataFrame([(1, text.format("Maria", "12")), (2, "l’été à Évry où Zoë dort déjà")], "item_id long, text string")
    names = ["Élodie", "McDonald", "O'Brien", "Jean-Paul", "NASA"]
    rows = [(i, text.format(n, w)) for i, (n, w) in enumerate(zip(names, ["fifteen", "twenty-one", "7", "ninety", "zero"]))]
    rows += [(10, text.format("she", "no")), (11, text.format("Maria", "no")), (12, "L’ÉTÉ À ÉVRY OÙ ZOË DORT DÉJÀ"), (13, " \t\n"), (14, " \x0b\f")]
    got = plain(decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items), "doc_id", "item_id", "n_changed")
    assert sorted(got) == [(i, 1, 2) for i in range(len(names))] + [(12, 2, 0)]


def test_shared_windows_of_several_widths(spark):
    """Items of 3 to 9 tokens at the start, the end and across the whole of a text, each by its own width."""
    texts = {n: " ".join(f"item{n}word{i}" for i in range(n)) for n in range(3, 10)}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = spark.createDataFrame([r for n, t in texts.items() for r in (
        (10 * n, t), (10 * n + 1, f"{t} end"), (10 * n + 2, f"begin {t}"), (10 * n + 3, t.rpartition(" ")[0]))], "doc_id long, text string")
    got = plain(decontaminate.contaminated(docs, items), "doc_id", "item_id", "n_windows")
    want = [(10 * n + k, n, max(1, n - 7)) for n in texts for k in range(3)] + [(93, 9, 1)]
    assert sorted(got) == sorted(want)


def test_names_whatever_their_case_and_place(spark):
    items = spark.createDataFrame([
        (1, "Two plus two is four"), (2, "in town old Maria sells apples"), (3, "Maria sells twelve old apples daily"),
        (4, "the man buys 12 apples today. Maria gives them away")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "They say Two plus two is four"), (2, "in town old maria sells apples"), (3, "IN TOWN OLD MARIA SELLS APPLES"),
        (4, "Petra sells twelve old apples daily"), (5, "and then Petra sells twelve old apples daily"),
        (6, "Hi. The man buys 15 apples today. Petra gives them away"), (7, "and petra sells twelve old apples daily"),
        (8, "the man buys 15 apples today. Petra gives them away")], "doc_id long, text string")
    got = plain(decontaminate.contaminated(docs, items), "doc_id", "item_id", "n_changed")
    assert sorted(got) == [(1, 1, 0), (2, 2, 0), (3, 2, 0), (4, 3, 1), (5, 3, 1), (6, 4, 2), (8, 4, 2)]


# --- 4: sharding -------------------------------------------------------------------------------


def check_shards(df, docs, shards):
    got = plain(df, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    want = collections.Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs)
    assert collections.Counter(g[:3] for g in got) == want
    for shard in range(shards):
        own = sorted(g[5] for g in got if g[4] == shard)
        assert own == list(range(len(own)))
    assert all(g[6] in (g[4], shards) and g[3] == "key" for g in got)
    assert len({(g[0], g[4]) for g in got}) == len({g[0] for g in got})


def test_shards(spark, table, rows, awkward, repeated, empty):
    check_shards(sharding.shard_rows(table), [(k, t) for k, t, *_ in rows], 24)
    for df in (awkward, repeated, empty):
        check_shards(sharding.shard_rows(df), plain(df, "doc_id", "text"), 24)
    # One more shard is the same law with that many shards.
    more = dict(plain(sharding.shard_rows(table, 25), "doc_id", "shard"))
    assert dict(plain(sharding.shard_rows(table), "doc_id", "grown_shard")) == more
    keys = spark.range(20_000).withColumn("shard", sharding.rendezvous(F.col("id"), [3.0, 1.0, 0.0]))
    counts = dict(plain(keys.groupBy("shard").count(), "shard", "count"))
    # Rows of one key, NULL, spread over the cells that are sorted, and still have gapless slots.
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    check_shards(sharding.shard_rows(same), plain(same, "doc_id", "text"), 24)
    crcs = same.select(F.lit(0).alias("shard"), "doc_id", F.crc32("text").alias("c"))
    assert crcs.select(sharding.cell(("doc_id", "c"), 64)).distinct().count() == 64


# --- 5: URL rules -------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("com", "/x", "block")], "host string, path string, verdict string")
    urls = {"http://Example.COM/en/a": ("example.com", "/en/a", "example.com/en/", "block"),
            "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://m.www.example.com/en/?q": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
            "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
            "http://a.net/es": ("a.net", "/es", None, "allow"), "http://a.net/es/x#y": ("a.net", "/es/x", "net/es/", "block"),
            "http://a.com": ("a.com", "", None, "allow"), "http://a.com/xy": ("a.com", "/xy", "com/x", "block"),
            "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
            "x://net/fr/": ("net", "/fr/", "net/fr/", "block"), "a://b.com/c://d.net/es/": ("b.com", "/c://d.net/es/", "com/", "allow")}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(list(urls) * 2)], "page_id long, url string, rule string")
    for run in (1, 100_000):
        real = urlfilter.match_urls
        out = {}
        try:
            urlfilter.match_urls = lambda k, r: real(k, r, run)
            for i, *rest in plain(urlfilter.filter_urls(pages, rules), "page_id", "host", "path", "rule", "verdict"):
                out[i] = tuple(rest)
        finally:
            urlfilter.match_urls = real
        assert out == {i: urls[u] for i, u in enumerate(list(urls) * 2)}
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert {v for v, in plain(urlfilter.filter_urls(pages, rules.limit(0)), "verdict")} == {"allow"}


# --- 6: substrings -------------------------------------------------------------------------------


def check_removed(df, docs, **how):
    length = how.get("length", substrings.LENGTH)
    got = {r[0]: r[1:] for r in plain(substrings.remove_repeats(df, **how), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute.removed([(-1 if k is None else k, t) for k, t in docs], length) | {}


def test_removed_bytes(spark, table, rows):
    check_removed(table, [(k, t) for k, t, *_ in rows])
    # Hot anchors, tiny buckets.
    check_removed(table, [(k, t) for k, t, *_ in rows], hot_contexts=2, bucket_bytes=500)


def test_removed_bytes_with_several_groups_of_filters(spark, table, rows, monkeypatch):
    monkeypatch.setattr(bloom, "segment_count", lambda entries, words=bloom.WORDS: 3)
    check_removed(table, [(k, t) for k, t, *_ in rows], group=2)


def test_removed_bytes_of_small_alphabets(spark):
    rng = random.Random(8)
    docs = [(i, "".join(rng.choices("ab", k=rng.randint(0, 160)))) for i in range(60)]
    docs += [(60, "a" * 300), (61, "ab" * 100), (62, None), (63, ""), (64, "a" * 300), (65, "é" * 90)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for hot in (2, 10_000):
        check_removed(df, docs, length=12, gram=4, hot_contexts=hot, bucket_bytes=700)


def test_removed_bytes_of_awkward_rows(spark, awkward, repeated, empty):
    docs = [(-1 if k is None else k, t) for k, t, *_ in AWKWARD]
    want = brute.removed(docs, 100)
    for df in (awkward, repeated):
        got = plain(substrings.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert len(got) == df.count()
        assert {(-1 if g[0] is None else g[0], *g[1:]) for g in got} == {(k, *v) for k, v in want.items()}
    assert substrings.remove_repeats(empty).count() == 0


# --- 7: paragraphs --------------------------------------------------------------------------------


def test_paragraphs(spark, table, rows, awkward, repeated, empty):
    names = ("doc_id", "line", "kept_doc_id", "kept_line")
    docs = [(k, t) for k, t, *_ in rows]
    want = brute.paragraphs(docs, paragraphs.MIN_WORDS, paragraphs.SIMILARITY)
    for most in (30, paragraphs.GROUP_SHINGLES):
        got = {r[:2]: r[2:] for r in plain(paragraphs.repeated_paragraphs(table, most=most).filter("kind = 'line'"), *names)}
        assert got == want
    known = brute.paragraphs([(k, t) for k, t, *_ in AWKWARD if k is not None], 25, 0.8)
    for df in (awkward, repeated):
        found = plain(paragraphs.repeated_paragraphs(df).filter("kind = 'line'"), *names)
        assert {r[:2]: r[2:] for r in found} == known and len(found) == len(known)
    assert paragraphs.repeated_paragraphs(empty).count() == 0
    assert paragraphs.band_count(0.8, 4, 0.99) == 9


def test_long_lines_are_one_unit(spark):
    """Equal lines of some hundred KB at other places in their texts, beyond what the tokeniser takes at once."""
    rng = random.Random(3)
    line = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    docs = [(1, "short line\n" + line), (2, "x " * 40_000 + "\n" + line + "\nend"), (3, line + " more words here")]
    got = {r[:2]: r[2:] for r in plain(paragraphs.repeated_paragraphs(
        spark.createDataFrame(docs, "doc_id long, text string")).filter("kind = 'line'"), "doc_id", "line", "kept_doc_id", "kept_line", "n_words")}
    assert got == {(2, 1): (1, 1, 60_000), (3, 0): (1, 1, 60_003)}


def test_pieces_of_content():
    """Pieces cover each text in order, and a passage has the same ones wherever it stands but for its ends."""
    rng = random.Random(6)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    noise = [" ".join(f"n{rng.randrange(10**6)}" for _ in range(50)) for _ in range(4)]
    texts = [f"{noise[0]} {passage} {noise[1]}", f"{noise[2]}\n{passage.replace(' ', chr(10))} {noise[3]}", None, "", "one", "a a a a a a a a a a a a"]
    (chunk,) = paragraphs.whole_texts(pa.array(texts))
    row, start, size, ids = paragraphs.content_pieces(chunk)
    for r, t in enumerate(texts):
        own = row == r
        assert size[own].sum() == len(brute.words(t))
        assert (start[own] == np.concatenate(([0], np.cumsum(size[own])[:-1]))[:own.sum()]).all()
    shared = set(ids[row == 0].tolist()) & set(ids[row == 1].tolist())
    assert size[(row == 0) & np.isin(ids, list(shared))].sum() >= 80 - 4 * paragraphs.REACH - 12


def test_passages(spark, table, rows):
    """All runs of 50 words that occur twice: nearly each is found, and what is found does repeat."""
    found = paragraphs.repeated_paragraphs(table).filter("kind = 'passage'")
    places = collections.defaultdict(set)
    texts = {k: brute.words(t) for k, t, *_ in rows}
    for k, _, _, _ in rows:
        for i in range(len(texts[k]) - 49):
            places[tuple(texts[k][i:i + 50])].add((k, i))
    later = {p for at in places.values() if len(at) > 1 for p in sorted(at)[1:]}
    got = plain(found, "doc_id", "first_word", "n_words", "kept_doc_id", "kept_word")
    spans = collections.defaultdict(list)
    for k, at, n, other, there in got:
        assert n >= 25 and (other, there) < (k, at)
        head = texts[k][at:at + 6]
        assert head == texts[other][there:there + 6]
        spans[k].append((at, at + n))
    hit = sum(any(a < i + 50 and b > i for a, b in spans[k]) for k, i in later)
    assert later and hit >= 0.95 * len(later)
    # Each found piece of text occurs elsewhere too.
    grams = collections.Counter(tuple(w[i:i + 6]) for w in texts.values() for i in range(len(w) - 5))
    assert all(grams[tuple(texts[k][i:i + 6])] > 1 for k, at, n, *_ in got for i in (at,))


def test_planted_passages(spark):
    """Passages of 51 to 90 words inside other text, at any place in lines of any length."""
    rng = random.Random(12)
    def some(n, tag):
        return [f"{tag}{rng.randrange(10**7)}" for _ in range(n)]

    def broken(w):
        return " ".join(x + rng.choice(["", "", "", "", "", "", "\n"]) for x in w)

    docs, planted = [], set()
    for i in range(300):
        passage = some(rng.randint(51, 90), "p")
        for j in (2 * i, 2 * i + 1):
            w = some(rng.randint(0, 200), "n")
            at = rng.randint(0, len(w))
            docs.append((j, broken(w[:at] + passage + w[at:])))
        planted.add(2 * i + 1)
    docs += [(1000 + i, broken(some(300, "c"))) for i in range(100)]
    found = {k for k, in plain(paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")}
    assert found <= planted and len(found) >= 0.97 * len(planted)


# --- 8: mixing ---------------------------------------------------------------------------------------


def check_mix(df, docs):
    got = plain(df, "doc_id", "size", "source_size", "target", "taken")
    want = brute.mixture(docs)
    source = {k: s for k, _, s in docs}
    taken = collections.Counter()
    for key, size, total, target, words_taken in got:
        assert 0 <= words_taken <= 2 * size
        assert (total, pytest.approx(target)) == want[source[key]]
        taken[source[key]] += words_taken
    assert len(got) == len(docs) and all(abs(taken[s] - t) <= 1 for s, (_, t) in want.items())


def test_mix(spark, table, rows, awkward, repeated, empty):
    docs = [(k, t, s) for k, t, _, s in rows]
    first = mixing.mix(table)
    check_mix(first, docs)
    assert sorted(plain(first, "doc_id", "taken")) == sorted(plain(mixing.mix(table.repartition(7)), "doc_id", "taken"))
    # Many short runs need several levels of the tree.
    check_mix(mixing.mix(table, run_rows=1, fan_in=2), docs)
    for df in (awkward, repeated):
        check_mix(mixing.mix(df), plain(df, "doc_id", "text", "source"))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(repeated)
    assert mixed.columns == repeated.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4


def test_mixed_documents_of_equal_rows(spark):
    """Equal rows hold all the copies that the mix takes of them, also where the rows do not divide these."""
    docs = spark.createDataFrame([(1, "one two three four", "a")] * 3 + [(2, "five six seven eight", "b")] * 5, "doc_id long, text string, source string")
    n = F.col("whole") + (F.col("part") >= 0.5).cast("long")
    want = dict(plain(mixing.copies(docs).withColumn("n", n).groupBy("id").agg(F.sum("n").alias("n")).filter("n > 0"), "id", "n"))
    got = dict(plain(mixing.mixed_documents(docs).groupBy("doc_id").count(), "doc_id", "count"))
    # Source a stops at two copies of each row; b holds 24 of 20 words, 6 copies over 5 rows.
    assert want == {1: 6, 2: 6} and got == want


# --- 9: languages ---------------------------------------------------------------------------------------


def test_language(spark, table, rows, awkward, repeated, empty):
    net = language.fit(table)
    got = {k: (h, p, s) for k, h, p, s in plain(language.predict(table, net), "doc_id", "held_out", "lang_pred", "score")}
    assert all(got[k][0] == (brute.crc(k) % 3 == 1) and 0 <= got[k][2] <= 1 for k, *_ in rows)
    held = [(got[k][1], lang) for k, t, lang, _ in rows if got[k][0] and lang and len(t or "") > 40]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    for df in (awkward, repeated):
        out = plain(language.predict(df, net), "doc_id", "lang_pred", "score")
        assert len(out) == df.count() and {r[1] for r in out if r[0] in (1, 2, 3, 12)} == {"und"}
        assert {r[1] for r in out} <= {"und", *net.labels}
    assert language.fit(empty) is None and language.predict(empty, net).count() == 0
    assert {r[0] for r in plain(language.predict(awkward, None), "lang_pred")} == {"und"}


# --- 10: quality rules -------------------------------------------------------------------------------------


def test_quality(spark, awkward, repeated, empty):
    for df in (awkward, repeated):
        out = plain(quality.quality_report(df), "doc_id", "n_words", "n_dup_lines", "n_repeat_words", "kept")
        assert len(out) == df.count()
        got = {r[0]: r[1:] for r in out}
        assert got[1] == got[2] == got[3] == (0, 0, 0, False) and got[6] == (60, 0, 0, True)
        assert got[11][1] == 1 and got[12][2] == 80 and not got[5][3]
        kept = quality.quality_filter(df)
        assert kept.columns == df.columns
        assert collections.Counter(k for k, in plain(kept, "doc_id")) == collections.Counter(r[0] for r in out if r[4])
    assert quality.quality_report(empty).count() == 0 and quality.quality_filter(empty).count() == 0
    # The order of the rules never changes the verdict.
    want = sorted(plain(quality.quality_filter(awkward), "doc_id"), key=str)
    assert sorted(plain(quality.quality_filter(awkward, order=list(reversed(quality.RULES))), "doc_id"), key=str) == want


def test_native_operators_run_no_python(spark, sf):
    for name in ("op3_decontamination", "op5_url_filter", "op10_quality_rules"):
        text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text, name


# --- queries and pipeline ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    cursor = check.connect(sf).execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert collections.Counter(plain(got, *names)) == collections.Counter(cursor.fetchall())


def test_pipeline(spark, sf, table):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixture", "shards"]
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == table.columns and docs.count() > 0
        if name != "mixture":
            assert docs.count() < before.count()
    result = corpus_pipeline.run(spark, sf)
    assert collections.Counter(plain(result, "doc_id")) == collections.Counter(plain(docs, "doc_id"))

"""Benchmark decontamination by template windows, with built-in expressions only.

Numbers, names and units become typed placeholders, so that a question with other parameters has
the same template. Windows of eight template tokens are hash-joined with the benchmark's. Windows that
equal the item's always count; of the others each run along an alignment of a text with an item
counts if one item value stands for one document value throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.prefilter import bitmap, marked
from pactlens.llm.words import SPACE_CLASS
from pactlens.operators.hold import hold
from pactlens.operators.sizing import broadcast_if_small
from pactlens.sources.scratch import store

WINDOW = 8
MIN_LITERALS = 5       # of a template window's tokens, of a shorter item's five eighths; others match verbatim
MIN_ITEM = 5           # items with fewer tokens match verbatim only
BROADCAST_WINDOWS = 200_000
NUMBER, NAME, UNIT, OPEN = "\x01", "\x02", "\x03", "\x04"
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr",
         "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
         "gram", "grams", "pound", "pounds", "liter", "liters", "litre", "litres", "second", "seconds", "minute",
         "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent",
         "dollar", "dollars", "cent", "cents", "euro", "euros")
_ONES = "two three four five six seven eight nine".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = ("zero", *_ONES, *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
                *_TENS, *(t + o for t in _TENS for o in ("one", *_ONES)), "hundred", "thousand", "million", "billion")  # "one" is a pronoun too
_SLOT = f"[{NUMBER}-{UNIT}]"
_REMOVED = r"[\x01-\x04\p{P}\p{S}]+"
_PUNCTUATION = r"[\p{P}\p{S}]+"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"


def _marked(text: Column) -> Column:
    """The text with its placeholders; OPEN stands before a capitalised word that need not be a name."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x04]", "")
    t = F.regexp_replace(t, _NAME.replace(r"\p{Lu}", r"\p{Lu}(?<=[\p{Ll},;] .)", 1), NAME)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}{NAME}])({_NAME})", f"{OPEN}$1")
    t = F.regexp_replace(t, _PUNCTUATION, "")
    t = F.regexp_replace(t, r"[0-9]+", NUMBER)
    return F.regexp_replace(t, rf"{NUMBER}( ?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")


def _words(text: Column) -> Column:
    """ARRAY<STRING> of the words of a text that is not NULL; blank texts have none."""
    return F.array_remove(F.split(text, rf"{SPACE_CLASS}+"), "")


def _template(marked: Column) -> Column:
    return F.transform(_words(F.lower(marked)), lambda w: F.when(w.isin(*NUMBER_WORDS), F.lit(NUMBER)).otherwise(w))


def _literal(marked: Column) -> Column:
    """Template tokens whose open words are literals."""
    return _template(F.replace(marked, F.lit(OPEN), F.lit("")))


def _named(marked: Column) -> Column:
    """Template tokens whose open words are names."""
    return _template(F.regexp_replace(marked, rf"{OPEN}\p{{Lu}}\p{{L}}+", NAME))


def template(text: Column) -> Column:
    """ARRAY<STRING>: template tokens; one for each of `raw_tokens`.

    A capitalised word inside a sentence is a name, with inner capitals, apostrophes and hyphens; a number is
    of digits or one of NUMBER_WORDS; a unit is one of UNITS after digits.
    """
    return _literal(_marked(text))


def raw_tokens(text: Column) -> Column:
    return _words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _REMOVED, "")))


def _tokens(tokens: Column) -> Column:
    """ARRAY<BIGINT>: the hash of each token."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _window(tokens: Column) -> Column:
    """The hash of a window's tokens, that of its tokens' hashes in order."""
    return F.xxhash64(_tokens(tokens))


def item_windows(items: DataFrame, item: str, text: str, widths: list[int]) -> DataFrame:
    """(h, item, ipos, width, itemplate, iliteral, inamed, iraw, fuzzy): the windows of the items, by template and by raw tokens.

    Items shorter than WINDOW have one window, of their own length. A template is indexed where enough
    of it is literal and the item has MIN_ITEM tokens; the raw tokens always are. Each choice of literal or name
    for the open words of a window is a template, and the first token may be capitalised in the text.
    """
    rows = hold(items.select(F.col(item).alias("item"), F.col(text).alias("_t")), m=_marked(F.col("_t")), r=raw_tokens(F.col("_t")))
    rows = hold(rows, x=_literal(F.col("m")), y=_named(F.col("m")))
    out = None
    for width in widths:
        own = rows.filter(F.size("x") >= width) if width == WINDOW else rows.filter(F.size("x") == width)
        own = own.select("item", F.explode(F.sequence(F.lit(0), F.size("x") - width)).alias("ipos"), "x", "y", "r").select(
            "item", "ipos", F.lit(width).alias("width"), *[F.slice(c, F.col("ipos") + 1, width).alias(n)
                                                           for c, n in (("x", "iliteral"), ("y", "inamed"), ("r", "iraw"))])
        out = own if out is None else out.unionByName(own)
    differ = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get("iliteral", i) != F.get("inamed", i))
    out = hold(out, _open=differ)
    out = out.withColumn("_pick", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("_open")).cast("int") - 1)))

    def token(x: Column, i: Column) -> Column:
        nth = F.array_position("_open", i.cast("int"))
        chosen = (nth > 0) & (F.pmod(F.floor(F.col("_pick") / F.pow(F.lit(2), nth - 1)), F.lit(2)) == 1)
        return F.when(chosen, F.get("inamed", i)).otherwise(x)

    out = hold(out, itemplate=F.transform("iliteral", token))
    literals = F.size(F.filter("itemplate", lambda w: ~w.rlike(_SLOT)))
    out = hold(out, fuzzy=(F.col("width") >= MIN_ITEM) & (literals * 8 >= MIN_LITERALS * F.col("width")))
    capital = F.when(F.get("itemplate", F.lit(0)).rlike(r"^\p{Ll}{2,}$"), F.lit(NAME)).otherwise(F.get("itemplate", F.lit(0)))
    begun = F.concat(F.array(capital), F.slice("itemplate", 2, WINDOW))
    keys = F.array_distinct(F.concat(F.array(_window(F.col("iraw"))), F.when(F.col("fuzzy"), F.array(
        _window(F.col("itemplate")), _window(begun))).otherwise(F.array().cast("array<bigint>"))))
    return out.select(F.explode(keys).alias("h"), "item", "ipos", "width", "itemplate", "iliteral", "inamed", "iraw", "fuzzy")


def _read(docs: DataFrame) -> DataFrame:
    """Add r, x and y: the raw tokens, and the template tokens with open words as literals and as names."""
    marked = hold(docs, m=_marked(F.col("text")), r=raw_tokens(F.col("text"))).drop("text")
    return hold(marked, x=_literal(F.col("m")), y=_named(F.col("m"))).drop("m")


def _hits(docs: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """(key, rid, pos, width) of the document windows that the benchmark has, by template or by raw tokens.

    Each token is hashed once. A window's hash is made of its tokens' hashes in generated code, row by
    row of its places; a kind of tokens that is like another in the window adds no key.
    """
    kinds = ("r", "x", "y")
    rows = hold(_read(docs), **{f"{k}h": _tokens(F.col(k)) for k in kinds}).drop(*kinds)
    rows = rows.filter(F.size("rh") >= widths[0]).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("rh") - widths[0])))

    # The hashes stand in a step of their own: a generator's array would compute each anew for every comparison.
    hashed = rows.select("key", "rid", "pos", F.size("rh").alias("n"), *[
        F.xxhash64(*[F.get(f"{k}h", F.col("pos") + i) for i in range(width)]).alias(f"{k}{width}") for width in widths for k in kinds])

    def keys(width: int) -> list[Column]:
        r, x, y = [F.col(f"{k}{width}") for k in kinds]
        fits = F.col("pos") + width <= F.col("n")
        return [F.when(fits, r), F.when(fits & (x != r), x), F.when(fits & (y != r) & (y != x), y)]

    found = hashed.select("key", "rid", "pos", F.explode(F.array(*[k for w in widths for k in keys(w)])).alias("h"))
    return found.filter("h IS NOT NULL").join(known, "h").select("key", "rid", "pos", "width")


def _rid(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(key, rid, item, n_windows, n_changed) of each text; equal rows are one."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _rid(F.col(text)).alias("rid"))
    lengths = [r[0] for r in items.select(F.least(F.size(template(F.col(item_text))), F.lit(WINDOW)).alias("n"))
               .filter("n > 0").distinct().collect()]  # at most WINDOW
    widths = sorted(lengths) or [WINDOW]
    windows = store(item_windows(items, item, item_text, widths), "windows")
    hits = store(_hits(source, broadcast_if_small(windows.select("h", "width").distinct(), BROADCAST_WINDOWS), widths), "hits")
    return _aligned(source, hits, windows)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_windows, n_changed), one row per document and item it holds a passage of.

    n_windows counts the shared windows that are verbatim or in a consistent run, n_changed the
    values that differ along the closest alignment. NULL texts hold nothing; each text of a repeated key is
    aligned by itself and the key reports their sum, equal rows once; repeated items each report;
    empty tables give no rows.
    """
    pairs = _found(docs, items, key, text, item, item_text).groupBy("key", "item").agg(
        F.sum("n_windows").alias("n_windows"), F.min("n_changed").alias("n_changed"))
    return pairs.select(F.col("key").alias(key), F.col("item").alias(item), "n_windows", "n_changed")


def _aligned(source: DataFrame, hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, rid, item, n_windows, n_changed) of the verbatim windows and the consistent runs of changed ones.

    The tokens of a hit's window come from its document again: only those with hits are read
    through, once each, with the places of their hits.
    """
    places = hits.groupBy("key", "rid").agg(F.collect_set(F.struct("pos", "width")).alias("places"))
    places = places.withColumnRenamed("key", "_k").withColumnRenamed("rid", "_r")
    places = store(places, "places")
    # Most texts have no hit: they stay where they are.
    likely = marked(source, F.col("rid"), bitmap(places, "_r")).filter("_likely").drop("_likely")
    held = likely.join(places, F.col("key").eqNullSafe(F.col("_k")) & (F.col("rid") == F.col("_r"))).drop("_k", "_r")
    held = hold(_read(held), parts=F.transform("places", lambda p: F.struct(
        p["pos"].alias("pos"), *[F.slice(c, p["pos"] + 1, p["width"]).alias(n) for c, n in (("r", "raw"), ("x", "tpl"), ("y", "named"))])))
    spans = held.select("key", "rid", F.inline("parts"))
    spans = spans.withColumn("h", F.explode(F.array_distinct(F.array(*[_window(F.col(c)) for c in ("tpl", "named", "raw")]))))
    table = windows.withColumnRenamed("h", "_h")
    fits = F.forall(F.arrays_zip("itemplate", "tpl", "named"), lambda s: (s["itemplate"] == s["tpl"]) | (s["itemplate"] == s["named"]))
    alike = (F.col("raw") == F.col("iraw")) | (F.col("fuzzy") & (F.size("tpl") == F.size("itemplate")) & fits)
    both = spans.join(table, F.col("h") == F.col("_h")).filter(alike)
    line = ("key", "rid", "item", "shift")
    # An open word that is the same in the text is a literal.
    slots = F.filter(F.arrays_zip("iliteral", "inamed", "iraw", "raw"), lambda s: s["iliteral"].rlike(_SLOT) | (
        s["inamed"].rlike(_SLOT) & (s["iraw"] != s["raw"])))
    both = store(both.select("key", "rid", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"),
                             (F.col("iraw") == F.col("raw")).alias("same"), F.exists(slots, lambda s: ~s["iliteral"].rlike(_SLOT)).alias("wide"),
                             F.transform(slots, lambda s: F.struct(s["iraw"].alias("iraw"), s["raw"].alias("raw"))).alias("slots"))
                 .dropDuplicates([*line, "ipos"]), "spans")
    changed = both.filter("NOT same")
    # Runs of the windows whose open words are the same are judged by themselves too.
    good = (both.filter("same").select(*line, "ipos", F.array().cast("array<string>").alias("values"))
            .unionByName(_consistent(changed, line)).unionByName(_consistent(changed.filter("NOT wide"), line)))
    lines = good.groupBy(*line).agg(F.size(F.collect_set("ipos")).cast("bigint").alias("n_windows"),
                                    F.size(F.array_distinct(F.flatten(F.collect_list("values")))).cast("bigint").alias("n_changed"))
    return lines.groupBy("key", "rid", "item").agg(F.sum("n_windows").alias("n_windows"), F.min("n_changed").alias("n_changed"))


def _consistent(changed: DataFrame, line: tuple[str, ...]) -> DataFrame:
    """(line, ipos, values) of the windows in runs where one item value stands for one document value.

    Windows that follow each other are a run: their place less their rank stays the same.
    """
    nth = F.row_number().over(Window.partitionBy(*line).orderBy("ipos"))
    placed = changed.withColumn("run", F.col("ipos") - nth)
    values = (placed.select(*line, "run", F.explode("slots").alias("s"))
              .groupBy(*line, "run", F.col("s.iraw").alias("theirs")).agg(F.min("s.raw").alias("low"), F.max("s.raw").alias("high"))
              .groupBy(*line, "run").agg(F.max((F.col("low") != F.col("high")).cast("int")).alias("bad"),
                                         F.collect_set(F.when(F.col("theirs") != F.col("low"), F.col("theirs"))).alias("values")))
    runs = _renamed(values.filter("bad = 0").drop("bad"), *line, "run")
    return placed.join(runs, _equal(*line, "run")).select(*line, "ipos", "values")


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in df.columns])


def _equal(*names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no benchmark passage, with their own columns."""
    bad = store(_found(docs.select(key, text), items, key, text, item, item_text).select(
        F.col("key").alias("bad"), F.col("rid").alias("bad_rid")).distinct(), "bad")
    # Columns of the search stand beside a struct of the table's own; only rows that may be bad are joined.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), _rid(F.col(text)).alias("rid"))
    rows = marked(rows, F.col("rid"), bitmap(bad, "bad_rid"))
    tried = rows.filter("_likely").join(bad, F.col("key").eqNullSafe(F.col("bad")) & (F.col("rid") == F.col("bad_rid")), "left_anti")
    return rows.filter("NOT _likely").select("row.*").unionByName(tried.select("row.*"))

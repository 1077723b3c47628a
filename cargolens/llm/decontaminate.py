"""Benchmark passages in documents, also with other numbers, names or units in them.

Texts are read in two forms: plain words with case folded, and templates with typed
placeholders for numbers, names and units, a run of numbers or names being one. Windows of
either form are hash-joined and tell where an item may lie. There the item is laid beside the
document, word by word, and the words that agree are counted, so that an edit costs its own
words only. In a placeholder each of the item's values must stand for one value in the document
throughout. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import stored

#: Words of a window, the least share of an item's words, the shortest item looked for, and
#: the shortest run of agreeing words that counts (also the shortest template).
WINDOW, SHARE, SHORTEST, RUN = 5, 0.8, 5, 3
PLAIN, TYPED = "plain", "typed"
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Measures that become ``<unit>`` (fixed words).
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes",
    "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent", "degree", "degrees", "watt", "watts", "volt", "volts", "mph", "kmh",
)


def spaced(text: Column) -> Column:
    """Words of a text between single spaces: letters, digits and signs of money or percent."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}%$€£]+", " "))


def plain_of(text: Column) -> Column:
    """The words with case folded."""
    return F.split(F.lower(F.upper(spaced(text))), " ")


def typed_of(text: Column) -> Column:
    """The words; a number's end with U+0002 and a name's with U+0001, and runs of either are one word."""
    marked = spaced(text)
    for first, mark in ((r"[\p{Lu}\p{Lt}]", "\u0001"), ("[0-9$€£]", "\u0002")):
        marked = F.regexp_replace(marked, f"(?<![^ ])({first}[^ ]*)", f"$1{mark}")
        marked = F.regexp_replace(marked, f"{mark} (?={first})", mark)
    return F.split(marked, " ")


def template_of(word: Column) -> Column:
    """A typed word's place in a template; the same word gives the same wherever it stands."""
    return (
        F.when(word.endswith("\u0002"), F.lit(NUM))
        .when(word.endswith("\u0001"), F.lit(NAME))
        .when(word.isin(*UNITS), F.lit(UNIT))
        .otherwise(F.lower(word))
    )


def templates_of(words: Column, form: str) -> Column:
    return F.transform(words, template_of) if form == TYPED else words


def windows_of(words: Column, form: str, size: int) -> Column:
    """Place and hash of every window of ``size`` words, in order; none for a shorter text."""
    hashes = F.transform(words, lambda w: F.xxhash64(template_of(w) if form == TYPED else w))

    def window(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - size)
        key = F.lit(f"{form} {size}")
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(key, *(h[i + k] for k in range(size))).alias("hash")))

    # The hashes are bound once; written out, they would be computed for every window.
    bound = F.transform(F.array(hashes), window)[0]
    return F.coalesce(F.when(F.size(words) >= size, bound), F.array().cast("array<struct<at:int,hash:bigint>>"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(
        F.xxhash64(doc, text).alias("k1"), F.hash(doc, text).alias("k2"), doc.alias("doc_id"), text.alias("text")
    ).where(F.col("text").isNotNull())


def _items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Each item in both forms: item_id, form, words, templates, spans (begin and width in plain
    words), n (plain words), size (words of a window)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    items = items.withColumn("plain", plain_of(F.col("text"))).where(F.size("plain") >= SHORTEST).distinct()
    out = None
    for form, words in ((PLAIN, F.col("plain")), (TYPED, typed_of(F.col("text")))):
        part = items.select("item_id", F.lit(form).alias("form"), words.alias("words"), F.size("plain").alias("n"))
        part = part.withColumn("templates", templates_of(F.col("words"), form))
        out = part if out is None else out.unionAll(part)
    # A run has a mark after each of its words.
    width = lambda w: F.greatest(F.lit(1), F.length(F.regexp_replace(w, "[^\u0001\u0002]", "")))
    out = out.withColumn("widths", F.transform("words", width))
    begin = lambda w, i: F.struct(F.aggregate(F.slice("widths", F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("begin"), w.alias("width"))
    out = out.withColumn("spans", F.transform("widths", begin)).drop("widths")
    return out.where(F.size("words") >= RUN).withColumn("size", F.least(F.lit(window), F.size("words")))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item: k1, k2 (keys of the row), doc_id, item_id, coverage, kind.

    ``coverage`` is the share of the item's words that the document has, in runs of at least
    ``RUN``, where a window of ``window`` words agrees in the same alignment; ``kind`` is
    ``same`` if all values are the item's, else ``other values``. Case never matters to
    words that are compared plainly. Forms shorter than ``window`` words are one window;
    items under five words, null or empty ones are not looked for, and templates under
    ``RUN`` words say nothing, so such items are looked for plainly only. Null and empty documents
    hold nothing. Repeated rows and items with equal texts are each reported (equal rows
    once). Other columns are not read.

    All windows of an item are joined: a few edits can leave any one of them alone.
    """
    items = stored(_items(benchmark, item_col, item_text, window), "items")
    sizes = sorted((r[0], r[1]) for r in items.select("form", "size").distinct().collect())
    rows = _keyed(docs, id_col, text_col)
    if not sizes:
        none = rows.limit(0).select("k1", "k2", "doc_id")
        return none.select("*", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit("").alias("kind"))

    told = None
    for form, size in sizes:
        part = items.where((F.col("form") == form) & (F.col("size") == size))
        part = part.select("item_id", "form", F.explode(windows_of(F.col("words"), form, size)).alias("w"))
        told = part if told is None else told.unionAll(part)
    told = stored(told.select("item_id", "form", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash")), "item-windows")

    def read(frame: DataFrame) -> DataFrame:
        return frame.select("k1", "k2", "doc_id", plain_of(F.col("text")).alias(PLAIN), typed_of(F.col("text")).alias(TYPED))

    every = F.concat(*(windows_of(F.col(form), form, size) for form, size in sizes))
    found = read(rows).select("k1", "k2", F.explode(every).alias("w")).select("k1", "k2", "w.at", "w.hash").join(told, "hash")
    place = ["k1", "k2", "item_id", "form"]
    shifts = stored(found.select(*place, (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "shifts")

    holders = rows.join(shifts.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").distinct()
    here = F.when(F.col("form") == PLAIN, F.col(PLAIN)).otherwise(F.col(TYPED)).alias("doc_words")
    laid = shifts.join(read(holders), ["k1", "k2"]).select("doc_id", *place, "shift", here).join(items, ["item_id", "form"])
    last = F.size("words") - 1

    def beside(word: Column, j: Column) -> Column:
        """An item's word and the document's beside it; a run that goes on beyond the item is cut."""
        ours = F.get("doc_words", j + F.col("shift"))
        longer = ((j == 0) & ours.endswith(word)) | ((j == last) & ours.startswith(word))
        template = F.when(F.col("form") == TYPED, template_of(ours)).otherwise(ours)
        slot = (F.col("form") == TYPED) & F.col("templates")[j].isin(NUM, NAME, UNIT)
        return F.struct(
            F.coalesce(F.col("templates")[j] == template, F.lit(False)).alias("agrees"),
            slot.alias("slot"),
            word.alias("theirs"),
            F.when(longer, word).otherwise(ours).alias("ours"),
            j.alias("j"),
        )

    def in_runs(slots: Column) -> Column:
        def in_run(slot: Column, j: Column) -> Column:
            runs = F.lit(False)
            for first in range(1 - RUN, 1):
                run = slot["agrees"]
                for k in range(first, first + RUN):
                    run = run & F.coalesce(F.get(slots, j + k)["agrees"], F.lit(False))
                runs = runs | run
            return runs

        return F.filter(slots, in_run)

    def consistent(held: Column) -> Column:
        # Values at an item's ends may belong to a run that the document begins before or ends after it.
        inner = lambda s: s["slot"] & (((s["j"] > 0) & (s["j"] < last)) | (s["theirs"] == s["ours"]))
        values = F.array_distinct(F.transform(F.filter(held, inner), lambda s: F.struct(s["theirs"].alias("theirs"), s["ours"])))
        single = lambda v: F.size(F.array_distinct(F.transform(v, lambda x: x["theirs"]))) == F.size(v)
        return F.when(F.transform(F.array(values), single)[0], held)

    # Each step's array is bound once, as in windows_of.
    held = F.transform(F.array(F.transform("words", beside)), in_runs)[0]
    held = F.transform(F.array(held), consistent)[0]
    laid = laid.select("doc_id", *place, "shift", "n", "spans", held.alias("held"))

    words = laid.select("k1", "k2", "doc_id", "item_id", "n", "spans", F.explode("held").alias("s"))
    other = F.col("s.slot") & (F.col("s.theirs") != F.col("s.ours"))
    span = F.col("spans")[F.col("s.j")]
    spread = F.sequence(span["begin"], span["begin"] + span["width"] - 1)
    words = words.select("k1", "k2", "doc_id", "item_id", "n", other.alias("other"), F.explode(spread).alias("word"))
    # One row per pair and word, so that a word met at two places counts once.
    pair = ["k1", "k2", "doc_id", "item_id", "n"]
    held = words.groupBy(*pair, "word").agg(F.min("other").alias("other"))
    held = held.groupBy(*pair).agg(F.count(F.lit(1)).alias("got"), F.max("other").alias("other"))
    kind = F.when(F.col("other"), "other values").otherwise("same")
    return held.where(F.col("got") >= share * F.col("n") - 1e-9).select(
        "k1", "k2", "doc_id", "item_id", (F.col("got") / F.col("n")).alias("coverage"), kind.alias("kind")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named: str) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns as they are."""
    found = stored(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **named), "leaks")
    keys = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    doc, text = docs[id_col].cast("long"), docs[text_col]
    return docs.join(keys, (F.xxhash64(doc, text) == keys["_k1"]) & (F.hash(doc, text) == keys["_k2"]), "left_anti")

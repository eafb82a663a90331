"""Documents that hold benchmark items, also with other numbers, units and names.

Text becomes a template: words that begin with a digit are numbers, unit words behind them units, words
with a capital within a sentence names; each is a typed placeholder, everything else its lower-case word.
Hashes of template windows of the items meet those of the documents in a join. For each item and place in
a document the matched windows are put together and the values behind the placeholders compared: a name
of the item, and a number with the word behind it, has to stand for the same value of the document nearly
everywhere, as it does in a copy and in a question with new parameters, but not where only the form of a
sentence is common. Windows that are word for word those of the item need no such agreement.

Windows have WINDOW words; an item with fewer is one window of its own length. Templates of fewer than SHORTEST
words or mostly placeholders cannot be told from other text. So windows of the plain words in lower case, of items
of any length, meet those of the documents as well. A window of fewer than WINDOW words that stands in more than
COMMON_TEXTS different texts and in COMMON_PERCENT of the documents is common language and tells no item.

Null, empty and blank texts of documents and items match nothing, rows without doc_id are kept, and an empty table
gives an empty result or no match. Texts of any length are judged whole. Repeated rows, and equal texts, get the same
verdict; rows that share an id share their items. An item that stands at several places counts by the best one.
Everything runs as SQL expressions; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import written

WINDOW = 8
SHORTEST = 4
# A window with more placeholders than this share says nothing about its item.
MAX_SLOT_SHARE = 0.5
# Matched windows of an item at one place: this many, or all it has.
MIN_WINDOWS = 3
# Slots of a run that stand for the value their item's value has most often, at least; a run with MIN_WINDOWS
# windows that are word for word the item's needs none.
MIN_AGREEING_PERCENT = 80
# A window of fewer than WINDOW words tells nothing if more texts hold it than both of these allow.
COMMON_TEXTS = 20
COMMON_PERCENT = 1
# Windows and matched ids up to this number are broadcast; more are joined by a shuffle of narrow rows.
BROADCAST_ROWS = 1_000_000

TEMPLATE, EXACT = "template", "exact"
# Placeholders and unit words, fixed values.
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs day days week weeks month months year"
    " years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles"
    " inch inches foot feet gram grams kilogram kilograms liter liters litre litres percent dollar dollars euro"
    " euros cent cents degree degrees volt volts watt watts"
).split()
# White space with the punctuation beside it; punctuation within a word stays.
BETWEEN = r"[.,;:!?\"'()\[\]{}«»“”„…]*\s[\s.,;:!?\"'()\[\]{}«»“”„…]*"


def _words(text: Column) -> Column:
    """The words of a text without the punctuation around them; words of punctuation alone vanish."""
    parts = F.split(F.concat(F.lit(" "), text, F.lit(" ")), BETWEEN)
    return F.array_remove(parts, "")  # only the first and the last part can be empty


def templated(text: Column) -> Column:
    """A text with placeholders in place of numbers, units and names, in lower case."""
    numbers = F.regexp_replace(F.concat(F.lit(" "), text), r"\s[^\s\w]{0,3}\d\S*", f" {NUMBER}")
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?i:{'|'.join(UNITS)})(?!\w)", UNIT)
    names = F.regexp_replace(units, r"(?<=\s)[^\s\w]{0,3}\p{Lu}\S*", NAME)
    return F.lower(names)


def template_words(text: Column) -> Column:
    return _words(templated(text))


def plain_words(text: Column) -> Column:
    """The words as they are, place by place those of the template."""
    return _words(text)


def exact_words(text: Column) -> Column:
    return _words(F.lower(text))


def with_windows(frame: DataFrame, words: Column, sizes: list[int], form: str) -> DataFrame:
    """``frame`` with a column of hashes of all runs of words for each size, named by form and size.

    Runs double: those of 8 words are made of two of 4, these of two of 2. All columns have an entry for each
    word; the last ones, whose run would end beyond the text, mean nothing.
    """

    def joined(left: Column, right: Column, by: int) -> Column:
        rest = F.slice(right, F.lit(by + 1), F.size(right))
        return F.zip_with(left, rest, lambda a, b: F.xxhash64(a, b))

    def doubled(size: int) -> str:
        return f"{form}_double_{size}"

    frame = frame.withColumn(doubled(1), F.transform(words, lambda w: F.xxhash64(w)))
    power = 1
    while 2 * power <= max(sizes, default=1):
        half = F.col(doubled(power))
        power *= 2
        frame = frame.withColumn(doubled(power), joined(half, half, power // 2))
    for size in sizes:
        run, length = None, 0
        for bit in (8, 4, 2, 1):
            if size & bit:
                part = F.col(doubled(bit))
                run, length = (part, bit) if run is None else (joined(run, part, length), length + bit)
        frame = frame.withColumn(f"{form}_{size}", run)
    return frame


def _item_hashes(items: DataFrame, form: str) -> DataFrame:
    """``items`` (words and size) with the hashes of their windows of that size by place."""
    sizes = list(range(1, WINDOW + 1))
    hashed = with_windows(items, F.col("words"), sizes, form)
    return hashed.select(*items.columns, F.element_at(F.array(*[f"{form}_{s}" for s in sizes]), F.col("size")).alias("hashes"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Item, place, size and hash of the telling windows of every item, and how many its item has."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        "item_id", template_words(F.col("text")).alias("words"), plain_words(F.col("text")).alias("plain")
    )
    items = items.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where(F.col("size") >= SHORTEST)
    items = _item_hashes(items, TEMPLATE)
    slots = F.array(F.lit(NUMBER), F.lit(UNIT), F.lit(NAME))
    place = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    placed = items.withColumn("item_place", place).withColumn(
        "window", F.slice("words", F.col("item_place") + 1, F.col("size"))
    )
    n_slots = F.size(F.filter("window", lambda w: F.array_contains(slots, w)))
    telling = placed.where(n_slots <= F.lit(MAX_SLOT_SHARE) * F.col("size")).select(
        "item_id",
        "item_place",
        "size",
        F.element_at("hashes", F.col("item_place") + 1).alias("hash"),
        F.slice("plain", F.col("item_place") + 1, F.col("size")).alias("item_values"),
        F.slice("plain", F.col("item_place") + 2, F.col("size")).alias("item_next"),
        F.transform("window", lambda w: F.array_contains(slots, w)).alias("is_slot"),
        F.transform("window", lambda w: w == F.lit(NAME)).alias("is_name"),
    )
    telling = written(telling, "item-windows")
    counts = telling.groupBy(F.col("item_id").alias("c_item")).agg(F.count("*").alias("item_windows"))
    return written(telling.join(counts, F.col("item_id") == F.col("c_item")).drop("c_item"), "items")


def exact_windows(benchmark: DataFrame) -> DataFrame:
    """Item, place, size and hash of all windows of the plain words of every item, and how many its item has."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", exact_words(F.col("text")).alias("words"))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).where(F.col("size") > 0)
    n_windows = F.size("words") - F.col("size") + 1
    placed = _item_hashes(items, EXACT).withColumn("item_windows", n_windows.cast("long")).withColumn(
        "item_place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    )
    hashed = F.element_at("hashes", F.col("item_place") + 1).alias("hash")
    return written(placed.select("item_id", "item_place", "size", hashed, "item_windows"), "exact-items")


def _runs(places: DataFrame, items: DataFrame) -> DataFrame:
    """Document, item, shift and number of windows found, where they are enough for the item."""
    windows = items.select(F.col("item_id").alias("i"), "item_windows").distinct()
    return (
        places.groupBy("doc_id", "item_id", "shift")
        .agg(F.countDistinct("item_place").alias("found"))
        .join(windows, F.col("item_id") == F.col("i"))
        .where(F.col("found") >= F.least(F.lit(MIN_WINDOWS), F.col("item_windows")))
        .drop("i")
    )


def matched_places(docs: DataFrame, items: DataFrame, exact: DataFrame) -> DataFrame:
    """Form, document, item, the two places and their shift for every window they have in common.

    One pass over the texts: all windows of a text, of both forms and of every size that items have, are one
    array with a section for each form and size, so an entry's section and place follow from its position.
    """
    columns = ("form", "item_id", "item_place", "size", "hash")
    wanted = written(
        items.withColumn("form", F.lit(TEMPLATE)).select(*columns).union(
            exact.withColumn("form", F.lit(EXACT)).select(*columns)
        ),
        "wanted",
    )
    sections = sorted((r["form"], r["size"]) for r in wanted.select("form", "size").distinct().collect())  # 2 * WINDOW at most
    small = wanted.count() <= BROADCAST_ROWS
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    for form, words in ((TEMPLATE, template_words), (EXACT, exact_words)):
        rows = with_windows(rows, words(F.col("text")), [s for f, s in sections if f == form], form)
    windows = F.concat(*[f"{form}_{size}" for form, size in sections]) if sections else F.array().cast("array<bigint>")
    # The outer form: the inner one would compute all windows once more in a filter on their number.
    rows = rows.select(
        "doc_id", "text_hash", F.size(f"{EXACT}_double_1").alias("words"), windows.alias("windows")
    ).select("doc_id", "text_hash", "words", F.posexplode_outer("windows").alias("at", "d_hash"))
    section = F.lit(0)
    for number, (form, size) in enumerate(sections):
        section = F.when((F.col("form") == form) & (F.col("size") == size), number).otherwise(section)
    placed = wanted.withColumn("section", section)
    met = (
        rows.join(F.broadcast(placed) if small else placed, F.col("d_hash") == F.col("hash"))
        .withColumn("place", F.col("at") - F.col("section") * F.col("words"))
        .where("place >= 0 and place <= words - size")
        .withColumn("shift", F.col("place") - F.col("item_place"))
        .select("form", "size", "hash", "text_hash", "doc_id", "item_id", "place", "item_place", "shift")
    )
    return _telling(written(met.distinct(), "places"), docs.count())


def _telling(places: DataFrame, documents: int) -> DataFrame:
    """``places`` without short windows that too many texts hold to tell their item."""
    limit = max(COMMON_TEXTS, documents * COMMON_PERCENT // 100)
    window = ("form", "size", "hash")
    common = (
        places.where(F.col("size") < WINDOW)
        .groupBy(*window)
        .agg(F.countDistinct("text_hash").alias("texts"))
        .where(F.col("texts") > limit)
        .select(*[F.col(c).alias(f"c_{c}") for c in window])
    )
    same = [F.col(c) == F.col(f"c_{c}") for c in window]
    return places.join(written(common, "common-windows"), same[0] & same[1] & same[2], "left_anti")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Document, item, share of the item's windows found at one place, and whether parameters differ."""
    docs = docs.select("doc_id", "text")
    items, exact_items = item_windows(benchmark), exact_windows(benchmark)
    matched = matched_places(docs, items, exact_items)
    places = matched.where(F.col("form") == TEMPLATE).select("doc_id", "item_id", "place", "item_place", "shift").distinct()
    runs = written(_runs(places, items), "runs")
    ids = runs.select(F.col("doc_id").alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    plain = (
        docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
        .select(F.col("doc_id").alias("p_doc"), plain_words(F.col("text")).alias("plain"))
    )
    values = items.select(
        F.col("item_id").alias("v_item"), F.col("item_place").alias("v_place"), "size", "item_values", "item_next",
        "is_slot", "is_name",
    )
    runs_of = runs.select(
        F.col("doc_id").alias("r_doc"), F.col("item_id").alias("r_item"), F.col("shift").alias("r_shift")
    )
    placed = (
        places.join(
            runs_of,
            (F.col("doc_id") == F.col("r_doc")) & (F.col("item_id") == F.col("r_item")) & (F.col("shift") == F.col("r_shift")),
            "left_semi",
        )
        .join(values, (F.col("item_id") == F.col("v_item")) & (F.col("item_place") == F.col("v_place")))
        .join(plain, F.col("doc_id") == F.col("p_doc"))
        .withColumn("doc_values", F.slice("plain", F.col("place") + 1, F.col("size")))
    )
    run = ("doc_id", "item_id", "shift")
    as_is = F.transform("doc_values", lambda w: F.lower(w)) == F.transform("item_values", lambda w: F.lower(w))
    exact = placed.groupBy(*run).agg(F.countDistinct(F.when(as_is, F.col("item_place"))).alias("exact"))
    # A name is one person; a number is one quantity together with the word behind it.
    value = F.lower("slot.item_values")
    key = F.when(F.col("slot.is_name"), value).otherwise(F.concat_ws(" ", value, F.lower("slot.item_next")))
    slots = (
        placed.select(
            *run,
            "item_place",
            F.posexplode(F.arrays_zip("is_slot", "is_name", "item_values", "item_next", "doc_values")).alias("at", "slot"),
        )
        .where("slot.is_slot")
        .select(
            *run,
            (F.col("item_place") + F.col("at")).alias("slot_place"),
            key.alias("key"),
            F.lower("slot.doc_values").alias("d_value"),
            (F.lower("slot.doc_values") != value).alias("differs"),
        )
        .dropDuplicates([*run, "slot_place"])
        .groupBy(*run, "key", "d_value")
        .agg(F.count("*").alias("n"), F.max("differs").alias("differs"))
        .groupBy(*run, "key")
        .agg(F.max("n").alias("agreeing"), F.sum("n").alias("n"), F.max("differs").alias("differs"))
        .groupBy(*run)
        .agg(F.sum("agreeing").alias("agreeing"), F.sum("n").alias("n_slots"), F.max("differs").alias("differs"))
    )
    slots = exact.join(slots, list(run), "left").select(
        F.col("doc_id").alias("s_doc"), F.col("item_id").alias("s_item"), F.col("shift").alias("s_shift"),
        "exact", "agreeing", "n_slots", "differs",
    )
    consistent = F.col("n_slots").isNull() | (
        F.lit(100) * F.col("agreeing") >= F.lit(MIN_AGREEING_PERCENT) * F.col("n_slots")
    )
    checked = runs.join(
        slots,
        (F.col("doc_id") == F.col("s_doc")) & (F.col("item_id") == F.col("s_item")) & (F.col("shift") == F.col("s_shift")),
    ).where(consistent | (F.col("exact") >= F.least(F.lit(MIN_WINDOWS), F.col("item_windows"))))
    checked = checked.select("doc_id", "item_id", "found", "item_windows", F.coalesce("differs", F.lit(False)).alias("differs"))
    as_words = _runs(matched.where(F.col("form") == EXACT), exact_items).select(
        "doc_id", "item_id", "found", "item_windows", F.lit(False).alias("differs")
    )
    return checked.union(as_words).groupBy("doc_id", "item_id").agg(
        F.max(F.col("found") / F.col("item_windows")).alias("share"),
        F.min("differs").alias("other_parameters"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_items, item_ids, share (the largest), contaminated and kept."""
    found = (
        leaks(docs, benchmark)
        .groupBy(F.col("doc_id").alias("l_doc"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    )
    marked = docs.select("doc_id").join(written(found, "leaks"), F.col("doc_id") == F.col("l_doc"), "left")
    contaminated = F.col("l_doc").isNotNull()
    return marked.select(
        "doc_id",
        F.greatest(F.coalesce(F.size("item_ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        "item_ids",
        F.coalesce("share", F.lit(0.0)).alias("share"),
        contaminated.alias("contaminated"),
        (~contaminated).alias("kept"),
    )

"""Benchmark decontamination by templates, in column expressions only.

Numbers, names and units become typed placeholders, so a question asked again with other values has
the same template. Windows of template words are hash-joined between benchmark and documents. Where
a window has placeholders, the values behind them must map one to one between the benchmark and the
document: a re-parameterised question renames each value the same way everywhere, and two values never
to one. Only windows that hold a value against this are dropped, and windows whose own words are the
item's count whatever the others hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.shared import landed, packed, same_row

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"  # private-use characters
#: Short units that may follow a number, and spelled ones with prefixes and plurals.
UNITS = (
    "mm cm dm m km in inch inches ft feet foot yd mi mg g kg t lb lbs oz ml cl l s sec min h hr"
    " percent usd eur gbp mph kmh kph hz khz mhz ghz w kw v a j kj cal kcal kb mb gb tb"
).split()
SPELLED = (
    "yard mile pound ounce pint quart gallon acre hectare cup spoon dozen second minute hour day week month year decade"
    " century dollar euro cent degree knot ton tonne"
).split()
PREFIXES = "kilo centi milli micro nano deci mega giga tera".split()
PREFIXED = "meter metre gram gramme liter litre watt volt joule hertz byte bit newton pascal calorie ampere".split()
#: Numbers in words; 'one' is left to be a word.
NUMERALS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
#: Capitalised words that are no names, wherever they stand.
COMMON = (
    "a about above after again all along also although an and another any are as at away back be because been before"
    " below between both but by calculate can compute consider could compare count determine did do does draw during each either"
    " even every evaluate explain express few find finally first five following for four from give given has have he"
    " hence her here his how however i if in initially is it its last later let list many may more most much must my name"
    " neither next no not now of often on once one only or other our out over per please prove put second select several"
    " she should show simplify since so solve some state such suppose take ten that the their them then there therefore"
    " these they third this those though three through thus to today together two under until up use using was we were"
    " what when where whether which while who whom whose why will with without would write yes yesterday you your"
).split()
WINDOW = 8
#: A pair leaks by so many words in a row, however long the item is.
RUN = 13
SHORTEST = 5
#: A window matches as a template if so many of its words are no placeholders, and so many of these none of
#: the common words, and always word for word.
LITERALS, CONTENT = 4, 2
_BLANKS = "\t\n\x0b\x0c\r"
_MARK = f"[{NUMBER}-{UNIT}]"


def _tree(words: list[str]) -> str:
    """A pattern for any of the words that decides letter by letter."""
    ends, heads = "" in words, sorted({w[0] for w in words if w})
    parts = [h + _tree([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return f"{body}?" if ends else body


def _marked(text: Column) -> Column:
    """The text in lower case with a placeholder before each number, name and unit.

    Names are words that begin with a capital and go on in lower case, wherever they stand, and other
    capitals within a sentence; common words are none. Numbers may be spelled, and stand at the
    beginning of a word.
    """
    common = _tree(sorted(set(COMMON + NUMERALS)))
    name = r"(?=\p{Lu})(?<![\p{L}\p{N}'’-])" + rf"(?!(?i:{common})(?![\p{{L}}'’-]))"
    within = rf"(?<=[\p{{Ll}}\p{{Nd}},;][ {_BLANKS}]{{1,8}})"
    text = F.regexp_replace(text, rf"{name}(?:\p{{Lu}}\p{{Ll}}|{within}\p{{Lu}})[\p{{L}}'’-]*", f"{NAME}$0")
    numeral = _tree(NUMERALS)
    heads = "".join(sorted({w[0] for w in NUMERALS}))
    spelled = rf"{numeral}(?:-{numeral}|-one)?(?![\p{{L}}\p{{N}}'’-])"
    number = rf"(?=[0-9{heads}])(?<![\p{{L}}\p{{N}}{NAME}])(?:[0-9]+(?:[.,:/][0-9]+)*|{spelled})"
    text = F.regexp_replace(F.lower(text), number, f"{NUMBER}$0")
    units = f"{'|'.join(UNITS)}|(?:{'|'.join(SPELLED)}|(?:{'|'.join(PREFIXES)})?(?:{'|'.join(PREFIXED)}))s?"
    numbers = "(?:[0-9][0-9.,:/]*|[a-z-]+)"
    return F.regexp_replace(text, f"({NUMBER}{numbers} ?)((?:{units})(?!\\p{{L}})|%)", f"$1{UNIT}$2")


def _words(rows: DataFrame) -> DataFrame:
    """``text`` replaced by ``w``, its words with their placeholders before them, in lower case and without
    punctuation; what has no letter, number or placeholder is no word."""
    clean = F.col("text")
    held = F.contains(clean, F.lit(NUMBER)) | F.contains(clean, F.lit(NAME)) | F.contains(clean, F.lit(UNIT))
    clean = F.when(held, F.regexp_replace(clean, _MARK, "")).otherwise(clean)
    bare = F.regexp_replace(_marked(clean), rf"[^a-z \p{{L}}\p{{N}}{NUMBER}-{UNIT}{_BLANKS}]+", "")
    return rows.withColumn("text", F.split(bare, f"[ {_BLANKS}]+")).select(
        *[c for c in rows.columns if c != "text"], F.array_remove("text", "").alias("w")
    )


def _own(word: Column) -> Column:
    """A word without placeholders."""
    return F.regexp_replace(word, _MARK, "")


def _template(word: Column) -> Column:
    """The placeholders of a word that has some."""
    return F.regexp_replace(word, rf"[^{NUMBER}-{UNIT}]+", "")


def _is_marked(word: Column) -> Column:
    return F.contains(word, F.lit(NAME)) | F.contains(word, F.lit(NUMBER)) | F.contains(word, F.lit(UNIT))


def _hash(words: Column, at: Column, size: int) -> Column:
    """The hash of a window of words, which are hashes themselves."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def _codes(size: int) -> tuple[Column, Column]:
    """Place, size and kind of all windows of so many words, and of those template windows that hold a mark."""
    none, last, code = F.array().cast("array<int>"), F.col("n") - size, 2 * (size - SHORTEST)

    def around(mark: Column) -> Column:
        low, high = F.greatest(mark - size + 1, F.lit(0)), F.least(mark, last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    plain = F.sequence(F.lit(code), 8 * last + code, F.lit(8))
    near = F.array_distinct(F.flatten(F.transform("marks", around)))
    marked = F.transform(near, lambda i: 8 * i + code + 1)
    there = last >= 0
    return F.coalesce(F.when(there, plain), none), F.coalesce(F.when(there, marked), none)


def _windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """All other columns, with ``at`` and ``hash`` of every window of words, and of every template window that has
    a placeholder. rows: as ``_words`` makes them.

    Words are hashed once. Windows are numbers until they are hashed, place, size and kind in one, so
    that rows are made and hashed in generated code.
    """
    rest = [c for c in rows.columns if c != "w"]
    # Without a placeholder template and text are the same words.
    hashed = rows.select(
        *rest, F.size("w").alias("n"),
        F.transform("w", lambda w: F.xxhash64(F.when(_is_marked(w), _own(w)).otherwise(w))).alias("r"),
        F.transform("w", lambda w: F.when(_is_marked(w), F.xxhash64(_template(w)))).alias("c"),
    )
    place = F.filter(F.transform("c", lambda c, i: F.when(c.isNotNull(), i)), lambda i: i.isNotNull())
    mixed = F.zip_with("c", "r", lambda c, r: F.coalesce(c, r))
    hashed = hashed.select(*rest, "r", "n", place.alias("marks"), mixed.alias("c"))
    codes = [c for size in sizes for c in _codes(size)]
    coded = hashed.select(*rest, "r", "c", F.concat(*codes).alias("codes"))
    # The outer form: for the other one Spark tests the array for being empty, further down and all over again.
    some = coded.select(*rest, "r", "c", F.explode_outer("codes").alias("code")).where("code IS NOT NULL")
    at, kind = F.shiftright("code", 3), F.col("code").bitwiseAND(F.lit(7))
    made = None
    for size in sizes:
        for marked, name in enumerate("rc"):
            one = _hash(F.col(name), at, size)
            test = kind == 2 * (size - SHORTEST) + marked
            made = F.when(test, one) if made is None else made.when(test, one)
    return some.select(*rest, at.alias("at"), (kind.bitwiseAND(F.lit(1)) == 1).alias("marked"), made.alias("hash"))


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, variant (of its text), size, pos and hash of every window of the benchmark, ``slots``, its words
    where it is a template with placeholders, and n_windows of its variant. A window without enough other
    words than placeholders, or with little but common ones, is no template; its own words always are one.

    Items of fewer than 8 template words are one window of their own size; fewer than 5 words (and
    null or empty texts) are too little to tell a leak and have none. Rows of equal id and text are one;
    texts that share an id are judged each by itself.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = items.select(F.col(f"`{item}`").alias("item"), F.xxhash64(body).alias("variant"), body.alias("text"))
    rows = _words(rows.dropDuplicates(["item", "variant"])).where(F.size("w") >= SHORTEST)
    rows = landed(rows.withColumn("size", F.least(F.size("w"), F.lit(WINDOW))), "benchmark-words")
    found = None
    for size in range(SHORTEST, WINDOW + 1):
        some = rows.where(F.col("size") == size)
        some = _windows(some.withColumn("words", F.col("w")), [size])
        found = some if found is None else found.unionAll(some)
    found = found.withColumn("words", F.slice("words", F.col("at") + 1, F.col("size")))
    literal = F.filter("words", lambda w: ~_is_marked(w))
    content = F.filter(literal, lambda w: ~w.isin(COMMON))
    enough = (F.size(literal) >= F.least(F.lit(LITERALS), F.col("size"))) & (F.size(content) >= CONTENT)
    found = found.where(~F.col("marked") | enough)
    totals = found.groupBy("item", "variant").agg(F.countDistinct("at").alias("n_windows"))
    same = F.col("r.item").eqNullSafe(F.col("t.item")) & (F.col("r.variant") == F.col("t.variant"))
    both = found.alias("r").join(totals.alias("t"), same)
    slots = F.when(F.col("marked"), F.col("words")).alias("slots")
    return both.select("r.item", "r.variant", "size", F.col("at").alias("pos"), "hash", slots, "t.n_windows")


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", coverage: float = 0.25, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per leaked (document, item): ``key``, ``text_hash``, ``item``, ``n_matched`` of
    ``n_windows`` windows, and ``n_slotted``, how many of these have placeholders.

    A pair leaks when at least ``coverage`` of the item's windows, two at least if it has two, stand
    in the document with consistent values, or when 13 words of it in a row do. Null texts are empty and leak nothing. Rows of equal key
    and text are one. broadcast_rows: a benchmark with more windows is joined by shuffling instead.
    """
    marks = landed(benchmark_windows(items, item, item_text), "benchmark-windows")
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect())  # four at most
    few = marks.count() <= broadcast_rows
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    hashes = _windows(_words(rows), sizes or [WINDOW]).drop("marked")
    light = marks.select("hash", "item", "variant", "pos", "size", "n_windows", F.col("slots").isNotNull().alias("slotted"))
    found = hashes.join(F.broadcast(light) if few else light, "hash")
    found = found.withColumn("shift", F.col("at") - F.col("pos")).drop("hash")
    found = landed(found.distinct(), "template-matches")
    # Only documents with placeholders in matched windows are read again.
    slotted = landed(found.where("slotted").select("key", "text_hash").distinct(), "slotted-documents")
    right, n = found.alias("f"), slotted.count()
    if n:
        odd = _inconsistent(found.where("slotted"), marks, rows, F.broadcast(slotted) if n <= broadcast_rows else slotted)
        on = [F.col(f"f.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("key", "text_hash", "item", "variant", "shift", "pos")]
        right = right.join(odd.alias("o"), [*on, F.col("f.slotted")], "left_anti")
    at = ["key", "text_hash", "item", "variant", "shift"]
    # Windows RUN - WINDOW before each one's place, at the same shift: there if all between are.
    before = F.lag("pos", RUN - WINDOW).over(Window.partitionBy(*at).orderBy("pos"))
    runs = right.groupBy(*at, "pos").agg(F.max("slotted").alias("slotted"), F.max("n_windows").alias("n_windows"))
    runs = runs.withColumn("run", F.col("pos") - before == RUN - WINDOW)
    pairs = runs.groupBy("key", "text_hash", "item", "variant").agg(
        F.coalesce(F.max("run"), F.lit(False)).alias("run"),
        F.countDistinct("pos").alias("n_matched"),
        F.max("n_windows").alias("n_windows"),
        F.countDistinct(F.when(F.col("slotted"), F.col("pos"))).alias("n_slotted"),
    )
    least = F.greatest(F.least(F.lit(2), F.col("n_windows")), F.ceil(F.col("n_windows") * coverage))
    pairs = pairs.where((F.col("n_matched") >= least) | F.col("run"))
    # Of an item's texts the one of which the document has the largest share.
    share = F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "n_matched", "n_windows", "n_slotted")
    best = pairs.groupBy("key", "text_hash", "item").agg(F.max(share).alias("best"))
    return best.select(
        F.col("key").alias(key), "text_hash", F.col("item").alias(item), "best.n_matched", "best.n_windows", "best.n_slotted"
    )


def _inconsistent(found: DataFrame, marks: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The windows (document, item, shift, pos) that hold a value of the item which became two values in
    the document at this shift, or a value of the document which stands for two of the item."""
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("key", "text_hash")]
    texts = texts.alias("t").join(docs.alias("d"), same, "left_semi").dropDuplicates(["key", "text_hash"])
    texts = _words(texts).select("key", "text_hash", F.col("w").alias("words"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("key", "text_hash")]
    rows = found.alias("f").join(texts.alias("x"), same).select("f.*", F.slice("x.words", F.col("at") + 1, F.col("size")).alias("own"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("item", "variant", "pos", "size")]
    rows = rows.alias("r").join(marks.where("slots IS NOT NULL").alias("m"), same).select("r.*", "m.slots")
    values = F.filter(F.arrays_zip(F.col("slots").alias("theirs"), F.col("own").alias("own")), lambda s: _is_marked(s["theirs"]))
    pairs = F.transform(values, lambda s: F.struct(
        _template(s["theirs"]).alias("c"), _own(s["theirs"]).alias("theirs"), _own(s["own"]).alias("own")
    ))
    at = ["key", "text_hash", "item", "variant", "shift"]
    slots = rows.select(*at, "pos", F.explode_outer(pairs).alias("s")).where("s IS NOT NULL")
    slots = slots.select(*at, "pos", "s.c", "s.theirs", "s.own")
    there, back = Window.partitionBy(*at, "c", "theirs"), Window.partitionBy(*at, "c", "own")
    slots = slots.withColumn("there", F.min("own").over(there) != F.max("own").over(there))
    slots = slots.withColumn("back", F.min("theirs").over(back) != F.max("theirs").over(back))
    return slots.where("there OR back").select(*at, "pos").distinct()


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without those that leak an item; all columns, repeated rows kept."""
    leaks = find_leaks(docs, items, key, text, **settings)
    leaks = leaks.select(F.col(f"`{key}`").alias("key"), "text_hash").distinct()
    rows = packed(docs, key, text).alias("d").join(leaks.alias("x"), same_row("d", "x"), "left_anti")
    return rows.select("row.*")

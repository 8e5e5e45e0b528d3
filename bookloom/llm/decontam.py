"""Benchmark decontamination by template windows: catches items whose numbers, names or units were
exchanged. Only DataFrame operations.

A text becomes words; numbers, names and units become typed placeholders that keep their value in
a second array. Each run of `window` words, as a template, is hash-joined with the benchmark's
templates and compared in full. Matches of one document and item on one diagonal (same distance
between their places) form an alignment. It is consistent if every value of a slot in the item
stands for one value of the document throughout: a re-parameterised item exchanges `12` for `15`
everywhere, a chance likeness does not. A document leaks an item if consistent alignments cover at
least `least` of the item's windows.

Names are words that begin with one capital followed by small letters, after a small letter, digit,
comma, colon or semicolon; so sentence starts and texts in capitals hold none. Windows in which
placeholders are the majority say nothing as templates and are left out. An item that has no other
windows, or is shorter than a window, is looked for word for word: its windows (the whole item where
that is shorter) are hash-joined with their values. Items of fewer than `SHORTEST` words are no
passage and match nothing.

Null and empty texts match nothing. Repeated rows of a document count once, repeated rows of an
item too. Rows without an id count as one document in `leaks`; `keep` judges each by its text. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import settle

#: Words taken for units where they follow a number.
UNITS = ("kg mg km cm mm ml mph kmh hour hours minute minutes second seconds day days week weeks "
         "month months year years metre metres meter meters mile miles foot feet inch inches pound "
         "pounds ounce ounces gram grams litre litres liter liters dollar dollars cent cents euro "
         "euros percent degree degrees kilograms kilometers kilometres g m s h").split()
#: What marks numbers, names and units: private characters.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
SIGNS = {"%": "percent", "$": "dollar", "€": "euro", "£": "pound"}
SPACE = r"\x20\x09-\x0D"
#: Steps from text to marked words, in order: pattern and replacement ($n: the nth group). Classes
#: of ASCII characters are much quicker than those of Unicode, and each step reads the whole text.
STEPS = [
    # a name may begin where the one before it ends, hence twice
    *[(rf"([^.!?{SPACE}][{SPACE}])(\p{{Lu}}\p{{Ll}}+)", f"$1{NAME}$2")] * 2,
    ("lower", ""),
    *[(r"([0-9])[.,:/]([0-9])", "$1$2")] * 2,
    (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\x{2010}-\x{2027}\x{3000}-\x{3002}]+", " "),
    (r"([0-9]+)", f" {NUMBER}$1 "),
    (r" +", " "),
    (rf"({NUMBER}[0-9]+ )({'|'.join(UNITS)})( )", f"$1{UNIT}$2$3"),
]
#: A marked word loses its value.
TEMPLATE = (f"([{NUMBER}-{UNIT}])[^ ]+", "$1")
#: Fewest words of an item.
SHORTEST = 3
#: Most benchmark windows that are broadcast (about 100 bytes each); beyond, both sides shuffle.
BROADCAST_ROWS = 200_000


def marked(text: str | Column) -> Column:
    c = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for sign, word in SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(f" {UNIT}{word} "))
    for pattern, by in STEPS:
        c = F.lower(c) if pattern == "lower" else F.regexp_replace(c, pattern, by)
    return F.trim(c)


def words(df: DataFrame) -> DataFrame:
    """Adds arrays: template (words with bare placeholders) and valued (words with values)."""
    return (df.withColumn("marked", marked("text"))
            .withColumn("valued", F.split("marked", " "))
            .withColumn("template", F.split(F.regexp_replace("marked", *TEMPLATE), " "))
            .drop("marked", "text"))


def windows(df: DataFrame, key: str, window: int, exact: Sequence[int] = ()) -> DataFrame:
    """A row per window: key, at (from 1), exact, hash, part of template and valued. Windows of `window`
    words are hashed as templates; those of each length in `exact` with their values."""
    def starts(width: int, is_exact: bool) -> Column:
        n = F.size("template") - width + 1
        every = F.transform(F.sequence(F.lit(1), n), lambda at: F.struct(
            at.alias("at"), F.lit(width).alias("width"), F.lit(is_exact).alias("exact")))
        return F.when(n >= 1, every).otherwise(F.array().cast("array<struct<at:int,width:int,exact:boolean>>"))

    # the outer form keeps the optimiser from preparing every text twice to look for empty arrays
    if exact:
        cuts = F.concat(starts(window, False), *[starts(w, True) for w in exact])
        cut = words(df).select(key, "template", "valued", F.explode_outer(cuts).alias("cut")).select(
            key, "template", "valued", "cut.*")
    else:
        n = F.size("template") - window + 1
        at = F.explode_outer(F.when(n >= 1, F.sequence(F.lit(1), n))).alias("at")
        cut = words(df).select(key, "template", "valued", at, F.lit(window).alias("width"),
                               F.lit(False).alias("exact"))
    template, valued = (F.slice(c, F.col("at"), F.col("width")) for c in ("template", "valued"))
    hashed = F.when(F.col("exact"), F.xxhash64(valued)).otherwise(F.xxhash64(template)) if exact else \
        F.xxhash64(template)
    return cut.where(F.col("at").isNotNull()).select(
        key, "at", "exact", hashed.alias("hash"), template.alias("template"), valued.alias("valued"))


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """Windows of the items that documents are compared with, and the lengths of those to be met word for word."""
    every = windows(benchmark.select("item_id", "text").distinct(), "item_id", window,
                    range(SHORTEST, window + 1))
    usable = 2 * F.size(F.filter("template", lambda w: ~w.isin(NUMBER, NAME, UNIT))) >= window
    told = every.where(~F.col("exact") & usable)
    # of items without such windows, those of the longest length that the item has
    rest = every.where("exact").join(told.select("item_id").distinct(), "item_id", "left_anti")
    longest = rest.groupBy("item_id").agg(F.max(F.size("valued")).alias("width"))
    plain = rest.join(longest, "item_id").where(F.size("valued") == F.col("width")).drop("width")
    lengths = [r["width"] for r in longest.select("width").distinct().collect()]  # window - 2 of them at most
    return settle(told.unionByName(plain), "item_windows"), sorted(lengths)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, least: float = 0.4,
          key: str = "doc_id") -> DataFrame:
    """doc_id (or another key), item_id, n_windows (of the item, covered), n_item_windows, n_slots, verbatim."""
    found, lengths = item_windows(benchmark, window)
    items = found.select(
        "item_id", F.col("at").alias("item_at"), F.col("exact").alias("item_exact"), "hash",
        F.col("template").alias("item_template"), F.col("valued").alias("item_valued"))
    total = items.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_item_windows"))
    n = items.count()
    if n <= BROADCAST_ROWS:
        items = F.broadcast(items)
    rows = windows(docs.select(key, "text"), key, window, lengths)
    slots = F.filter(F.arrays_zip(F.col("item_valued").alias("i"), F.col("valued").alias("d")),
                     lambda p: p["i"].substr(1, 1).isin(NUMBER, NAME, UNIT))
    # the full comparison stands behind the join: as a key it would be made for every window
    same = F.array_contains(F.array("item_template"), F.col("template"))
    if lengths:
        same &= (F.col("exact") == F.col("item_exact")) & (
            ~F.col("exact") | F.array_contains(F.array("item_valued"), F.col("valued")))
    met = rows.join(items, "hash").where(same).select(
        key, "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"),
        slots.alias("slots"))
    # as many rows and values per alignment as the item has windows, at most
    lines = met.groupBy(key, "item_id", "diagonal").agg(
        F.collect_set("item_at").alias("covered"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    of = F.transform("slots", lambda p: p["i"])
    fits = lines.where(F.size("slots") == F.size(F.array_distinct(of)))
    changed = F.exists("slots", lambda p: p["i"] != p["d"])
    found = fits.groupBy(key, "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_windows"),
        F.max(F.size("slots")).alias("n_slots"),
        (~F.max(changed)).alias("verbatim"))
    small = total if n > BROADCAST_ROWS else F.broadcast(total)
    return found.join(small, "item_id").where(
        F.col("n_windows") >= least * F.col("n_item_windows")).select(
        key, "item_id", F.col("n_windows").cast("long"), F.col("n_item_windows").cast("long"),
        F.col("n_slots").cast("long"), "verbatim")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, unchanged."""
    # rows without an id are told apart by their text
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.sha2(docs["text"], 256)))
    bad = leaks(docs.select(name.alias("_name"), "text"), benchmark, key="_name").select("_name").distinct()
    return docs.join(bad, name == bad["_name"], "left_anti")


def oracle(window: int = 5, least: float = 0.4) -> str:
    def sql(pattern: str) -> str:
        return pattern.replace("'", "''")

    text = "' ' || coalesce(text, '') || ' '"
    for sign, word in SIGNS.items():
        text = f"replace({text}, '{sign}', ' {UNIT}{word} ')"
    marks = f"('{NUMBER}', '{NAME}', '{UNIT}')"
    for pattern, by in STEPS:
        text = (f"lower({text})" if pattern == "lower" else
                f"regexp_replace({text}, '{sql(pattern)}', '{by.replace('$', chr(92))}', 'g')")

    def cut(source: str, key: str, width: str = str(window), extra: str = "") -> str:
        return f"""(SELECT {key}, pos, list_slice(template, pos, pos + {width} - 1) AS template,
          list_slice(valued, pos, pos + {width} - 1) AS valued
        FROM (SELECT *, unnest(generate_series(1, len(template) - {width} + 1)) AS pos
          FROM (SELECT {extra} {key}, string_split(regexp_replace(m, '{TEMPLATE[0]}', '\\1', 'g'), ' ')
                AS template, string_split(m, ' ') AS valued
            FROM (SELECT {extra}{key}, trim({text}) AS m FROM {source}))))"""

    return f"""
WITH docs AS {cut("documents", "doc_id")},
items AS (SELECT * FROM {cut("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")}
  WHERE 2 * len(list_filter(template, lambda w: w NOT IN {marks})) >= {window}),
plain AS (SELECT * FROM {cut("(SELECT DISTINCT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM items))",
                             "item_id", f"least({window}, len(template))")}
  WHERE len(valued) >= {SHORTEST}),
lengths AS (SELECT DISTINCT len(valued) AS width FROM plain),
total AS (SELECT item_id, count(DISTINCT pos) AS n_item_windows
  FROM (SELECT item_id, pos FROM items UNION ALL SELECT item_id, pos FROM plain) GROUP BY 1),
met AS (SELECT doc_id, item_id, i.pos AS item_at, d.pos - i.pos AS diagonal,
    i.valued AS iv, d.valued AS dv
  FROM docs d JOIN items i ON array_to_string(d.template, ' ') = array_to_string(i.template, ' ')
  UNION ALL
  SELECT doc_id, item_id, i.pos, d.pos - i.pos, i.valued, d.valued
  FROM {cut("(SELECT doc_id, text, width FROM documents, lengths)", "doc_id", "width", "width, ")} d
  JOIN plain i ON array_to_string(d.valued, ' ') = array_to_string(i.valued, ' ')),
pairs AS (SELECT DISTINCT doc_id, item_id, diagonal, i, d FROM
    (SELECT doc_id, item_id, diagonal, unnest(iv) AS i, unnest(dv) AS d FROM met)
  WHERE left(i, 1) IN {marks}),
slots AS (SELECT doc_id, item_id, diagonal, count(*) AS n, count(DISTINCT i) AS ni,
    bool_or(i <> d) AS changed FROM pairs GROUP BY ALL),
lines AS (SELECT doc_id, item_id, diagonal, item_at, coalesce(n, 0) AS n,
    coalesce(changed, false) AS changed
  FROM met LEFT JOIN slots USING (doc_id, item_id, diagonal) WHERE coalesce(n = ni, true))
SELECT doc_id, item_id, count(DISTINCT item_at) AS n_windows, any_value(n_item_windows)
  AS n_item_windows, max(n) AS n_slots, NOT bool_or(changed) AS verbatim
FROM lines JOIN total USING (item_id) GROUP BY doc_id, item_id
HAVING count(DISTINCT item_at) >= {least} * any_value(n_item_windows)"""

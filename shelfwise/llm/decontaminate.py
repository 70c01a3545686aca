"""Benchmark decontamination by question templates (operator 3).

Texts become lower-cased words. Numbers, names and units after a number are
slots: in the template each is its type only. A name is a capitalised word
inside a sentence, and a capitalised word elsewhere that is a name inside some
sentence of the same text. Every window of eight words of every document is joined to the windows of
the benchmark items by two hashes: of its template, so a question asked again
with other numbers and names still meets its item, and of its lower-cased words
as they are, so a copy meets it in any case. A window without slots has one hash
for both.

The slots of windows that meet by template are then compared along each
alignment of a document with an item: slots map one to one, each item value to
the document value that most of the alignment's windows pair it with and the
other way round (of equal counts the least value). A window with a pair outside
this mapping is dropped, unless its slots equal the item's.

A document is contaminated by an item if the windows that remain cover half of
the item's windows, or six of them (13 words in a row). A window with fewer
than four plain words meets by its words alone. Items shorter than eight words
are one window of their length, so an item of one word marks every document
that holds it. An item is read up to four times, as a document may hold
its first words otherwise: as it stands, after a number, and with the capitals
that begin its sentences all plain or all names; each reading has alignments of
its own.

Edge cases: null and empty texts are never contaminated; items that are null
or hold no word are skipped; repeated rows get equal
answers and rows with null ids are answered like any other; repeated items
count once an id; very long texts are taken whole, at a cost near their length;
an empty benchmark or empty documents give all-clean or
empty results; only id and text columns are read, and ``clean_documents``
returns the input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import bind, stage

WINDOW = 8
MIN_PLAIN = 4
# Units of measure that count as slots after a number.
UNITS = (
    "km", "kilometer", "kilometers", "kilometre", "kilometres", "m", "meter", "meters", "metre",
    "metres", "cm", "mm", "mile", "miles", "yard", "yards", "foot", "feet", "ft", "inch", "inches",
    "kg", "kilogram", "kilograms", "g", "gram", "grams", "mg", "lb", "lbs", "pound", "pounds",
    "ounce", "ounces", "oz", "ton", "tons", "l", "liter", "liters", "litre", "litres", "ml",
    "second", "seconds", "s", "minute", "minutes", "min", "hour", "hours", "h", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "usd", "euro",
    "euros", "eur", "cent", "cents", "percent", "degrees", "mph", "kmh",
)
_NAME, _BEGIN, _UNIT = "\x01", "\x02", "\x03"
# What fails at most characters stands first: a capital, and a digit before a unit.
_CAPITAL = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}\p{{M}}{_NAME}])"
_INSIDE_SENTENCE = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;:] )"
# All but letters, digits, marks, and points or commas between digits. No group is
# repeated, as Java would recurse once a character on a long run.
_NOISE = rf"[^\p{{L}}\p{{N}}\p{{M}}{_NAME}{_BEGIN}.,]+|[.,](?!\p{{N}})|(?<!\p{{N}})[.,]"
_UNIT_WORD = rf"([0-9] ){_BEGIN}?({'|'.join(UNITS)})(?= |$)"
# Windows of the benchmark that may be broadcast: about 100 bytes each.
BROADCAST_WINDOWS = 500_000


def words(text: Column, begun: str | None = None) -> Column:
    """Lower-cased words; names and units begin with a mark, numbers with a digit.

    Capitals that begin a sentence are names if the text holds them as such
    elsewhere; ``begun`` makes them all plain (``""``) or all names (``_NAME``).
    """
    inside = F.regexp_replace(F.coalesce(text, F.lit("")), _INSIDE_SENTENCE, _NAME)

    def begins(inside: Column) -> Column:
        marked = F.regexp_replace(inside, _CAPITAL, _BEGIN)
        return F.when(F.contains(inside, F.lit(_NAME)), marked).otherwise(inside)

    def typed(plain: Column) -> Column:
        units = F.regexp_replace(plain, _UNIT_WORD, f"$1{_UNIT}$2")
        return F.when(plain.rlike("[0-9]"), units).otherwise(plain)

    def split(typed: Column) -> Column:
        found = F.split(typed, " ", -1)
        return (
            F.when(typed == "", F.array().cast("array<string>"))
            .when(F.contains(typed, F.lit(_BEGIN)), bind(found, _named))
            .otherwise(found)
        )

    if begun is None:
        marked = bind(inside, begins)
    else:
        marked = F.regexp_replace(inside, _CAPITAL, begun) if begun else inside
    spaced = F.regexp_replace(F.regexp_replace(marked, _NOISE, " "), " {2,}", " ")
    return bind(bind(F.btrim(F.lower(spaced)), typed), split)


_HALVES = [1 << bit for bit in range(27, -1, -1)]


def _named(words: Column) -> Column:
    """Words that begin a sentence as names, if they are among the names, or plain."""

    def by(names: Column) -> Column:
        def one(word: Column) -> Column:
            def among(name: Column) -> Column:
                def further(at: Column, step: Column) -> Column:
                    return F.when(F.get(names, at + step - 1) <= name, at + step).otherwise(at)

                last = F.aggregate(F.array(*map(F.lit, _HALVES)), F.lit(0), further)
                return F.when(F.get(names, last - 1) == name, name).otherwise(F.substr(name, F.lit(2)))

            name = F.concat(F.lit(_NAME), F.substr(word, F.lit(2)))
            return F.when(F.ascii(word) == ord(_BEGIN), bind(name, among)).otherwise(word)

        return F.transform(words, one)

    return bind(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.ascii(w) == ord(_NAME)))), by)


def _is_slot(word: Column) -> Column:
    return F.ascii(word) <= F.lit(ord("9"))


def _exact(words: Column) -> Column:
    """The hash of each word without its mark."""
    marked = lambda w: F.ascii(w) < F.lit(ord(" "))
    return F.transform(words, lambda w: F.xxhash64(F.when(marked(w), F.substr(w, F.lit(2))).otherwise(w)))


def _typed(words: Column, exact: Column) -> Column:
    """The type of each word that is a slot, the hash of any other."""
    kind = lambda a: F.when(a == ord(_NAME), -1).when(a == ord(_UNIT), -2).otherwise(-3).cast("long")
    return F.transform(words, lambda w, i: F.when(_is_slot(w), kind(F.ascii(w))).otherwise(exact[i]))


_KEYS = "array<struct<hash:bigint,at:int,slots:array<string>,plain:boolean>>"


def _windows(words: Column, width: int, flagged: bool = False) -> Column:
    """``{hash, at, slots, plain}`` of every window by its words, and of those with slots by their template.

    A window with too few plain words has no template; if ``flagged``, ``plain``
    tells which these are, else it is true.
    """
    enough = min(MIN_PLAIN, width)
    none, sure = F.lit(None).cast("array<string>"), F.lit(True)

    def over(numbers: Column, at: Column) -> Column:
        return F.xxhash64(F.lit(width), F.slice(numbers, at + 1, width))

    def slots(at: Column) -> Column:
        return F.filter(F.slice(words, at + 1, width), _is_slot)

    def by_words(exact: Column, plain) -> Column:
        def key(at: Column) -> Column:
            return F.struct(
                over(exact, at).alias("hash"), at.alias("at"), none.alias("slots"), plain(at).alias("plain")
            )

        return F.transform(F.sequence(F.lit(0), F.size(exact) - width), key)

    def by_template(words: Column, exact: Column) -> Column:
        last = F.size(words) - width
        at_slots = F.filter(
            F.transform(words, lambda w, i: F.when(_is_slot(w), i)), lambda i: i.isNotNull()
        )
        around = F.transform(
            at_slots, lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i, last), F.lit(1))
        )
        held = F.transform(
            F.array_distinct(F.flatten(around)), lambda at: F.struct(at.alias("at"), slots(at).alias("slots"))
        )

        def keys(typed: Column) -> Column:
            return F.transform(
                F.filter(held, lambda x: F.size(x["slots"]) <= width - enough),
                lambda x: F.struct(
                    over(typed, x["at"]).alias("hash"), x["at"].alias("at"), x["slots"].alias("slots"), sure.alias("plain")
                ),
            )

        return bind(_typed(words, exact), keys)

    def with_slots(exact: Column) -> Column:
        plain = (lambda at: F.size(slots(at)) <= width - enough) if flagged else (lambda at: sure)
        return F.concat(by_words(exact, plain), by_template(words, exact))

    return F.when(F.size(words) < width, F.array().cast(_KEYS)).otherwise(
        F.when(F.exists(words, _is_slot), bind(_exact(words), with_slots)).otherwise(
            bind(F.transform(words, lambda w: F.xxhash64(w)), lambda e: by_words(e, lambda at: sure))
        )
    )


def _readings(text: Column) -> Column:
    """The words of an item as it stands, after a number, and with sentences begun plainly or by names."""
    after = words(F.concat(F.lit("1 "), F.btrim(F.coalesce(text, F.lit("")))))
    return bind(
        after,
        lambda w: F.array_distinct(
            F.array(words(text), F.slice(w, F.lit(2), F.size(w)), words(text, ""), words(text, _NAME))
        ),
    )


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of the items with their numbers: of all, and of those with enough plain words."""
    split = benchmark.select(
        F.col(id_col).alias("item"), F.posexplode(_readings(F.col(text_col))).alias("reading", "w")
    )
    split = split.filter(F.col("item").isNotNull() & (F.size("w") > 0))
    sized = split.withColumn("width", F.least(F.size("w"), F.lit(WINDOW)))
    by_width = F.lit(None)
    for width in range(1, WINDOW + 1):
        by_width = F.when(F.col("width") == width, _windows(F.col("w"), width, flagged=True)).otherwise(by_width)
    found = sized.select("item", "reading", "width", F.explode(by_width).alias("x")).select(
        "item", "width", F.when(F.col("x.slots").isNotNull(), F.col("reading")).otherwise(0).alias("reading"), "x.*"
    )
    found = found.groupBy("item", "width", "reading", "hash", "at", "slots").agg(F.max("plain").alias("plain"))
    sizes = found.groupBy(F.col("item").alias("of")).agg(
        F.countDistinct("at").alias("n_windows"),
        F.countDistinct(F.when(F.col("plain"), F.col("at"))).alias("n_plain"),
    )
    return found.join(sizes, F.col("item") == F.col("of")).select(
        "item", "n_windows", "n_plain", "reading", "hash", F.col("at").alias("item_at"),
        F.col("slots").alias("item_slots"), F.col("plain").alias("item_plain"), "width",
    )


def meetings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of documents that meet a window of an item."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most eight
    windows = F.concat(*(_windows(F.col("w"), n) for n in widths or [WINDOW]))
    spread = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
        .select("id", "text_hash", F.explode(windows).alias("x"))
        .select("id", "text_hash", "x.hash", "x.at", "x.slots")
    )
    # Benchmarks are small; one that is not is joined by shuffling both sides.
    small = items.count() <= BROADCAST_WINDOWS
    return spread.join(F.broadcast(items) if small else items, "hash")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    min_share: float = 0.5,
    min_windows: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, text_hash, items)`` of the contaminated texts, written once."""
    items = stage(item_windows(benchmark, item_id_col, item_text_col), "items")
    met = stage(
        meetings(docs, items, id_col, text_col)
        .select(
            "id", "text_hash", "item", "n_windows", "n_plain", "reading", "item_at", "item_plain",
            (F.col("at") - F.col("item_at")).alias("shift"), "slots", "item_slots",
        )
        .distinct(),
        "meetings",
    )
    alignment = ["id", "text_hash", "item", "reading", "shift"]
    # The type of a slot is its first character, digits being numbers. Windows
    # that meet by their words hold no slots and need no mapping.
    pairs = (
        met.filter(F.col("slots").isNotNull())
        .select(*alignment, "item_at", F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
        .select(*alignment, "item_at", F.col("p.item_slots").alias("asked"), F.col("p.slots").alias("given"))
    )
    counted = pairs.groupBy(*alignment, "asked", "given").agg(F.count("*").alias("n"))
    best = [
        F.row_number().over(Window.partitionBy(*alignment, one).orderBy(F.desc("n"), other)) == 1
        for one, other in (("asked", "given"), ("given", "asked"))
    ]
    outside = counted.select(*alignment, "asked", "given", (best[0] & best[1]).alias("kept")).filter("not kept")

    def same(keys: list[str]) -> list[Column]:
        return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]

    dropped = (
        pairs.alias("l")
        .join(outside.alias("r"), same([*alignment, "asked", "given"]), "left_semi")
        .select(*alignment, "item_at")
        .distinct()
    )
    by_template = F.col("l.slots").isNotNull() & (F.col("l.slots") != F.col("l.item_slots"))
    good = met.alias("l").join(dropped.alias("r"), [*same([*alignment, "item_at"]), by_template], "left_anti")
    hits = (
        good.groupBy("id", "text_hash", "item")
        .agg(
            F.countDistinct("item_at").alias("covered"),
            F.countDistinct(F.when(F.col("item_plain"), F.col("item_at"))).alias("covered_plain"),
            F.max("n_windows").alias("n_windows"),
            F.max("n_plain").alias("n_plain"),
        )
        .filter(
            (F.col("covered") >= min_share * F.col("n_windows"))
            | (F.col("covered") >= min_windows)
            | ((F.col("covered_plain") > 0) & (F.col("covered_plain") >= min_share * F.col("n_plain")))
        )
        .groupBy("id", "text_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return stage(hits, "contaminated")


def _keyed(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    found = hits.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "items")
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return found, docs[id_col].eqNullSafe(found["_id"]) & (text_hash == found["_hash"])


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, contaminated, n_items, items)`` of every document."""
    hits = contamination(docs, benchmark, id_col=id_col, text_col=text_col)
    rows = docs.select(id_col, text_col)
    found, same = _keyed(rows, hits, id_col, text_col)
    items = F.coalesce(found["items"], F.array().cast(hits.schema["items"].dataType))
    return rows.join(found, same, "left").select(
        id_col,
        found["items"].isNotNull().alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the contaminated ones."""
    hits = contamination(docs, benchmark, id_col=id_col, text_col=text_col)
    found, same = _keyed(docs, hits, id_col, text_col)
    return docs.join(found, same, "left_anti")


def oracle_sql(min_share: float = 0.5, min_windows: int = 6) -> str:
    """DuckDB SQL for ``contamination_report`` (items comma-joined) over tables
    ``documents`` and ``benchmark``. Look-behinds are written as groups, applied
    twice where a match may take the character that the next one needs."""
    capital = r"'(^|[^\p{L}\p{N}\p{M}\x01\x02])(\p{Lu}\p{Ll})', '\1' || chr(2) || '\2', 'g')"
    inside = r"'([\p{L}\p{N},;:] )(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g')"
    point = r"'(\p{N})\.(\p{N})', '\1' || chr(4) || '\2', 'g')"
    comma = r"'(\p{N}),(\p{N})', '\1' || chr(5) || '\2', 'g')"
    units = ", ".join(f"'{u}'" for u in UNITS)

    def plain(text: str) -> str:
        for step in (inside, capital, point, comma):
            text = f"regexp_replace(regexp_replace({text}, {step}, {step}"
        spaced = rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}\p{{M}}\x01\x02\x04\x05]+', ' ', 'g')"
        return f"trim(lower(replace(replace({spaced}, chr(4), '.'), chr(5), ',')))"

    whole = "coalesce(text, '')"

    def windows(table: str, readings: str) -> str:
        return f"""{table}_p AS ({readings}),
{table}_s AS (
  SELECT id, th, reading, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM {table}_p
), {table}_n AS (
  SELECT *, list_filter(w, lambda x: unicode(x) = 1) AS names,
         [CASE WHEN unicode(x) = 2 THEN substr(x, 2) ELSE x END FOR x IN w] AS v FROM {table}_s
), {table}_u AS (
  SELECT id, th, reading,
         [CASE WHEN i > 1 AND v[i] IN ({units}) AND regexp_matches(v[i - 1], '[0-9]$') THEN chr(3) || v[i]
               WHEN unicode(w[i]) = 2 AND (reading = 3 OR reading < 2 AND list_contains(names, chr(1) || v[i]))
               THEN chr(1) || v[i] ELSE v[i] END FOR i IN range(1, len(w) + 1)] AS w
  FROM {table}_n
), {table}_w AS (SELECT id, th, reading, CASE WHEN reading = 1 THEN w[2:] ELSE w END AS w FROM {table}_u),
{table}_t AS (
  SELECT *, [CASE WHEN unicode(x) > 57 THEN x WHEN unicode(x) = 1 THEN chr(1) WHEN unicode(x) = 3 THEN chr(3)
                  ELSE chr(2) END FOR x IN w] AS tpl,
         [CASE WHEN unicode(x) < 32 THEN substr(x, 2) ELSE x END FOR x IN w] AS lit FROM {table}_w
)"""

    def keys(table: str, width: str, source: str) -> str:
        return f"""{table}_x AS (
  SELECT id, th, reading, {width} AS width, unnest(
    [{{'t': array_to_string(tpl[i:i + {width} - 1], ' '), 'e': array_to_string(lit[i:i + {width} - 1], ' '),
       'pos': i - 1, 'slots': list_filter(w[i:i + {width} - 1], lambda x: unicode(x) <= 57)}}
     FOR i IN range(1, len(w) - {width} + 2)]) AS x FROM {source}
), {table}_k AS (
  SELECT id, th, width, reading, x.t AS h, x.pos AS pos, x.slots AS slots, true AS plain FROM {table}_x
  WHERE len(x.slots) > 0 AND width - len(x.slots) >= least({MIN_PLAIN}, width)
  UNION ALL
  SELECT id, th, width, 0, x.e, x.pos, NULL, width - len(x.slots) >= least({MIN_PLAIN}, width) FROM {table}_x
)"""

    docs = f"SELECT doc_id AS id, hash(text) AS th, 0 AS reading, {plain(whole)} AS t FROM documents"
    after = f"'1 ' || trim({whole})"
    items = " UNION ALL ".join(
        f"SELECT item_id AS id, hash(text) AS th, {n} AS reading, {plain(text)} AS t FROM benchmark"
        for n, text in enumerate((whole, after, whole, whole))
    )
    alignment = "id, th, item, reading, shift"

    def same(more: str) -> str:
        return " AND ".join(f"l.{c} IS NOT DISTINCT FROM r.{c}" for c in f"{alignment}, {more}".split(", "))

    return f"""WITH {windows("documents", docs)}, {windows("benchmark", items)},
{keys("benchmark", f"least(len(w), {WINDOW})", "benchmark_t WHERE id IS NOT NULL AND len(w) > 0")},
bu AS (
  SELECT id AS item, width, reading, h, pos AS item_at, slots AS item_slots, max(plain) AS plain
  FROM benchmark_k GROUP BY ALL
), bn AS (
  SELECT item, count(DISTINCT item_at) AS n_windows, count(DISTINCT item_at) FILTER (plain) AS n_plain
  FROM bu GROUP BY item
), widths AS (SELECT DISTINCT width AS k FROM bu),
{keys("documents", "k", "documents_t, widths WHERE len(w) >= k")},
met AS (
  SELECT DISTINCT d.id, d.th, b.item, n_windows, n_plain, b.reading, item_at, plain, d.pos - item_at AS shift,
         d.slots, item_slots
  FROM (SELECT id, th, width, h, pos, slots FROM documents_k) d
  JOIN bu b ON d.h = b.h AND d.width = b.width JOIN bn USING (item)
), pr AS (
  SELECT {alignment}, item_at, unnest(item_slots) AS asked, unnest(slots) AS given FROM met WHERE slots IS NOT NULL
), cn AS (SELECT {alignment}, asked, given, count(*) AS n FROM pr GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {alignment}, asked ORDER BY n DESC, given) AS by_asked,
         row_number() OVER (PARTITION BY {alignment}, given ORDER BY n DESC, asked) AS by_given FROM cn
), dropped AS (
  SELECT DISTINCT {", ".join(f"l.{c}" for c in alignment.split(", "))}, item_at
  FROM pr l JOIN ranked r ON {same("asked, given")} WHERE by_asked > 1 OR by_given > 1
), good AS (
  SELECT * FROM met l WHERE slots IS NULL OR slots = item_slots
    OR NOT EXISTS (SELECT 1 FROM dropped r WHERE {same("item_at")})
), hits AS (
  SELECT id, th, item FROM good GROUP BY id, th, item
  HAVING count(DISTINCT item_at) >= {min_share} * max(n_windows) OR count(DISTINCT item_at) >= {min_windows}
      OR (count(DISTINCT item_at) FILTER (plain) > 0
          AND count(DISTINCT item_at) FILTER (plain) >= {min_share} * max(n_plain))
), per AS (SELECT id, th, list(item ORDER BY item) AS items FROM hits GROUP BY id, th)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(len(items), 0) AS n_items,
       coalesce(array_to_string(items, ','), '') AS items
FROM documents d LEFT JOIN per ON per.id IS NOT DISTINCT FROM d.doc_id AND per.th = hash(d.text)"""

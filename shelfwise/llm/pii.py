"""Personal data by bootstrapped contextual extraction (operator 6).

Seeds are what four fixed patterns find in a text: e-mail addresses, IPv4
addresses, card numbers and phone numbers. Every word with a digit or an "@"
is a mention; the words around it are its lexical patterns. Spark scores the
graph of patterns and mentioned values in rounds: a pattern is trusted by the
share of its mentions that are seeds or accepted so far, a value by its best
trusted pattern, and identifier-like values that trusted patterns hold are
accepted, which may make more patterns trusted. Their mentions become spans of
kind ``id`` beside the seeds.

All of it is native expressions, joins and partial aggregations. Matches are
located in code points by splitting the text at them, with two-level running
sums; a match is looked up among others by halving, and pieces of a text are
taken from chunks of it, so the cost stays near the text's length however many
matches there are and however long it is. Contexts are whole words.

``redact`` replaces exactly the spans that ``personal_data`` reports: spans that
overlap, of any kind, go together under the kind of the one that starts first (of
equal starts, the kind listed first).

Edge cases: a null text counts as empty; repeated rows get the same spans; a
null id is a row like any other (joins on the id are null-safe); no seeds means
no patterns and only the base spans; an empty table gives an empty result.
``redact`` returns the input's columns under their names; a null text stays
null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WHITE_SPACE, WHITE_SPACE_RUN, bind, stage

# The contract's patterns, written so that Java neither recurses nor tries the
# same characters again: a repeated group becomes a lazy run up to the first
# character that nothing of the group follows.
_LABEL, _LOCAL = "[A-Za-z0-9-]", "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": (
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?=\.{_LABEL})"
        rf"[A-Za-z0-9.-]*?{_LABEL}(?!\.?{_LABEL})"
    ),
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
_MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_BLOCK = 64


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _cut(text: Column, pattern: str, body) -> Column:
    """``body(parts, matches)`` of a text cut at the matches of a pattern."""
    return bind(
        F.split(text, pattern, -1),
        lambda parts: bind(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: body(parts, found)
        ),
    )


def _starts(parts: Column, found: Column) -> Column:
    """Where each match starts, in code points from 0."""

    def by_block(lengths: Column) -> Column:
        count = F.size(lengths)
        blocks = F.sequence(F.lit(0), F.floor((count - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda j: _total(F.slice(lengths, j * _BLOCK + 1, _BLOCK)))

        def running(sums: Column) -> Column:
            before = F.transform(sums, lambda _, j: _total(F.slice(sums, 1, j)))
            return bind(
                before,
                lambda before: F.transform(
                    found,
                    lambda _, i: before[F.floor(i / _BLOCK).cast("int")]
                    + _total(F.slice(lengths, i - i % _BLOCK + 1, i % _BLOCK))
                    + F.length(parts[i]),
                ),
            )

        return bind(sums, running)

    lengths = F.transform(found, lambda m, i: F.length(parts[i]) + F.length(m))
    return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(bind(lengths, by_block))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return _total(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), weighed)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return bind(
            _digits(match),
            lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)),
        )
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap condition without which a text has no match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


SPANS = "array<struct<start:int,end:int>>"
_HALVES = [1 << bit for bit in range(27, -1, -1)]
_CHUNK = 1024


def _count_up_to(spans: Column, end: str, limit: Column) -> Column:
    """How many of these spans, sorted and apart, start or end at or before ``limit``."""

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(spans, at + step - 1)[end] <= limit, at + step).otherwise(at)

    halving = F.aggregate(F.array(*map(F.lit, _HALVES)), F.lit(0), further)
    return F.when(F.size(spans) == 0, 0).otherwise(halving)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _taken(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text in chunks."""
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor((end - 1) / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end <= start, "").otherwise(near.substr(start - first * _CHUNK + 1, end - start))


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind, by start, as ``{start, end}``."""

    def located(parts: Column, found: Column) -> Column:
        spans = F.transform(
            F.arrays_zip(_starts(parts, found).alias("start"), found.alias("m")),
            lambda x: F.struct(
                x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m")
            ),
        )
        good = F.filter(spans, lambda x: _valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(_may_hold(kind, text), _cut(text, PATTERNS[kind], located)).otherwise(
        F.array().cast(SPANS)
    )


def _mentions(text: Column, seeds: list[Column]) -> Column:
    """Words with a digit or "@": place, value, context and whether a seed covers it."""

    def word(x: Column, back: bool) -> Column:
        """The words of a context nearest to the mention, one or two."""
        spaced = F.lower(F.regexp_replace(x, WHITE_SPACE_RUN, " "))
        return F.substring_index(spaced, " ", -2 if back else 1)

    def covering(start: Column, end: Column) -> Column:
        """The first kind's seed that shares a character with the range."""
        firsts = [F.get(s, _count_up_to(s, "end", start)) for s in seeds]
        return F.coalesce(*(bind(f, lambda f: F.when(f["start"] < end, f)) for f in firsts))

    def located(chunks: Column) -> Column:
        def placed(parts: Column, found: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                lead = F.length(F.regexp_extract(x["m"], "^[^A-Za-z0-9+]*", 0))
                value = F.regexp_extract(x["m"], r"^[^A-Za-z0-9+]*(.*?)[^A-Za-z0-9]*$", 1)
                left = word(F.btrim(parts[i], F.lit(WHITE_SPACE)), True)
                right = word(F.btrim(parts[i + 1], F.lit(WHITE_SPACE)), False)
                start = x["start"] + lead
                # A word of a longer seed stands for the whole of it.
                return bind(
                    covering(start, start + F.length(value)),
                    lambda seed: F.struct(
                        start.alias("start"),
                        (start + F.length(value)).alias("end"),
                        F.lower(
                            F.when(seed.isNull(), value).otherwise(_taken(chunks, seed["start"], seed["end"]))
                        ).alias("value"),
                        left.alias("left"),
                        right.alias("right"),
                        seed.isNotNull().alias("seed"),
                    ),
                )

            return F.transform(F.arrays_zip(_starts(parts, found).alias("start"), found.alias("m")), one)

        return _cut(text, _MENTION, placed)

    kind = (
        "array<struct<start:int,end:int,value:string,left:string,right:string,seed:boolean>>"
    )
    return F.when(
        text.rlike("[0-9@]"), F.filter(bind(_chunks(text), located), lambda m: m["value"] != "")
    ).otherwise(F.array().cast(kind))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash``, an array of spans for each kind, and the mentions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
        *(base_spans(text, k).alias(k) for k in KINDS),
    )
    return found.select(
        "id", "text_hash", *KINDS, _mentions(F.col("text"), [F.col(k) for k in KINDS]).alias("mentions")
    )


def accepted_mentions(
    found: DataFrame,
    min_support: int = 5,
    min_confidence: float = 0.8,
) -> DataFrame:
    """``(id, text_hash, start, end)`` of the mentions that trusted patterns add.

    A pattern is two words to the left, or one word on each side. It is trusted
    if it holds ``min_support`` different known values and these make up
    ``min_confidence`` of its mentions. A value may be accepted if it has at
    least six characters, three of them digits. Known values only grow; rounds
    end when none is added.
    """
    mentions = stage(
        found.select("id", "text_hash", F.explode("mentions").alias("m")).select("id", "text_hash", "m.*"),
        "mentions",
    )
    one_left = F.substring_index("left", " ", -1)
    patterns = F.array(
        F.when(F.col("left").contains(" "), F.concat(F.lit("L "), "left")),
        F.when(
            (one_left != "") & (F.col("right") != ""), F.concat(F.lit("M "), one_left, F.lit(" _ "), "right")
        ),
    )
    edges = stage(
        mentions.select("value", "seed", F.explode(F.array_compact(patterns)).alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed")),
        "graph",
    )
    like_id = (F.length(F.regexp_replace("value", "[^a-z0-9]", "")) >= 6) & (
        F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3
    )
    known = stage(edges.filter("seed").select(F.col("value").alias("known")).distinct(), "known")
    size = known.count()
    while True:
        scored = edges.join(known, F.col("value") == F.col("known"), "left")
        is_known = F.col("known").isNotNull()
        trusted = (
            scored.groupBy("pattern")
            .agg(
                F.sum(F.when(is_known, F.col("n")).otherwise(0)).alias("good"),
                F.sum("n").alias("all"),
                F.sum(is_known.cast("long")).alias("support"),
            )
            .filter((F.col("support") >= min_support) & (F.col("good") >= min_confidence * F.col("all")))
            .select(F.col("pattern").alias("trusted"))
        )
        more = edges.filter(like_id).join(trusted, F.col("pattern") == F.col("trusted"), "left_semi")
        known = stage(known.union(more.select("value")).distinct(), "known")
        now = known.count()
        if now == size:
            break
        size = now
    new = mentions.filter(like_id & ~F.col("seed")).join(
        known, F.col("value") == F.col("known"), "left_semi"
    )
    return new.select("id", "text_hash", "start", "end").distinct()


def _added(found: DataFrame) -> DataFrame:
    spans = accepted_mentions(found).groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("added")
    )
    return stage(spans.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "added"), "added")


def _with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(added, same, "left").withColumn(
        "added", F.coalesce("added", F.array().cast(SPANS))
    ).drop("_id", "_hash")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, an array of spans for each base kind, and ``added`` spans, of every document."""
    found = stage(find_base(docs, id_col, text_col), "base")
    added = _added(found)
    return _with_added(found.drop("mentions"), added).drop("text_hash").withColumnRenamed("id", id_col)


def span_text(kinds: dict[str, str]) -> Column:
    """``kind:start:end`` of the given kinds (name -> column), in order, comma-joined."""
    def listed(kind: str, column: str) -> Column:
        return F.transform(
            F.col(column),
            lambda s: F.concat(
                F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
            ),
        )

    return F.array_join(F.concat(*(listed(k, c) for k, c in kinds.items())), ",")


def _redacted(text: Column, kinds: dict[str, Column]) -> Column:
    """``text`` with the spans of each kind (name -> sorted spans) replaced."""
    names = list(kinds)

    def marked(k: int, spans: Column) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
        )

    every = F.array_sort(F.concat(*(marked(k, spans) for k, spans in enumerate(kinds.values()))))

    def is_first(x: Column) -> Column:
        """Whether no span that starts before, or that comes before at the same start, reaches it."""

        def by(k: int, spans: Column) -> Column:
            first = F.get(spans, _count_up_to(spans, "end", x["start"]))["start"]
            same = (F.lit(k) < x["kind"]).cast("int")
            return F.coalesce(first < x["start"] + same, F.lit(False))

        return ~reduce(Column.__or__, (by(k, spans) for k, spans in enumerate(kinds.values())))

    def replaced(heads: Column) -> Column:
        def last_end(i: Column) -> Column:
            """Where the spans that start before the next head end."""
            limit = F.coalesce(F.get(heads, i + 1)["start"], F.lit(1 << 30)) - 1
            ends = [F.get(s, _count_up_to(s, "start", limit) - 1)["end"] for s in kinds.values()]
            return F.greatest(*ends, F.lit(0))

        def rebuilt(bound: Column) -> Column:
            chunks, ends = bound["chunks"], bound["ends"]
            shown = F.array(*(F.lit(f"<{n.upper()}>") for n in names))
            pieces = F.transform(
                heads,
                lambda x, i: F.concat(
                    _taken(chunks, F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), x["start"]),
                    F.get(shown, x["kind"]),
                ),
            )
            rest = _taken(chunks, F.element_at(ends, -1), F.length(text))
            return F.concat(F.array_join(pieces, ""), rest)

        ends = F.transform(heads, lambda _, i: last_end(i))
        return bind(F.struct(_chunks(text).alias("chunks"), ends.alias("ends")), rebuilt)

    return F.when(F.size(every) > 0, bind(F.filter(every, is_first), replaced)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in capitals, as ``<EMAIL>``."""
    added = _added(stage(find_base(docs, id_col, text_col), "base"))
    names = docs.columns
    body, key = F.col(f"_d{names.index(text_col)}"), F.col(f"_d{names.index(id_col)}")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(names)))
    rows = _with_added(
        rows.withColumns({"id": key, "text_hash": F.xxhash64(F.coalesce(body, F.lit("")))}), added
    )
    rows = rows.withColumns({k: base_spans(F.coalesce(body, F.lit("")), k) for k in KINDS})
    clean = _redacted(body, {k: F.col(k) for k in KINDS} | {"id": F.col("added")})
    return rows.select(
        *((clean if c == text_col else F.col(f"_d{i}")).alias(c) for i, c in enumerate(names))
    )

"""Personal data: fixed patterns, and more identifiers from the contexts of what they find.

``BASE`` finds e-mail addresses, internet addresses, card and phone numbers.  These are the
seeds of a bootstrap over lexical contexts.  A pattern is the last word, or the last two,
before an identifier; an instance is an identifier's text.  Rounds score the bipartite graph
of patterns and instances: a pattern by the mean score of all distinct instances it
precedes, an unseen instance by the chance that at least one confident pattern before it
is right.  An unseen identifier is reported where a confident pattern precedes it, if its
digits fit the kind; an address needs none.  A number written with blanks counts as one, and its
parts are instances too, so that two numbers side by side are not lost.

Only DataFrame and SQL functions.  The texts are read once; what the rounds read are the
contexts of identifiers, and each round is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace

#: The fixed patterns.  Possessive runs, and starts only where a run starts or the match
#: before has ended, keep the leftmost matches and make the search linear.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped: a run of such characters with a digit; groups of digits joined by a single
#: blank, dot, hyphen, slash or bracket; and whatever is written like an address.
_PART = "A-Za-z0-9._/@+-"
_NAME = r"\p{L}\p{N}"
SHAPES = {
    "run": rf"(?<![{_PART}])[A-Za-z._/@+-]*+[0-9][{_PART}]*+",
    "groups": rf"(?<![{_PART}])\+?[(\[]?[0-9]++(?:[)\]]?[\x20\xA0./-]?[(\[]?[0-9]++)++",
    "address": rf"(?:\G|(?<![{_NAME}._%+'-]))[{_NAME}._%+'-]++@[{_NAME}]++(?:[.-]++[{_NAME}]++)*+",
}
LEAST_DIGITS, LEAST_CHARS, MOST_CHARS, MOST_ADDRESS = 4, 6, 64, 320
#: Groups with blanks have at most so many digits; more are several numbers.
MOST_DIGITS = {"email": 0, "ip": 12, "card": 19, "phone": 15}
CONTEXT = 60
#: Matches of one text that are worked on together.
BLOCK = 128
ROUNDS, LEAST_HITS, CONFIDENT = 3, 5.0, 0.8

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (sum, i) -> sum + if(i % 2 = 1, "
    f"int(substring(reverse({_DIGITS}), i, 1)), "
    f"int(substring('0246813579', 1 + int(substring(reverse({_DIGITS}), i, 1)), 1)))) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": rf"s.value rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def firsts(items: Column) -> Column:
    """The places, from 0, at which blocks of ``BLOCK`` items begin.  What is built item by
    item is built within blocks, so its cost does not grow with the square of their number."""
    return F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value, before) of all matches; ``before`` is the ``CONTEXT``
    characters before the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        found,
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")),
    )
    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")

    def step(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["value"])
        size = F.lit(CONTEXT)
        before = F.right(F.concat(so_far["tail"], F.right(pair["gap"], size)), size)
        tail = F.right(F.concat(before, F.right(pair["value"], size)), size)
        span = F.struct(
            start.alias("start"), stop.alias("stop"), pair["value"].alias("value"), before.alias("before")
        )
        out = F.concat(so_far["out"], F.array(span))
        return F.struct(stop.alias("at"), tail.alias("tail"), out.alias("out"))

    def total(items: Column) -> Column:
        return F.aggregate(
            items, F.lit(0), lambda sum, p: sum + F.length(p["gap"]) + F.length(p["value"])
        )

    def spans(pairs: Column, sizes: Column, first: Column, block: Column) -> Column:
        # A match has a character at least, so these hold the context of the block's first.
        warm = F.least(first, F.lit(CONTEXT))
        ahead = F.slice(pairs, first - warm + 1, warm)
        begin = F.aggregate(F.slice(sizes, F.lit(1), block), F.lit(0), lambda sum, n: sum + n)
        zero = F.struct(
            (begin - total(ahead)).alias("at"), F.lit("").alias("tail"), none.alias("out")
        )
        own = F.slice(pairs, first - warm + 1, warm + BLOCK)
        return F.slice(F.aggregate(own, zero, step, lambda so_far: so_far["out"]), warm + 1, BLOCK)

    def placed(pairs: Column) -> Column:
        sizes = F.transform(firsts(pairs), lambda first: total(F.slice(pairs, first + 1, BLOCK)))
        return let(
            sizes,
            lambda sizes: F.flatten(
                F.transform(firsts(pairs), lambda first, block: spans(pairs, sizes, first, block))
            ),
        )

    return let(pairs, placed)


def free_ones(found: Column, taken: Column, keep) -> Column:
    """The spans of ``found``, in their order, that pass ``keep`` and overlap none of ``taken``."""

    def apart(part: Column) -> Column:
        begin, end = F.get(part, F.lit(0))["start"], F.get(part, F.size(part) - 1)["stop"]
        near = F.filter(taken, lambda b: (b["start"] < end) & (b["stop"] > begin))

        def free(s: Column, near: Column) -> Column:
            return ~F.exists(near, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

        return let(near, lambda near: F.filter(part, lambda s: keep(s) & free(s, near)))

    blocks = F.transform(
        firsts(found), lambda first: let(F.slice(found, first + 1, BLOCK), apart)
    )
    return F.flatten(blocks)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with an array of valid matches per kind and ``shaped``, the other identifiers."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    digit = F.col("_text").rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")
    needs = {
        "email": F.col("_text").contains("@"),
        "ip": F.col("_text").rlike("[0-9][.][0-9]"),
        "card": F.col("_text").rlike("[0-9][\\x20-]?[0-9]"),
        "phone": F.col("_text").contains("+"),
    }
    for kind, pattern in BASE.items():
        found = F.when(needs[kind], matches(F.col("_text"), pattern)).otherwise(none)
        out = out.withColumn(f"_{kind}", found)
        out = out.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, s -> {VALID[kind]})"))
    out = out.withColumn("_taken", F.concat(*[f"_{kind}" for kind in BASE]))

    def number(s: Column, most: int | None = None) -> Column:
        digits, size = F.length(F.regexp_replace(s["value"], "[^0-9]", "")), F.length(s["value"])
        fits = (digits >= LEAST_DIGITS) & size.between(LEAST_CHARS, MOST_CHARS)
        return fits if most is None else fits & (digits <= most)

    keep = {
        "run": number,
        "groups": lambda s: number(s, max(MOST_DIGITS.values())),
        "address": lambda s: F.length(s["value"]) <= MOST_ADDRESS,
    }
    for shape, pattern in SHAPES.items():
        possible = needs["email"] if shape == "address" else digit
        found = F.when(possible, matches(F.col("_text"), pattern)).otherwise(none)
        out = out.withColumn(f"_{shape}", found)
        out = out.withColumn(f"_{shape}", free_ones(F.col(f"_{shape}"), F.col("_taken"), keep[shape]))
    shaped = F.concat(*[f"_{shape}" for shape in SHAPES])
    return out.withColumn("_shaped", shaped).drop("_text", "_taken", *[f"_{shape}" for shape in SHAPES])


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, stop, value, kind, inner, pattern) of seeds, and of shaped ones with no kind.

    The context begins where the identifiers before have ended.  A shaped one that overlaps an
    earlier or longer one is ``inner``: another reading of the same place.
    """
    fields = "s.start as start, -s.stop as back, s.stop as stop, s.value as value, s.before as before"
    seeds = [
        F.expr(f"transform(_{kind}, s -> struct({fields}, '{kind}' as kind))") for kind in BASE
    ]
    other = F.expr(f"transform(_shaped, s -> struct({fields}, cast(null as string) as kind))")
    listed = found.select("row", F.explode(F.concat(*seeds, other)).alias("s")).select("row", "s.*")
    in_row = Window.partitionBy("row").orderBy("start", "back", "value", "before", "kind")
    earlier = in_row.rowsBetween(Window.unboundedPreceding, -1)
    until = in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = listed.withColumn("reach", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    reached = reached.withColumn("apart", F.when(F.col("start") >= F.col("reach"), F.col("reach")))
    begun = reached.withColumn("begin", F.last("apart", ignorenulls=True).over(until))
    listed = begun.select(
        "row",
        "start",
        "stop",
        "value",
        F.right("before", F.col("start") - F.col("begin")).alias("before"),
        "kind",
        (F.col("kind").isNull() & (F.col("start") < F.col("reach"))).alias("inner"),
    )
    words = F.filter(F.split(F.lower("before"), r"[^\p{L}:=#]+"), lambda word: word != "")
    last = listed.withColumn("words", words)
    patterns = F.expr(
        "array_compact(array(if(size(words) > 0, concat('1 ', element_at(words, -1)), null), "
        "if(size(words) > 1, concat('2 ', element_at(words, -2), ' ', element_at(words, -1)), null)))"
    )
    return last.select(
        "row", "start", "stop", "value", "kind", "inner", F.explode(patterns).alias("pattern")
    )


def fits() -> Column:
    """Whether ``value`` can be of ``kind``: an address needs no digits."""
    digits = "length(regexp_replace(value, '[^0-9]', ''))"
    most = " ".join(f"when '{kind}' then {n}" for kind, n in MOST_DIGITS.items())
    return F.expr(
        f"if(kind = 'email' and contains(value, '@'), true, {digits} >= {LEAST_DIGITS} and "
        f"(not value rlike r'[\x20\xA0]' or {digits} <= case kind {most} end))"
    )


def bootstrap(found: DataFrame, tables: Workspace) -> DataFrame:
    """(row, kind, start, stop) of identifiers that confident patterns discover."""
    seen = tables.written(occurrences(found))
    edges = tables.written(seen.select("pattern", "value", "kind", "inner").distinct())
    outer = edges.where("not inner")
    sizes = outer.groupBy("pattern").agg(F.count_distinct("value").alias("size"))
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    seeds = tables.written(seeds.withColumn("score", F.lit(1.0)))
    open_edges = edges.where("kind is null").select("pattern", "value").distinct()
    links = outer.select("pattern", "value").distinct()
    known, confident = seeds, None
    for _ in range(ROUNDS):
        scored = (
            links.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("hits"))
            .where(F.col("hits") >= LEAST_HITS)
            .join(sizes, "pattern")
            .withColumn("score", F.col("hits") / (F.col("size") + 1))
            .where(F.col("score") >= CONFIDENT)
        )
        confident = tables.written(scored.select("pattern", "kind", F.col("score").alias("trust")))
        unseen = (
            open_edges.join(confident, "pattern")
            .where(fits())
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        )
        known = tables.written(seeds.unionByName(unseen.join(seeds, ["value", "kind"], "left_anti")))
    found_there = (
        seen.where("kind is null")
        .drop("kind", "inner")
        .join(confident, "pattern")
        .join(known, ["value", "kind"])
        .where(F.col("score") >= CONFIDENT)
    )
    best = F.max(F.struct("score", "kind"))["kind"]
    return found_there.groupBy("row", "start", "stop").agg(F.concat(F.lit("ctx_"), best).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with ``spans``: array of (order, kind, start, stop).

    Spans are in code points, the stop exclusive, ordered by kind (as in ``BASE``, then the
    discovered ``ctx_`` kinds by name) and start.  A null text has none.  Null ids and repeated
    rows stay rows of their own.  An empty table gives no rows.  Columns of docs keep their
    names and values; only ``spans`` and ``row`` are taken for results.
    """
    tables = Workspace(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("row", "spans")]
    found = base_spans(docs.select(*kept)).withColumn("row", F.monotonically_increasing_id())
    found = tables.written(found)
    # Of several readings of a place, what lies in a longer one is left out.
    reading = bootstrap(found, tables)
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), "kind")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    reading = reading.withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0)))
    span = F.struct(F.lit(len(BASE)).alias("order"), "kind", "start", "stop")
    extra = (
        reading.where("stop > reach").groupBy("row").agg(F.collect_list(span).alias("extra"))
    )
    own = [
        F.expr(f"transform(_{kind}, s -> struct({k} as order, '{kind}' as kind, s.start, s.stop))")
        for k, kind in enumerate(BASE)
    ]
    none = F.array().cast("array<struct<order:int,kind:string,start:int,stop:int>>")
    spans = F.sort_array(F.concat(*own, F.coalesce("extra", none)))
    return found.join(extra, "row", "left").select(*kept, "row", spans.alias("spans"))


def span_text(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')")


def span_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs."""
    found = personal_data(docs.select("doc_id", "text"))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
        for kind in BASE
    ]
    base = span_text(f"filter(spans, s -> s.order < {len(BASE)})")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs with every span, overlapping ones together, replaced by its kind in brackets."""
    found = personal_data(docs)
    fields = "s -> struct(s.start as start, s.stop as stop, s.kind as kind)"
    found = found.withColumn("spans", F.expr(f"array_sort(transform(spans, {fields}))"))

    def furthest(spans: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(spans, lambda s: s["stop"])), F.lit(0))

    def step(part: Column, begin: Column):
        def add(so_far: Column, s: Column) -> Column:
            gap = F.substring(part, so_far["at"] - begin + 1, s["start"] - so_far["at"])
            name = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            inside = F.struct(
                F.greatest(so_far["at"], s["stop"]).alias("at"), so_far["out"].alias("out")
            )
            after = F.struct(
                s["stop"].alias("at"), F.concat(so_far["out"], gap, name).alias("out")
            )
            return F.when(s["start"] < so_far["at"], inside).otherwise(after)

        return add

    def block(spans: Column, first: Column) -> Column:
        own = F.slice(spans, first + 1, BLOCK)

        def written(ends: Column) -> Column:
            begin, end = ends["begin"], ends["end"]
            zero = F.struct(begin.alias("at"), F.lit("").alias("out"))
            return let(
                F.substring(F.col("text"), begin + 1, F.greatest(end - begin, F.lit(0))),
                lambda part: F.aggregate(own, zero, step(part, begin), lambda a: a["out"]),
            )

        reach = furthest(F.slice(spans, F.lit(1), first))
        return let(F.struct(reach.alias("begin"), furthest(own).alias("end")), written)

    spans = F.col("spans")
    masked = F.concat(
        F.array_join(F.transform(firsts(spans), lambda first: block(spans, first)), ""),
        F.substring(F.col("text"), furthest(spans) + 1, F.length("text")),
    )
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)

"""Personal data in whole texts: fixed patterns, then contextual extraction that bootstraps from them.

The base finds four kinds by their form. Every base span is a seed: the words around it are lexical
patterns (two words before, one before and one after, two after). Other tokens that could be identifiers,
and the patterns around those, form a graph of patterns and instances with the seeds. Rounds score it:
the confidence of a pattern for a kind is the share of its distinct instances that are of the kind, the
score of an unknown instance is the noisy-or of the confident patterns it stands in. Instances
that pass count in the next round, and the last round's patterns mark new identifiers in the texts.

Everything is Spark SQL. Patterns are written so that no search is longer than linear in the text and no
repetition recurses. A text is cut into segments once, so contexts cost the same in long texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.sizes import broadcast_if_small
from tallymart.functions.values import computed_once
from tallymart.llm import frames

# The kinds in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone"]

# The form of each kind. A search starts where a run of its characters starts or where
# the match before ended: elsewhere inside a run it cannot succeed if it failed at the run's start.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SMALL_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
CARD_DIGITS = (12, 19)
PHONE_DIGITS = (9, 15)

# A token that could be an identifier: a whole run of these characters with a digit or an at sign.
TOKEN = r"(?<![A-Za-z0-9._%+@:/-])[A-Za-z._%+:/-]*+[0-9@][A-Za-z0-9._%+@:/-]*+"
TOKEN_CHARS = (6, 64)
WORD = r"[^\x20\x09-\x0D]+"

SEGMENT = 4096
REACH = 48

# A pattern needs this many distinct instances of its kind, and this share of all its instances.
SUPPORT = 3
CONFIDENCE = 0.7
# An instance needs this score.
ACCEPTED = 0.8
ROUNDS = 3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(number)

    def weighed(i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match of the kind's form must satisfy besides."""
    if kind == "ip":
        return value.rlike(SMALL_PARTS)
    if kind == "card":
        return F.length(digits(value)).between(*CARD_DIGITS) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(*PHONE_DIGITS)
    return F.lit(True)


def blocks(items: Column) -> Column:
    """An array cut into about as many pieces as each holds items; an empty one has none."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda b: F.slice(items, b * size + 1, size))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + n)


def running(df: DataFrame, names: list[str], keep: list[Column]) -> DataFrame:
    """For columns of arrays of long: the sums of all items before each, by blocks and then inside a block.

    Every step is a column of its own, so none is evaluated again for each item.
    """
    cut = computed_once(df, {n: blocks(F.col(n)) for n in names}, keep)
    sums = {f"{n}_sums": F.transform(n, _total) for n in names}
    cut = computed_once(cut, sums, [*keep, *map(F.col, names)])
    offsets = {f"{n}_off": _offsets(f"{n}_sums") for n in names}
    cut = computed_once(cut, offsets, [*keep, *map(F.col, names)])

    def inside(n: str) -> Column:
        off = F.col(f"{n}_off")
        return F.flatten(F.transform(n, lambda block, b: F.transform(block, lambda _, i: F.get(off, b) + _before(block, i))))

    return computed_once(cut, {n: inside(n) for n in names}, keep)


def _before(values: Column, i: Column) -> Column:
    return _total(F.slice(values, F.lit(1), i))


def _offsets(name: str) -> Column:
    return F.transform(name, lambda _, b: _before(F.col(name), b))


def _found(df: DataFrame, text: str, forms: dict[str, str]) -> DataFrame:
    """``df`` and for each form a column of spans (start, end, value) of its matches that are valid.

    Splitting a text at its matches gives the gaps between them, so their lengths in turn give the places.
    """
    keep = [F.col(c) for c in df.columns]
    hits = {f"{n}_hits": F.regexp_extract_all(F.col(text), F.lit(form), F.lit(0)) for n, form in forms.items()}
    found = computed_once(df, hits, keep)
    hit_columns = [F.col(c) for c in hits]
    gaps = {
        f"{n}_gaps": F.when(F.size(f"{n}_hits") > 0, F.split(F.col(text), form, -1)).otherwise(F.array().cast("array<string>"))
        for n, form in forms.items()
    }
    found = computed_once(found, gaps, [*keep, *hit_columns])
    # A match starts behind all gaps and matches before it and its own gap; the last gap has no match.
    steps = {f"{n}_at": F.zip_with(f"{n}_gaps", f"{n}_hits", lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long")) for n in forms}
    firsts = {f"{n}_first": F.transform(f"{n}_gaps", F.length) for n in forms}
    found = computed_once(found, steps | firsts, [*keep, *hit_columns])
    first_columns = [F.col(c) for c in firsts]
    found = running(found, list(steps), [*keep, *hit_columns, *first_columns])

    def spans(n: str) -> Column:
        def span(value: Column, i: Column) -> Column:
            start = F.get(F.col(f"{n}_at"), i) + F.get(F.col(f"{n}_first"), i)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.filter(F.transform(f"{n}_hits", span), lambda s: valid(n, s["value"]))

    return computed_once(found, {n: spans(n) for n in forms}, keep)


def listed(spans: Column) -> Column:
    """Spans (start, kind number, end) as text: kind:start:end by start, then kind, then end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def _mentions() -> Column:
    """Base spans and other tokens that could be identifiers, as (start, end, value, kind)."""

    def plain(spans: Column, kind: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["value"], kind.alias("kind")))

    def meets(t: Column, k: str) -> Column:
        def overlap(first: Column, last: Column) -> Column:
            return (first["start"] < t["end"]) & (last["end"] > t["start"])

        # Spans of a kind lie in order, so few blocks need a look inside.
        return F.exists(
            f"{k}_blocks", lambda b: overlap(F.get(b, F.lit(0)), F.element_at(b, -1)) & F.exists(b, lambda s: overlap(s, s))
        )

    def unknown(t: Column) -> Column:
        return F.length(t["value"]).between(*TOKEN_CHARS) & ~reduce(lambda a, b: a | b, [meets(t, k) for k in KINDS])

    base = [plain(F.col(k), F.lit(i)) for i, k in enumerate(KINDS)]
    return F.concat(*base, plain(F.filter("token", unknown), F.lit(None).cast("int")))


def _around(mention: Column) -> Column:
    """A mention and the words within ``REACH`` characters on both sides, with all digits made equal."""

    def words(first: Column) -> Column:
        at = F.floor(first / SEGMENT).cast("int")
        two = F.concat(F.coalesce(F.get("segments", at), F.lit("")), F.coalesce(F.get("segments", at + 1), F.lit("")))
        part = F.substring(two, (first - at * SEGMENT + 1).cast("int"), F.lit(REACH))
        return F.regexp_extract_all(F.regexp_replace(F.lower(part), "[0-9]", "0"), F.lit(WORD), F.lit(0))

    # Segments begin with REACH blanks: a window before the first character needs no case of its own.
    return F.struct(
        mention.alias("m"), words(mention["start"]).alias("left"), words(mention["end"] + REACH).alias("right")
    )


def _patterns(around: Column) -> Column:
    """The lexical patterns of a mention: its two words before, one on each side, two after."""
    left, right = around["left"], around["right"]
    near, far = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    after, then = F.get(right, F.lit(0)), F.get(right, F.lit(1))
    return F.filter(
        F.array(
            F.concat(far, F.lit(" "), near, F.lit(" _")),
            F.concat(near, F.lit(" _ "), after),
            F.concat(F.lit("_ "), after, F.lit(" "), then),
        ),
        lambda p: p.isNotNull(),
    )


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (row, doc_id, n_email, n_ip, n_card, n_phone, base, mentions).

    ``base`` has the base spans (start, kind, end), ``mentions`` what the graph is made of. A null text
    is empty; other columns are left out.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        frames.col(docs, id_col).alias("doc_id"),
        F.coalesce(frames.col(docs, text_col).cast("string"), F.lit("")).alias("text"),
    )
    spans = _found(rows, "text", FORMS | {"token": TOKEN})
    keep = [F.col(c) for c in ("row", "doc_id", *KINDS)]
    found = computed_once(spans, {f"{k}_blocks": blocks(F.col(k)) for k in KINDS}, [*keep, F.col("text"), F.col("token")])
    found = computed_once(found, {"mentions": _mentions()}, [*keep, F.col("text")])
    segments = F.when(
        F.size("mentions") > 0,
        F.regexp_extract_all(F.concat(F.lit(" " * REACH), "text"), F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)),
    ).otherwise(F.array().cast("array<string>"))
    found = computed_once(found, {"segments": segments}, [*keep, F.col("mentions")])
    found = computed_once(found, {"around": F.transform("mentions", _around)}, keep)
    with_patterns = F.transform(
        "around",
        lambda a: F.struct(a["m"]["start"], a["m"]["end"], a["m"]["value"], a["m"]["kind"], _patterns(a).alias("patterns")),
    )

    def placed(k: str, kind: Column) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end")))

    base = F.concat(*[placed(k, F.lit(i)) for i, k in enumerate(KINDS)])
    return found.select(
        "row", "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        base.alias("base"), with_patterns.alias("mentions"),
    )


def graph(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Edges (pattern, value, kind) once each; patterns with fewer instances than any could need are left out."""
    mention = found.select(F.explode("mentions").alias("m"))
    edges = (
        mention.select(F.explode("m.patterns").alias("pattern"), F.col("m.value").alias("value"), F.col("m.kind").alias("kind"))
        .distinct()
    )
    counted = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    return edges.join(counted.where(F.col("n") >= support).select("pattern"), "pattern", "left_semi")


def bootstrap(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accepted: float = ACCEPTED, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Score the graph in rounds: ((pattern, kind, confidence), (value, kind)) of the patterns and instances that pass.

    A round is two grouped sums and two joins with the few that passed. It ends early when no instance
    passes that did not before. Rounds never take an instance back.
    """
    edges = frames.store(edges, "edges")
    total = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    total = frames.store(total, "patterns")
    known = edges.where("false").select("value", "kind", F.lit(0.0).alias("score"))
    held = 0
    for _ in range(rounds):
        gained = edges.where("kind is null").drop("kind").join(broadcast_if_small(known), "value")
        scored = edges.where("kind is not null").select("pattern", "kind", F.lit(1.0).alias("score")).unionByName(
            gained.select("pattern", "kind", "score")
        )
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("m"))
        passed = (
            sums.where(F.col("m") >= support)
            .join(total, "pattern")
            .withColumn("confidence", F.least(F.lit(0.999), F.col("score") / F.col("n")))
            .where(F.col("confidence") >= confidence)
            .select("pattern", "kind", "confidence")
        )
        passed = frames.store(passed, "confident")
        doubt = F.exp(F.sum(F.log1p(-F.col("confidence"))))
        reached = (
            edges.where("kind is null").drop("kind").join(broadcast_if_small(passed), "pattern")
            .groupBy("value", "kind").agg((F.lit(1.0) - doubt).alias("score"))
            .where(F.col("score") >= accepted)
        )
        # An instance is of one kind: the likeliest, the first of equals.
        best = reached.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        new = best.select("value", (-F.col("b.k")).cast("int").alias("kind"), F.col("b.score").alias("score"))
        known = frames.store(
            known.unionByName(new).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score"),
            "instances",
        )
        now = known.count()
        if now == held:
            break
        held = now
    return passed, known


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row a document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    Counts and ``base_sha256`` are of the base spans; ``spans`` lists those and, with the kind of their
    patterns, the identifiers that bootstrapping adds. Places are code points, ends exclusive. A null
    or empty text holds nothing, long texts are searched whole, repeated rows each give their own
    result, spans of different kinds may overlap, and other columns are left out.
    """
    found = frames.store(extract(docs, id_col, text_col), "personal")
    patterns, instances = bootstrap(graph(found), rounds=rounds)
    mention = found.select("row", F.explode("mentions").alias("m")).where("m.kind is null")
    mention = mention.select("row", "m.start", "m.end", "m.value", F.explode("m.patterns").alias("pattern"))
    added = (
        mention.join(broadcast_if_small(patterns.select("pattern", "kind")), "pattern")
        .join(broadcast_if_small(instances.select("value", "kind")), ["value", "kind"])
        .select("row", F.struct(F.col("start"), F.col("kind"), F.col("end")).alias("s"))
        .groupBy("row").agg(F.collect_set("s").alias("added"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    whole = found.drop("mentions").join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return whole.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )

"""Personal data: base patterns, and more found by bootstrapped contexts.

Matches of the base patterns are the seeds. The words around a mention are its patterns;
patterns and the strings they surround form a graph. A pattern is trusted as far as the
strings it surrounds are known, an unknown string as far as its patterns are trusted, in
turns. Strings of the right make in trusted patterns are added, wherever they stand.

All of it is column expressions, groupings and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.session import stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and starts at the edge of a run match
# the same strings as plain ones, and keep long runs from being tried from each of their places.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Digit groups in a row, of no more digits than an identifier has.
_RUN = r"(?<![\p{L}\p{N}@.+_-])(?:\(\+?[0-9]{1,6}\)[\x20-]?|\+)?[0-9](?:(?:\x20-\x20|\x20?\(|\)[\x20-]?|[\x20.-])?[0-9]){5,18}(?![\p{L}\p{N}@])"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _found(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches: places follow from the lengths of what lies between."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(values.alias("v"), F.slice(gaps, 1, F.size(values)).alias("g"))
    empty = F.array().cast(_SPAN)

    def step(acc: Column, one: Column) -> Column:
        start = acc["at"] + one["g"]
        end = start + F.length(one["v"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), one["v"].alias("value"))).alias("spans"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))

    def worth(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(turned, worth), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans (start, end, value) of the base patterns; code points, end exclusive."""
    worth_it = text.rlike("[0-9@]")
    return {kind: F.when(worth_it, _kept(text, kind, pattern)).otherwise(F.array().cast(_SPAN)) for kind, pattern in PATTERNS.items()}


def _kept(text: Column, kind: str, pattern: str) -> Column:
    return F.filter(_found(text, pattern), lambda s: _holds(kind, s["value"]))


def _context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The two words before a span and the one after it, lower-cased; quotes and brackets next to it are left out."""
    before = F.substring(text, F.greatest(start - 80, F.lit(0)) + 1, F.least(start, F.lit(80)))
    before = F.lower(F.regexp_replace(before, r"[\s\"'(<\[{]+$", ""))
    after = F.lower(F.substring(text, end + 1, F.lit(80)))
    return F.regexp_extract(before, r"(?:(\S+)\s+)?\S+$", 0), F.regexp_extract(after, r"^[\s\"')>\]}.,;]*(\S+)", 1)


def _meets(spans: Column, one: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < one["end"]) & (one["start"] < b["end"]))


def spaced_runs(text: Column, spans: dict[str, Column]) -> Column:
    """Runs of digit groups with spaces in them, apart from the base spans."""
    taken = F.concat(*spans.values())
    runs = F.filter(_found(text, _RUN), lambda s: s["value"].contains(" ") & ~_meets(taken, s))
    return F.when(text.rlike("[0-9]\\)? ?[(-]? ?[0-9]"), runs).otherwise(F.array().cast(_SPAN))


def mentions(text: Column, spans: dict[str, Column], runs: Column) -> Column:
    """Seeds with their kind; runs and other tokens with a digit or an at sign without one, each with its context.

    A token that meets a run is marked as `part` of it.
    """

    def with_context(kind: Column, start: Column, end: Column, value: Column, part: Column) -> Column:
        left, right = _context(text, start, end)
        return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), F.lower(value).alias("value"), left.alias("left"), right.alias("right"), part.alias("part"))

    def of_kind(kind: str) -> Column:
        return F.transform(spans[kind], lambda s: with_context(F.lit(kind), s["start"], s["end"], s["value"], F.lit(False)))

    taken, no_kind = F.concat(*spans.values()), F.lit(None).cast("string")

    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}+@]*", 0))
        core = F.regexp_replace(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}+@]+", ""), r"[^\p{L}\p{N}]+$", "")
        start = s["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"))

    tokens = F.filter(
        F.transform(_found(text, _TOKEN), trimmed),
        lambda s: (F.length(s["value"]) >= 4) & ~_meets(taken, s),
    )
    others = F.transform(tokens, lambda s: with_context(no_kind, s["start"], s["end"], s["value"], _meets(runs, s)))
    spaced = F.transform(runs, lambda s: with_context(no_kind, s["start"], s["end"], s["value"], F.lit(False)))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string,part:boolean>>")
    return F.when(text.rlike("[0-9@]"), F.concat(*[of_kind(k) for k in KINDS], others, spaced)).otherwise(none)


def _of_the_make(kind: Column, value: Column) -> Column:
    """Whether a string could be an identifier of a kind at all."""
    n = F.length(_digits(value))
    letters = value.rlike(r"\p{L}")
    return (
        F.when(kind == "email", value.rlike(r"[^@]@[^@]|\p{L}"))
        .when(kind == "ip", value.rlike(r"^[0-9a-f]+([.:][0-9a-f]*){2,}$"))
        .when(kind == "card", (n >= 8) & ~letters)
        .otherwise((n >= 6) & (n <= 15) & ~letters)
    )


def _key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), text)


def bootstrap(seen: DataFrame, rounds: int, least_known: int, trust: float) -> DataFrame:
    """(value, kind, score): strings that trusted patterns add to the seeds.

    `seen` has (kind, value, left, right, part) of mentions; parts of a run do not count in a pattern's trust. A pattern is a pair of words before,
    one word before, or the words on both sides. It needs `least_known` known strings of a kind,
    and the share of their score in all distinct strings of the kind's make and a half must be
    over one half. As in RlogF the share weighs more the more is known: with a score of s, trust
    is 1 - (1 - share) ^ log2(s). A string takes the trust of its best pattern, once that
    reaches `trust`.
    """
    last = F.regexp_extract("left", r"\S+$", 0)
    patterns = F.array(
        F.when(F.col("left").rlike(r"\s"), F.concat(F.lit("before2 "), F.col("left"))), F.when(last != "", F.concat(F.lit("before "), last)),
        F.when((last != "") & (F.col("right") != ""), F.concat(F.lit("around "), last, F.lit(" _ "), F.col("right"))),
    )
    edges = stored(
        seen.select("value", "part", "kind", F.explode(F.array_compact(patterns)).alias("pattern")).groupBy("value", "pattern")
        .agg(F.min("part").alias("part"), *[F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in KINDS])
        .select("value", "pattern", "part", *[(F.col(k) | _of_the_make(F.lit(k), F.col("value"))).alias(k) for k in KINDS]), "pattern_graph",
    )
    counted = edges.where("NOT part")
    known = stored(seen.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "known_0")
    width = counted.groupBy("pattern").agg(*[F.count_if(F.col(k)).alias(k) for k in KINDS]).where(F.greatest(*KINDS) >= least_known)
    n = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in KINDS])
    share = F.col("mass") / (n + 0.5)
    # Below 1, which is the score of seeds.
    score = F.least(1 - F.pow(1 - share, F.log2("mass")), F.lit(1 - 1e-9))
    for turn in range(rounds):
        mass = counted.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("hits")).where(F.col("hits") >= least_known)
        trusted = mass.join(width, "pattern").where(share > 0.5).withColumn("trust", score).where(F.col("trust") >= trust).select("pattern", "kind", "trust")
        reached = edges.join(trusted, "pattern").groupBy("value", "kind").agg(F.max("trust").alias("score"))
        fresh = reached.join(known.select("value").distinct(), "value", "left_anti").where(_of_the_make(F.col("kind"), F.col("value")))
        # A string belongs to the kind that trusts it most.
        best = fresh.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        known = stored(known.unionByName(best), f"known_{turn + 1}")
    return known.where(F.col("score") < 1.0)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_known: int = 4, trust: float = 0.8,
) -> DataFrame:
    """Spans of personal data of each row, as (doc_id, key, email, ip, card, phone, added).

    The first four hold the spans of the base patterns; `added` those that contexts found, as
    (kind, start, end), none of which overlaps a base span: single tokens, and runs of digit
    groups with spaces, dots, brackets or hyphens between, which go before their parts. Null texts are empty; repeated rows
    have equal results; rows of an empty table have none. Texts are read once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", _key("doc_id", F.col("text")))
    spans = base_spans(F.col("text"))
    rows = rows.select("doc_id", "key", "text", *[c.alias(k) for k, c in spans.items()])
    own = {k: F.col(k) for k in KINDS}
    rows = rows.withColumn("runs", spaced_runs(F.col("text"), own))
    found = stored(rows.select("doc_id", "key", *KINDS, mentions(F.col("text"), own, F.col("runs")).alias("mentions")), "personal_data")
    seen = found.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    added = bootstrap(seen, rounds, least_known, trust)
    more = (
        seen.where("kind IS NULL").select("key", "start", "end", "value", "part").join(added.select("value", "kind"), "value")
        .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end", "part"))).alias("all"))
        .withColumn("whole", F.filter("all", lambda s: ~s["part"]))
        .select("key", F.filter("all", lambda s: ~s["part"] | ~_meets(F.col("whole"), s)).alias("added"))
        .withColumn("added", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.drop("mentions").join(more, "key", "left").withColumn("added", F.coalesce("added", none))


def all_spans() -> Column:
    """All spans of a row of `find` as (kind, start, end), by kind as listed and start."""
    parts = []
    for number, kind in enumerate(KINDS):
        parts.append(_tagged(kind, number))
    return F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def _tagged(kind: str, number: int) -> Column:
    entry = lambda s: F.struct(F.lit(number).alias("number"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.concat(F.transform(kind, entry), F.transform(F.filter("added", lambda s: s["kind"] == kind), entry))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced together, under the kind of the first. Null texts stay.
    """
    found = find(docs, id_col, text_col, **settings).select("key", all_spans().alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key"])
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), _key(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"])))
    joined = packed.join(found, "key", "left").withColumn("text", text)
    done = joined.select("row", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("row")[text_col]).alias("clean"))
    return done.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts and hash of base spans, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.concat(*[F.transform(k, _entry(k)) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(all_spans()).alias("spans"),
    )


def _entry(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

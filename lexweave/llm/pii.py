"""Personal data by base patterns, extended through bootstrapped lexical contexts. DataFrame functions only.

Base matches (e-mail, IP address, payment card, phone number) seed a graph. Every candidate, base match or
loosely shaped look-alike, is an instance ``(kind, value)``; the words around it make its patterns:
``kind, two words before`` and ``kind, word before, word after``. Rounds of joins and sums score the graph:
a pattern by the summed score of its distinct instances over their number plus one, an instance that
is no seed by its best pattern of enough support. Look-alikes whose score and pattern reach
``CONFIDENCE`` become spans beside the base ones; a look-alike that overlaps a base span never does.

Offsets are code points, the end exclusive. Null and empty texts have no spans. Rows that share id
and text share their result, each row keeps a row of its own. Other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENCE, SUPPORT, CONTEXT_CHARS = 3, 0.8, 4, 64

# Possessive forms of the contract's patterns; a match may begin only where a leftmost one can.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]*[^\s@.,;:!?]",
    "ip": BASE["ip"],
    "card": BASE["card"],
    "phone": r"(?<![0-9().+-])[(0-9][\x20().0-9-]{5,30}[0-9](?![0-9])",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": None}
HAS_CANDIDATES = "[0-9@]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a base match passes its check."""
    n = F.length(_digits(value))

    def octet(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), octet))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(value)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a loose match may be an identifier at all."""
    n = F.length(_digits(value))
    return F.when(kind == "card", n.between(13, 19)).when(kind == "phone", n.between(7, 15)).when(kind == "email", F.length(value) >= 6).otherwise(True)


def candidates(docs: DataFrame) -> DataFrame:
    """Matches of all patterns, one row per text and place: ``_id, _text`` name the text."""
    text = F.col("text")
    rows = docs.where(text.rlike(HAS_CANDIDATES)).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")

    def found(kind: str, loose: bool) -> Column:
        pattern = (LOOSE if loose else BASE)[kind]
        here = F.lit(True) if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
        here = here & (F.contains(text, F.lit("+")) if kind == "phone" and not loose else F.lit(True))
        matches = F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        gaps = F.when(here, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), matches.alias("values"), gaps.alias("gaps"))

    # Failed base matches are the look-alikes of cards and addresses: their loose pattern is the same.
    sets = F.array(*[found(k, False) for k in KINDS], *[found(k, True) for k in ("email", "phone")])
    each = rows.select("_id", "_text", F.explode(sets).alias("s")).where(F.size("s.values") > 0).select("_id", "_text", "s.*")
    placed = each.select("_id", "_text", "kind", "loose", "gaps", F.posexplode("values").alias("pos", "value")).select(
        "_id",
        "_text",
        "kind",
        "loose",
        "pos",
        "value",
        F.length(F.get("gaps", F.col("pos"))).alias("_gap"),
        F.expr(f"right(get(gaps, pos), {CONTEXT_CHARS})").alias("before"),
        F.expr(f"left(get(gaps, pos + 1), {CONTEXT_CHARS})").alias("after"),
    )
    # Rows with one id and text give the same matches.
    once = placed.dropDuplicates(["_id", "_text", "kind", "loose", "pos"])
    own = Window.partitionBy("_id", "_text", "kind", "loose").orderBy("pos")
    end = F.sum(F.col("_gap") + F.length("value")).over(own).cast("long")
    spans = once.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    base = ~F.col("loose") & _valid(F.col("kind"), F.col("value"))
    other = ~base & F.when(F.col("kind").isin("ip", "card"), ~F.col("loose")).otherwise(F.col("loose"))
    marked = spans.withColumn("base", base).where(base | (other & _plausible(F.col("kind"), F.col("value"))))
    return marked.select("_id", "_text", "kind", "start", "end", "value", "before", "after", "base")


def _apart(found: DataFrame) -> DataFrame:
    """Without look-alikes that overlap a base span of their text."""
    key = F.when(F.col("base"), F.col("start")).otherwise(F.col("end") - 1)
    before = Window.partitionBy("_id", "_text").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The furthest end of base spans that begin before this one ends.
    reach = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before), F.lit(0))
    marked = found.withColumn("_key", key).withColumn("_reach", reach)
    return marked.where(F.col("base") | (F.col("_reach") <= F.col("start"))).drop("_key", "_reach")


def _patterns() -> Column:
    """The lexical patterns of a candidate."""

    def words(side: str) -> Column:
        return F.regexp_extract_all(F.regexp_replace(F.lower(side), "[0-9]+", "0"), F.lit(r"\S+"), F.lit(0))

    left, right = words("before"), words("after")
    nearest = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))
    second = F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit(""))
    following = F.coalesce(F.get(right, F.lit(0)), F.lit(""))
    both = [F.concat_ws(" ", F.col("kind"), second, nearest, F.lit("_")), F.concat_ws(" ", F.col("kind"), nearest, F.lit("_"), following)]
    return F.array(*both)


def confident_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern`` and ``score`` of the patterns that reach ``CONFIDENCE`` after the last round."""
    placed = found.select(F.explode("patterns").alias("pattern"), "kind", "value", "base")
    edges = placed.groupBy("pattern", "kind", "value").agg(F.max(F.col("base").cast("double")).alias("seed"))
    edges = cut_lineage(edges.withColumn("score", F.col("seed")))
    patterns = None
    for _ in range(rounds):
        sums = edges.groupBy("pattern").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
        patterns = cut_lineage(sums.where(F.col("s") >= SUPPORT).select("pattern", (F.col("s") / (F.col("n") + 1)).alias("strength")))
        unseen = edges.where("seed = 0").join(patterns, "pattern")
        best = unseen.groupBy("kind", "value").agg(F.max("strength").alias("best"))
        scored = edges.drop("score").join(best, ["kind", "value"], "left")
        score = F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
        edges = cut_lineage(scored.withColumn("score", score).drop("best"))
    return patterns.where(F.col("strength") >= CONFIDENCE).select("pattern", F.col("strength").alias("score"))


def text_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``_id, _text`` and the sorted ``spans`` of every text that has any."""
    found = cut_lineage(_apart(candidates(docs)).withColumn("patterns", _patterns()).drop("before", "after"))
    strong = confident_patterns(found, rounds).select("pattern")
    place = ["_id", "_text", "kind", "start", "end"]
    unseen = found.where(~F.col("base")).select(*place, F.explode("patterns").alias("pattern"))
    added = unseen.join(strong, "pattern", "left_semi").select(*place).distinct()
    every = found.where("base").select(*place, "base").unionByName(added.withColumn("base", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(number.alias("number"), "start", "end", "kind", "base")
    return every.groupBy("_id", "_text").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def detect(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id`` and its ``spans`` (number, start, end, kind, base), empty where a text has none."""
    spans = text_spans(docs, rounds)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, same, "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Base counts, the hash of the base spans and all spans as text."""

    def listed(spans: Column) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    touched = F.coalesce(F.col("text").rlike(HAS_CANDIDATES), F.lit(False))
    hashed = docs.where(touched).select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    spans = text_spans(docs.select("doc_id", "text"), rounds)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def cover(done: Column, span: Column) -> Column:
        kept = F.substring("text", (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        grown = F.concat(done["parts"], F.array(kept, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))))
        fresh = span["start"] >= done["at"]
        return F.struct(F.when(fresh, grown).otherwise(done["parts"]).alias("parts"), F.greatest(done["at"], span["end"]).alias("at"))

    def finish(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring("text", (done["at"] + 1).cast("int"), F.length("text")))

    changed = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate(ordered, empty, cover, finish))
    joined = hashed.join(spans, same, "left")
    columns = [changed.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns).unionByName(docs.where(~touched))

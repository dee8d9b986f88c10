"""Personal data in text, by DataFrame functions alone.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for account numbers, octets for addresses),
and words just before a span move its score. No Python runs on the executors.

Every pattern starts where its kind can start and its loops either cannot give back or have a bound, so a match costs
time in proportion to the text and no stack on texts of any length (Java runs loops that cannot give back without any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in the order in which they are listed at the same start; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

#: What proposes a span. Lookbehinds put the start where the plain pattern's leftmost match starts; \G is the end of the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}

#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

#: Score of a confirmed span, and what a context word within CONTEXT characters before it adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT, BONUS = 40, 0.3
WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|address|host|server)\b",
    "card": r"(?i)\b(card|visa|credit|payment)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
}
#: Kinds beyond the base count from this score on.
LEAST = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right doubled, digits summed."""
    marks = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    twice = F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod 97 check: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)) == 1


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def confirmed(kind: Column, found: Column) -> Column:
    """Whether a proposed span holds what its kind asks for."""
    n = F.length(_digits(found))
    return (
        F.when(kind == "ip", found.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$"))
        .when(kind == "card", luhn(_digits(found)))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", mod97(found))
        .otherwise(True)
    )


def _proposed(kind: str) -> Column:
    """For one kind, its matches in order: (kind, gap, found, before); gap: code points since the match before.

    ``split`` by the pattern gives the text between the matches, and its lengths their places.
    """
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    rows = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"))),
        lambda m, g: F.struct(F.lit(kind).alias("kind"), g["gap"].alias("gap"), m.alias("found"), g["before"].alias("before")),
    )
    rows = F.filter(rows, lambda r: r["found"].isNotNull())
    none = F.array().cast("array<struct<kind:string,gap:int,found:string,before:string>>")
    return F.when(text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]"), rows).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (kind, start, end, score) by start, then kind; code points, end exclusive.

    Spans of one kind never overlap. Null or empty text has no spans. Rows that repeat, or have a null doc_id, are rows
    of their own. An empty table gives an empty table.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    # The last element stands for the document itself, so one shuffle of short rows carries documents and spans.
    itself = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("before")))
    kinds = own.select("doc_id", "row", F.array(*(_proposed(k) for k in KINDS), itself).alias("all"))
    rows = kinds.select("doc_id", "row", F.explode("all").alias("one")).select("doc_id", "row", F.posexplode("one").alias("at", "m")).select("doc_id", "row", "at", "m.*")
    rows = rows.withColumn("step", F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).repartition("row")
    end = F.sum("step").over(Window.partitionBy("row", "kind").orderBy("at"))
    near = F.lit(False)
    for k in KINDS:
        near = F.when(F.col("kind") == k, F.col("before").rlike(WORDS[k])).otherwise(near)
    base = F.lit(0.0)
    for k in KINDS:
        base = F.when(F.col("kind") == k, F.lit(SCORES[k])).otherwise(base)
    score = F.least(F.lit(1.0), base + F.when(near, BONUS).otherwise(0.0))
    spans = (
        rows.withColumn("end", end)
        .withColumn("score", F.round(score, 2))
        .withColumn("ok", F.col("kind").isNotNull() & confirmed(F.col("kind"), F.col("found")) & (F.col("kind").isin(*KINDS[:4]) | (F.col("score") >= LEAST)))
    )
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    span = F.struct((F.col("end") - F.length("found")).alias("start"), rank.alias("rank"), F.col("end"), F.col("kind"), F.col("score"))
    found = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("spans"))
    return found.select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))


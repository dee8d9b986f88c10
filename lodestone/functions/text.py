"""Text: normal forms, numbers, dates, tokens, snippets. Python only where Unicode normal forms are needed."""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lodestone.functions import vocabulary

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@pandas_udf(T.StringType())
def canonical_json_sha256(s: pd.Series) -> pd.Series:
    """sha256 of JSON with sorted keys and no spaces; null for what is not JSON."""

    def one(x: str) -> str | None:
        try:
            return sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


@pandas_udf(T.StringType())
def pretty_json(s: pd.Series) -> pd.Series:
    """JSON with line breaks and indents of two; null for what is not JSON."""

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


@pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def token_offsets(s: pd.Series) -> pd.Series:
    """Tokens with their places in code points, end exclusive."""
    import regex

    pattern = regex.compile(TOKEN)
    return s.map(lambda x: [(m.group(), m.start(), m.end()) for m in pattern.finditer(x)], na_action="ignore")


@pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes as text: utf-8, else euc-kr, else utf-8 with replacement characters."""

    def one(x: bytes) -> str:
        for code in ("utf-8", "euc-kr"):
            try:
                return bytes(x).decode(code)
            except UnicodeDecodeError:
                pass
        return bytes(x).decode("utf-8", "replace")

    return raw.map(one, na_action="ignore")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def normal_alias(name: Column) -> Column:
    """A name for matching: NFC, lower case, without white space, dots, dashes, underscores, brackets and quotes."""
    return F.regexp_replace(F.lower(F.trim(nfc(name))), vocabulary.ALIAS_MARKS, "")


def normal_report_name(name: Column) -> Column:
    """A report's name without its bracketed prefix and (YYYY.MM), white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(nfc(name), vocabulary.REPORT_PREFIX, ""), vocabulary.REPORT_MONTH, ""), r"(?U)\s+", " "))


def normal_report_family(name: Column) -> Column:
    """A report's family: NFKC, no prefix, no white space, punctuation or symbols, no closing 체결."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(nfkc(name), vocabulary.REPORT_PREFIX, ""), vocabulary.FAMILY_MARKS, ""), vocabulary.FAMILY_END, "")


def normal_text(text: Column) -> Column:
    """Without regard to width, case, white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfkc(text)), vocabulary.FAMILY_MARKS, "")


def normal_label(label: Column) -> Column:
    """A table label without its number and separators, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfc(F.coalesce(label, F.lit(""))), vocabulary.LABEL_NUMBER, ""), vocabulary.LABEL_MARKS, ""))


def canonical_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), r"(?U)\s+", " "))


def parse_number(text: Column) -> Column:
    """DECIMAL(38,6) of a plain number with commas or spaces, else null."""
    plain = F.regexp_replace(text, r"(?U)[,\s]", "")
    return F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("decimal(38,6)"))


def parse_date(text: Column) -> Column:
    """DATE of a whole text like 2024.01.31, 2024-1-31, 2024/1/31 or 2024년 1월 31일, else null; also for days that do not exist."""
    return _date(F.trim(text), r"^(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})\s*일?$")


def find_date(text: Column) -> Column:
    """DATE of the first 20YY date in a text, else null."""
    return _date(text, r"(20\d{2})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})")


def _date(text: Column, pattern: str) -> Column:
    part = lambda k, n: F.lpad(F.regexp_extract(text, pattern, k), n, "0")
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))


def receipt_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def known_at(day: Column, zone: str = "+09:00") -> Column:
    """The moment at which a document of that day is known: midnight in its zone."""
    return F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T00:00:00{zone}")))


def snippet(text: Column, needle: Column, around: int = 160) -> Column:
    """The needle in the text with up to ``around`` code points on each side; null if it is not there."""
    at = F.position(needle, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when((at > 0) & (F.length(needle) > 0), F.substring(text, start, at - start + F.length(needle) + around))


def redact(text: Column, most: int = 500) -> Column:
    """An error text without bearer tokens and keys, cut to ``most`` characters."""
    safe = F.regexp_replace(text, vocabulary.BEARER, "Bearer [REDACTED]")
    return F.left(F.regexp_replace(safe, vocabulary.SECRET, "$1=[REDACTED]"), F.lit(most))


def source_locator(path: Column, node: Column, row_start: Column | None = None, row_end: Column | None = None, col_start: Column | None = None, col_end: Column | None = None) -> Column:
    """path#node=N;row=a-b;col=c-d, with the parts that are there."""
    part = lambda name, a, z: F.when(a.isNotNull(), F.concat(F.lit(f"{name}="), a.cast("string"), F.lit("-"), F.coalesce(z, a).cast("string")))
    parts = [F.concat(F.lit("node="), node.cast("string"))]
    if row_start is not None:
        parts.append(part("row", row_start, row_end))
    if col_start is not None:
        parts.append(part("col", col_start, col_end))
    return F.concat(path, F.lit("#"), F.concat_ws(";", *parts))


def linear_row(cells: Column) -> Column:
    """A table row as one text; null if all its cells are blank."""
    trimmed = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.exists(trimmed, lambda c: c != ""), F.array_join(trimmed, " | "))


def auxiliary_row(text: Column) -> Column:
    """Whether a table row only names a unit, a date or a place to go to."""
    t = canonical_text(text)
    return t.rlike(vocabulary.AUXILIARY_PLACE) | (t.rlike(vocabulary.AUXILIARY_UNIT) & ~t.rlike(vocabulary.FIGURE))


def common_prefix(paths: Column) -> Column:
    """The longest path that all paths of an array of arrays begin with."""
    shorter = lambda a, b: F.slice(a, 1, F.coalesce(F.array_min(F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(F.get(b, i)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())), F.size(a)))
    return F.aggregate(paths, F.try_element_at(paths, F.lit(1)), shorter)


def json_safe(x: Column) -> Column:
    """A number as JSON may hold it: null instead of not a number and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

"""Scalar column functions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Runs of lower-case letters and digits (super- and subscript ones too) with single
# underscores between them. Possessive, so a name is read once without backtracking.
_RUN = r"[a-z0-9\p{IsLowercase}\p{Nd}²³¹⁰⁴-⁹₀-₉]++"
SNAKE_CASE = rf"\A{_RUN}(?:_{_RUN})*+\z"

# Personas per group priority.
PRIORITY_QUOTA = {"high": 3, "medium": 2, "low": 1}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_snake_case(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(SNAKE_CASE), F.lit(False))


def starts_uppercase(c: Column | str) -> Column:
    first = F.substring(_col(c), 1, 1)
    return F.coalesce(F.lower(first) != first, F.lit(False))


def sanitize_filename(c: Column | str) -> Column:
    name = F.regexp_replace(_col(c), r'[\\/*?:"<>|]', "_")
    name = F.regexp_replace(name, r"(?U)\s+", "_")
    return F.lower(F.substring(F.btrim(name, F.lit("_")), 1, 100))


def word_count(c: Column | str) -> Column:
    return F.size(F.split(_col(c), " ", -1)).cast("long")


def triple_to_string(s: Column | str, p: Column | str, o: Column | str) -> Column:
    return F.concat(F.lit("("), _col(s), F.lit(", "), _col(p), F.lit(", "), _col(o), F.lit(")"))


def issue_to_string(path: str, message: str, context: str, hint: str) -> Column:
    def optional(label: str, name: str) -> Column:
        value = F.col(name)
        return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(
            F.concat(F.lit(f" ({label}: "), value, F.lit(")"))
        )

    return F.concat(
        F.lit("["), F.col(path), F.lit("] "), F.col(message),
        optional("context", context), optional("hint", hint),
    )


def priority_to_n(c: Column | str) -> Column:
    value = _col(c)
    result = F.lit(None).cast("int")
    for name, n in PRIORITY_QUOTA.items():
        result = F.when(value == name, F.lit(n)).otherwise(result)
    return result


def node_size(degree: Column | str, max_degree: Column) -> Column:
    return F.lit(6.0) + F.least(_col(degree) / max_degree * 20.0, F.lit(20.0))


def edge_width(frequency: Column | str, max_frequency: Column) -> Column:
    return F.lit(0.5) + _col(frequency) / max_frequency * 3.0


def confidence_width(confidence: Column | str) -> Column:
    return F.lit(1.0) + 4.0 * F.coalesce(_col(confidence).cast("double"), F.lit(1.0))


def percent_of_total(counts: DataFrame, count: str, name: str = "percent") -> DataFrame:
    """Share of each row in the whole, in percent with one decimal."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.round(F.col(count) * 100.0 / total, 1))


def to_snake_case(c: Column | str) -> Column:
    """Normalise a label to an entity id: lower case, runs of other signs to one '_'."""
    value = F.regexp_replace(F.lower(_col(c)), r"[^\p{IsLowercase}\p{Nd}]+", "_")
    return F.btrim(value, F.lit("_"))


def to_pascal_case(c: Column | str) -> Column:
    """Normalise a label to a class name: words with a capital, joined."""
    words = F.regexp_replace(_col(c), r"[^\p{L}\p{Nd}]+", " ")
    return F.regexp_replace(F.initcap(words), " ", "")

"""Answers of questions: coercion of loose JSON, and comparison with the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_SLACK = 0.6


def _field(raw: Column, name: str) -> Column:
    """The field of a JSON object as text; null where the text is no object or has none."""
    return F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "string")


def _json(raw: Column, name: str) -> Column:
    return F.to_json(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))


def ids(raw: Column, name: str) -> Column:
    """A list of ids: a list as it is, with numbers as text; one text as a list of it; anything else: null."""
    text = _json(raw, name)
    listed = F.transform(F.from_json(text, "array<string>"), lambda x: x)
    return F.when(text.startswith("["), listed).when(text.startswith('"'), F.array(_field(raw, name)))


def text(raw: Column, name: str) -> Column:
    """A text: texts as they are, other values as written; null and missing: null."""
    return F.when(_json(raw, name) != "null", _field(raw, name))


def number(raw: Column, name: str) -> Column:
    """A number, also one written as text; what is no number: NaN; missing: null."""
    found = text(raw, name)
    return F.when(found.isNotNull(), F.coalesce(found.try_cast("double"), F.lit(float("nan"))))


def flag(raw: Column, name: str) -> Column:
    """true or false where the value is one of these, else null: texts do not count."""
    written = _json(raw, name)
    return F.when(written == "true", True).when(written == "false", False)


def same_ids(want: Column, got: Column) -> Column:
    """Equal with repeats, in any order; a missing answer is wrong."""
    return F.coalesce(F.array_sort(want) == F.array_sort(got), F.lit(False))


def same_number(want: Column, got: Column, metres: bool = False) -> Column:
    """Equal; of lengths, to METRES_SLACK."""
    slack = METRES_SLACK if metres else 0.0
    return F.coalesce(~F.isnan(got) & (F.abs(got - want) <= slack), F.lit(False))

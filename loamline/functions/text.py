"""Scalar functions on text, priorities and numbers, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PRIORITIES = ["Low", "Medium", "High"]


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, byte for byte; other letters stay, unlike with lower()."""
    return F.translate(text, UPPER, UPPER.lower())


def contains_ignoring_case(text: Column, keyword: str) -> Column:
    """Whether the keyword is in the text, A-Z in any case. An empty keyword is in nothing."""
    if not keyword:
        return F.lit(False)
    return F.contains(ascii_lower(text), ascii_lower(F.lit(keyword)))


def priority_from_label(label: Column) -> Column:
    """Low and High in two spellings each; everything else, null too, is Medium."""
    return F.when(label.isin("Low", "low"), "Low").when(label.isin("High", "high"), "High").otherwise("Medium")


def priority_from_input(label: Column) -> Column:
    """For edits: low, medium and high in any case; null where it is none of them."""
    lower = ascii_lower(label)
    return F.when(lower == "low", "Low").when(lower == "medium", "Medium").when(lower == "high", "High")


def priority_rank(priority: Column) -> Column:
    """1, 2, 3 from low to high; null for another value."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority), F.lit(0))


def priority_label(rank: Column) -> Column:
    """The label of a rank, Unknown for any other number."""
    return F.when(rank == 1, "Low").when(rank == 2, "Medium").when(rank == 3, "High").otherwise("Unknown")


def status_mark(completed: Column) -> Column:
    return F.when(completed, "[x] ").otherwise("[ ] ")


def or_default(text: Column, default: str) -> Column:
    """The text, or the default where it is empty or null."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def integer_input(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """A whole number in a text, null where the text is something else or the number out of bounds."""
    value = F.trim(text).try_cast("int")
    if low is not None:
        value = F.when(value >= low, value)
    return value if high is None else F.when(value <= high, value)


def double_input(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def product_verdict(name: Column, quantity: Column, price: Column) -> Column:
    """ok, or the first rule that a product breaks. Missing values break the rule of their field."""
    return (
        F.when(name.isNull() | (name == ""), "empty name")
        .when(quantity.isNull() | (quantity < 0), "bad quantity")
        .when(price.isNull() | (price < 0), "bad price")
        .otherwise("ok")
    )


def task_verdict(title: Column, description: Column, priority: Column, editing: bool) -> Column:
    """ok, or the first rule that a task breaks: an edit also needs a description and a priority of the three."""
    verdict = F.when(title.isNull() | (title == ""), "empty title")
    if editing:
        verdict = verdict.when(description.isNull() | (description == ""), "empty description")
        verdict = verdict.when(priority_from_input(priority).isNull(), "bad priority")
    return verdict.otherwise("ok")

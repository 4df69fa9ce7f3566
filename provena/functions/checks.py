"""Shape and value checks as columns: a reason string, or NULL when fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_SHAPE = r"^[a-z][a-z0-9]*_[0-9a-f]{32}$"
SHA_SHAPE = r"^[0-9a-f]{64}$"

#: w:jc values and the alignment each stands for (fixed values).
ALIGNMENT = {
    "left": "left",
    "start": "left",
    "center": "center",
    "right": "right",
    "end": "right",
    "both": "both",
}

#: Text values of an XML boolean that mean false (fixed values).
FALSE_VALUES = ("false", "0", "off")


def path_problem(path: Column) -> Column:
    """Why a stored relative path is refused."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), F.lit("empty"))
        .when(path.startswith("/"), F.lit("absolute"))
        .when(path.contains("\\"), F.lit("backslash"))
        .when(path.contains("\x00"), F.lit("nul"))
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit("component"))
    )


def placeholder_name(text: Column) -> Column:
    """The name in a stand-alone ``{{ name }}``, NULL when the text is none."""
    token = F.trim(text)
    inner = F.trim(F.substr(token, F.lit(3), F.length(token) - 4))
    return F.when(token.startswith("{{") & token.endswith("}}") & (F.length(token) >= 4), inner)


def placeholder_valid(text: Column) -> Column:
    """A declared placeholder holds an identifier once underscores are taken out."""
    bare = F.replace(placeholder_name(text), F.lit("_"), F.lit(""))
    return F.coalesce(bare.rlike(r"^(?U)\p{Alpha}\w*$"), F.lit(False))


def within(actual: Column, expected: Column, tolerance: Column) -> Column:
    return F.abs(actual - expected) <= tolerance


def truth(present: Column, value: Column) -> Column:
    """An XML boolean: absent is NULL; present is true unless its value says false."""
    return F.when(present, ~F.coalesce(value.isin(*FALSE_VALUES), F.lit(False)))


def alignment(value: Column) -> Column:
    """Alignment name, NULL for values outside the vocabulary."""
    pairs = [F.lit(x) for pair in ALIGNMENT.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)

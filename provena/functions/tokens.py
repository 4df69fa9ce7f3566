"""Token streams of a paragraph: ``array<struct<kind, text>>`` with text, tab and break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of the digest stream (fixed values).
TOKEN_SEP = "\x1f"
TOKEN_END = "\x1e"
PARAGRAPH_SEP = "\x1d"


def plain_text(tokens: Column) -> Column:
    """Text tokens in order, a tab as TAB and a break as LF."""
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t["kind"] == "tab", "\t")
            .when(t["kind"] == "break", "\n")
            .otherwise(F.coalesce(t["text"], F.lit(""))),
        ),
        "",
    )


def digest_stream(tokens: Column) -> Column:
    """The paragraph's part of a region's digest."""
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.concat(
                F.when(t["kind"] == "tab", F.lit("tab"))
                .when(t["kind"] == "break", F.lit("br"))
                .otherwise(F.concat(F.lit("t" + TOKEN_SEP), F.coalesce(t["text"], F.lit("")))),
                F.lit(TOKEN_END),
            ),
        ),
        "",
    )

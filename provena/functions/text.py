"""Text columns: canonical form, exact code-point positions, lines, snippets.

``length``, ``substr``, ``position`` and ``split(text, '')`` count code points in
Spark; the regexp position functions count UTF-16 units and are not used here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: C0 controls other than tab, line feed and carriage return (fixed values).
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

#: Bytes of texts that are Python strings at one time; a longer text is alone.
SLICE_BYTES = 1 << 20


def slices(values: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """An array of texts in runs of at most ``limit`` bytes, or one text."""
    limit = limit or SLICE_BYTES
    start = size = 0
    for i, length in enumerate(pc.binary_length(values).fill_null(0).to_pylist()):
        if i > start and size + length > limit:
            yield values.slice(start, i - start)
            start, size = i, 0
        size += length
    yield values.slice(start)


def composed(values: pa.Array) -> pa.Array:
    """Texts in NFC, a few at a time; runs that are in NFC stay the bytes that came."""
    # Arrow's own utf8_normalize leaves combining marks uncomposed.
    done, changed = [], False
    for part in slices(values):
        texts = part.to_pylist()
        if not all(v is None or unicodedata.is_normalized("NFC", v) for v in texts):
            part = pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in texts], values.type)
            changed = True
        done.append(part)
    return pa.concat_arrays(done) if changed else values


@F.arrow_udf(T.StringType())
def _utf8_nfc(values: pa.Array) -> pa.Array:
    return composed(values)


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no normaliser; texts beyond ASCII go through Arrow.

    A byte count tells them apart; a regexp of stable ranges costs more than it saves.
    """
    beyond_ascii = F.when(F.octet_length(text) != F.length(text), text)
    return F.coalesce(_utf8_nfc(beyond_ascii), text)


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def canonical(text: Column) -> Column:
    """NFC, then CRLF and CR to LF; nothing else changes."""
    return newlines(nfc(text))


def code_points(text: Column) -> Column:
    return F.length(text).cast("bigint")


def size_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def lines(text: Column) -> Column:
    """Lines split on LF with the trailing empty line kept; empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def non_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def slice_points(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` in code points, 0-based and half-open."""
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def literal_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (removed / F.length(term)).cast("bigint")).otherwise(F.lit(0))


def literal_position(text: Column, term: Column) -> Column:
    """0-based position of the first occurrence, -1 when absent."""
    return (F.position(term, text) - 1).cast("bigint")


def literal_positions(text: Column, term: Column) -> Column:
    """0-based positions of every occurrence, overlapping ones too; none for an empty term.

    The text is cut before each place where the term begins; what stands before a cut says
    where it is. A cut at the very beginning leaves no piece, so that place is asked for.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.split(text, quoted)
    ends = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<bigint>"),
        lambda acc, piece: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)).cast("bigint") + F.length(piece))),
    )
    first = F.when(F.startswith(text, term), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.length(term) > 0, F.concat(first, ends)).otherwise(F.array().cast("array<bigint>"))


def snippet(text: Column, pos: Column, limit: int) -> Column:
    """At most ``limit`` points around ``pos``; an ellipsis marks each cut end."""
    window = limit - 2
    total = F.length(text)
    left = F.greatest(F.lit(0), F.least(pos, total - window))
    if limit <= 3:
        return F.when(total <= limit, text).otherwise(F.lit("…"))
    cut = F.concat(
        F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
        F.substr(text, (left + 1).cast("int"), F.lit(window)),
        F.when(left + window < total, F.lit("…")).otherwise(F.lit("")),
    )
    return F.when(total <= limit, text).otherwise(cut)


def illegal_positions(text: Column) -> Column:
    """Code-point indexes of characters that may not be rendered.

    Few offenders are placed by the lengths of the pieces between them. That would be
    quadratic in their number, so texts full of them are walked by character instead.
    """
    pieces = F.split(text, CONTROLS)

    def place(acc: Column, piece: Column) -> Column:
        at = acc["next"] + F.length(piece)
        return F.struct((at + 1).alias("next"), F.concat(acc["seen"], F.array(at)).alias("seen"))

    start = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("seen"))
    few = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, place)["seen"]
    marks = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(CONTROLS), i.cast("bigint")))
    many = F.filter(marks, lambda i: i.isNotNull())
    return (
        F.when(~text.rlike(CONTROLS), F.array().cast("array<bigint>"))
        .when(F.size(pieces) <= 500, few)
        .otherwise(many)
    )


def offence_message(text: Column, positions: Column, limit: int = 5) -> Column:
    """The first offenders as ``index i (U+XXXX)``; NULL when there are none."""
    named = F.transform(
        F.slice(positions, 1, limit),
        lambda i: F.concat(
            F.lit("index "),
            i.cast("string"),
            F.lit(" (U+"),
            F.lpad(F.hex(F.ascii(F.substr(text, (i + 1).cast("int"), F.lit(1)))), 4, "0"),
            F.lit(")"),
        ),
    )
    return F.when(
        F.size(positions) > 0,
        F.concat(F.lit("text contains forbidden control characters: "), F.array_join(named, ", ")),
    )


def query_text(query: Column, limit: int | None = None) -> Column:
    """A search query as sent: outer white space of any script off, at most ``limit`` points."""
    bare = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    return bare if limit is None else F.substr(bare, F.lit(1), F.lit(limit))


def query_terms(query: Column) -> Column:
    """Terms between white space of any script, first occurrence order, no repeats."""
    return F.array_distinct(F.filter(F.split(query, r"(?U)\s+"), lambda t: t != ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def upload_name(name: Column) -> Column:
    """Last segment of a browser file name, backslashes included; 255 points at most."""
    last = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    kept = F.substr(F.regexp_replace(last, r"^\s+|\s+$", ""), F.lit(1), F.lit(255))
    return F.when(kept == "", F.lit("material")).otherwise(kept)


def utc_iso(ts: Column) -> Column:
    """ISO-8601 with microseconds and an explicit Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))

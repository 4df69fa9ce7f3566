"""Benchmark decontamination by template canonicalisation, in column functions only.

Numbers, names and units become typed placeholders that remember what they replace. Windows
of the template, without what the placeholders hold, are hashed and joined with the windows
of the benchmark's items. Where windows of one item line up in a document, the placeholders
must agree: one value of the item stands for one value of the document. An item whose
values were all exchanged consistently is found as well as a verbatim copy. Items that are
too short for that, or hold too little but placeholders, are found where all their tokens
stand in a row with the same values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import session
from provena.llm import common


@dataclass(frozen=True)
class Params:
    """window: tokens in a window. literals: tokens of a window that must be no placeholder.
    least: items of fewer tokens, and those without such a window, are only found verbatim;
    items between least and window are matched as one window of their own length. share: part of an item's windows that must
    be found with consistent slots."""

    window: int = 8
    literals: int = 4
    least: int = 5
    share: float = 0.3


#: Units that may follow a number.
UNITS = (
    "%", "°c", "°f", "km", "cm", "mm", "nm", "m", "kg", "mg", "g", "t", "lb", "lbs", "oz", "km/h", "mph", "ft", "mi", "in", "l", "ml",
    "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz", "w", "kw", "kwh", "v", "kb", "mb", "gb", "tb", "usd", "eur", "gbp",
    "€", "£", "miles", "mile", "meters", "metres", "meter", "metre", "feet", "foot", "inches", "inch", "yards", "grams", "gram",
    "kilograms", "kilogram", "tons", "tonnes", "pounds", "pound", "dollars", "dollar", "euros", "euro", "cents", "seconds",
    "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "liters", "litres",
)
#: Numbers written as words.
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn",
    "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho",
    "nueve", "diez",
)

_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
#: Letters of scripts without blanks between words: Thai to Burmese, Khmer, kana, Han. Others fail at the first test.
_UNSPACED = (
    r"[\x{E00}-\x{3FFFF}&&[\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{1950}-\x{19DF}\x{1A20}-\x{1AAF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]&&[\p{L}\p{Nl}]]\p{M}*"
)
_UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))


def marked(text: Column) -> Column:
    """The tokens of a text; a placeholder is U+0001, its type, ``=`` and what it replaces.

    A letter of a script that puts no blanks between words is a token of its own.
    A name is a word of a capital and small letters that neither begins the text nor follows the end of a
    sentence or a line break.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), "=\x01", "  ")
    named = F.regexp_replace(clean, r"(?<=[\p{L}\p{N},;][ \t])(\p{Lu}[\p{Ll}\p{M}]+)(?![\p{L}\p{M}\p{N}])", "\x01a=$1")
    # Most places hold no digit, which the first test of each pattern sees.
    measured = F.regexp_replace(named, rf"(?iu)(?=[0-9])(?<![\p{{L}}\p{{N}}=])({_NUMBER})[ \t]?({_UNIT})(?![\p{{L}}\p{{N}}])", " \x01n=$1 \x01u=$2 ")
    counted = F.regexp_replace(measured, rf"(?=[0-9])(?<!=)(?<![0-9][.,:/])(?<![0-9]){_NUMBER}", " \x01n=$0 ")
    loose = F.regexp_replace(F.lower(counted), r"(?<![0-9=])[^\p{L}\p{M}\p{N}\s=\x01]+|(?<!=)[^\p{L}\p{M}\p{N}\s=\x01]+(?![0-9\p{L}°/])", " ")
    single = F.regexp_replace(loose, _UNSPACED, " $0 ")
    tokens = F.filter(F.split(single, r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when(t.isin(*NUMBER_WORDS), F.concat(F.lit("\x01n="), t)).otherwise(t))


def _windows(tokens: Column, lengths: list[int], verbatim: list[int] = []) -> Column:
    """Structs of pos, len and hash for every window of the given lengths. A window whose
    slot values count, of a length in ``verbatim``, has it below zero."""

    def plain(of: Column) -> Column:
        return F.transform(of, lambda t: F.when(F.startswith(t, F.lit("\x01")), F.substring(t, 1, 2)).otherwise(t))

    def of(all_: Column, n: int, sign: int) -> Column:
        starts = F.when(F.size(all_) >= n, F.sequence(F.lit(1), F.size(all_) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(sign * n).alias("len"), F.xxhash64(F.slice(all_, i, n)).alias("hash"))),
            F.array().cast("array<struct<pos:int,len:int,hash:bigint>>"),
        )

    # The template is bound once and every length reads it.
    if not verbatim:
        return F.flatten(F.transform(F.array(plain(tokens)), lambda p: F.concat(*[of(p, n, 1) for n in lengths])))
    both = F.struct(tokens.alias("own"), plain(tokens).alias("plain"))
    return F.flatten(F.transform(F.array(both), lambda b: F.concat(*[of(b["plain"], n, 1) for n in lengths], *[of(b["own"], n, -1) for n in verbatim])))


def item_windows(items: DataFrame, p: Params) -> DataFrame:
    """item_id, tokens, total and pos, len, hash of each window that has enough literals.

    An item without one has its first tokens as a window, with their values and a ``len``
    below zero: where it is found, all tokens have to follow.
    """
    all_ = items.where(F.col("item_id").isNotNull()).select("item_id", marked(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).distinct()
    tokens = all_.where(F.size("tokens") >= p.least)
    lengths = range(p.least, p.window + 1)
    cut = tokens.select("item_id", "tokens", F.explode(_windows(F.col("tokens"), list(lengths))).alias("w"))
    cut = cut.where(F.col("w.len") == F.least(F.lit(p.window), F.size("tokens")))
    literals = F.size(F.filter(F.slice("tokens", F.col("w.pos"), F.col("w.len")), lambda t: ~F.startswith(t, F.lit("\x01"))))
    kept = cut.where(literals >= F.least(F.lit(p.literals), F.col("w.len"))).select("item_id", "tokens", "w.*").distinct()
    totals = kept.groupBy("item_id").agg(F.count("*").alias("total"))
    n = F.least(F.lit(p.window), F.size("tokens"))
    rest = all_.join(kept.select("item_id", "tokens").distinct(), ["item_id", "tokens"], "left_anti")
    whole = rest.select("item_id", "tokens", F.lit(1).alias("item_pos"), (-n).alias("len"), F.xxhash64(F.slice("tokens", 1, n)).alias("hash"), F.lit(1).cast("long").alias("total"))
    return kept.join(totals, "item_id").withColumnRenamed("pos", "item_pos").unionByName(whole)


def find(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """Documents that hold an item, or one that differs from it only in consistent slots.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read.
    One row per text and item: doc_id, text_hash, item_id, windows found with consistent
    slots, their share of the item's windows, and whether all slots are those of the item;
    an item that is only found verbatim counts as one window.
    Null and empty texts hold nothing; rows of one id and text count once; a null doc_id
    is an id like any other, rows without item_id are left out. Texts never leave the scan
    but for documents in which some window was found.
    """
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    bench = session.settle(item_windows(items, p), "item-windows")
    sizes = sorted(r["len"] for r in bench.select("len").distinct().collect()) or [p.window]
    lengths, verbatim = [n for n in sizes if n > 0], [-n for n in sizes if n < 0]
    places = docs.where(F.col("text").isNotNull()).select(*key, F.explode(_windows(marked(F.col("text")), lengths, verbatim)).alias("w"))
    hits = places.select("doc_id", "text_hash", "w.*").join(
        common.sized(bench.select("hash", "len", "item_id", "item_pos")), ["hash", "len"]
    )
    hits = session.settle(hits.select("doc_id", "text_hash", "item_id", "pos", "item_pos", "len").distinct(), "window-hits")
    owners = common.sized(hits.select("doc_id", "text_hash").distinct())
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    found = docs.select("doc_id", "text", *key[1:])
    texts = found.join(owners, same(found, owners), "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    texts = texts.select("doc_id", "text_hash", marked(F.col("text")).alias("doc_tokens"))
    whole = bench.where(F.col("len") < 0).select("item_id", "tokens")
    held = (
        hits.where(F.col("len") < 0).join(common.sized(whole), "item_id").join(texts, same(hits, texts))
        .where(F.slice("doc_tokens", F.col("pos"), F.size("tokens")) == F.col("tokens"))
        .select(hits["doc_id"], hits["text_hash"], "item_id", F.lit(1).alias("windows"), F.lit(1.0).alias("share"), F.lit(True).alias("exact")).distinct()
    )
    own = bench.where(F.col("len") > 0).select("item_id", "tokens", "total").distinct()
    near = hits.where(F.col("len") > 0)
    lined = near.join(texts, same(near, texts)).select(near["*"], F.slice("doc_tokens", near["pos"], near["len"]).alias("d")).join(own, "item_id")
    slots = F.filter(
        F.arrays_zip(F.slice("tokens", F.col("item_pos"), F.col("len")).alias("i"), F.col("d")), lambda z: F.startswith(z["i"], F.lit("\x01"))
    )
    lined = lined.select("doc_id", "text_hash", "item_id", "total", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", slots.alias("slots"))
    # An alignment of at most as many windows as the item has: its slot values fit in a set.
    place = ["doc_id", "text_hash", "item_id", "total", "shift"]
    values = F.array_distinct(F.flatten(F.collect_set("slots")))
    aligned = lined.groupBy(*place).agg(F.collect_set("item_pos").alias("at"), values.alias("values"))
    steady = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda z: z["i"])))
    exact = F.forall("values", lambda z: z["i"] == z["d"])
    summed = aligned.where(steady).groupBy("doc_id", "text_hash", "item_id", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("windows"), F.bool_or(exact).alias("exact")
    )
    found = summed.select("doc_id", "text_hash", "item_id", "windows", (F.col("windows") / F.col("total")).alias("share"), "exact").where(F.col("share") >= p.share)
    return found.unionByName(held) if verbatim else found


def clean(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with all their columns, without the texts in which an item was found."""
    own, text_hash = common.fresh(docs, "own_id", "own_hash")
    bad = session.settle(find(docs, items, p).select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash)).distinct(), "contaminated")
    hit = docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    return docs.join(common.sized(bad), hit, "left_anti")

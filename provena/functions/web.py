"""Web columns: addresses, policy, media types, and HTML to text."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hosts that keep every byte on the machine (fixed values).
LOOPBACK = ("127.0.0.1", "localhost", "::1")
CATEGORIES = ("web_search", "web_fetch")

#: Charsets that are decoded in the JVM, by the names a page may give them (fixed values).
UTF8 = ("utf-8", "utf8")
LATIN = ("iso-8859-1", "latin-1", "latin1")
ASCII = ("us-ascii", "ascii")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without port or brackets, empty when there is none."""
    place = F.regexp_replace(authority(url), "^.*@", "")
    bracketed = F.regexp_extract(place, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(place.startswith("["), bracketed).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))


def url_problem(url: Column) -> Column:
    """Why an address is refused whatever the policy; NULL when its shape is fine."""
    return (
        F.when(~scheme(url).isin("http", "https"), F.concat(F.lit("scheme not http/https: "), scheme(url)))
        .when(host(url) == "", F.lit("no host component"))
        .when(authority(url).contains("@"), F.lit("embedded credentials"))
    )


def policy_decision(url: Column, category: Column, policy: Column, loopback: tuple[str, ...] = LOOPBACK) -> tuple[Column, Column]:
    """(allowed, reason) of reaching an address under a data policy."""
    malformed, where = url_problem(url), host(url)
    local = where.isin(*loopback)
    known = category.isin(*CATEGORIES)
    allowed = known & malformed.isNull() & ((policy == "llm_allowed") | local)
    reason = (
        F.when(~known, F.concat(F.lit("unknown category "), category))
        .when(malformed.isNotNull(), F.concat(malformed, F.lit(" ("), category, F.lit(")")))
        .when(policy == "llm_allowed", F.concat(category, F.lit(" to "), where, F.lit(" permitted by llm_allowed")))
        .when(local, F.concat(category, F.lit(" loopback "), where, F.lit(" allowed under local_only")))
        .otherwise(F.concat(category, F.lit(" to "), where, F.lit(" denied under local_only")))
    )
    return allowed, reason


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def media_accepted(content_type: Column) -> Column:
    media = media_type(content_type)
    return (media == "") | media.startswith("text/") | media.isin("application/json", "application/xhtml+xml")


def success(status: Column) -> Column:
    return status.between(200, 299)


def charset(content_type: Column) -> Column:
    """The charset parameter without quotes, NULL when absent."""
    found = F.regexp_extract(content_type, r"""(?i);\s*charset\s*=['" ]*([^;'" ]+)""", 1)
    return F.nullif(F.lower(found), F.lit(""))


@F.arrow_udf(T.StringType())
def _decode(bodies: pa.Array, names: pa.Array) -> pa.Array:
    def text(body: bytes | None, name: str | None) -> str | None:
        if body is None:
            return None
        try:
            return body.decode(name, "replace")
        except (LookupError, ValueError):
            # A name that is no charset, or one such as idna that cannot read these bytes.
            return body.decode("utf-8", "replace")

    return pa.array([text(b, n) for b, n in zip(bodies.to_pylist(), names.to_pylist())], pa.string())


def decode_body(body: Column, content_type: Column) -> Column:
    """Bytes to text by declared charset, else UTF-8, with replacement characters.

    UTF-8, Latin-1 and ASCII are read in the JVM; rows of any other charset go to Arrow."""
    name = charset(content_type)
    plain = F.make_valid_utf8(body.cast("string"))
    other = name.isNotNull() & ~name.isin(*LATIN, *ASCII, *UTF8)
    return F.when(other, F.coalesce(_decode(F.when(other, body), F.when(other, name)), plain)).when(name.isin(*LATIN), F.decode(body, "ISO-8859-1")).when(
        name.isin(*ASCII) & F.is_valid_utf8(body.cast("string")) & (F.octet_length(body) == F.length(plain)), plain
    ).otherwise(plain)


@F.arrow_udf(T.StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


#: Entities replaced in the JVM, in order; the ampersand comes last (fixed values).
COMMON_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
)


def unescape(text: Column) -> Column:
    """Entities to characters. Rows with other entities than the common ones go to Arrow."""
    names = "|".join(e[1:-1] for e, _ in COMMON_ENTITIES)
    odd = F.regexp_replace(text, f"&({names});", "").rlike("&[#A-Za-z]")
    plain = text
    for entity, character in COMMON_ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    return F.coalesce(_unescape(F.when(odd, text)), plain)


def strip_markup(markup: Column) -> Column:
    """A page without script and style bodies, comments and tags; entities still encoded."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[!?][^>]*>", "")
    text = F.regexp_replace(text, r"""</?[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""", "")
    # Tags with an unpaired quote.
    return F.regexp_replace(text, r"</?[A-Za-z][^>]*>", "")


def html_to_text(pages: DataFrame, markup: str, target: str) -> DataFrame:
    """Add the text of a page column. Stripping is a step of its own, done once per row."""
    stripped = pages.withColumn("_stripped", strip_markup(F.col(markup)))
    return stripped.withColumn(target, unescape(F.col("_stripped"))).drop("_stripped")


def squash(fragment: Column) -> Column:
    """A fragment without tags, its whitespace squeezed."""
    return F.regexp_replace(F.regexp_replace(fragment, "<[^>]+>", ""), r"(?U)\s+", " ")


def label(fragment: Column) -> Column:
    """A fragment as shown: no tags, entities decoded, outer whitespace off."""
    return F.regexp_replace(unescape(squash(fragment)), r"(?U)^\s+|\s+$", "")


def source_filename(url: Column, index: Column) -> Column:
    slug = F.substr(F.regexp_replace(url, "[^A-Za-z0-9._-]+", "-"), F.lit(1), F.lit(40))
    name = F.regexp_replace(slug, "^-+|-+$", "")
    return F.concat(
        F.lit("research_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"),
        F.when(name == "", F.lit("page")).otherwise(name), F.lit(".txt"),
    )

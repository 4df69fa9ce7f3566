"""Template contracts: sidecar tables, placeholders, static regions, registration.

A template document is small and stays in one row as an array of paragraphs while its
placeholders are looked at; templates are what is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import checks
from provena.functions.digest import sha, stable_id
from provena.operators.findings import union_all
from provena.operators.ranking import latest_rows

#: Sidecar version and slot kinds (fixed values).
SIDECAR_VERSION = "1.1"
KINDS = ("text_block", "data_table", "chart", "table_asset", "image_asset")

#: Template syntax (fixed values).
PLACEHOLDER = r"\{\{[^{}]*\}\}"
VARIABLE = "^[A-Za-z_][A-Za-z0-9_]*$"
CONTROL = r"\{%"
RICH = r"\{\{\s*[rpP]\b"
FILTER = r"\{\{[^{}]*\|[^{}]*\}\}"

#: Characters of a document's text, or its paragraphs, that one bin holds; paragraphs in a bin of regions.
BIN = 4096
RUN = 64

SIDECAR = (
    "schema_version string, template_id string, slots array<struct<slot_id:string,placeholder:string,kind:string,"
    "required:boolean,allow_user_omit:boolean,semantic_requirement:string,style_key:string>>, "
    "sections array<struct<section_id:string,title:string,slot_ids:array<string>>>"
)


def sidecar_tables(sidecars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sidecar JSON (template_id, sidecar) to (slots, sections, findings)."""
    parsed = sidecars.select("template_id", F.from_json("sidecar", SIDECAR).alias("_s"))
    slot, section = F.col("_e"), F.col("_e")

    def blank(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) == ""

    slot_problem = (
        F.when(blank(slot["slot_id"]), "slot_id missing")
        .when(~F.coalesce(checks.placeholder_valid(slot["placeholder"]), F.lit(False)), "placeholder malformed")
        .when(~F.coalesce(slot["kind"].isin(*KINDS), F.lit(False)), "kind unknown")
        .when(slot["required"].isNull(), "required missing")
        .when(blank(slot["semantic_requirement"]), "semantic_requirement missing")
        .when(blank(slot["style_key"]), "style_key missing")
    )
    slots = parsed.select("template_id", F.posexplode("_s.slots").alias("slot_pos", "_e")).withColumn("_problem", slot_problem)
    section_problem = F.when(blank(section["section_id"]), "section_id missing").when(
        F.coalesce(F.size(section["slot_ids"]), F.lit(0)) < 1, "slot_ids empty"
    )
    sections = parsed.select("template_id", F.posexplode("_s.sections").alias("section_pos", "_e")).withColumn("_problem", section_problem)

    def bad(rows: DataFrame, code: str, name: str, pos: str) -> DataFrame:
        place = F.concat(F.lit(f"sidecar.{name}["), F.col(pos).cast("string"), F.lit("]"))
        return rows.filter(F.col("_problem").isNotNull()).select(
            "template_id", F.lit(code).alias("code"), place.alias("locator"), F.col("_problem").alias("detail")
        )

    def whole(condition: Column, code: str, place: str, detail: Column) -> DataFrame:
        return parsed.filter(condition).select("template_id", F.lit(code).alias("code"), F.lit(place).alias("locator"), detail.alias("detail"))

    version, declared = F.col("_s.schema_version"), F.col("_s.template_id")
    empty = F.lit("must not be empty")
    findings = union_all(
        [
            whole(
                ~version.eqNullSafe(F.lit(SIDECAR_VERSION)), "SIDECAR_SCHEMA_VERSION", "sidecar.schema_version",
                F.concat(F.lit(f"expected {SIDECAR_VERSION}, got "), F.coalesce(version, F.lit("none"))),
            ),
            whole(declared != F.col("template_id"), "SIDECAR_TEMPLATE_ID_MISMATCH", "sidecar.template_id", F.concat(F.lit("sidecar declares "), declared)),
            whole(F.coalesce(F.size("_s.slots"), F.lit(0)) < 1, "SIDECAR_INCOMPLETE", "sidecar.slots", empty),
            whole(F.coalesce(F.size("_s.sections"), F.lit(0)) < 1, "SIDECAR_INCOMPLETE", "sidecar.sections", empty),
            bad(slots, "SIDECAR_SLOT_INVALID", "slots", "slot_pos"),
            bad(sections, "SIDECAR_SECTION_INVALID", "sections", "section_pos"),
        ]
    )
    good_slots = slots.filter(F.col("_problem").isNull()).select("template_id", "slot_pos", "_e.*")
    good_sections = sections.filter(F.col("_problem").isNull()).select("template_id", "section_pos", "_e.*")
    return good_slots, good_sections, findings


def discovered(paragraphs: DataFrame, key: str) -> DataFrame:
    """Stand-alone placeholders of body paragraphs (key, idx, text), in document order."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    name = checks.placeholder_name(text)
    valid = F.replace(name, F.lit("_"), F.lit("")).rlike(r"^(?U)[\p{L}\p{N}]+$")
    return paragraphs.withColumn("name", name).filter(F.coalesce(valid, F.lit(False))).select(key, "idx", "name")


def full_text(paragraphs: Column) -> Column:
    """Text of an array of paragraphs run together, as placeholders may cross them."""
    return F.array_join(F.transform(paragraphs, lambda p: p["text"]), "")


def owner_of(paragraphs: Column, offset: Column) -> Column:
    """Index of the paragraph that holds a character of the run-together text."""

    def step(acc: Column, p: Column) -> Column:
        end = acc["end"] + F.length(p["text"])
        found = F.when(acc["found"].isNull() & (offset >= acc["end"]) & (offset < end), p["idx"]).otherwise(acc["found"])
        return F.struct(end.alias("end"), found.alias("found"))

    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("found"))
    return F.aggregate(paragraphs, start, step)["found"]


def _place(idx: Column) -> Column:
    return F.when(idx.isNull(), F.lit("document")).otherwise(F.concat(F.lit("document:para["), idx.cast("string"), F.lit("]")))


def placeholder_findings(templates: DataFrame, slots: DataFrame) -> DataFrame:
    """Findings on the placeholders of templates (template_id, paragraphs).

    ``paragraphs`` is an ordered array of (idx, text, run_texts, bookmarks); ``slots``
    (template_id, slot_id, placeholder).
    """
    wanted = slots.groupBy("template_id").agg(
        F.collect_list(F.struct("slot_id", F.trim("placeholder").alias("placeholder"))).alias("_slots")
    )
    docs = templates.join(wanted, "template_id").withColumn("_full", full_text(F.col("paragraphs")))
    full, paragraphs = F.col("_full"), F.col("paragraphs")

    # Placeholders nobody declared: matches, with offsets from the pieces between them.
    marks = F.regexp_extract_all(full, F.lit(PLACEHOLDER), F.lit(0))
    pieces = F.split(full, PLACEHOLDER)
    spotted = docs.select("template_id", "paragraphs", "_slots", marks.alias("_marks"), pieces.alias("_between")).select(
        "template_id", "paragraphs", "_slots", "_marks", "_between", F.posexplode("_marks").alias("_k", "_token")
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.length(v))

    at = total(F.slice(F.col("_between"), F.lit(1), F.col("_k") + 1)) + total(F.slice(F.col("_marks"), F.lit(1), F.col("_k")))
    stray = spotted.filter(~F.array_contains(F.transform("_slots", lambda s: s["placeholder"]), F.col("_token"))).withColumn(
        "_idx", owner_of(paragraphs, at)
    )
    inner = F.trim(F.substr("_token", F.lit(3), F.length("_token") - 4))
    undeclared = stray.select(
        "template_id",
        F.when(inner.rlike(VARIABLE), "PLACEHOLDER_UNDECLARED").otherwise("PLACEHOLDER_NOT_VARIABLE").alias("code"),
        _place(F.col("_idx")).alias("locator"), F.col("_token").alias("detail"),
    )
    syntax = F.array_compact(
        F.array(
            *[
                F.when(full.rlike(pattern), F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))
                for code, pattern, detail in (
                    ("JINJA_CONTROL_SYNTAX", CONTROL, "control syntax is outside the supported subset"),
                    ("JINJA_RICH_TEXT_TAG", RICH, "rich-text tags are outside the supported subset"),
                    ("JINJA_FILTER", FILTER, "filters are outside the supported subset"),
                )
            ]
        )
    )
    forbidden = docs.select("template_id", F.inline(syntax)).select("template_id", "code", F.lit("document").alias("locator"), "detail")

    # Declared placeholders, one row per slot.
    each = docs.select("template_id", "paragraphs", "_full", F.explode("_slots").alias("_s")).select(
        "template_id", "paragraphs", "_full", F.col("_s.slot_id").alias("slot_id"), F.col("_s.placeholder").alias("_p")
    )
    times = ((F.length("_full") - F.length(F.replace("_full", F.col("_p"), F.lit("")))) / F.length("_p")).cast("int")
    owner = F.get(F.filter("paragraphs", lambda p: F.contains(p["text"], F.col("_p"))), F.lit(0))
    held = each.withColumn("_times", times).withColumn("_owner", owner)
    where, para = F.concat(F.lit("document:"), F.col("slot_id")), _place(F.col("_owner.idx"))
    found, alone = F.col("_owner").isNotNull(), F.trim("_owner.text") == F.col("_p")
    whole_run = F.exists("_owner.run_texts", lambda r: F.trim(r) == F.col("_p"))
    anchored = F.exists("_owner.bookmarks", lambda b: (b["name"] == F.col("slot_id")) & b["closed"])

    def say(condition: Column, code: str, place: Column, detail: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), place.alias("locator"), detail.alias("detail")))

    present, token = F.col("_times") > 0, F.col("_p")
    rules = F.array_compact(
        F.array(
            say(~present, "PLACEHOLDER_MISSING", where, token),
            say(F.col("_times") > 1, "PLACEHOLDER_DUPLICATE", where, F.concat(token, F.lit(" occurs "), F.col("_times").cast("string"), F.lit(" times"))),
            say(present & ~found, "PLACEHOLDER_FRAGMENTED", where, token),
            say(present & found & ~alone, "PLACEHOLDER_NOT_ALONE", para, F.col("_owner.text")),
            say(present & found & alone & ~whole_run, "PLACEHOLDER_SPLIT_RUN", para, token),
            say(present & found & ~anchored, "PLACEHOLDER_MISSING_ANCHOR", para, F.col("slot_id")),
        )
    )
    declared = held.select("template_id", F.inline(rules))
    return union_all([undeclared, forbidden, declared])


def header_findings(parts: DataFrame) -> DataFrame:
    """Headers and footers (template_id, part, text) may hold no placeholders."""
    return parts.filter((F.col("part") != "document") & F.col("text").contains("{{")).select(
        "template_id", F.lit("PLACEHOLDER_IN_HEADER_FOOTER").alias("code"), F.col("part").alias("locator"),
        F.lit("dynamic placeholders are only allowed in the document part").alias("detail"),
    )


def style_findings(slots: DataFrame, styles: DataFrame) -> DataFrame:
    """Style entries that are no valid spec, and slots whose style nobody declared.

    ``styles`` is (template_id, style_key, alignment, font_size, tolerance).
    """
    problem = (
        F.when(F.col("font_size") < 1, "font_size below 1")
        .when(F.col("tolerance") < 0, "tolerance below 0")
        .when(F.col("alignment").isNotNull() & ~F.col("alignment").isin("left", "center", "right", "both", "unknown"), "alignment unknown")
    )
    invalid = styles.withColumn("_problem", problem).filter(F.col("_problem").isNotNull()).select(
        "template_id", F.lit("STYLES_SPEC_INVALID").alias("code"),
        F.concat(F.lit("styles_spec."), F.col("style_key")).alias("locator"), F.col("_problem").alias("detail"),
    )
    key = ["template_id", "style_key"]
    unknown = slots.join(styles.select(*key).distinct(), key, "left_anti").select(
        "template_id", F.lit("STYLE_KEY_UNKNOWN").alias("code"),
        F.concat(F.lit("slot:"), F.col("slot_id")).alias("locator"), F.col("style_key").alias("detail"),
    )
    return invalid.unionByName(unknown)


def slot_order(anchors: DataFrame) -> DataFrame:
    """0-based order of the anchored slots (template_id, slot_id, idx) of each template."""
    window = Window.partitionBy("template_id").orderBy("idx", "slot_id")
    return anchors.withColumn("slot_order", (F.row_number().over(window) - 1).cast("bigint"))


def region_members(regions: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of static regions, and the regions that point nowhere.

    ``regions`` is (doc, region_id, first, last, table_ref), ``paragraphs`` (doc, idx,
    cell_locator). A range is inclusive on both ends. Ranges and paragraphs meet in bins of
    paragraph numbers, tables and cells by equal paths, so a long document with many regions
    does not pair them all.
    """
    sizes = paragraphs.groupBy("doc").agg(F.count("*").alias("_n"))
    sized = regions.join(sizes, "doc", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ranged, first, last = F.col("first").isNotNull(), F.col("first"), F.col("last")
    outside = ranged & ((first < 0) | (last < first) | (last >= F.col("_n")))
    # A region meets the paragraphs of the bins its range covers, or the cells below its table.
    sound = sized.filter(~outside)
    covered = F.sequence(F.floor(first / RUN), F.floor(last / RUN))
    ranges = sound.filter(ranged).select("doc", "region_id", "first", "last", F.explode(covered).alias("_bin"))
    by_range = ranges.join(paragraphs.select("doc", "idx", F.floor(F.col("idx") / RUN).alias("_bin")), ["doc", "_bin"]).filter(
        F.col("idx").between(first, last)
    )
    steps = F.split("cell_locator", "/")
    depths = F.filter(F.sequence(F.lit(1), F.size(steps)), lambda n: n < F.size(steps))
    above = F.transform(depths, lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    cells = paragraphs.filter(F.col("cell_locator").isNotNull()).select("doc", "idx", F.explode(above).alias("table_ref"))
    by_table = sound.filter(first.isNull()).select("doc", "region_id", "table_ref").join(cells, ["doc", "table_ref"])
    members = by_range.select("doc", "region_id", "idx").unionByName(by_table.select("doc", "region_id", "idx"))
    neither = sized.filter(first.isNull() & F.col("table_ref").isNull()).select("doc", "region_id", F.lit("region needs a range or a table").alias("problem"))
    bounds = sized.filter(outside).select(
        "doc", "region_id",
        F.concat(F.lit("paragraph_range ["), first.cast("string"), F.lit(", "), last.cast("string"), F.lit("] out of part bounds")).alias("problem"),
    )
    tables = sized.filter(first.isNull() & F.col("table_ref").isNotNull()).join(
        members.select("doc", "region_id").distinct(), ["doc", "region_id"], "left_anti"
    ).select("doc", "region_id", F.concat(F.lit("no table cells match "), F.col("table_ref")).alias("problem"))
    return members, union_all([bounds, neither, tables])


def offset_owners(offsets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Character offsets (doc, offset) to the paragraph (doc, idx, text) that holds them.

    Paragraphs lie one after another in idx order without anything between them. Starts are
    summed over runs of paragraphs and then inside each run, so a document of any length is
    summed by many tasks. Each paragraph is listed in the bins of characters it covers and
    an offset looks into its own bin, so neither side meets more than a bin of the other;
    empty paragraphs hold nothing. Offsets outside the document, or NULL, have no paragraph.
    """
    runs = paragraphs.select("doc", "idx", F.length("text").cast("bigint").alias("_len"), F.floor(F.col("idx") / BIN).alias("_run"))
    sums = runs.groupBy("doc", "_run").agg(F.sum("_len").alias("_sum"))
    earlier = Window.partitionBy("doc").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("doc", "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("doc", "_run").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("_before", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    placed = inside.join(bases, ["doc", "_run"]).filter(F.col("_len") > 0).select(
        "doc", "idx", (F.col("_base") + F.col("_before")).alias("_start"), (F.col("_base") + F.col("_before") + F.col("_len")).alias("_end")
    )
    bins = F.sequence(F.floor(F.col("_start") / BIN), F.floor((F.col("_end") - 1) / BIN))
    listed = placed.withColumn("_bin", F.explode(bins))
    asked = offsets.withColumn("_bin", F.floor(F.col("offset") / BIN))
    at = F.col("offset")
    hit = (asked["doc"] == listed["doc"]) & (asked["_bin"] == listed["_bin"]) & (at >= F.col("_start")) & (at < F.col("_end"))
    return asked.join(listed, hit, "left").select(asked["doc"], "offset", "idx", _place(F.col("idx")).alias("locator"))


def scaffold(paragraphs: DataFrame, semantics: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slots, regions, refusals) for uploaded documents (key, idx, text, in_table).

    Every discovered placeholder becomes a required slot of style ``body`` in the section
    ``root``; every other paragraph with text a static region of just itself, numbered by
    its place in the document flow. A placeholder without semantics refuses the document.
    """
    found = discovered(paragraphs, key)
    named = found.join(semantics.select(key, "name", "semantic", "allow_omit"), [key, "name"], "left")
    blank = F.coalesce(F.trim("semantic"), F.lit("")) == ""
    missing = named.filter(blank).groupBy(key).agg(
        F.concat(F.lit("placeholders without semantics: "), F.array_join(F.array_sort(F.collect_set("name")), ", ")).alias("problem")
    )
    none = paragraphs.select(key).distinct().join(found.select(key), key, "left_anti").select(key, F.lit("no placeholder found").alias("problem"))
    refusals = missing.unionByName(none)
    slots = named.join(refusals.select(key), key, "left_anti").select(
        key, "idx", F.col("name").alias("slot_id"), F.concat(F.lit("{{ "), F.col("name"), F.lit(" }}")).alias("placeholder"),
        F.lit("text_block").alias("kind"), F.lit(True).alias("required"), F.coalesce("allow_omit", F.lit(False)).alias("allow_user_omit"),
        F.trim("semantic").alias("semantic_requirement"), F.lit("body").alias("style_key"), F.lit("root").alias("section_id"),
    )
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    static = paragraphs.filter((text != "") & ~(text.startswith("{{") & text.endswith("}}")))
    regions = static.join(refusals.select(key), key, "left_anti").select(
        key, F.concat(F.lit("static_"), F.col("idx").cast("string")).alias("region_id"), F.col("idx").alias("first"), F.col("idx").alias("last")
    )
    return slots, regions, refusals


def ensure_registered(incoming: DataFrame, versions: DataFrame, digests: tuple[str, ...]) -> DataFrame:
    """A new version only when one of the digests differs from the latest version's."""
    newest = latest_rows(versions, ["template_id"], [F.col("version")], ["version", "template_version_id", *digests]).select(
        "template_id", "version", "template_version_id", *[F.col(d).alias(f"_{d}") for d in digests]
    )
    joined = incoming.join(newest, "template_id", "left")
    same = F.col("version").isNotNull()
    for d in digests:
        same = same & (F.col(d) == F.col(f"_{d}"))
    fresh = ~F.coalesce(same, F.lit(False))
    version = F.when(fresh, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).cast("bigint")
    return joined.select(
        "template_id", version.alias("version"),
        F.when(fresh, stable_id("tver", F.col("template_id"), version)).otherwise(F.col("template_version_id")).alias("template_version_id"),
        fresh.alias("newly_registered"),
    )


def contract_digest(fields: list[str]) -> Column:
    """Digest of a row's canonical JSON: keys sorted, no spaces, whatever order they came in."""
    return sha(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}))


def canonical_json(text: Column) -> Column:
    """JSON of any shape in one form: keys in order at every depth, no spaces, numbers in Spark's own form.

    NULL for text that is no JSON or names a key twice.
    """
    return F.to_json(F.try_parse_json(text))


def _as_json(value: Column) -> Column:
    return canonical_json(F.to_json(value, {"ignoreNullFields": "false"}))


def contract_refusals(sections: DataFrame, slots: DataFrame) -> DataFrame:
    """What keeps slots and sections from making a contract at all (template_id, problem)."""

    def told(rows: DataFrame, what: str, name: str) -> DataFrame:
        names = F.array_join(F.array_sort(F.collect_set(name)), ", ")
        return rows.groupBy("template_id").agg(F.concat(F.lit(what), names).alias("problem"))

    def repeated(column: Column) -> DataFrame:
        return slots.groupBy("template_id", column.alias("_name")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)

    key = ["template_id", "slot_id"]
    named = sections.select("template_id", F.explode("slot_ids").alias("slot_id")).distinct()
    return union_all(
        [
            told(repeated(F.col("slot_id")), "slot declared twice: ", "_name"),
            told(repeated(F.trim("placeholder")), "placeholder of two slots: ", "_name"),
            told(named.join(slots.select(*key), key, "left_anti"), "section names an unknown slot: ", "slot_id"),
            told(slots.select(*key).distinct().join(named, key, "left_anti"), "slot in no section: ", "slot_id"),
        ]
    )


def contracts(
    headers: DataFrame, sections: DataFrame, slots: DataFrame, anchors: DataFrame, regions: DataFrame, findings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(contracts, refusals): one contract per template version, and templates that can have none.

    ``headers`` is (template_id, version, extractor_version, docx_sha256, styles, static_map) with
    the last two as JSON text; ``slots`` and ``sections`` as `sidecar_tables` gives them,
    ``anchors`` (template_id, slot_id, idx, bookmark_id, in_table, cell_locator,
    structure_signature), ``regions`` (template_id, region_id, locator, text_sha256,
    token_count), ``findings`` (template_id, code, locator, detail). A contract's digest is that
    of its canonical JSON without the digest itself. One with findings must not be activated.
    Texts that are no JSON have no digest.
    """
    refusals = contract_refusals(sections, slots)
    empty = union_all(
        [
            headers.join(rows.select("template_id").distinct(), "template_id", "left_anti").select("template_id", F.lit(f"no {name}").alias("problem"))
            for rows, name in ((slots, "slots"), (sections, "sections"))
        ]
    )
    refusals = refusals.unionByName(empty)

    def gathered(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
        entry = F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_entry"))
        listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_entry"])
        return rows.groupBy("template_id").agg(listed.alias(name))

    placed = slot_order(anchors).withColumn("part", F.lit("document"))
    anchor = F.struct("part", "bookmark_id", "slot_order", "in_table", "cell_locator", "structure_signature").alias("anchor")
    anchored = slots.join(placed.select("template_id", "slot_id", anchor), ["template_id", "slot_id"], "left")
    slot_fields = ["slot_id", "placeholder", "kind", "required", "allow_user_omit", "semantic_requirement", "style_key", "anchor"]
    held = regions.withColumn("part", F.lit("document"))
    whole = (
        headers.join(refusals.select("template_id").distinct(), "template_id", "left_anti")
        .join(gathered(sections, "sections", ["section_pos"], ["section_id", "title", "slot_ids"]), "template_id")
        .join(gathered(anchored, "slots", ["slot_pos"], slot_fields), "template_id")
        .join(gathered(held, "static_regions", ["region_id"], ["region_id", "part", "locator", "text_sha256", "token_count"]), "template_id", "left")
        .join(gathered(findings, "unsupported_findings", ["code", "locator", "detail"], ["code", "locator", "detail"]), "template_id", "left")
    )
    for name in ("static_regions", "unsupported_findings"):
        whole = whole.withColumn(name, F.coalesce(name, F.array().cast(whole.schema[name].dataType)))
    hashes = F.struct("docx_sha256", sha(canonical_json(F.col("styles"))).alias("styles_sha256"), sha(canonical_json(F.col("static_map"))).alias("static_map_sha256"))
    body = F.struct(
        F.lit(1).alias("schema_version"), "template_id", "version", "extractor_version", hashes.alias("hashes"),
        "sections", "slots", "static_regions", "unsupported_findings",
    )
    rows = whole.withColumn("contract", _as_json(body)).select(
        "template_id", "version", "contract", sha(F.col("contract")).alias("contract_sha256"),
        F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda s: s["anchor"].isNotNull())).alias("n_anchored"),
        F.size("static_regions").alias("n_regions"), F.size("unsupported_findings").alias("n_findings"),
        (F.size("unsupported_findings") == 0).alias("activatable"),
    )
    return rows, refusals

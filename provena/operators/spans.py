"""Spans: exact slices of canonical text, with hashes the program computes itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.functions.digest import sha, stable_id
from provena.session import settle

#: Words of an anchor, the window by which a passage is looked up in the corpus.
ANCHOR_WORDS = 5


def span_status(start: Column, end: Column, total: Column) -> Column:
    """Why a requested span cannot be resolved; emptiness is looked at first."""
    return (
        F.when(start >= end, "empty")
        .when((start < 0) | (end > total), "out_of_range")
        .otherwise("ok")
    )


def resolve(materials: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, task_id, artifact_id, span_start, span_end) to spans.

    An artifact of another task and an unknown one give the same answer.
    """
    held = materials.select(
        "task_id", "artifact_id", "text",
        sha(F.col("text")).alias("_sha"), tx.code_points(F.col("text")).alias("_total"),
    )
    start, end = F.col("span_start"), F.col("span_end")
    status = F.when(F.col("text").isNull(), "not_found").otherwise(span_status(start, end, F.col("_total")))
    joined = requests.join(held, ["task_id", "artifact_id"], "left").withColumn("status", status)
    ok = F.col("status") == "ok"
    exact = F.when(ok, tx.slice_points(F.col("text"), start, end))
    return (
        joined.withColumn("exact_text", exact)
        .withColumn("canonical_sha256", F.when(ok, F.col("_sha")))
        .withColumn("span_sha256", sha(F.col("exact_text")))
        .withColumn("illegal_positions", tx.illegal_positions(F.col("exact_text")))
        .drop("text", "_sha", "_total")
    )


def verify(materials: DataFrame, refs: DataFrame) -> DataFrame:
    """Check refs against the text as it is now; the first failing rule names the status."""
    held = materials.select(
        "artifact_id", "text", sha(F.col("text")).alias("_sha"), tx.code_points(F.col("text")).alias("_total")
    )
    return (
        refs.join(held, "artifact_id", "left")
        .withColumn("status", ref_status(F.col("text"), F.col("_sha"), F.col("_total")))
        .drop("text", "_sha", "_total")
    )


def ref_status(text: Column, text_sha: Column, total: Column) -> Column:
    """Status of the ref columns of a row against a text on the same row."""
    start, end = F.col("span_start"), F.col("span_end")
    return (
        F.when(text.isNull(), "not_found")
        .when(F.col("canonical_sha256") != text_sha, "canonical_mismatch")
        .when((start < 0) | (end > total), "out_of_range")
        .when(start >= end, "empty")
        .when(F.col("span_sha256") != sha(tx.slice_points(text, start, end)), "span_mismatch")
        .otherwise("ok")
    )


def handles(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each resolved span its handle, reusing issued ones.

    A stored handle whose hashes moved is corrupt and gives no handle. New handles are
    made from the key, so issuing them twice, or on a retried task, yields the same one.
    """
    key = ["task_id", "artifact_id", "span_start", "span_end"]
    stored = existing.select(
        *key,
        F.col("span_handle").alias("_handle"),
        F.col("canonical_sha256").alias("_canonical"),
        F.col("span_sha256").alias("_span"),
    )
    known = F.col("_handle").isNotNull()
    moved = known & ((F.col("_canonical") != F.col("canonical_sha256")) | (F.col("_span") != F.col("span_sha256")))
    fresh = resolved.filter(F.col("status") == "ok").dropDuplicates(key)
    return (
        fresh.join(stored, key, "left")
        .withColumn("handle_status", F.when(moved, "corrupt").when(known, "reused").otherwise("issued"))
        .withColumn(
            "span_handle",
            F.when(moved, F.lit(None)).otherwise(
                F.coalesce(F.col("_handle"), stable_id("span", *[F.col(k) for k in key]))
            ),
        )
        .drop("_handle", "_canonical", "_span")
    )


def verified_refs(handles_used: DataFrame, issued: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Handles named by a task (task_id, span_handle) to refs, or why each is rejected.

    ``issued`` holds issued spans, ``artifacts`` (artifact_id, task_id, text, sha256).
    """
    spans = issued.select(
        "span_handle", F.col("task_id").alias("_owner"), "artifact_id",
        "canonical_sha256", "span_start", "span_end", "span_sha256",
    )
    held = artifacts.select(
        "artifact_id", F.col("task_id").alias("_holder"), F.col("sha256").alias("_registered"), "text",
        sha(F.col("text")).alias("_sha"), tx.code_points(F.col("text")).alias("_total"),
    )
    joined = handles_used.join(spans, "span_handle", "left").join(held, "artifact_id", "left")
    status = (
        F.when(F.col("_owner").isNull(), "never_issued")
        .when(F.col("_owner") != F.col("task_id"), "other_task")
        .when(F.col("_holder").isNull() | (F.col("_holder") != F.col("task_id")), "material_outside_task")
        .when(F.col("_registered") != F.col("_sha"), "no_longer_canonical")
        .otherwise(ref_status(F.col("text"), F.col("_sha"), F.col("_total")))
    )
    return joined.withColumn("status", status).drop("_owner", "_holder", "_registered", "text", "_sha", "_total")


def locate(materials: DataFrame, passages: DataFrame) -> DataFrame:
    """Every place where a material quotes a passage word for word, overlapping ones too.

    ``passages`` is (passage_id, quote). A quote holds its own inner words as whole words
    of the material, so a hash of a few inner words finds the candidates by an equi-join
    and the text confirms them. Bodies are joined back for candidates only. Quotes of fewer
    than three words have no inner word; ``_short_candidates`` finds theirs. An empty quote
    stands nowhere.
    """
    words = F.split(F.col("quote"), r"\s+")
    shaped = passages.filter(F.col("quote") != "").withColumn("_words", words).withColumn("_n", F.size("_words"))
    inner = F.slice(F.col("_words"), F.lit(2), F.col("_n") - 2)
    # The window with the most characters is the one least likely to be found elsewhere.
    places = F.sequence(F.lit(0), F.size(inner) - ANCHOR_WORDS)
    widest = F.array_max(
        F.transform(
            places,
            lambda i: F.struct(
                F.length(F.array_join(F.slice(inner, (i + 1).cast("int"), F.lit(ANCHOR_WORDS)), "")).alias("n"),
                _window_hash(inner, i, ANCHOR_WORDS).alias("hash"),
            ),
        )
    )
    long = shaped.filter(F.col("_n") >= ANCHOR_WORDS + 2).select(
        "passage_id", "quote", widest.getField("hash").alias("_anchor")
    )
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    short = shaped.filter((F.col("_n") >= 3) & (F.col("_n") < ANCHOR_WORDS + 2)).select(
        "passage_id", "quote", F.xxhash64(F.lit(1), longest.getField("word")).alias("_anchor")
    )
    tiny = settle(shaped.filter(F.col("_n") < 3).select("passage_id", "quote"), "short-quotes")

    probed = materials.select("artifact_id", F.split("text", r"\s+").alias("_words"))
    # Written down, the candidates have a known size: few are broadcast to the bodies, many
    # are joined to them.
    found = _candidates(probed, long, ANCHOR_WORDS).unionByName(_candidates(probed, short, 1))
    if not tiny.isEmpty():
        found = found.unionByName(_short_candidates(materials, tiny))
    candidates = settle(found.distinct(), "candidates")
    with_text = candidates.join(passages, "passage_id").join(materials.select("artifact_id", "text"), "artifact_id")
    # Digests once a text and quote, places after them.
    held = with_text.filter(F.contains(F.col("text"), F.col("quote"))).select(
        "passage_id", "artifact_id", sha(F.col("text")).alias("canonical_sha256"), sha(F.col("quote")).alias("span_sha256"),
        F.length("quote").cast("bigint").alias("_length"), tx.literal_positions(F.col("text"), F.col("quote")).alias("_places"),
    )
    return held.withColumn("span_start", F.explode("_places")).select(
        "passage_id", "artifact_id", "span_start", (F.col("span_start") + F.col("_length")).alias("span_end"), "canonical_sha256", "span_sha256"
    )


#: Characters by which short quotes are looked up in the vocabulary.
GRAM = 3


def _short_candidates(materials: DataFrame, tiny: DataFrame) -> DataFrame:
    """(artifact_id, passage_id) pairs for quotes of one or two words, which may be parts of
    longer words. The longest of them, or a quote of nothing but blanks, lies within one word
    or one run of blanks: it is looked up in the corpus's different ones by its first
    characters, and those lead to the texts that hold them."""
    visible = F.array_max(F.transform(F.split("quote", r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    piece = F.when(visible.getField("n") > 0, visible.getField("word")).otherwise(F.col("quote"))
    wanted = tiny.select("passage_id", piece.alias("_piece")).withColumn("_gram", F.substring("_piece", 1, GRAM))
    runs = F.array_distinct(F.concat(F.split("text", r"\s+"), F.split("text", r"\S+")))
    placed = materials.select("artifact_id", F.explode(F.filter(runs, lambda w: w != "")).alias("_run"))
    grams = F.flatten(F.transform(
        F.array(*[F.lit(n) for n in range(1, GRAM + 1)]),
        lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.length("_run")), lambda i: i + n - 1 <= F.length("_run")), lambda i: F.substring(F.col("_run"), i, n)),
    ))
    vocabulary = placed.select("_run").distinct().withColumn("_gram", F.explode(F.array_distinct(grams)))
    held = vocabulary.join(wanted, "_gram").filter(F.contains(F.col("_run"), F.col("_piece"))).select("_run", "passage_id")
    return placed.join(held, "_run").select("artifact_id", "passage_id")


def _window_hash(words: Column, at: Column, width: int) -> Column:
    window = F.array_join(F.slice(words, (at + 1).cast("int"), F.lit(width)), " ")
    return F.xxhash64(F.lit(width), window)


def _candidates(probed: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(artifact_id, passage_id) pairs that share an anchor. Each material names a hash once."""
    if width == 1:
        hashes = F.transform(F.array_distinct("_words"), lambda w: F.xxhash64(F.lit(1), w))
    else:
        starts = F.sequence(F.lit(0), F.size("_words") - width)
        hashes = F.array_distinct(F.transform(starts, lambda i: _window_hash(F.col("_words"), i, width)))
    exploded = probed.filter(F.size("_words") >= width).select("artifact_id", F.explode(hashes).alias("_anchor"))
    return exploded.join(anchors.select("passage_id", "_anchor"), "_anchor").select("artifact_id", "passage_id")

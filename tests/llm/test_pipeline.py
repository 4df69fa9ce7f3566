"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import random

import numpy as np
import tiktoken

import corpus_pipeline
from provena.llm import bpe, common, decontamination, langid, quality
from pyspark.sql import functions as F
from tests.llm.cases import frame, prose
from tests.llm.test_texts import RANKS, plain_components

ITEM = prose(random.Random(31), [f"ka{x}o" for x in "bcdfghjklm"], 25).capitalize() + "."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"aa": [f"ka{x}o" for x in "bcdfghjklm"] + [f"lo{x}i" for x in "bcdfghjklm"], "bb": [f"sch{x}er" for x in "bcdfghjklm"] + [f"un{x}ig" for x in "bcdfghjklm"]}
    rows, labels, junk = [], [], set()
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        text = prose(rng, words[lang], rng.randrange(25, 150)).capitalize() + "."
        if i % 6 == 5:
            text = "### ".join(w.upper() + "$$" for w in text.split())
            junk.add(i)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(i not in junk), 0))
    base = prose(rng, words["aa"], 60).capitalize() + "."
    rows += [(250, base, "aa", "s", 1), (300, base, "aa", "s", 1), (301, " ".join(["Other", *base.split()[1:]]), "aa", "s", 1), (302, rows[10][1] + " " + ITEM + " " + rows[12][1], "aa", None, None)]
    rows += [(400, None, None, None, None), (401, "", "aa", "s", 0), (402, "123 456", "aa", "s", 7), (None, rows[14][1], "aa", "s", 1)]
    return rows, labels, junk


def test_stages_do_what_plain_versions_do(spark, tmp_path):
    rows, labels, junk = corpus()
    frame(spark, rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir = str(tmp_path)
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if at < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / f"stage{at}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{at}"))
        kept[at] = docs.collect()
    ids = [[r["doc_id"] for r in kept[at]] for at in range(5)]
    everything = [i for i, *_ in rows]
    assert sorted(map(repr, ids[0])) == sorted(repr(i) for i in everything if i not in (400, 401, 402))
    # The models themselves, row by row.
    model = langid.fit(common.table(spark, sf_dir, "documents"))
    said = common.table(spark, sf_dir, "documents").select("doc_id", langid.identify(F.col("text"), model).alias("p")).collect()
    assert sorted(map(repr, ids[0])) == sorted(repr(r["doc_id"]) for r in said if not r["p"]["rejected"])
    first = spark.read.parquet(str(tmp_path / "stage0"))
    scorer = quality.fit(first, common.table(spark, sf_dir, "labels"))
    stats = np.array([quality.statistics(r["text"]) for r in kept[0]])
    assert sorted(map(repr, ids[1])) == sorted(repr(r["doc_id"]) for r, s in zip(kept[0], scorer.score(stats)) if s >= 0.7)
    assert len(ids[1]) > 0.75 * len(ids[0])
    second = [(r["doc_id"], r["text"]) for r in kept[1]]
    firsts = [repr(i) for (i, _), (_, c) in zip(second, plain_components(second)) if i == c]
    assert sorted(map(repr, ids[2])) == sorted(firsts)
    assert {300, 301} & set(ids[1]) and not {300, 301} & set(ids[2])
    leaks = {repr(r["doc_id"]) for r in kept[2] if ITEM in r["text"]}
    assert set(map(repr, ids[2])) - set(map(repr, ids[3])) == leaks == {"302"}
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    assert {r["doc_id"]: r["n_tokens"] for r in kept[4]} == {r["doc_id"]: len(coder.encode_ordinary(r["text"])) for r in kept[3]}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, kept[4]))


def test_empty_documents_pass_through(spark, tmp_path):
    frame(spark, [], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontamination.find(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "benchmark")).count() == 0

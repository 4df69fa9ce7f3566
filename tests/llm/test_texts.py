"""BPE, id shards, licences, decontamination and near copies against plain models."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from provena import session
from provena.llm import bpe, common, decontamination, idindex, jaccard, licenses
from tests.llm.cases import LONG, clashing, frame, odd_rows, prose

RANKS = common.resource(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
TOKENIZER = common.resource(common.tokenizer_path("byte_bpe_50k.json")).decode()
TRICKY = [
    "it's  two   blanks \n\n and lines", " leading", "trailing ", "  ", "a b 　 c", "x\x1cy", "don't've 1,234.5€ <|endoftext|>", "日本語 の 文章", "\U0001f600 ok",
    "tab\t\tthen", "a \nb", "''s ''", "ÀÉ ß", "end\n",
]


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def odd_docs(spark):
    rows = [(i, t) for i, t, _ in odd_rows()] + [(100 + i, t) for i, t in enumerate(TRICKY)]
    return rows, clashing(frame(spark, rows))


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    rows, docs = odd_docs(spark)
    got = bpe.decode(bpe.encode(docs.repartition(3), RANKS), RANKS).collect()
    expected = sorted((repr(i), np.array(coder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((repr(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == expected
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_ids_are_decoded_where_they_are_put_together(spark):
    from provena.llm.queries import op5

    rows, docs = odd_docs(spark)
    docs = docs.repartition(3)
    both, of = bpe.encode(docs, RANKS, decoded=True), lambda df: sorted(map(repr, df.collect()))
    assert of(both) == of(bpe.decode(bpe.encode(docs, RANKS), RANKS))
    assert bpe.encode(docs.limit(0), RANKS, decoded=True).count() == 0
    # One Python worker a task: no second Python step stands in the stage that puts ids together.
    for df in (both, op5(spark, "/root/testdata/sf0.001"), corpus_pipeline.encoded(spark, docs, "")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "EvalPython" not in plan
    with pytest.raises(ValueError, match="vocabulary lacks"):
        bpe.TokenBytes(RANKS).of(np.array([1, 1 << 20], "<u4").tobytes())


def test_workers_keep_no_coder_of_words(spark):
    def kept(batches):
        import gc
        import time

        for batch in batches:
            time.sleep(0.5)  # So that every idle worker gets a task.
            gc.collect()
            batch["id"] = sum(type(o).__module__.startswith("tiktoken") for o in gc.get_objects() if type(o).__name__ == "Encoding")
            yield batch

    bpe.encode(odd_docs(spark)[1].repartition(8), RANKS).collect()
    assert {r["id"] for r in spark.range(0, 16, 1, 16).mapInPandas(kept, "id long").collect()} == {0}


def test_id_shards_read_back_by_key(spark, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(TOKENIZER)
    rows, docs = odd_docs(spark)
    path = str(tmp_path / "ids")
    idindex.write(docs, TOKENIZER, path, idindex.Params(shard=50_000, block=5_000, keys=5))
    got = idindex.read(spark, path, docs).collect()
    ids = {(repr(i), tuple(coder.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows}
    assert {(repr(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got} == ids
    assert len(got) == len(rows)
    # One after another, in ascending order of the ids, without gaps.
    got = sorted(got, key=lambda r: r["start"])
    start, last = 0, -1
    for r in got:
        assert r["start"] == start and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        start, last = start + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    some = idindex.read(spark, path, frame(spark, [(5, "x"), (5, "y"), (999_999, "absent")])).collect()
    assert [r["doc_id"] for r in some] == [5, 5]
    empty = str(tmp_path / "none")
    idindex.write(docs.limit(0), TOKENIZER, empty)
    assert idindex.read(spark, empty, docs).count() == 0


def test_op3_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from provena.llm.queries import QUERIES

    coder = Tokenizer.from_str(TOKENIZER)
    rows = list(enumerate(["a text<|endoftext|>", "<|endoftext|>", "one  <|endoftext|> <|endoftext|>\n two", "<|endoftext|", "plain words", "", None, *TRICKY]))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: coder.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    assert 50256 in ids[0]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op3_idindex"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    built = idindex.build_hash(keys)
    slots = idindex.slot_of(keys, *built)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    prints = np.zeros(len(keys), np.uint32)
    prints[slots] = idindex.fingerprint(keys)
    others = np.arange(1_000_000, 1_050_000)
    found = idindex.slot_of(others, *built)
    hit = found >= 0
    assert (prints[found[hit]] == idindex.fingerprint(others[hit])).sum() == 0


def test_licences_match_whole_texts_in_any_spelling(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "MIT License text:\n" + mit), (2, mit.upper().replace(", ", " ,\n")), (3, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit),
        (4, "Some words.\nReleased under the MIT licence!\nmore words"), (5, "Released under the MIT License. And more"), (6, None), (7, ""), (8, LONG), (9, "Released under the MIT License."),
        (9, "Released under the MIT License."), (None, "  SPDX-License-Identifier:   MIT "),
    ]
    found = licenses.scan(clashing(frame(spark, rows)), licenses.built_in(spark))
    got = sorted((repr(r["doc_id"]), r["line_no"], r["license_id"]) for r in found.collect())
    assert got == sorted([("1", 2, "MIT"), ("2", 0, "MIT"), ("3", 0, "MIT"), ("3", 4, "MIT"), ("4", 2, "MIT"), ("9", 0, "MIT"), ("9", 0, "MIT"), ("None", 0, "MIT")])
    assert licenses.scan(frame(spark, []), licenses.built_in(spark)).count() == 0
    assert licenses.scan(frame(spark, rows), licenses.built_in(spark).limit(0)).count() == 0


def test_whole_wrapped_licence_files_and_notices(spark):
    whole = {i: max((t for k, t in licenses.KNOWN if k == i), key=len) for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0")}
    mit = "MIT License\n\nCopyright (c) 2021 Someone Else\n\n" + textwrap.fill(licenses.KNOWN[0][1], 78) + "\n"
    bsd = next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause" and t.startswith("Redistribution") and "1. " in t)
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n" + textwrap.fill(bsd, 78)
    lines = [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0")]
    rows = [(1, mit), (2, bsd), *((3 + k, f"words\n{line}\nwords") for k, (line, _) in enumerate(lines)), *((10 + k, textwrap.indent(t, "  ")) for k, t in enumerate(whole.values()))]
    got = sorted((r["doc_id"], r["line_no"], r["license_id"]) for r in licenses.scan(frame(spark, rows), licenses.built_in(spark)).collect() if r["line_no"] == 0 or r["doc_id"] < 10)
    assert got == sorted([(1, 0, "MIT"), (2, 0, "BSD-3-Clause"), *((3 + k, 2, i) for k, (_, i) in enumerate(lines)), *((10 + k, 0, i) for k, i in enumerate(whole))])


BIG = [(1 << 53) + 1, (1 << 63) - 1, -(1 << 63) + 1]


def test_large_ids_beside_nulls_stay_what_they_are(spark, tmp_path):
    rows = [(None, "a text of some words that has no id"), *((i, f"text {i} of some words that has one") for i in BIG)]
    docs = frame(spark, rows).coalesce(1)
    want = sorted(map(repr, [None, *BIG]))
    of = lambda df: sorted(repr(r[0]) for r in df.collect())
    assert of(bpe.encode(docs, RANKS).select("doc_id")) == want
    idindex.write(docs, TOKENIZER, str(tmp_path / "ids"))
    assert of(idindex.read(spark, str(tmp_path / "ids"), docs).select("doc_id")) == want
    assert of(jaccard.join(docs).select("doc_id")) == want
    assert {r["component_id"] for r in jaccard.join(docs).collect()} == {None, *BIG}


def test_finished_chunks_and_coders_are_freed_without_the_collector():
    import gc
    import weakref

    gc.disable()
    try:
        words = bpe.Words()
        words.read("some words and some words again")
        coder = idindex.Coder(TOKENIZER, False)
        coder.encode("some words <|endoftext|> again")
        gone = [weakref.ref(words), weakref.ref(words.pieces), weakref.ref(coder), weakref.ref(coder.pieces)]
        del words, coder
        assert [g() for g in gone] == [None] * 4
    finally:
        gc.enable()


def test_new_pieces_of_a_text_are_split_in_one_call(monkeypatch):
    import regex

    find, calls = regex.compile(bpe.PATTERN).findall, []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return find(text)

    monkeypatch.setattr(regex, "compile", lambda pattern: Counted())
    rng = random.Random(3)
    blanks = ["".join(rng.choice(" \n\ta b'1é\x1c\x85\u3000") for _ in range(rng.randrange(14))) for _ in range(5_000)]
    words, noted = bpe.Words(), bpe.Words()
    for text in [*TRICKY, *blanks, LONG]:
        del calls[:]
        numbers = np.frombuffer(words.read(text), np.uint32).tolist()
        assert len(calls) <= 3
        known = list(words.numbers)
        assert [known[i] for i in numbers] == find(text)
        noted.note(text)
    assert set(noted.numbers) == set(words.numbers)


def test_new_words_of_a_text_are_merged_together():
    import json

    from tokenizers import Tokenizer

    library, parsed, words = Tokenizer.from_str(TOKENIZER), json.loads(TOKENIZER), [f"word{i}é" for i in range(1_000)]
    alone = {**parsed, "model": {**parsed["model"], "ignore_merges": True}}
    for model, content in ((parsed, TOKENIZER), (alone, json.dumps(alone))):
        ids, begins = idindex._merger(content, model, "<u2")(words)
        ids = np.frombuffer(ids, "<u2").tolist()
        want = [Tokenizer.from_str(content).encode(w, add_special_tokens=False).ids for w in words[:3]]
        assert [ids[i:j] for i, j in zip(begins[:3], begins[1:4])] == want and begins[-1] == len(ids)
    coder, asked = idindex.Coder(TOKENIZER, False), []
    make = coder.pieces.make
    coder.pieces.make = lambda new: asked.append(len(new)) or make(new)
    text = "a " + " ".join(words)
    for _ in range(2):
        assert np.frombuffer(coder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == [1_000]


def test_a_coder_forgets_when_full():
    coder, other = idindex.Coder(TOKENIZER, False, held=2000), idindex.Coder(TOKENIZER, False)
    for text in [*TRICKY, LONG[:50_000]]:
        assert coder.encode(text) == other.encode(text)
        assert coder.words.bytes < 2_000_000


ITEM = "The train from Berlin to Hamburg leaves at 14:30 and needs 95 minutes; how many km does Anna ride if it goes 120 km/h on the way from Berlin?"


def test_decontamination_finds_exchanged_slots_only_if_consistent(spark):
    other = ITEM.replace("Berlin", "Lisbon").replace("Hamburg", "Porto").replace("14:30", "9:05").replace("95", "180").replace("Anna", "Bruno").replace("120", "80")
    mixed = other.replace("from Lisbon?", "from Madrid?")
    filler = prose(random.Random(1), "and or but the a of to in on at by for with".split(), 40)
    rows = [
        (1, f"{filler}. {ITEM} {filler}"), (2, f"{filler}.\n{other}\n{filler}"), (3, filler), (4, None), (5, ""), (6, LONG), (7, ITEM.upper()), (None, ITEM),
        (8, ITEM), (8, ITEM), (9, mixed), (10, "how many words does it take to say nothing at all in a long line of text"),
    ]
    items = frame(spark, [(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, ITEM)], "item_id long, text string")
    docs = clashing(frame(spark, rows))
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find(docs, items).collect()}
    assert set(got) >= {(1, 1), (2, 1), (None, 1), (8, 1)} and not {d for d, _ in got} & {3, 4, 5, 6, 9, 10}
    assert got[1, 1]["exact"] and not got[2, 1]["exact"]
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [d for d in (3, 4, 5, 6, 7, 9, 10) if d != 7 or (7, 1) not in got]
    assert decontamination.find(docs.limit(0), items).count() == 0
    assert decontamination.find(docs, items.limit(0)).count() == 0


def test_short_items_are_one_window(spark):
    items = frame(spark, [(1, "six small words make this item")], "item_id long, text string")
    rows = [(1, "well, six small words make this item."), (2, "six small words make another item")]
    assert [r["doc_id"] for r in decontamination.find(frame(spark, rows), items).collect()] == [1]


def test_items_without_a_window_are_found_verbatim(spark):
    sums = " ".join(f"{i} + {i + 3} = {2 * i + 3};" for i in range(11, 40))
    thai, chinese = "น้ำเดือดที่อุณหภูมิเท่าไร", "水在标准大气压下的沸点是多少度"
    items = frame(spark, [(1, "What is 15% of 240?"), (2, "Define osmosis."), (3, sums), (4, chinese), (5, thai), (6, "")], "item_id long, text string")
    rows = [
        (1, "Q: What is 15% of 240? A: 36"), (2, "Q: What is 20% of 240?"), (3, "please define osmosis now"), (4, "define the osmosis"), (5, f"so {sums} and so on"),
        (6, sums.replace("39 + 42", "39 + 43")), (7, f"问题：{chinese}？答案"), (8, "水在高山上的沸点是多少"), (9, f"ถาม{thai}ตอบ"), (10, None), (11, ""),
    ]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.find(docs, items).collect()}
    assert got == {(1, 1): True, (3, 2): True, (5, 3): True, (7, 4): True, (9, 5): True}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [2, 4, 6, 8, 10, 11]


def plain_sets(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    return [shingles(t) for _, t in rows]


def plain_components(rows):
    sets = plain_sets(rows)
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    low = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and (low[top(i)] is None or doc_id < low[top(i)]):
            low[top(i)] = doc_id
    return [(len(s), low[top(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def corpus(seed):
    """Copies, near copies around the threshold, short texts, and texts that share passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = prose(rng, words, 60)
    rows = []
    for _ in range(12):
        base = prose(rng, words, rng.choice([6, 9, 15, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 5, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rows += [f"{shared} {prose(rng, words, n)}" for n in (5, 10, 10, 30, 60, 200) for _ in range(4)]
    rows += ["a", "A", "b c", "B\tC", "b  c d", "one two three four", "ONE two three four", "", None, "  "]
    rng.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(clashing(frame(spark, rows).repartition(5))).collect()}
    assert got == {i: e for (i, _), e in zip(rows, plain_components(rows))}


def test_jaccard_of_odd_rows_and_firsts(spark):
    rows = [(i, t) for i, t, _ in odd_rows()] + [(9, LONG + " more"), (50, "a text without an id that has some words"), (None, "nobody owns this text of words"), (None, "nobody owns this text of words")]
    docs = clashing(frame(spark, rows))
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in jaccard.join(docs).collect())
    expected = sorted((repr(i), n, repr(c)) for (i, _), (n, c) in zip(rows, plain_components(rows)))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert got == expected
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    texts = sorted((repr(r["doc_id"]), r["text"] or "") for r in kept.select("doc_id", "text").collect())
    gone = [("None", "a text without an id that has some words"), ("5", odd_rows()[5][1]), ("9", LONG + " more"), ("None", "nobody owns this text of words")]
    expected = sorted((repr(i), t or "") for i, t in rows)
    for row in gone:
        expected.remove(row)
    assert texts == expected
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.first_of_each(docs.limit(0)).count() == 0


def test_groups_of_lists_are_sized_by_all_their_entries(spark):
    from pyspark.sql import functions as F

    p = jaccard.Params()
    sets = [np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)) for n in range(1, 90)]
    sizes = frame(spark, [(len(s),) for s in sets], "size long")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for light in (0, 4, 16, 64, 512):
        counted = {r["size"]: r["n"] for r in sizes.select("size", jaccard.key_count(F.col("size"), light, p).alias("n")).collect()}
        assert counted == {len(s): len(jaccard.keys_of(s, none, light, p)[0]) for s in sets}


def test_hot_group_yields_few_pairs_and_all_links(spark):
    rng = random.Random(9)
    base = prose(rng, [f"w{i}" for i in range(500)], 80).split()
    rows = []
    for i in range(300):
        text = list(base)
        for k in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"new{i}x{k}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, plain_components(rows))}


def test_near_copies_broadcast_small_sides_only(spark, monkeypatch):
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    seen, former, settle = [], spark.conf.get(key), session.settle
    monkeypatch.setattr(session, "settle", lambda df, name: (seen.append(df.sparkSession.conf.get(key)), settle(df, name))[1])
    rows = corpus(4)
    docs, want = frame(spark, rows).repartition(5), {i: c for (i, _), (_, c) in zip(rows, plain_components(rows))}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == want
    assert len(seen) > 5 and set(seen) == {"4m"} and spark.conf.get(key) == former
    # The result does not hang on what is broadcast.
    monkeypatch.setattr(jaccard, "SIDE", "-1")
    monkeypatch.setattr(jaccard, "TEXTS", 0)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == want
    assert sorted(r["doc_id"] for r in jaccard.first_of_each(docs).collect()) == sorted(i for i, c in want.items() if i == c)
    with pytest.raises(ZeroDivisionError), session.setting(spark, key, "1m"):
        raise ZeroDivisionError
    assert spark.conf.get(key) == former


def test_digests_are_those_of_the_contract(spark):
    rows = [(1, "Zwei Wörter"), (2, None)]
    ids = bpe.encode(frame(spark, rows), RANKS).collect()
    assert {r["doc_id"]: hashlib.sha256(bytes(r["ids"])).hexdigest() for r in ids}[2] == hashlib.sha256(b"").hexdigest()
    assert zlib.crc32(np.array([2], "<u4").tobytes()) > 0

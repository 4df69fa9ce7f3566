"""Token ids in shards of raw bytes, with a minimal perfect hash index by document key.

Documents are put in ascending order of their key by range, encoded, and written as blocks of
raw ids. An index maps each key to its place: a cascade of bit arrays gives every key of an
index part a number of its own below the count of keys (a minimal perfect hash), under which
lie a fingerprint of the key and where its rows begin. Reading a key looks at a few bits, one
fingerprint and one slice of one block.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import operator
import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena import session
from provena.llm import common
from provena.llm.bpe import PATTERN, odd, pieces_of, split_all

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """shard: characters of text in a shard on average. block: ids after which a block is
    closed; a longer document is a block. keys: of an index part on average. end: the id
    appended to every document. added: whether the file's added tokens have their own ids
    where a text holds them, as the library has it; else they are text. held: bytes of words
    and pieces that a worker remembers."""

    shard: int = 32_000_000
    block: int = 2_000_000
    keys: int = 100_000
    end: int = 2
    added: bool = True
    held: int = 200_000_000


def _alphabet() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(rest)}}


class _Found(dict):
    """Remembers what a function makes of texts, within so many bytes: once they are full,
    what was asked for since is kept, and what was not asked for until they are full again goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.bytes, self.limit, self.older = make, 0, limit // 2, {}

    def all(self, keys: list[str], refused=None) -> list[bytes] | None:
        """What is made of each of ``keys``; None if one that is not known is refused."""
        found = list(map(self.get, keys))
        if None in found:
            lacking = {k for k, f in zip(keys, found) if f is None}
            if not self._learn(lacking, refused):
                return None
            found = [self[k] if f is None else f for k, f in zip(keys, found)]
        if self.bytes > self.limit:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        return found

    def _learn(self, keys: set[str], refused) -> bool:
        made = {k: self.older[k] for k in keys if k in self.older} if self.older else {}
        fresh = [k for k in keys if k not in made]
        if refused and any(map(refused, fresh)):
            return False
        made.update(zip(fresh, self.make(fresh) if fresh else ()))
        self.update(made)
        # A place in a dict has some 70 bytes.
        self.bytes += 70 * len(made) + sum(map(sys.getsizeof, made)) + sum(map(sys.getsizeof, made.values()))
        return True


#: Words whose bytes are merged in one call of the library; pieces or words that a text looks up at once.
JOINED, RUN = 100, 100_000


def _merger(content: str, parsed: dict, kind: str):
    """A function of words that gives their ids in a row, raw, and where each word's begin, with the end.

    The library's model merges byte letters. Words are given to it together, with the byte 255
    between them, which UTF-8 lacks: where no token but its own holds that byte, nothing is
    merged over it. A vocabulary or model of another kind has its words one by one."""
    from tokenizers import Tokenizer

    tokenize, alphabet, model, gap = Tokenizer.from_str(content).model.tokenize, _alphabet(), parsed["model"], chr(255)
    number, letters, vocab = operator.attrgetter("id"), np.array([alphabet[b] for b in range(256)], "<u2"), model.get("vocab") or {}
    alone = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "unk_token"))
    joined = 1 if alone or model.get("type") != "BPE" or [t for t in vocab if gap in t] != [gap] else JOINED

    def merged(words: list[str]) -> tuple[bytes, list[int]]:
        ids, ends = [], []
        for i in range(0, len(words), joined):
            raw = b"\xff".join([w.encode("utf-8", "replace") for w in words[i : i + joined]])
            ids += map(number, tokenize(letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")))
            if joined == 1:
                ends.append(len(ids))
            else:
                ids.append(vocab[gap])
        flat = np.array(ids, np.int64)
        if joined > 1:
            at = np.flatnonzero(flat == vocab[gap])
            if len(at) != len(words):
                raise ValueError("words were merged with each other")
            flat, ends = flat[flat != vocab[gap]], (at - np.arange(len(at))).tolist()
        return flat.astype(kind).tobytes(), [0, *ends]

    return merged


class Coder:
    """Encodes whole texts with a tokenizers file, each different piece once as long as the
    memory holds it. A text falls apart before every single blank between two words, and
    such a piece by the pattern; the library's model merges each word. What is new in a text
    is split and merged together. With ``added`` a text is first split at the file's added
    tokens. Nothing here refers to itself: a coder that is let go is freed at once."""

    def __init__(self, content: str, wide: bool, added: bool = True, held: int = Params.held):
        import regex

        find, kind, parsed = regex.compile(PATTERN).findall, "<u4" if wide else "<u2", json.loads(content)
        merged, width = _merger(content, parsed, kind), np.dtype(kind).itemsize

        def words(new: list[str]) -> list[bytes]:
            raw, begins = merged(new)
            return [raw[width * i : width * j] for i, j in itertools.pairwise(begins)]

        def pieces(new: list[str]) -> list[bytes]:
            found, starts = split_all(find, new)
            raw, begins = merged(found)
            return [raw[width * begins[i] : width * begins[j]] for i, j in itertools.pairwise(starts)]

        self.find, self.words, self.pieces = find, _Found(words, held // 4), _Found(pieces, held - held // 4)
        # Of several at one place the longest counts.
        tokens = sorted(parsed.get("added_tokens") or [] if added else [], key=lambda t: -len(t["content"]))
        self.own = [np.array([t["id"]], kind).tobytes() for t in tokens]
        self.added = re.compile("|".join(self._mark(t) for t in tokens)).finditer if tokens else None

    @staticmethod
    def _mark(token: dict) -> str:
        whole = f"({re.escape(token['content'])})"
        if token.get("single_word"):
            whole = rf"(?<!\w){whole}(?!\w)"
        return (r"\s*" if token.get("lstrip") else "") + whole + (r"\s*" if token.get("rstrip") else "")

    def encode(self, text: str | None) -> bytes:
        if not text or not self.added:
            return self._plain(text)
        out, at = [], 0
        for found in self.added(text):
            out += [self._plain(text[at : found.start()]), self.own[found.lastindex - 1]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _whole(self, text: str) -> bytes:
        words = self.find(text)
        return b"".join([f for i in range(0, len(words), RUN) for f in self.words.all(words[i : i + RUN])])

    def _plain(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = pieces_of(text)
        if parts is None:
            return self._whole(text)
        head, rest, tail = parts
        out = [self._whole(head)]
        for i in range(0, len(rest), RUN):
            found = self.pieces.all(rest[i : i + RUN], odd)
            if found is None:
                return self._whole(text)
            out += found
        return b"".join([*out, self._whole(tail)])


def write(docs: DataFrame, tokenizer: str, path: str, p: Params = Params()) -> None:
    """Write ids and index of ``docs`` below ``path``, a folder that all executors share.

    ``docs`` has doc_id and text; other columns are not read. ``tokenizer`` is the content of
    a tokenizers file. Null texts count as empty and still get the end id. Rows without an
    id come first; of equal ids the smaller text hash.

    payload: shard, block, n_ids, ids (raw), and by row keys, known and where its ids begin
    (``begins``, one more than rows). index: part, words of the cascade's bits with how many
    are set before each, and by slot the fingerprint and the places.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(size) // p.shard + 1)
    wide = _ids(tokenizer) > 1 << 16
    kind, digest = "<u4" if wide else "<u2", hashlib.sha256(tokenizer.encode()).hexdigest()
    # Ranges of the order, not of ids alone, so that a key of many rows spreads as well.
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select(F.col("doc_id").cast("string"), "text")
    )

    def blocks(batches):
        from pyspark import TaskContext

        # One for all tasks of a worker: words that come in every shard are merged once.
        coder, end = common.per_worker(("Coder", digest, p.added, p.held), lambda: Coder(tokenizer, wide, p.added, p.held)), np.array([p.end], kind).tobytes()
        shard, number, width = TaskContext.get().partitionId(), itertools.count(), np.dtype(kind).itemsize
        ids, parts, held = [], [], 0

        def closed():
            begins = np.cumsum([0, *(len(b) // width for b in parts)], dtype=np.int64)
            return pd.DataFrame({
                "shard": [shard], "block": [next(number)], "n_ids": [int(begins[-1])], "ids": [b"".join(parts)], "begins": [begins],
                "keys": [np.array([0 if k is None else k for k in ids], np.int64)], "known": [np.array([k is not None for k in ids])],
            })

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if doc_id is None else int(doc_id))
                parts.append(coder.encode(text) + end)
                held += len(parts[-1]) // width
                if held > p.block:
                    yield closed()
                    ids, parts, held = [], [], 0
        if ids:
            yield closed()

    schema = "shard int, block int, n_ids long, ids binary, begins array<long>, keys array<long>, known array<boolean>"
    ordered.mapInPandas(blocks, schema).withColumn("wide", F.lit(wide)).write.parquet(f"{path}/payload")
    spark = docs.sparkSession
    payload = spark.read.parquet(f"{path}/payload")
    # One number per shard, as many as there are tasks: their sum so far is where each begins.
    totals = payload.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = list(itertools.accumulate((r["n"] for r in totals), initial=0))
    spark.createDataFrame([(r["shard"], b) for r, b in zip(totals, before)], "shard int, before long").coalesce(1).write.parquet(f"{path}/shards")

    runs = _runs(payload)
    parts = max(1, payload.agg(F.sum(F.size("keys"))).first()[0] or 0) // p.keys + 1
    keyed = runs.withColumn("part", F.when(F.col("known"), F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(parts).cast("int"))
    keyed.groupBy("part").applyInPandas(_index_part, INDEX).withColumn("parts", F.lit(parts)).write.parquet(f"{path}/index")


def _ids(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True)


def _runs(payload: DataFrame) -> DataFrame:
    """One row per block and key: its first row in the block and how many rows it has."""
    rows = payload.select("shard", "block", F.posexplode(F.arrays_zip("keys", "known")).alias("row", "z"))
    return rows.groupBy(F.col("z.keys").alias("key"), F.col("z.known").alias("known"), "shard", "block").agg(
        F.min("row").alias("row"), F.count("*").cast("int").alias("rows")
    )


INDEX = "part int, n int, sizes array<int>, bits binary, ranks binary, fingerprints binary, first binary, places binary"
_PLACE = np.dtype([("shard", "<i4"), ("block", "<i4"), ("row", "<i4"), ("rows", "<i4")])


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers for each seed: different keys stay different."""
    x = keys.astype(np.int64).view(np.uint64) + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1_000_003) >> _U(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bit arrays of a cascade for different ``keys``, as words of 64 bits, and how many bits
    are set before each word: in each level a key that has a cell to itself sets its bit, the
    others go on to the next level."""
    sizes, levels, left = [], [], keys
    while len(left):
        size = max(64, 2 * len(left))
        cell = (_mixed(left, len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(cell, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[cell]]
    bits = np.concatenate([*levels, np.zeros(-sum(sizes) % 64, bool)])
    words = np.packbits(bits, bitorder="little").view("<u8")
    return sizes, words, np.cumsum(np.bitwise_count(words), dtype=np.uint32) - np.bitwise_count(words)


def slot_of(keys: np.ndarray, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The number of each key, below the count of keys; -1 for one that the cascade lacks.

    A key looks at one word and one count in each level that it goes through, two or so."""
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        cell = base + (_mixed(keys[left], level) % _U(size)).astype(np.int64)
        word, bit = words[cell >> 6], (cell & 63).astype(np.uint64)
        hit = (word >> bit) & _U(1) == 1
        below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
        slot[left[hit]] = (ranks[cell >> 6] + below)[hit]
        left, base = left[~hit], base + size
        if not len(left):
            break
    return slot


def _index_part(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["key", "shard", "block"])
    keys, counts = np.unique(group["key"].to_numpy(np.int64), return_counts=True)
    sizes, words, ranks = build_hash(keys)
    slots = slot_of(keys, sizes, words, ranks)
    prints = np.zeros(len(keys), np.uint32)
    prints[slots] = fingerprint(keys)
    # Places in the order of slots; ``first`` says where each slot's begin.
    by = np.argsort(slots)
    starts = np.cumsum(counts) - counts
    order = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in by]) if len(by) else np.zeros(0, np.int64)
    places = np.zeros(len(group), _PLACE)
    for name in _PLACE.names:
        places[name] = group[name].to_numpy()[order]
    first = np.concatenate([[0], np.cumsum(counts[by])]).astype("<i8")
    return pd.DataFrame({
        "part": [int(group["part"].iloc[0])], "n": [len(keys)], "sizes": [np.array(sizes, np.int32)], "bits": [words.tobytes()], "ranks": [ranks.astype("<u4").tobytes()],
        "fingerprints": [prints.tobytes()], "first": [first.tobytes()], "places": [places.tobytes()],
    })


def _looked_up(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({c: [] for c in ("key", "shard", "block", "row", "rows")})
    if not len(index) or not len(wanted):
        return none
    part = index.iloc[0]
    keys = wanted["key"].to_numpy(np.int64)
    sizes = [int(s) for s in part["sizes"]]
    slots = slot_of(keys, sizes, np.frombuffer(part["bits"], "<u8"), np.frombuffer(part["ranks"], "<u4"))
    known = slots >= 0
    known[known] = np.frombuffer(part["fingerprints"], np.uint32)[slots[known]] == fingerprint(keys[known])
    keys, slots = keys[known], slots[known]
    first = np.frombuffer(part["first"], "<i8")
    counts = first[slots + 1] - first[slots]
    before = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(first[slots] - before, counts)
    places = np.frombuffer(part["places"], _PLACE)[at]
    return pd.DataFrame({"key": np.repeat(keys, counts), **{n: places[n] for n in _PLACE.names}})


def read(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of the wanted keys.

    ``keys`` has doc_id, each wanted once however often it stands there; null asks for the
    rows without an id. All rows of a key are returned, in no order; a key that was never
    written gives none (a fingerprint alone lets one in 2**32 through, so the key is also
    compared with the block's).
    """
    index, payload = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/payload")
    first = index.select("parts").limit(1).collect()
    parts = first[0]["parts"] if first else 1
    asked = keys.select("doc_id").distinct().select(
        F.coalesce("doc_id", F.lit(0)).alias("key"),
        F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).otherwise(parts).cast("int").alias("part"),
    )
    places = index.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(_looked_up, "key long, shard int, block int, row int, rows int")
    sizes = payload.select("shard", "block", "n_ids").join(spark.read.parquet(f"{path}/shards"), "shard")
    begin = sizes.select("shard", "block", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("begin"))
    blocks = payload.join(begin, ["shard", "block"])

    def sliced(block, wanted):
        if not len(block) or not len(wanted):
            return pd.DataFrame({c: [] for c in ("doc_id", "start", "n_tokens", "ids")})
        b = block.iloc[0]
        kind = "<u4" if b["wide"] else "<u2"
        raw = np.frombuffer(b["ids"], kind)
        begins = np.asarray(b["begins"], np.int64)
        known, own = np.asarray(b["known"], bool), np.asarray(b["keys"], np.int64)
        rows = np.concatenate([np.arange(r, r + n) for r, n in zip(wanted["row"], wanted["rows"])])
        asked_for = np.repeat(wanted["key"].to_numpy(np.int64), wanted["rows"].to_numpy(np.int64))
        rows = rows[own[rows] == asked_for]
        return pd.DataFrame({
            "doc_id": pd.array([int(own[r]) if known[r] else None for r in rows], "Int64"), "start": b["begin"] + begins[rows],
            "n_tokens": begins[rows + 1] - begins[rows], "ids": [raw[begins[r] : begins[r + 1]].astype("<u4").tobytes() for r in rows],
        })

    return blocks.groupBy("shard", "block").cogroup(places.groupBy("shard", "block")).applyInPandas(sliced, "doc_id long, start long, n_tokens long, ids binary")


def folder(spark: SparkSession) -> str:
    return session.work_dir(spark, "id-index")

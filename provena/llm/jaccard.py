"""Similarity join of documents by the Jaccard similarity of their word n-grams, size-aware.

Equal sets collapse into one node. Nodes meet under keys that similar sets must share, given
one order of all shingles, frequent ones last: a set of ``s`` shingles that overlaps another
in at least ``o`` has its first ``c`` common shingles among its first ``s - o + c``. Light
sets, smaller than a boundary, enumerate the subsets of two of those shingles; heavy sets
scan the inverted list of each of their first ``s - o + 1``. The boundary is the size at which
the counted keys and list entries cost least. Under each key all nodes are first compared
with one; what that does not join is compared across the components found so far, so a group
of copies never yields all its pairs, and no link that matters is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import session
from provena.llm import common, components


@dataclass(frozen=True)
class Params:
    """words: of a shingle. num/den: the least Jaccard similarity as a fraction. ordered: how
    many of the most frequent shingles have a place of their own at the end of the order;
    the order of the others does not follow their frequency. It steers the work and not
    the result. entries: list entries that one group holds on average."""

    words: int = 5
    num: int = 3
    den: int = 4
    ordered: int = 200_000
    entries: int = 600_000


#: Shingles that a task holds before it counts the repeated ones, or keys before it sends them.
HELD = 2_000_000
#: Cost of visiting one list entry, in units of the cost of sending one key.
VISIT = 0.02

_U = np.uint64
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: a polynomial of its bytes, whatever stands around it."""
    b = np.frombuffer(blob, np.uint8)
    blank = _BLANK[b]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    powers = np.empty(len(b) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * powers[:-1], dtype=np.uint64)])
    # Divide by the power of the start: its inverse is a power of the inverse base.
    back = np.full(len(b) + 1, _inverse(int(_BASE)), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _shingled(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted different shingle hashes of one document's word hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _U(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
    return np.unique(mix(total))


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each whole text, a megabyte at a time."""
    out: list[np.ndarray] = []
    blobs = [(t or "").encode("utf-8", "replace").translate(_LOWER) + b" " for t in texts]
    at = 0
    while at < len(blobs):
        end, size = at, 0
        while end < len(blobs) and (end == at or size + len(blobs[end]) <= 1 << 20):
            size += len(blobs[end])
            end += 1
        starts, words = _word_hashes(b"".join(blobs[at:end]))
        cuts = np.searchsorted(starts, np.cumsum([0, *map(len, blobs[at:end])]))
        out += [_shingled(words[i:j], n) for i, j in zip(cuts[:-1], cuts[1:])]
        at = end
    return out


def node_of(shingles: np.ndarray) -> int:
    """The identity of a set: a 64-bit digest of its elements. Two different sets of n have
    the same one with a chance of n * n / 2**65, and must also be equally large to meet."""
    with np.errstate(over="ignore"):
        a = mix(shingles * _U(0xC2B2AE3D27D4EB4F) + _U(len(shingles)))
        return int(mix(np.array([a.sum(dtype=np.uint64) ^ (_U(len(shingles)) * _BASE)]))[0].astype(np.int64))


def _profiles(docs: DataFrame, p: Params) -> DataFrame:
    """kind 0: a document's node and size. kind 1: a shingle that several different sets of
    some texts read together share, and in how many."""
    cols = ["kind", "doc_id", "node", "size", "token", "seen"]

    def counted(held, n):
        tokens, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        tokens, seen = tokens[seen > 1], seen[seen > 1]
        return pd.DataFrame({"kind": 1, "doc_id": None, "node": None, "size": None, "token": tokens.view(np.int64), "seen": seen})[cols]

    def run(batches):
        held, n, known = [], 0, set()
        common.give_back()
        for batch in batches:
            sets = shingle_sets(batch["text"], p.words)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"], "node": pd.array(nodes, "Int64"), "size": [len(s) for s in sets], "token": None, "seen": None})[cols]
            for s, node in zip(sets, nodes):
                if node is not None and node not in known:
                    known.add(node)
                    held.append(s)
                    n += len(s)
            if n > HELD:
                yield counted(held, n)
                held, n, known = [], 0, set()
                common.give_back()
        yield counted(held, n)
        held, known = [], set()
        common.give_back()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "kind int, doc_id string, node long, size int, token long, seen long")
    return found.withColumn("doc_id", common.as_id(F.col("doc_id")))


def needed(size, p: Params):
    """The least overlap of a set with any set similar to it."""
    return -(-size * p.num // p.den)


def boundary(sizes: dict[int, int], mean_list: float, p: Params) -> int:
    """Sets below this size are light. Chosen so that keys and list visits cost least.

    ``sizes``: how many sets there are of each size; ``mean_list``: entries of the list of an
    average shingle."""
    best, least = 0, np.inf
    for x in (0, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512):
        cost = 0.0
        for s, n in sizes.items():
            first = s - needed(s, p) + 1
            if s < x:
                cost += n * (first + 1) * first / 2
            if s * p.den >= x * p.num:
                cost += n * first * (1 + VISIT * mean_list)
        if cost < least:
            best, least = x, cost
    return best


def key_count(size: Column, light: int, p: Params) -> Column:
    """How many keys :func:`keys_of` gives for a set of a size."""
    first = size - F.ceil(size * p.num / p.den) + 1
    subsets = F.when((size > 1) & (size < light), F.least(first + 1, size) * (F.least(first + 1, size) - 1) / 2).otherwise(0)
    return (subsets + F.when((size > 1) & (size * p.den >= light * p.num), first).otherwise(0)).cast("long")


def keys_of(shingles: np.ndarray, order: tuple[np.ndarray, np.ndarray], light: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which a set meets others, how much of it lies from there on, and which keys
    are subsets of two."""
    s = len(shingles)
    tokens, places = order
    at = np.searchsorted(tokens, shingles)
    at[at == len(tokens)] = 0
    frequent = np.where(tokens[at] == shingles, places[at], 0) if len(tokens) else np.zeros(s, np.int64)
    ranked = mix(shingles ^ _U(0x5851F42D4C957F2D))
    first = s - int(needed(s, p)) + 1
    chosen = np.lexsort((ranked, frequent))[: first + 1]
    ordered = shingles[chosen]
    keys, reach, pairs = [], [], []
    if s < light and s > 1:
        i, j = np.triu_indices(min(first + 1, s), 1)
        keys.append(mix(ordered[i] * _U(0xA0761D6478BD642F) + ordered[j]))
        reach.append(s - j + 1)
        pairs.append(np.ones(len(i), bool))
    if s * p.den >= light * p.num and s > 1:
        keys.append(mix(ordered[:first]))
        reach.append(s - np.arange(first))
        pairs.append(np.zeros(first, bool))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(reach), np.concatenate(pairs)


_PLANES = {"key": np.uint32, "node": np.int64, "size": np.uint32, "reach": np.uint32, "pair": np.uint8}


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns byte plane by byte plane, which is where their regularity lies."""
    planes = [c.astype(_PLANES[k]).view(np.uint8).reshape(len(c), -1).T.tobytes() for k, c in columns.items()]
    return zstandard.compress(b"".join(planes), 3)


def _unpack(blob: bytes, n: int) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, {}
    for k, kind in _PLANES.items():
        width = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out[k] = np.ascontiguousarray(part).view(kind).ravel()
        at += n * width
    return out


def _lists(docs: DataFrame, order, light: int, buckets: int, p: Params) -> DataFrame:
    """Packed list entries by bucket of their key."""

    def packed(nodes, sizes, parts):
        keys = np.concatenate([k for k, _, _ in parts])
        repeat = [len(k) for k, _, _ in parts]
        bucket = ((keys >> _U(32)) % _U(buckets)).astype(np.int64)
        low = (keys & _U(0xFFFFFFFF)).astype(np.uint32)
        by = np.lexsort((low, bucket))
        columns = {"key": low, "node": np.repeat(nodes, repeat), "size": np.repeat(sizes, repeat), "reach": np.concatenate([r for _, r, _ in parts]), "pair": np.concatenate([f for _, _, f in parts])}
        columns = {k: c[by] for k, c in columns.items()}
        bucket = bucket[by]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
        rows = [(int(bucket[i]), j - i, _pack({k: c[i:j] for k, c in columns.items()})) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pd.DataFrame(rows, columns=["bucket", "n", "entries"])

    def run(batches):
        nodes, sizes, parts, n, known = [], [], [], 0, set()
        for batch in batches:
            for s in shingle_sets(batch["text"], p.words):
                node = node_of(s) if len(s) else None
                if node is None or node in known:
                    continue
                known.add(node)
                nodes.append(node)
                sizes.append(len(s))
                parts.append(keys_of(s, order, light, p))
                n += len(parts[-1][0])
                if n > HELD:
                    yield packed(nodes, sizes, parts)
                    nodes, sizes, parts, n = [], [], [], 0
                    common.give_back()
            if len(known) > 1_000_000:
                known = set()
        if parts:
            yield packed(nodes, sizes, parts)
        nodes, sizes, parts, known = [], [], [], set()
        common.give_back()

    return docs.select("text").mapInPandas(run, "bucket int, n int, entries binary")


def _first_pairs(lists: DataFrame, p: Params) -> DataFrame:
    """For each bucket: pairs of every node with the first of its list, and the entries of
    lists that hold two nodes or more."""

    def run(group):
        parts = [_unpack(e, n) for e, n in zip(group["entries"], group["n"])]
        e = {k: np.concatenate([x.pop(k) for x in parts]) for k in _PLANES}
        by = np.lexsort((e["node"], e["pair"], e["key"]))
        e = {k: c[by] for k, c in e.items()}
        # Copies read by different tasks are one entry.
        new = np.ones(len(by), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["pair"][1:] != e["pair"][:-1]) | (e["node"][1:] != e["node"][:-1])
        e = {k: c[new] for k, c in e.items()}
        head = np.ones(len(e["key"]), bool)
        head[1:] = (e["key"][1:] != e["key"][:-1]) | (e["pair"][1:] != e["pair"][:-1])
        number = np.cumsum(head) - 1
        starts = np.flatnonzero(head)
        shared = np.bincount(number)[number] > 1
        # The first of a list is the node that has least of its own before the key: of a group
        # of copies the one that was changed least, which most others are similar to.
        own = np.lexsort((e["node"], -(e["reach"] / e["size"]), number))
        pivot = own[starts][number]
        del by, new, head, own, e["key"]
        a, b = e["node"][pivot], e["node"]
        small, large = np.minimum(e["size"][pivot], e["size"]).astype(np.int64), np.maximum(e["size"][pivot], e["size"]).astype(np.int64)
        need = -(-(small + large) * p.num // (p.num + p.den))
        ok = shared & (pivot != np.arange(len(number))) & (small * p.den >= large * p.num) & (np.minimum(e["reach"][pivot], e["reach"]) >= need)
        pairs = np.unique(np.stack([a[ok], b[ok]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
        del pivot, a, b, small, large, need, ok
        common.give_back()
        return pd.DataFrame({
            "bucket": [int(group["bucket"].iloc[0])], "a": [pairs[:, 0]], "b": [pairs[:, 1]], "list": [number[shared].astype(np.int64)],
            "node": [e["node"][shared]], "size": [e["size"][shared].astype(np.int64)], "reach": [e["reach"][shared].astype(np.int64)], "pair": [e["pair"][shared].astype(np.int64)],
        })

    return lists.groupBy("bucket").applyInPandas(
        run, "bucket int, a array<long>, b array<long>, list array<long>, node array<long>, size array<long>, reach array<long>, pair array<long>"
    )


#: Sets that are compared with one copy of a set; beyond that the set is sent again.
BESIDE = 2_000
#: Bytes of sets that a task holds before it sends them on.
SENT = 16_000_000


def _narrow(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, as they travel. Two sets of n shingles agree in one that
    they do not share with a chance of n * n / 2**48, and it would have to be the one that
    they lack."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verified(docs: DataFrame, owners: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose sets are similar, by their whole sets.

    Each set is made where its text is read and sent once for each pair as ``b``, and once
    for each part of its pairs as ``a``; there it is held while the others stream by."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BESIDE).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("node"), F.struct("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role")).alias("r"))
    heads = parts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a").select("node", F.struct("a", "part", F.lit(0).alias("role")).alias("r"))
    # A node is compared with the few first nodes of its lists, or it is such a node itself.
    wanted = members.unionByName(heads).groupBy("node").agg(F.collect_list("r").alias("roles")).join(owners, "node")
    wanted = session.settle(wanted.select("owner", "node", "roles"), "wanted-sets")

    def sets(batches):
        for batch in batches:
            rows, held = [], 0
            found = shingle_sets(batch["text"], p.words)
            for s, node, roles in zip(found, batch["node"], batch["roles"]):
                if len(s) and node_of(s) == node:
                    raw = _narrow(s)
                    for r in roles:
                        rows.append((r["a"], r["part"], r["role"], node, raw))
                        held += len(raw)
                        if held > SENT:
                            yield pd.DataFrame(rows, columns=["a", "part", "role", "b", "shingles"])
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=["a", "part", "role", "b", "shingles"])
            del rows, found
            common.give_back()

    def similar(batches):
        head, own = None, None
        for batch in batches:
            keep = []
            for a, part, role, blob in zip(batch["a"], batch["part"], batch["role"], batch["shingles"]):
                s = _wide(blob)
                if role == 0:
                    head, own = (a, part), s
                    keep.append(False)
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True)) if head == (a, part) else 0
                keep.append(both * p.den >= p.num * (len(own) + len(s) - both))
            yield batch.loc[keep, ["a", "b"]]

    own = docs.select(F.col("doc_id").alias("owner"), "text").join(common.sized(wanted, TEXTS), "owner").select("node", "roles", "text")
    sent = own.mapInPandas(sets, "a long, part int, role int, b long, shingles binary")
    met = sent.repartition("a", "part").sortWithinPartitions("a", "part", "role", "b")
    return session.settle(met.mapInPandas(similar, "a long, b long").distinct(), "similar")


#: Nodes of a list that the others are compared with in one round; how many pairs across
#: components there may be for each list entry to compare them all; and what a round must
#: leave at most of them for another one to follow. One list in ``SOME`` takes part. NOISE
#: is how much the rank of a node varies from round to round.
PIVOTS, FEW, SLOW, SOME, NOISE = 3, 2, 0.7, 8, 0.05


def _fits(x: str, y: str, p: Params):
    """What sizes, and the rest of both sets from a shared key on, allow."""
    small, large = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & (small * p.den >= large * p.num) & (F.least(f"{x}.reach", f"{y}.reach") * (p.num + p.den) >= (small + large) * p.num)


def _pivoted(split: DataFrame, turn: int, p: Params) -> DataFrame:
    """Nodes outside the largest component of a list with a few nodes in it, others in
    every round: those that have least of their own before the key, more or less."""
    entry = F.struct("node", "size", "reach", "comp")

    def rank(k: int):
        noise = F.pmod(F.xxhash64(F.lit(turn * PIVOTS + k), "node"), F.lit(1000)) / 1000
        return F.struct((-F.col("reach") / F.col("size") * (1 - NOISE * (turn > 0 or k > 0) * noise)).alias("h"), F.col("node").alias("i"))

    picks = [F.min(F.struct(rank(k).alias("h"), entry.alias("y"))).alias(f"p{k}") for k in range(PIVOTS)]
    each = split.groupBy("bucket", "list", "comp").agg(F.count("*").alias("n"), *picks)
    largest = F.max_by(F.array_distinct(F.array(*[f"p{k}.y" for k in range(PIVOTS)])), F.struct("n", "comp")).alias("ys")
    pivots = each.groupBy("bucket", "list").agg(largest).select("bucket", "list", F.explode("ys").alias("y"))
    met = split.alias("x").join(pivots, ["bucket", "list"]).where(_fits("x", "y", p))
    # The pivot first: it is held while the others stream by.
    return met.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))


def _placed(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries of those lists that hold nodes of several components, with the components."""
    placed = entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by = placed.groupBy("bucket", "list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket", "list")
    return session.settle(placed.join(by, ["bucket", "list"]), "split-lists")


def _across(split: DataFrame, light: int, p: Params) -> DataFrame:
    """All pairs of nodes of a list that are not in one component."""
    x, y = split.alias("x"), split.alias("y")
    # Two light sets are left to their subsets.
    fits = _fits("x", "y", p) & (F.col("x.node") < F.col("y.node")) & ((F.col("x.pair") == 1) | (F.greatest("x.size", "y.size") >= light))
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.list") == F.col("y.list")) & fits)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


#: A broadcast lies in the driver as collected rows, as a hash table of twice their bytes and in
#: blocks. Joins of this operator are many and close together, so what one run of them leaves
#: is still there when the next ones come: only sides up to SIDE bytes are broadcast. TEXTS is
#: how many rows at most go to where texts are read; beyond that texts are shuffled.
SIDE, TEXTS = "4m", 250_000


def _forest(comps: DataFrame) -> DataFrame:
    return comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))


def join(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and the numbers of its set and
    of its component (node and comp, null without a word).

    ``docs`` has doc_id and text; other columns are not read. component_id is the smallest
    doc_id that links lead to. Texts without a word, null and empty ones among them, link
    with nothing and have component_id = doc_id. Rows of one id are documents of their
    own. Rows without an id belong to documents of the same set, and else to none: their
    component_id is then null. The rows are written before they are returned.
    """
    with session.setting(docs.sparkSession, "spark.sql.adaptive.autoBroadcastJoinThreshold", SIDE):
        return session.settle(_joined(docs, p), "components")


def _joined(docs: DataFrame, p: Params) -> DataFrame:
    profiles = session.settle(_profiles(docs, p), "set-profiles")
    mine = profiles.where("kind = 0")
    # Light and heavy, the order, and the number of groups: all from counts over every text.
    seen = profiles.where("kind = 1").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 3")
    frequent = seen.orderBy(F.desc("seen"), "token").limit(p.ordered).toPandas()
    by = np.argsort(frequent["token"].to_numpy().astype(np.int64).view(np.uint64))
    order = frequent["token"].to_numpy().astype(np.int64).view(np.uint64)[by], frequent["seen"].to_numpy().astype(np.int64)[by]
    totals = mine.agg(F.sum("size").alias("tokens")).first()
    sizes = {int(r["size"]): int(r["count"]) for r in mine.where("size between 2 and 700").groupBy("size").count().collect()}
    tokens = float(totals["tokens"] or 0)
    counts = order[1].astype(float)
    mean_list = ((counts**2).sum() + max(tokens - counts.sum(), 0)) / max(tokens, 1)
    light = boundary(sizes, mean_list, p)
    listed = mine.agg(F.sum(key_count(F.col("size"), light, p))).first()[0] or 0
    buckets = max(16, int(listed / p.entries) + 1)

    owners = session.settle(mine.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies")), "set-owners")
    met = session.settle(_first_pairs(_lists(docs, order, light, buckets, p), p), "met-sets")
    pairs = session.settle(met.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b").distinct(), "pairs")
    named = owners.where("owner is not null").select("node", "owner")
    links = _verified(docs, named, pairs, p)
    tried = pairs
    entries = met.select("bucket", F.explode(F.arrays_zip("list", "node", "size", "reach", "pair")).alias("z")).select("bucket", "z.*")
    # Rounds bring the nodes of a group together by some of its lists; they save work and
    # decide nothing, for all lists are looked at after them.
    some = session.settle(entries.where(F.pmod(F.xxhash64("bucket", "list"), F.lit(SOME)) == 0), "some-lists")
    turn, before = 0, float("inf")
    while True:
        comps = components.connected(links)
        some = _placed(some, comps)
        each = some.groupBy("bucket", "list", "comp").agg(F.count("*").alias("n")).groupBy("bucket", "list").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        sums = each.agg(F.sum("n").alias("entries"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("across")).first()
        across = float(sums["across"] or 0)
        if across <= FEW * (sums["entries"] or 0) or across > SLOW * before:
            break
        more = session.settle(_pivoted(some, turn, p).distinct().join(tried, ["a", "b"], "left_anti"), "more-pairs")
        some, turn, before = some.drop("comp"), turn + 1, across
        # A component is as well told by its nodes' links to the first of them.
        links = session.settle(_forest(comps).unionByName(_verified(docs, named, more, p)), "links-so-far")
        tried = session.settle(tried.unionByName(more), "tried")
    apart = _across(_placed(entries, comps), light, p).distinct().join(tried, ["a", "b"], "left_anti")
    apart = session.settle(apart.join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        comps = components.connected(_forest(comps).unionByName(_verified(docs, named, apart, p)))
    grouped = owners.join(comps, "node", "left").select("node", "owner", F.coalesce("comp", "node").alias("comp"))
    lowest = grouped.groupBy("comp").agg(F.min("owner").alias("component_id"))
    classes = session.settle(grouped.join(lowest, "comp").select("node", "component_id", "comp"), "classes")
    rows = mine.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "node").join(classes, "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "comp")


def first_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with all their columns, of each component the document of the smallest id.

    Texts without a word are no copies of each other and all stay. Where an id stands in
    several rows, one row of it stays in each component that it is the first of; rows
    without an id stay only where no row of their set has one, and then once per set.
    """
    rows = join(docs, p)
    again = session.settle(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    own, node, comp, key = common.fresh(docs, "own_id", "own_node", "own_first", "own_component")
    gone = rows.where("node is not null and doc_id <> component_id").select("doc_id").unionByName(again.where("doc_id is not null")).distinct()
    gone = session.settle(gone.withColumnRenamed("doc_id", own), "copies")
    kept = docs.where(F.col("doc_id").isNotNull()).join(common.sized(gone, TEXTS), F.col("doc_id") == F.col(own), "left_anti")
    if again.isEmpty():
        return kept

    @F.pandas_udf("long")
    def node_of_text(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(s) if len(s) else None for s in shingle_sets(texts, p.words)], dtype="Int64")

    # Rows whose id does not name them: their set does.
    several = docs.join(common.sized(again.withColumnRenamed("doc_id", own), TEXTS), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    several = several.withColumn(node, node_of_text.asNondeterministic()(F.col("text")))
    known = rows.where("node is not null").select(F.col("node").alias(own), F.col("component_id").alias(comp), F.col("comp").alias(key)).distinct()
    placed = several.where(F.col(node).isNotNull()).join(known, F.col(node) == F.col(own)).where(F.col("doc_id").eqNullSafe(F.col(comp)))
    placed = placed.dropDuplicates([key])
    return kept.unionByName(placed.select(*docs.columns)).unionByName(several.where(F.col(node).isNull()).select(*docs.columns))

"""Byte-level BPE over a corpus in which each distinct word is encoded once.

Documents are read in chunks of some megabytes. A chunk is split into pre-tokens; its
different words go to groups by a hash of the word, where every word of the corpus meets its
copies from all chunks and is encoded once; the ids go back to the chunks that asked, which
put them together by position. What travels is packed: the words of a chunk in sorted order,
and the positions as numbers of words. Decoding joins ids to the table of token bytes, in the
process that put them together where both are wanted.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm import common

#: Fixed value: the pattern that the rank files were made with; each match is merged alone.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that a chunk holds before it is closed; a longer text is one chunk.
CHUNK = 6_000_000
#: Characters of corpus for each group of words.
GROUP = 6_000_000


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class TokenBytes:
    """The bytes that ids of a vocabulary stand for. The table has one row per id, a size fixed
    by the rank file; it travels to every task and ids are looked up in it."""

    def __init__(self, ranks: bytes):
        pairs = sorted((rank, token) for token, rank in ranks_of(ranks).items())
        self.lengths = np.zeros(pairs[-1][0] + 1, np.int64)
        for rank, token in pairs:
            self.lengths[rank] = len(token)
        self.flat, self.starts = np.frombuffer(b"".join(token for _, token in pairs), np.uint8), np.cumsum(self.lengths) - self.lengths

    def of(self, blob: bytes) -> bytes:
        """The bytes of ids that stand as little-endian unsigned 32-bit integers; an id that
        the vocabulary lacks is an error."""
        ids = np.frombuffer(blob, "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        return _gathered(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


def _squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32, by byte plane."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unsqueeze(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _words_blob(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 3)


def _words_list(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
    return [raw[i:j] for i, j in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of ``flat`` one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total) + np.repeat(starts - before, lengths)]


def pieces_of(text: str) -> tuple[str, list[str], str] | None:
    """What stands before the first single blank of a text, the pieces between such blanks, and
    the end with its blank if it is one or ends with other white space. None if white space is
    seen beside an outer blank; beside the others :func:`odd` finds it."""
    head, *rest = text.split(" ")
    if not rest:
        return head, rest, ""
    if head[-1:].isspace() or rest[-1][:1].isspace():
        return None
    if not rest[-1] or rest[-1][-1].isspace():
        return head, rest, " " + rest.pop()
    return head, rest, ""


def odd(piece: str) -> bool:
    """Whether more white space than one blank stands on a side of a piece."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def split_all(find, pieces: list[str]) -> tuple[list[str], list[int]]:
    """Pre-tokens of pieces that are not odd, each with its blank, and where each piece's begin,
    with the end. The pieces are split as one text: a blank begins a piece and nothing else."""
    found = find(" " + " ".join(pieces))
    starts = [i for i, w in enumerate(found) if w[0] == " "]
    if len(starts) != len(pieces):
        raise ValueError("a pre-token reaches over a blank")
    return found, [*starts, len(found)]


class _Pieces(dict):
    """Numbers of the pre-tokens of a piece, with the blank before it."""


class Words:
    """Numbers the different pre-tokens of a chunk in the order in which they first come.

    A text falls apart before every single blank between two other characters: no pre-token
    reaches over such a place, and a piece splits alone as it does in the text. So every
    different piece is split once, those that are new in a text together. Texts with other
    white space beside a blank are split whole.
    """

    def __init__(self):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        self.pieces = _Pieces()
        self.seen: set[str] = set()

    def _numbered(self, words: list[str]) -> bytes:
        return array("I", map(self.numbers.__getitem__, words)).tobytes()

    def read(self, text: str) -> bytes:
        """Numbers of the text's pre-tokens, as unsigned 32-bit integers."""
        parts = pieces_of(text)
        if parts is None:
            return self._numbered(self.find(text))
        head, rest, tail = parts
        pieces = self.pieces
        new = [p for p in set(rest) if p not in pieces]
        if any(map(odd, new)):
            return self._numbered(self.find(text))
        if new:
            found, starts = split_all(self.find, new)
            raw = self._numbered(found)
            pieces.update(zip(new, [raw[4 * i : 4 * j] for i, j in itertools.pairwise(starts)]))
        return b"".join([self._numbered(self.find(head)), *map(pieces.__getitem__, rest), self._numbered(self.find(tail))])

    def note(self, text: str) -> None:
        """The same pre-tokens, only to know which there are."""
        parts = pieces_of(text)
        if parts is not None:
            head, rest, tail = parts
            new = set(rest) - self.seen
            if not any(map(odd, new)):
                self.seen |= new
                found = itertools.chain(self.find(head), self.find(tail), self.find(" " + " ".join(new)) if new else ())
                self.numbers.update(dict.fromkeys(found, 0))
                return
        self.numbers.update(dict.fromkeys(self.find(text), 0))

    def sorted(self, groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by group, in a group by their bytes; where each group begins; and where a
        number went. It depends on which words there are alone."""
        raw = [w.encode("utf-8", "replace") for w in self.numbers]
        part = np.fromiter((zlib.crc32(w) % groups for w in raw), np.int64, len(raw))
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(groups + 1))
        by = list(itertools.chain.from_iterable(sorted(by[i:j].tolist(), key=raw.__getitem__) for i, j in zip(cuts[:-1], cuts[1:])))
        order = np.empty(len(by), np.int64)
        order[by] = np.arange(len(by))
        return [raw[i] for i in by], cuts, order


def _in_chunks(batches):
    """Chunk ids, and the ids and texts of each chunk's documents.

    A chunk is named by the scan's partition and its place in it, and so is the same chunk
    whenever the table is read."""
    from pyspark import TaskContext

    base, number, ids, texts, size = TaskContext.get().partitionId() << 32, itertools.count(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids.append(None if doc_id is None else int(doc_id))
            texts.append(text or "")
            size += len(texts[-1]) + 16
            if size > CHUNK:
                yield base + next(number), ids, texts
                ids, texts, size = [], [], 0
                common.give_back()
    if ids:
        yield base + next(number), ids, texts


def _asked(docs: DataFrame, groups: int) -> DataFrame:
    """chunk, part (the group), n and words: the different words of each chunk."""

    def run(batches):
        for chunk, _, texts in _in_chunks(batches):
            words = Words()
            for text in texts:
                words.note(text)
            listed, cuts, _ = words.sorted(groups)
            rows = [(chunk, g, int(cuts[g + 1] - cuts[g]), _words_blob(listed[cuts[g] : cuts[g + 1]])) for g in np.flatnonzero(np.diff(cuts)).tolist()]
            yield pd.DataFrame(rows, columns=["chunk", "part", "n", "words"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "chunk long, part int, n int, words binary")


def _holders(docs: DataFrame, groups: int) -> DataFrame:
    """Of each chunk: its documents' ids, their numbers of pre-tokens, the positions' words,
    and the place of each word among all of the chunk."""

    def run(batches):
        for chunk, ids, texts in _in_chunks(batches):
            words = Words()
            slots = [words.read(text) for text in texts]
            _, _, order = words.sorted(groups)
            yield pd.DataFrame({
                "chunk": [chunk], "ids": [np.array([i or 0 for i in ids], np.int64)], "known": [np.array([i is not None for i in ids])],
                "lengths": [np.array([len(s) // 4 for s in slots], np.int64)], "slots": [_squeeze(np.frombuffer(b"".join(slots), np.uint32))], "order": [_squeeze(order)],
            })

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "chunk long, ids array<long>, known array<boolean>, lengths array<long>, slots binary, order binary")


def encode(docs: DataFrame, ranks: bytes, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text; with
    ``decoded`` also that column of :func:`decode`, made where a chunk's ids are put together.
    That takes one Python worker a task where the two calls take two, and ids travel once.

    ``docs`` has doc_id and text; other columns are not read. ``ranks`` is the content of a
    rank file. Null texts count as empty and have no ids; every row gives a row, repeated
    ids and null ids too. ``docs`` is read twice and must give the same partitions both
    times, as a stored table does; where it does not, the job fails.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(16, int(size) // GROUP + 1)

    coders = []  # Made once a task and gone with it: later steps have no use for its 20 MB.

    def encoded(group):
        import tiktoken

        if not coders:
            coders.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(ranks), special_tokens={}))
        asked = [_words_list(w, n) for w, n in zip(group["words"], group["n"])]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(asked)))}
        # One by one: the library's batch makes a future of each word, which costs far more than the word.
        found = [coders[0].encode_ordinary(w.decode("utf-8")) for w in distinct]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        rows = []
        for chunk, part, words in zip(group["chunk"], group["part"], asked):
            at = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            rows.append((chunk, part, len(words), _squeeze(lengths[at]), _squeeze(_gathered(flat, starts[at], lengths[at]))))
        del asked, distinct, found, flat
        common.give_back()
        return pd.DataFrame(rows, columns=["chunk", "part", "n", "lengths", "ids"])

    back = TokenBytes(ranks) if decoded else None
    columns = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    known = _asked(docs, groups).groupBy("part").applyInPandas(encoded, "chunk long, part int, n int, lengths binary, ids binary")
    holders = _holders(docs, groups)

    def assembled(holder, answers):
        common.give_back()
        if len(holder) != 1:
            raise ValueError("the documents were read in other chunks the second time")
        row = holder.iloc[0]
        answers = answers.sort_values("part")
        none = [np.zeros(0, np.uint32)]
        lengths = np.concatenate([*map(_unsqueeze, answers["lengths"]), *none]).astype(np.int64)
        flat = np.concatenate([*map(_unsqueeze, answers["ids"]), *none])
        starts = np.cumsum(lengths) - lengths
        order = _unsqueeze(row["order"])
        if len(order) != len(lengths):
            raise ValueError("the documents were read in other chunks the second time")
        slots = _unsqueeze(row["slots"])
        ends = np.cumsum(np.asarray(row["lengths"], np.int64))
        ids, begin = [], 0
        for end in ends.tolist():
            mine = order[slots[begin:end]]
            ids.append(_gathered(flat, starts[mine], lengths[mine]).tobytes())
            begin = end
        del lengths, flat, starts, order, slots, answers
        common.give_back()
        doc_id = pd.array([i if k else None for i, k in zip(row["ids"], row["known"])], "Int64")
        out = {"doc_id": doc_id, "n_tokens": [len(i) // 4 for i in ids], "ids": ids}
        return pd.DataFrame(out | {"decoded": list(map(back.of, ids))} if back else out, columns=columns)

    kinds = dict(zip(columns, ["long", "long", "binary", "binary"]))
    return holders.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(assembled, ", ".join(f"{c} {kinds[c]}" for c in columns))


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes that its ids stand for. An id that the
    vocabulary lacks fails the job."""
    back = TokenBytes(ranks)

    @F.pandas_udf("binary")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(map(back.of, batch)), dtype=object)

    return encoded.withColumn("decoded", joined(F.col("ids")))

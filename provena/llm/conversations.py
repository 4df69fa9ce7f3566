"""Repair of conversations at least cost, with Four-Russians block tables.

A conversation is a string of symbols, one a row: who speaks, and whether the row must go or
is cut off. A cheapest repair is a walk over four states (nothing yet, after the system, the
user, the assistant). For each state there is the cost still to come; less its smallest
number, such a vector is one of a few dozen, and what a block of symbols makes of each of them
is looked up in a table. Rows are read from the last to the first that way; going back,
blocks are expanded and every row takes the least letter among its cheapest edits.

Rows are sorted by range, so that a conversation of any length lies in pieces of bounded size.
Those inside a piece are finished there; of the others each piece gives a table of costs from
state to state, the tables are put together, and each piece is traced from where it is entered.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import session

#: Costs of the edits, and of keeping a row that is cut off.
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after the system, after the user, after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of the user or the assistant leads, whichever may stand there.
TURN = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 40
#: Fixed value: blanks.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Params:
    """block: symbols of a block. rows, chars: of a piece, on average."""

    block: int = 4
    rows: int = 20_000
    chars: int = 16_000_000


def symbol(role: str, gone: bool, cut: bool) -> int:
    """0 for a row that must go; else 1 to 4 by the role's initial, or 5 to 8 if cut off."""
    return 0 if gone else 1 + ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * bool(cut)


def _kept(state: int, who: int) -> int | None:
    """Where a row kept as it is leads; who: 0 system, 1 user, 2 assistant, 3 others."""
    if who == 0:
        return SYSTEM if state == START else None
    return TURN[state] if TURN[state] == who + 1 else None


def _edits(state: int, sym: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row, in the order of letters."""
    out = [("D", DELETE, state)]
    if sym:
        who, extra = (sym - 1) % 4, CUT * (sym > 4)
        if (to := _kept(state, who)) is not None:
            out.append(("K", extra, to))
        out.append(("R", RENAME + extra, TURN[state]))
    return out


def _with_inserts(costs: list[int]) -> list[int]:
    one = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return [min(NEVER, c, INSERT + one[TURN[q]]) for q, c in enumerate(one)]


class Tables:
    """Cost vectors less their smallest number, and what symbols and blocks make of them."""

    def __init__(self, size: int):
        self.size = size
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.end, _ = self._id(_with_inserts([0, NEVER, NEVER, 0]))
        self.units = [self._id(_with_inserts([0 if q == f else NEVER for q in range(4)]))[0] for f in range(4)]
        steps, at = [], 0
        while at < len(self.vectors):
            steps.append([self._id(self._before(self.vectors[at], sym)) for sym in range(9)])
            at += 1
        self.step = [[v for v, _ in row] for row in steps]
        self.rise = [[c for _, c in row] for row in steps]
        self.acts = [[[self._act(v, sym, q) for q in range(4)] for sym in range(9)] for v in range(len(self.vectors))]
        # A block's first symbol counts most; blocks are read from their last symbol on.
        one, up = np.array(self.step), np.array(self.rise)
        to, cost = one, up
        for _ in range(size - 1):
            cost = np.concatenate([cost + up[to, s] for s in range(9)], 1)
            to = np.concatenate([one[to, s] for s in range(9)], 1)
        self.block_to, self.block_cost = to.tolist(), cost.tolist()

    def _id(self, costs) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least if c < NEVER // 2 else NEVER for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    def number(self, costs) -> tuple[int, int]:
        """The vector that these costs are, less their smallest number; all that occur are known."""
        least = min(costs)
        return self.known[tuple(c - least if c < NEVER // 2 else NEVER for c in costs)], least

    @staticmethod
    def _before(after, sym: int) -> list[int]:
        return _with_inserts([min(cost + after[to] for _, cost, to in _edits(q, sym)) for q in range(4)])

    def _act(self, after: int, sym: int, state: int) -> tuple[str, int] | None:
        """The least letters that take a row of this symbol, and the state they lead to."""
        costs, here, letters = self.vectors[after], self._before(self.vectors[after], sym), ""
        if here[state] >= NEVER // 2:
            return None
        while True:
            edits = [(letter, cost + costs[to], to) for letter, cost, to in _edits(state, sym)]
            edits.append(("I", INSERT + here[TURN[state]], TURN[state]))
            letter, _, to = min(e for e in edits if e[1] == here[state])
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state

    def read(self, symbols: bytes, end: int) -> tuple[int, int, list[int]]:
        """Cost, the vector before the first symbol, and the vectors after every block."""
        size, lead = self.size, len(symbols) % self.size
        codes = (np.frombuffer(symbols, np.uint8)[lead:].reshape(-1, size) @ (9 ** np.arange(size)[::-1])).tolist()
        cost, v, after = 0, end, []
        for code in reversed(codes):
            after.append(v)
            cost += self.block_cost[v][code]
            v = self.block_to[v][code]
        after.append(v)
        for sym in reversed(symbols[:lead]):
            cost += self.rise[v][sym]
            v = self.step[v][sym]
        return cost, v, after[::-1]

    def trace(self, symbols: bytes, after: list[int], state: int, last: bool) -> tuple[str, int]:
        """Letters for the rows from a state on, and the state they lead to; at the ``last``
        piece with what must still be inserted behind them."""
        letters, lead = [], len(symbols) % self.size
        begins, ends = [0, *range(lead, len(symbols), self.size)], [lead, *range(lead + self.size, len(symbols) + 1, self.size)]
        for begin, end, v in zip(begins, ends, after):
            vectors = [v]
            for sym in symbols[begin:end][:0:-1]:
                vectors.append(self.step[vectors[-1]][sym])
            for sym, own in zip(symbols[begin:end], reversed(vectors)):
                some, state = self.acts[own][sym][state]
                letters.append(some)
        while last and state in (SYSTEM, USER):
            letters.append("I")
            state = TURN[state]
        return "".join(letters), state


@functools.lru_cache(4)
def tables(size: int) -> Tables:
    return Tables(size)


def lines(letters: str, state: int, roles, texts) -> Iterator[str]:
    """The rows that edits leave, from a state on, as ``role:text``."""
    rows, name = iter(zip(roles, texts)), {USER: "user", ASSISTANT: "assistant"}
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and role[0] == "s" else TURN[state]
        yield f"{role if letter == 'K' else name[state]}:{text}"


def illegal(initials) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage that depends on a row's id and turn alone.

    crc32 of ``conv_id:turn`` modulo 20 says which: 0 drops the row, 1 empties its text, 2
    takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    Nulls count as one space, and so do null roles and texts, which come out as such.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows as the tasks need them; ``k`` names a conversation, and a null id is one as well."""
    k = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(k.alias("k"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    bare = F.rtrim("text", F.lit(BLANKS))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("*", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), digest.alias("digest"))


PIECES = (
    "k string, piece int, pos long, role string, text string, blank boolean, cut boolean, digest binary, "
    "n_blank long, n_duplicate long, n_truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def _whole(k: str, rows: list, t: Tables) -> tuple:
    """The result of a conversation whose rows are all here."""
    seen, symbols, counts = set(), bytearray(), [0, 0, 0]
    for role, _, blank, cut, digest in rows:
        again = digest in seen
        seen.add(digest)
        fault = 0 if blank else 1 if again else 2 if cut else None
        if fault is not None:
            counts[fault] += 1
        symbols.append(symbol(role, blank or again, cut))
    symbols = bytes(symbols)
    cost, v, after = t.read(symbols, t.end)
    letters, _ = t.trace(symbols, after, START, True)
    text = "\n".join(lines(letters, START, [r[0] for r in rows], [r[1] for r in rows]))
    return (k, None, None, None, None, None, None, None, *counts, illegal([r[0][:1] for r in rows]), cost + t.vectors[v][START], letters, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())


def _pieces(p: Params):
    def run(batches):
        from pyspark import TaskContext

        t, piece, pos = tables(p.block), TaskContext.get().partitionId(), 0
        held: list = []
        current, number = None, 0

        def raw(rows):
            nonlocal pos
            out = []
            for role, text, blank, cut, digest in rows:
                out.append((current, piece, pos, role, text, blank, cut, digest, *[None] * 7))
                pos += 1
            return out

        for batch in batches:
            out = []
            for k, *row in zip(batch["k"], batch["role"], batch["text"], batch["blank"], batch["cut"], batch["digest"]):
                if k != current:
                    # The first conversation of a piece may have begun in another.
                    out += raw(held) if number == 1 else [_whole(current, held, t)] if held else []
                    current, held, number = k, [], number + 1
                held.append(row)
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(raw(held), columns=_COLUMNS)

    return run


def _symbols(rows: pd.DataFrame) -> tuple[pd.DataFrame, bytes]:
    rows = rows.sort_values("pos")
    return rows, bytes(rows["symbol"].tolist())


def _tables_of(p: Params):
    """Of a piece of a conversation: costs from state to state, and what is counted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, symbols = _symbols(rows)
        t, initials = tables(p.block), [r[:1] for r in rows["role"]]
        costs = []
        for unit in t.units:
            cost, v, _ = t.read(symbols, unit)
            costs += [min(NEVER, cost + c) for c in t.vectors[v]]
        fault = rows["fault"].to_numpy()
        return pd.DataFrame({
            "k": [rows["k"].iloc[0]], "piece": [rows["piece"].iloc[0]], "costs": [costs], "n_blank": [int((fault == 0).sum())], "n_duplicate": [int((fault == 1).sum())],
            "n_truncated": [int((fault == 2).sum())], "illegal": [illegal(initials)], "first": [initials[0]], "last": [initials[-1]],
        })

    return run


def _costs_to_come(p: Params):
    """Of a conversation, row by row of its pieces: the cost still to come after each."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts, t = parts.sort_values("piece"), tables(p.block)
        least, ahead, v = 0, [], list(t.vectors[t.end])
        for costs in reversed(parts["costs"].tolist()):
            ahead.append(v)
            costs = np.asarray(costs).reshape(4, 4)
            before = [min(int(costs[f][q]) + v[f] for f in range(4)) for q in range(4)]
            number, low = t.number(before)
            least, v = least + low, list(t.vectors[number])
        ends = parts["last"].tolist()
        between = illegal_between(ends[:-1], parts["first"].tolist()[1:])
        n = len(parts)
        return pd.DataFrame({
            "k": parts["k"], "piece": parts["piece"], "ahead": ahead[::-1], "is_last": [False] * (n - 1) + [True], "cost": [least + v[START]] + [0] * (n - 1), "between": [between] + [0] * (n - 1),
        })

    return run


def illegal_between(lasts, firsts) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(lasts, firsts))


def _ways(p: Params):
    """Of a piece: where each state leads."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, symbols = _symbols(rows)
        t = tables(p.block)
        _, v, after = t.read(symbols, t.known[tuple(int(c) for c in rows["ahead"].iloc[0])])
        leads = [t.trace(symbols, after, q, False)[1] if t.vectors[v][q] < NEVER else -1 for q in range(4)]
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "piece": [rows["piece"].iloc[0]], "leads": [leads]})

    return run


def _entered(ways: pd.DataFrame) -> pd.DataFrame:
    ways, state, states = ways.sort_values("piece"), START, []
    for leads in ways["leads"]:
        states.append(state)
        state = int(leads[state])
    return pd.DataFrame({"k": ways["k"], "piece": ways["piece"], "state": states})


def _traced(p: Params):
    """Of a piece: its letters (in the row of number -1) and the lines that are left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, symbols = _symbols(rows)
        t, head = tables(p.block), rows.iloc[0]
        _, _, after = t.read(symbols, t.known[tuple(int(c) for c in head["ahead"])])
        letters, _ = t.trace(symbols, after, int(head["state"]), bool(head["is_last"]))
        left = [letters, *lines(letters, int(head["state"]), rows["role"], rows["text"])]
        return pd.DataFrame({"k": head["k"], "piece": head["piece"], "number": range(-1, len(left) - 1), "line": left})

    return run


def _digests(batches):
    """Sorted lines to one digest a conversation; of a conversation only the digest so far is held."""
    current, sha, any_ = None, None, False
    for batch in batches:
        out = []
        for k, line in zip(batch["k"], batch["line"]):
            if k != current:
                if sha is not None:
                    out.append((current, sha.hexdigest()))
                current, sha, any_ = k, hashlib.sha256(), False
            sha.update((("\n" if any_ else "") + line).encode("utf-8", "replace"))
            any_ = True
        yield pd.DataFrame(out, columns=["k", "repaired_sha256"])
    yield pd.DataFrame([(current, sha.hexdigest())] if sha is not None else [], columns=["k", "repaired_sha256"])


def _long_ones(edges: DataFrame, p: Params) -> DataFrame:
    """Results of the conversations whose rows lie at the ends of pieces, from those rows."""
    place = F.struct("piece", "pos")
    firsts = edges.groupBy("k", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = edges.select("k", "piece", "pos", "digest").join(firsts, ["k", "digest"]).where(place > F.col("first")).select("piece", "pos", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), 0).when(F.col("again"), 1).when(F.col("cut"), 2)
    who = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    sym = F.when(F.col("blank") | F.col("again"), 0).otherwise(F.when((F.col("role") != "") & (who > 0), who).otherwise(4) + F.when(F.col("cut"), 4).otherwise(0))
    rows = edges.join(again, ["piece", "pos"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    rows = session.settle(rows.select("k", "piece", "pos", "role", "text", sym.cast("int").alias("symbol"), fault.alias("fault")), "long-conversations")
    narrow = rows.select("k", "piece", "pos", "symbol")
    costs = "k string, piece int, costs array<long>, n_blank long, n_duplicate long, n_truncated long, illegal long, first string, last string"
    parts = session.settle(rows.drop("text").groupBy("k", "piece").applyInPandas(_tables_of(p), costs), "piece-tables")
    ahead = session.settle(
        parts.select("k", "piece", "costs", "first", "last").groupBy("k").applyInPandas(_costs_to_come(p), "k string, piece int, ahead array<long>, is_last boolean, cost long, between long"), "costs-to-come"
    )
    to_come = ahead.select("k", "piece", "ahead", "is_last")
    ways = narrow.join(to_come, ["k", "piece"]).groupBy("k", "piece").applyInPandas(_ways(p), "k string, piece int, leads array<int>")
    entered = session.settle(ways.groupBy("k").applyInPandas(_entered, "k string, piece int, state int"), "entered-states")
    traced = session.settle(
        rows.join(to_come, ["k", "piece"]).join(entered, ["k", "piece"]).groupBy("k", "piece").applyInPandas(_traced(p), "k string, piece int, number long, line string"), "repaired-lines"
    )
    # One string a conversation is what is asked for.
    audit = traced.where("number < 0").groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "line"))), lambda s: s["line"]), "").alias("audit"))
    sha = traced.where("number >= 0").repartition("k").sortWithinPartitions("k", "piece", "number").select("k", "line").mapInPandas(_digests, "k string, repaired_sha256 string")
    sums = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n_blank", "n_duplicate", "n_truncated", "illegal")])
    costs = ahead.groupBy("k").agg(F.sum("cost").alias("cost"), F.sum("between").alias("between"))
    return sums.join(costs, "k").join(audit, "k").join(sha, "k", "left").select(
        "k", "n_blank", "n_duplicate", "n_truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def repair(rows: DataFrame, ids: DataFrame, p: Params = Params()) -> DataFrame:
    """Faults of every conversation and its cheapest repair.

    ``rows`` has conv_id, turn, role and text, ``ids`` conv_id; other columns are not read.
    One row for each different id of ``ids``, null too: conv_id, gaps (turns missing between
    the smallest and the largest, at most what a long holds), blank, duplicate, truncated,
    illegal, cost, audit (letters of the edits in order, the ASCII-least of the cheapest), and
    repaired_sha256 of the repaired ``role:text`` joined by line breaks. Rows are taken by
    turn, nulls first; rows of one turn by a hash of role and text, so equal rows are
    neighbours. Null roles and texts count as one space. An id without rows has zeros, an
    empty audit and the digest of nothing.

    The digest of a conversation of many pieces has to read them in order, in one task that
    holds no more than a batch of lines.
    """
    marked = _marked(rows)
    size = marked.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, size["n"] // p.rows, (size["chars"] or 0) // p.chars) + 1
    # The last column deals equal rows out, so that no range is one key.
    keyed = marked.withColumns({"h": F.xxhash64("role", "text"), "r": F.rand(11)})
    order = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("h"), F.col("r")]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "role", "text", "blank", "cut", "digest")
    pieces = session.settle(ordered.mapInPandas(_pieces(p), PIECES), "conversation-pieces")
    counts = ["n_blank", "n_duplicate", "n_truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = pieces.where("pos IS NULL").select("k", *counts)
    long_ones = _long_ones(pieces.where("pos IS NOT NULL").select(*_COLUMNS[:8]), p).select("k", *counts)
    wide = F.col("top").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("n")
    turns = keyed.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg(F.max("turn").alias("top"), F.min("turn").alias("low"), F.count("turn").alias("n"))
    turns = turns.select("k", F.when(F.col("top").isNotNull(), F.least(wide, F.lit((1 << 63) - 1).cast("decimal(38,0)"))).otherwise(0).cast("long").alias("gaps"))
    kind = ids.schema["conv_id"].dataType
    wanted = ids.select("conv_id").distinct().withColumn("k", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = wanted.join(done.unionByName(long_ones), "k", "left").join(turns, "k", "left")
    return out.select(
        F.col("conv_id").cast(kind).alias("conv_id"), zero("gaps").alias("gaps"), zero("n_blank").alias("blank"), zero("n_duplicate").alias("duplicate"), zero("n_truncated").alias("truncated"),
        zero("illegal").alias("illegal"), zero("cost").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )

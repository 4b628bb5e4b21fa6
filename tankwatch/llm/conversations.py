"""Conversation repair on a suffix-shared automaton.

Every row of a conversation is one symbol: its role's initial and its fault. The cheapest repair of what follows a row
depends on the rest of the signature alone, so signatures are put together from their ends: equal rests are one node,
wherever they occur, and a node's cost to go and best edit are found once for each state of the grammar. Distinct
signatures are dealt in the order of their reversed text, in which the nodes of a rest lie together: a task walks this
order with the path of the current signature alone in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwatch.llm.common import discard, written

#: Costs of the edits, and what a truncated row that is kept or given another role adds.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Initials that the grammar knows, any other, and none; the faults. A row is ``INITIALS`` index * 4 + fault + ``BASE``.
INITIALS, FAULTS, BASE = "sua?-", ("", "blank", "duplicate", "truncated"), ord("0")
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a row that is an ``s``, a ``u``, an ``a`` leads from each state; None if it may not stand there.
_STEP = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
#: A user or an assistant, whichever may follow.
_TURN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies`` after damage: by crc32 of ``conv:turn`` modulo 20, 0 drops a row, 1 empties its text,
    2 takes ``.!?`` out of it, 3 makes it two, 4 makes its role user. A null reads as one space there, in the role and in the text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(one("conv"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(what == 4, "user").otherwise(one("role"))
    return rows.where(what != 0).select("conv", "turn", role.alias("role"), text.alias("text"), F.when(what == 3, 2).otherwise(1).alias("copies"))


def _symbol(blank: Column, duplicate: Column, truncated: Column, role: Column) -> Column:
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).when(first == "", 4).otherwise(3)
    return (initial * 4 + F.when(blank, 1).when(duplicate, 2).when(truncated, 3).otherwise(0)).cast("int")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, one row for each conversation and batch: its symbols in order and its turns."""
    from pyspark import TaskContext

    part, number, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = ("conv_key", "turn", "role", "print")
        same = np.ones(n - 1, dtype=bool)
        edge = None
        for c in names:
            column = batch.column(c)
            equal = lambda a, b: np.asarray(pc.fill_null(pc.equal(a, b), False)) | np.asarray(pc.and_(pc.is_null(a), pc.is_null(b)))
            same &= equal(column[1:], column[:-1])
            if c == "conv_key":
                edge = ~same
        now = tuple(batch.column(c)[0].as_py() for c in names)
        again = np.r_[last == now, same]
        last = tuple(batch.column(c)[n - 1].as_py() for c in names)
        # equal rows of one turn follow each other: all but the first are duplicates, if they are not blank
        symbol = batch.column("symbol").to_numpy().copy()
        repeat = lambda s: np.where(s % 4 == 1, s, s // 4 * 4 + 2)
        symbol = np.where(again, repeat(symbol), symbol)
        copies = batch.column("copies").to_numpy()
        at = np.repeat(np.arange(n), copies)
        spread = symbol[at]
        extra = np.r_[False, at[1:] == at[:-1]]
        spread = np.where(extra, repeat(spread), spread)
        turn = batch.column("turn")
        begins = np.flatnonzero(np.r_[True, edge])
        cuts = np.searchsorted(at, np.r_[begins, n])
        rows = []
        for k, begin in enumerate(begins.tolist()):
            end = int(begins[k + 1]) if k + 1 < len(begins) else n
            turns = pc.unique(turn.slice(begin, end - begin).drop_null()).to_pylist()
            ends = [turns[0], turns[-1]] if turns else []
            rows.append((batch.column("conv_key")[begin].as_py(), part, number, (spread[cuts[k] : cuts[k + 1]] + BASE).astype(np.uint8).tobytes().decode(), ends, max(0, len(turns) - 2)))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["conv_key", "part", "number", "symbols", "ends", "inner"])


class Automaton:
    """Nodes of rests, each the row before it and the rest after it; only those of one signature are held.

    A node holds, for each state of the grammar, the cost to go, and the edits that begin the best one with the state they
    lead to: so the best audit of a rest is a walk over its nodes, and nothing as long as a rest is kept at a node. As two
    candidates differ within their first edits, ties need no look at what follows. Costs to go differ by a few units
    between states, so that but for a constant there are few different nodes; these are remembered, and a node is one of them
    and its constant.
    """

    def __init__(self):
        costs, edits = [], []
        for state in range(4):
            need, at = 0, state
            while at not in (START, AFTER_A):
                need, at = need + 1, _TURN[at]
            costs.append(need * INSERT)
            edits.append(("I" * need, at))
        self.reverse, self.path, self.base = "", [(tuple(costs), tuple(edits))], [0]
        self.choices = {c: self._choices(c) for c in range(len(INITIALS) * len(FAULTS))}
        self.seen: dict[tuple, tuple] = {}

    @staticmethod
    def _choices(symbol: int) -> list[list[tuple[int, str, int]]]:
        """For each state what may be done at a row: cost, edits, and the state after them."""
        initial, fault = INITIALS[symbol // 4], FAULTS[symbol % 4]
        out = []
        for state in range(4):
            able, at = [], state
            for inserts in range(3):
                price, before = inserts * INSERT, "I" * inserts
                able.append((price + DELETE, before + "D", at))
                if fault not in ("blank", "duplicate"):
                    extra = price + (CUT if fault == "truncated" else 0)
                    if initial in _STEP and _STEP[initial][at] is not None:
                        able.append((extra + KEEP, before + "K", _STEP[initial][at]))
                    able.append((extra + REROLE, before + "R", _TURN[at]))
                at = _TURN[at]
            out.append(able)
        return out

    def push(self, symbol: int) -> None:
        """The node of ``symbol`` before the rest whose node is the last of the path."""
        after = self.path[-1][0]
        if (symbol, after) not in self.seen:
            best = [min((price + after[to], edits, to) for price, edits, to in able) for able in self.choices[symbol]]
            least = min(b[0] for b in best)
            self.seen[symbol, after] = (tuple(b[0] - least for b in best), tuple(b[1:] for b in best)), least
        node, more = self.seen[symbol, after]
        self.path.append(node)
        self.base.append(self.base[-1] + more)

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit; nodes shared with the signature before are not built again."""
        reverse, shared = signature[::-1], 0
        most = min(len(reverse), len(self.reverse))
        while shared < most and reverse[shared] == self.reverse[shared]:
            shared += 1
        del self.path[shared + 1 :], self.base[shared + 1 :]
        for c in reverse[shared:]:
            self.push(ord(c) - BASE)
        self.reverse = reverse
        state, out = START, []
        for _, edits in reversed(self.path):
            done, state = edits[state]
            out.append(done)
        return self.base[-1] + self.path[-1][0][START], "".join(out)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        rows = []
        for signature in batch.column("signature").to_pylist():
            symbols = np.frombuffer(signature.encode(), dtype=np.uint8) - BASE
            faults, initials = np.bincount(symbols % 4, minlength=4).tolist(), symbols // 4
            legal = np.array([[p + q in _LEGAL for q in INITIALS] for p in INITIALS])
            illegal = int((~legal[initials[:-1], initials[1:]]).sum()) if len(initials) else 0
            rows.append((signature, *faults[1:], illegal, *automaton.solve(signature)))
        names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and order, each conversation behind its audit: the hash of what the edits leave."""
    audit, at, last, sha, begun, key = "", 0, "", hashlib.sha256(), False, None

    def put(role: str, text: str) -> None:
        nonlocal last, begun
        sha.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "replace"))
        last, begun = role[:1], True

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(turn(), "")
            at += 1

    turn = lambda: "assistant" if last == "u" else "user"

    def done() -> list[tuple]:
        inserts()
        return [] if key is None else [(key, sha.hexdigest())]

    for batch in batches:
        out = []
        kinds, keys, audits, roles, texts, copies = (batch.column(c).to_pylist() for c in ("kind", "conv_key", "audit", "role", "text", "copies"))
        for kind, conv, plan, role, text, times in zip(kinds, keys, audits, roles, texts, copies, strict=True):
            if kind == 0:
                out += done()
                key, audit, at, last, sha, begun = conv, plan or "", 0, "", hashlib.sha256(), False
                continue
            for _ in range(times):
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(role if edit == "K" else turn(), text)
        yield _rows(out)
    yield _rows(done())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["conv_key", "repaired_sha256"])


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """What is wrong with each conversation, and its cheapest repair to ``(s?(ua)+)?``, by roles' initials.

    Returns ``<id>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row for each id of the
    input. ``damage`` first damages the rows as ``damaged`` says; without it they are taken as they are. Rows are taken by turn, null turns
    first, rows of one turn by role and then by text's hash. A row's first fault counts: blank (nothing but ASCII white space),
    duplicate (role and text were there before), truncated (the last character that is no white space is none of ``.!?``). Gaps
    are turns that are lacking between the least and the greatest. Edits cost: Keep 0, Rerole to user or assistant 3, Delete 4 (a
    must for blank and duplicate rows), Insert an empty user or assistant row 3; a truncated row that stays adds 3.
    ``audit`` holds the initials of the cheapest edits, of those alike the least text; ``repaired_sha256`` is taken of
    ``role:text`` of the repaired rows, joined by line ends.

    Null ids are one conversation; a null role or text is one space, so that a null text is blank and a null role fits nowhere; an empty
    role has no initial and can't be kept either. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the
    hash of nothing. An empty table gives an empty one; other columns are not read.

    A long conversation's symbols come from several tasks, as rows are dealt by id and turn; they are a byte for a row, as
    its audit is. Its texts pass one task in order, as its hash asks, which holds one batch of them at a time.
    """
    spark = conversations.sparkSession
    raw = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("conv_key")
    ids = raw.select("conv", key).distinct()
    plain = raw.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))
    rows = (damaged(raw) if damage else plain).select(key, "turn", "role", "text", "copies", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("print"))
    shown = F.rtrim("text", F.lit(_WHITE))
    slim = rows.select("conv_key", "turn", "role", "copies", "print", (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"))
    # the turn in which a role and text first stand; what stands again in it is seen when rows are in order
    least = F.coalesce("turn", F.lit(-(1 << 63)))
    firsts = slim.groupBy("conv_key", "print").agg(F.min(least).alias("first"))
    placed = slim.join(firsts, ["conv_key", "print"]).select("conv_key", "turn", "role", "print", "copies", _symbol(F.col("blank"), least > F.col("first"), F.col("cut"), F.col("role")).alias("symbol"))
    order = ["conv_key", "turn", "role", "print"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_segments, "conv_key string, part int, number long, symbols string, ends array<long>, inner long")
    joined = cut.groupBy("conv_key").agg(F.array_sort(F.collect_list(F.struct("part", "number", "symbols"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"), F.sum("inner").alias("inner"))
    gaps = F.coalesce(F.array_max("ends") - F.array_min("ends") + 1 - F.size("ends") - F.col("inner"), F.lit(0))
    signed = written(joined.select("conv_key", F.array_join(F.transform("s", lambda x: x["symbols"]), "").alias("signature"), gaps.cast("long").alias("gaps")), "signatures")
    distinct = signed.select("signature").distinct().withColumn("_reverse", F.reverse("signature")).repartitionByRange(parts, "_reverse").sortWithinPartitions("_reverse")
    solved = written(distinct.select("signature").mapInArrow(_solved, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")
    judged = written(ids.join(signed.join(solved, "signature"), "conv_key", "left"), "judged")
    lines = judged.select("conv_key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").cast("binary").alias("print"), "audit", F.lit("").alias("text"), F.lit(0).alias("copies"))
    lines = lines.union(rows.select("conv_key", F.lit(1).alias("kind"), "turn", "role", "print", F.lit(None).cast("string").alias("audit"), "text", "copies"))
    hashes = lines.repartition("conv_key").sortWithinPartitions("conv_key", "kind", "turn", "role", "print").select("conv_key", "kind", "audit", "role", "text", "copies").mapInArrow(_hashed, "conv_key string, repaired_sha256 string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = judged.join(hashes, "conv_key").select(F.col("conv").alias(id_col), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), "repaired_sha256")
    out = written(out, "repaired")
    discard(signed, solved, judged)
    return out

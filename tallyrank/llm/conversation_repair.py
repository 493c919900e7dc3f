"""Conversation structure repair: the cheapest edits to alternating turns, ties by the least audit string.

Every turn gets one macro edit: up to two inserted turns, then keep, rerole or delete. Written as
``I``s and a closing K, R or D the macro edits are prefix-free codes, so two edit strings of
equally many turns compare as their codes do, one by one. Roles must read ``(s?(ua)+)?``, which
an automaton of four states checks; insertions and reroles have no choice of role, so an edit
string fixes the repaired conversation.

The dynamic programme keeps, after each turn (layer), the cost and the *rank* of the best string
of each state. Ranks replace the strings: of two candidates the one whose parent has the lesser
rank, or from one parent the one of the lesser code, has the lesser string. Parent pointers and
codes give the string afterwards.

A long conversation is more than one task's work. Segments of ``SEGMENT`` turns are solved for
every entry state at once: costs and ranks per (entry, exit). Segments fold into longer ones by
the same step (a segment stands where a turn stood: from one entry its ranks compare as codes do,
from different entries the rank ahead has decided), ``FAN`` at a time until one is left; then
entries and exits go down again, and each segment traces its own turns. Turns are numbered by
ranges (``order.numbered``), not in one task per conversation.

``edits`` gives a code per turn, ``repaired`` the repaired turns, ``report`` the digest of damaged
conversations. The audit string and the SHA-256 over a repaired conversation are sequential
by definition: they are made in one streaming pass over sorted turns that holds the audit string only.

Defined results: null roles and texts are one space; turns are ordered by turn (nulls first),
then role, then the text's SHA-256; texts are equal where that digest is; rows of one
conversation with equal role and text are duplicates but for the first; a null conversation id is
a conversation of its own; an empty table gives an empty result; other columns are ignored,
whatever their names; very long texts and conversations are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import numbered
from .common import WORD_CHAR, stored, whole_runs

SEGMENT = 1024
FAN = 256

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of a role's initial; absent: not allowed.
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIALS = "sua"
#: Insertions that end a conversation, by its state.
TAIL = [0, 2, 1, 0]
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NEVER = 1 << 40
CODES = sorted("I" * run + op for run, op in product(range(3), "KRD"))
#: Kind of a turn: its initial's number (3: other), plus 4 where truncated; GONE must be deleted.
GONE = 8


def wanted(state: int) -> str:
    """The initial that an inserted or rerolled turn gets in this state."""
    return "a" if state == USER else "u"


def _macro_edits() -> tuple[np.ndarray, np.ndarray]:
    """(costs, codes) by kind, state before, state after: the cheapest macro edit, of ties that of the least code."""
    cost, code = np.full((9, 4, 4), NEVER), np.zeros((9, 4, 4), np.int64)
    for kind, at, (k, text) in product(range(9), range(4), enumerate(CODES)):
        state, paid = at, INSERT * (len(text) - 1)
        for _ in text[:-1]:
            state = MOVES[state, wanted(state)]
        if text[-1] == "D":
            paid += DELETE
        elif kind == GONE:
            continue
        else:
            initial = wanted(state) if text[-1] == "R" else (INITIALS + "?")[kind % 4]
            if (state, initial) not in MOVES:
                continue
            state, paid = MOVES[state, initial], paid + REROLE * (text[-1] == "R") + TRUNCATED * (kind >= 4)
        if paid < cost[kind, at, state]:
            cost[kind, at, state], code[kind, at, state] = paid, k
    return cost, code


EDIT_COST, EDIT_CODE = _macro_edits()


def advance(cost: np.ndarray, rank: np.ndarray, by: np.ndarray, code: np.ndarray):
    """One layer: (cost, rank, parent) of each state, from those before and the costs and codes of the moves between states.

    cost and rank are (conversations, entries, states), by and code (conversations, state, state after).
    """
    tried = (cost[:, :, :, None] + by[:, None]) * 64 + rank[:, :, :, None] * 16 + code[:, None]
    parent, least = tried.argmin(axis=2), tried.min(axis=2)
    cost, key = least >> 6, least & 63
    lost = cost >= NEVER
    cost, key = np.where(lost, NEVER, cost), np.where(lost, 64, key)
    return cost, (key[..., None] > key[..., None, :]).sum(axis=-1), parent


def solve(starts: np.ndarray, sizes: np.ndarray, moves, entries: np.ndarray):
    """(cost, rank, parents by layer) of runs of layers, all runs a layer at a time.

    Run r has the layers ``starts[r]`` and on; ``moves(layers)`` gives their costs and codes. ``entries``
    (runs, entries): the states they begin in. Runs must come longest first.
    """
    cost = np.where(np.arange(4) == entries[:, :, None], 0, NEVER)
    rank, parents = np.zeros_like(cost), []
    for layer in range(int(sizes[0])):
        active = int(np.searchsorted(-sizes, -layer))  # runs longer than this
        cost[:active], rank[:active], parent = advance(cost[:active], rank[:active], *moves(starts[:active] + layer))
        parents.append(parent)
    return cost, rank, parents


def _turn_moves(rows: pd.DataFrame):
    kind = rows["kind"].to_numpy()
    return lambda at: (EDIT_COST[kind[at]], EDIT_CODE[kind[at]])


def _segment_moves(rows: pd.DataFrame):
    cost, rank = (np.array(rows[c].tolist(), np.int64).reshape(-1, 4, 4) for c in ("cost", "rank"))
    return lambda at: (cost[at], rank[at])


def _solved(keys: list[str], moves, extra):
    """Costs and ranks per entry and exit of each run of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in whole_runs(batches, keys):
            by = np.argsort(-sizes, kind="stable")
            cost, rank, _ = solve(starts[by], sizes[by], moves(rows), np.tile(np.arange(4), (len(by), 1)))
            out = rows.iloc[starts[by]][keys].reset_index(drop=True)
            out["cost"], out["rank"] = list(cost.reshape(-1, 16)), list(rank.reshape(-1, 16))
            yield extra(out, rows, starts[by], sizes[by])

    return run


def _traced(keys: list[str], moves, result):
    """Each row's state before and after, given each run's (columns entry and exit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in whole_runs(batches, keys):
            by = np.argsort(-sizes, kind="stable")
            starts, sizes = starts[by], sizes[by]
            of = moves(rows)
            _, _, parents = solve(starts, sizes, of, rows["entry"].to_numpy()[starts][:, None])
            entry, leave = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            state = rows["exit"].to_numpy()[starts].copy()
            for layer in range(len(parents) - 1, -1, -1):
                n = len(parents[layer])
                leave[starts[:n] + layer] = state[:n]
                state[:n] = parents[layer][np.arange(n), 0, state[:n]]
                entry[starts[:n] + layer] = state[:n]
            yield result(rows, entry, leave)

    return run


def _with_ends(out: pd.DataFrame, rows: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """The first and last initial of each segment and its pairs of neighbours that don't alternate."""
    initial = rows["initial"].to_numpy()
    bad = np.concatenate([[0], np.cumsum(~np.isin(initial[:-1] * 4 + initial[1:], [1, 6, 9]))])  # su, ua, au
    out["head"], out["last"], out["illegal"] = initial[starts], initial[starts + sizes - 1], bad[starts + sizes - 1] - bad[starts]
    return out


def _codes(rows: pd.DataFrame, entry: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
    out = rows[["c", "pos"]].copy()
    out["entry"], out["edit"] = entry, np.array(CODES, object)[EDIT_CODE[rows["kind"].to_numpy(), entry, leave]]
    return out


def _grouped(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def _placed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, text, digest): the rows by names of our own; c names a conversation and is never null."""
    plain = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = df.select(key_of(F.col(f"`{conv}`")).alias("c"), F.col(f"`{turn}`").cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    return rows.withColumn("digest", digest_of(F.col("text")))


def key_of(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


def digest_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


class Solved:
    """The stored tables of a repair: ``turns`` (c, pos, turn, role, digest, fault, kind), ``codes`` (c, pos, entry, edit), ``ends`` (c, cost, tail, illegal)."""

    def __init__(self, rows: DataFrame):
        text = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
        state = F.when(~F.col("text").rlike(WORD_CHAR), "blank").when(~text.substr(F.lit(-1), F.lit(1)).isin(*".!?"), "truncated")
        narrow = stored(rows.select("c", "turn", "role", "digest", state.alias("state"), F.monotonically_increasing_id().alias("tie")), "turns")
        placed = stored(numbered(narrow, ["c"], ["turn", "role", "digest", "tie"]).drop("tie"), "turns-placed")
        first = placed.groupBy("c", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) * (F.length("role") > 0).cast("int"), F.lit(0)) - 1, F.lit(3)).cast("int")
        fault = F.when(F.col("state") == "blank", "blank").when(F.col("pos") > F.col("first"), "duplicate").otherwise(F.col("state"))
        out = placed.join(first.hint("shuffle_hash"), ["c", "role", "digest"], "left").select("c", "pos", "turn", "role", "digest", initial.alias("initial"), fault.alias("fault"))
        kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(F.col("initial") + F.when(F.col("fault") == "truncated", 4).otherwise(0)).cast("int")
        self.turns = stored(out.withColumn("kind", kind), "turns-judged")
        self._solve()

    def _solve(self) -> None:
        turns = self.turns.select("c", "pos", (F.col("pos") / SEGMENT).cast("long").alias("seg"), "kind", "initial")
        table = "c string, seg long, cost array<long>, rank array<long>"
        segments = stored(_grouped(turns, ["c", "seg"], "pos").mapInPandas(_solved(["c", "seg"], _turn_moves, _with_ends), f"{table}, head int, last int, illegal long"), "segments")
        levels, folded = [segments.select("c", "seg", "cost", "rank")], lambda out, *_: out.rename(columns={"up": "seg"})
        while not levels[-1].where("seg > 0").isEmpty():
            rows = levels[-1].withColumn("up", (F.col("seg") / FAN).cast("long"))
            levels.append(stored(_grouped(rows, ["c", "up"], "seg").mapInPandas(_solved(["c", "up"], _segment_moves, folded), table), "segments-folded"))
        whole = levels[-1].select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.struct((F.get("cost", s) + F.get(F.array(*map(F.lit, [INSERT * t for t in TAIL])), s)).alias("cost"), F.get("rank", s).alias("rank"), s.alias("exit")))).alias("x"))
        # the empty conversation is right, other states end with their insertions
        best = whole.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.cost", "x.exit", F.get(F.array(*map(F.lit, TAIL)), F.col("x.exit")).alias("tail"))
        best = stored(best, "conversation-ends")
        states = best.select("c", F.lit(0).cast("long").alias("seg"), F.lit(START).cast("long").alias("entry"), F.col("exit").cast("long").alias("exit"))
        passed = lambda rows, entry, leave: rows[["c", "seg"]].assign(entry=entry, exit=leave)
        for below in levels[-2::-1]:
            rows = below.withColumn("up", (F.col("seg") / FAN).cast("long")).join(states.withColumnRenamed("seg", "up"), ["c", "up"])
            states = stored(_grouped(rows, ["c", "up"], "seg").mapInPandas(_traced(["c", "up"], _segment_moves, passed), "c string, seg long, entry long, exit long"), "segment-states")
        rows = turns.join(states, ["c", "seg"])
        self.codes = stored(_grouped(rows, ["c", "seg"], "pos").mapInPandas(_traced(["c", "seg"], _turn_moves, _codes), "c string, pos long, entry int, edit string"), "edits")
        behind = segments.select("c", (F.col("seg") + 1).alias("seg"), F.col("last").alias("ahead"))
        meet = F.when(F.col("ahead").isNotNull() & ~(F.col("ahead") * 4 + F.col("head")).isin(1, 6, 9), 1).otherwise(0)
        illegal = segments.join(behind, ["c", "seg"], "left").groupBy("c").agg(F.sum(F.col("illegal") + meet).alias("illegal"))
        self.ends = best.join(illegal, "c").drop("exit")

    def counts(self) -> DataFrame:
        """(c, gaps, blank, duplicate, truncated)"""
        faults = ["blank", "duplicate", "truncated"]
        by_turn = self.turns.groupBy("c", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in faults))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        return by_turn.groupBy("c").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in faults))


def edits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn, role, fault, edit): each turn's macro edit; insertions after the last turn aren't among them."""
    done = Solved(_placed(df, conv, turn, role, text))
    out = done.turns.join(done.codes, ["c", "pos"])
    return out.select(_conv(df, conv).alias(conv), "pos", F.col("turn").alias(turn), F.col("role").alias(role), "fault", "edit")


def _conv(df: DataFrame, conv: str) -> Column:
    return F.when(F.col("c") != "n", F.substring("c", 2, 2**31 - 1)).cast(df.schema[conv].dataType)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, part, role, text, edit): the turns of the repaired conversations, in the order of (pos, part).

    ``pos`` is the place of the turn whose macro edit made the row, part its place in that; the
    insertions after the last turn have the place after it.
    """
    rows = _placed(df, conv, turn, role, text)
    done = Solved(rows)
    turns = done.turns.join(done.codes, ["c", "pos"]).where("edit != 'D'").select("c", "pos", "role", "digest", "entry", "edit")
    texts = rows.groupBy("c", "role", "digest").agg(F.first("text").alias("text"))  # of equal role and text one turn at most is kept
    kept = turns.where(~F.col("edit").endswith("D")).join(texts, ["c", "role", "digest"]).unionByName(turns.where(F.col("edit").endswith("D")).withColumn("text", F.lit(None).cast("string")))
    size = done.turns.groupBy("c").agg(F.count("*").alias("pos"))
    after = done.ends.where("tail > 0").join(size, "c").select("c", "pos", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.when(F.col("tail") == 1, USER).otherwise(START).alias("entry"), F.repeat(F.lit("I"), F.col("tail").cast("int")).alias("edit"))
    both = kept.drop("digest").unionByName(after)
    both = both.select("*", F.posexplode(F.filter(F.split("edit", ""), lambda x: x != "")).alias("part", "op")).where("op != 'D'")
    due = F.when((F.col("entry") == USER) == (F.col("part") % 2 == 0), "assistant").otherwise("user")
    return both.select(_conv(df, conv).alias(conv), "pos", "part", F.when(F.col("op") == "K", F.col("role")).otherwise(due).alias(role), F.when(F.col("op") == "I", "").otherwise(F.col("text")).alias(text), F.col("op").alias("edit"))


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) damaged by rule; rows that go stay as marked (dropped)."""
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), again).drop("again")


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit string and SHA-256 of each conversation, from its sorted rows: edits (tag 0) ahead of the text they keep (tag 1), the end (tag 2)."""
    state, audit, sha, pending, begun = START, [], hashlib.sha256(), "", False

    def put(role: str, text: str) -> None:
        nonlocal state, begun
        sha.update(f"{chr(10) * begun}{role}:{text}".encode())
        state, begun = MOVES[state, role[0]], True

    def run(ops: str, text: str | None, own: str) -> str:
        """The edits that wait for a text."""
        nonlocal state
        for i, op in enumerate(ops):
            if op == "D":
                continue
            due = "assistant" if wanted(state) == "a" else "user"
            if op != "I" and text is None:
                return ops[i:]
            put(own if op == "K" else due, "" if op == "I" else text)
            text = None if op != "I" else text
        return ""

    for batch in batches:
        out = []
        for c, tag, role, edit, text in zip(*(batch[x].tolist() for x in ("c", "tag", "role", "edit", "text")), strict=True):
            if tag == 0:
                audit.append(edit)
                pending = run(edit, None, role) if not pending else pending + edit
            elif tag == 1:
                pending = run(pending, text, role) if pending else pending
            else:
                audit.append(edit)
                run(edit, None, "")
                out.append((c, "".join(audit), sha.hexdigest()))
                state, audit, sha, pending, begun = START, [], hashlib.sha256(), "", False
        yield pd.DataFrame(out, columns=["c", "audit", "repaired_sha256"])


def report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults and repairs, a row per conversation of the undamaged table."""
    harmed = damaged(conversations)
    done = Solved(_placed(harmed.where("not dropped"), "conv_id", "turn", "role", "text"))
    # sorted within a conversation the edits of a turn meet its text, so texts are shuffled once and joined with nothing
    none = lambda kind: F.lit(None).cast(kind)
    edit = done.turns.join(done.codes, ["c", "pos"]).select("c", F.lit(0).alias("end"), "turn", "role", "digest", F.lit(0).alias("tag"), "pos", "edit", none("string").alias("text"))
    texts = _placed(harmed.where("not dropped"), "conv_id", "turn", "role", "text").select("c", F.lit(0).alias("end"), "turn", "role", "digest", F.lit(1).alias("tag"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("edit"), "text")
    every = conversations.select(key_of(F.col("conv_id")).alias("c")).distinct()
    facts = stored(every.join(done.ends, "c", "left").join(done.counts(), "c", "left"), "conversation-facts")
    close = facts.select("c", F.lit(1).alias("end"), none("long").alias("turn"), F.lit("").alias("role"), none("binary").alias("digest"), F.lit(2).alias("tag"), F.lit(0).cast("long").alias("pos"), F.repeat(F.lit("I"), F.coalesce("tail", F.lit(0)).cast("int")).alias("edit"), none("string").alias("text"))
    rows = edit.unionByName(texts).unionByName(close).repartition("c").sortWithinPartitions("c", "end", "turn", "role", "digest", "tag", "pos")
    written = rows.select("c", "tag", "role", "edit", "text").mapInPandas(_written, "c string, audit string, repaired_sha256 string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return written.join(facts, "c").select(_conv(conversations, "conv_id").alias("conv_id"), *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), "audit", "repaired_sha256")

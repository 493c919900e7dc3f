"""Conversation repair against a search over whole edit strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyrank.llm import conversation_repair as cr


def harmed(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            out += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (1 + (k == 3))
    return out


def judged(rows):
    """Rows of one conversation in order, with their faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()[:16]))
    seen, out = set(), []
    for _, t, r, x in rows:
        s = x.strip(" \t\n\x0b\x0c\r")
        out.append((t, r, x, "blank" if not s else "duplicate" if (r, x) in seen else "truncated" if s[-1] not in ".!?" else None))
        seen.add((r, x))
    return out


def best(rows):
    """(cost, audit, repaired turns): over all strings of edits, one turn after another; only the cheapest, then least, of each output state goes on."""
    legal = re.compile("s?(ua)*u?")
    now = {"": (0, "", [])}

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for c, a, turns in list(out.values()):
                role = "assistant" if turns and turns[-1][0][0] == "u" else "user"
                add(out, (c + 2, a + "I", [*turns, (role, "")]))
        return out

    def add(states, candidate):
        shape = "".join(r[0] for r, _ in candidate[2])
        if legal.fullmatch(shape):
            end = "" if not shape else shape[-1]
            if end not in states or candidate[:2] < states[end][:2]:
                states[end] = candidate

    for _, r, x, fault in rows:
        ahead, now = inserts(now), {}
        for c, a, turns in ahead.values():
            add(now, (c + 3, a + "D", turns))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if r:
                    add(now, (c + late, a + "K", [*turns, (r, x)]))
                for role in ("user", "assistant"):
                    add(now, (c + 2 + late, a + "R", [*turns, (role, x)]))
    done = [v for v in inserts(now).values() if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in v[2]))]
    return min(done, key=lambda v: v[:2])


def expected(rows, every):
    out = {}
    for conv in every:
        own = judged([r for r in rows if r[0] == conv])
        cost, audit, turns = best(own)
        known = {t for t, *_ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        count = lambda f: sum(o[3] == f for o in own)  # noqa: E731, B023
        text = "\n".join(f"{r}:{x}" for r, x in turns)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()), turns
    return out


def talk(seed=3, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ufo"])
            text = rng.choice(["Fine.", "cut off", " ", "", None, "So?  \n", "x\x0b", "é!", "\xa0"]) if rng.random() < 0.6 else f"Text {rng.random()}."
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows + [r for r in rows if rng.random() < 0.05]


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for c in ("c", "pos", "seg", "kind", "edit", "entry", "digest", "dropped", "tie", "number", "first", "part"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.mark.parametrize("segment,fan", [(1024, 256), (3, 2)])
def test_equals_search_over_strings(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "FAN", fan)
    rows = talk(longest=9 if segment > 3 else 20, convs=60 if segment > 3 else 30)
    want = expected(harmed(rows), {r[0] for r in rows})
    got = {r.conv_id: tuple(r)[1:] for r in cr.report(table_of(spark, rows)).collect()}
    assert got == {c: v for c, (v, _) in want.items()}


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 4)
    rows = [(c, t, r, " " if x is None else x) for c, t, r, x in talk(seed=8)]
    rows = [(c, t, " " if r is None else r, x) for c, t, r, x in rows]
    want = expected(rows, {r[0] for r in rows})
    got = {}
    for r in sorted(cr.repaired(table_of(spark, rows)).collect(), key=lambda r: (r.pos, r.part)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: turns for c, (_, turns) in want.items() if turns}
    strings = {}
    for r in sorted(cr.edits(table_of(spark, rows)).collect(), key=lambda r: r.pos):
        strings[r.conv_id] = strings.get(r.conv_id, "") + r.edit
    assert all(v[6].removeprefix(strings[c]) in ("", "I", "II") for c, (v, _) in want.items())


def test_codes_are_prefix_free_and_ordered():
    assert cr.CODES == sorted(cr.CODES) and not any(a != b and b.startswith(a) for a in cr.CODES for b in cr.CODES)


def test_one_conversation_holds_all_rows(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 16)
    monkeypatch.setattr(cr, "FAN", 4)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), "same." if rng.random() < 0.3 else f"turn {t}" + rng.choice(".!x")) for t in range(3000)]
    want = expected(harmed(rows), [1])
    assert tuple(cr.report(table_of(spark, rows)).collect()[0])[1:] == want[1][0]


def test_empty_and_dropped(spark):
    assert cr.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    gone = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = cr.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidyspark.llm import conversation_repair as module
from tidyspark.llm.conversation_repair import Repair, as_rows, damaged, repair, repaired

SCHEMA = "conv_id long, turn long, role string, text string, gaps int, repeats string, gone int"
OF = {"s": "system", "u": "user", "a": "assistant"}


def conversations(seed=1, n=80):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((c, r.choice([t, t, t, t + 1, None]) if r.random() < 0.3 else t, role, r.choice(["Fine.", "What?", "no end", "", " \n", None, f"Turn {t}!", "a. b. c"])))
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), rows[4], rows[4], (900, 5, "user", "x" * 300_000 + "."), (900, 9, "assistant", "Ü.")]
    return [(*x, 1, "x", 2) for x in rows]


def spoilt(rows):
    """Damage by the contract's words: conversations in order."""
    out = defaultdict(list)
    space = lambda v: " " if v is None else v
    for conv, turn, role, text, *_ in rows:
        out[conv] += []
        role, text = space(role), space(text)
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by plain search over states, each with all its texts: position, what came last."""
    marks = faults(rows)
    best = {(0, ""): [(0, "", ())]}  # whole lists of ways, cut to the least of each (state, cost)

    def inserted(state, ways):
        found = defaultdict(list, {state: ways})
        for _ in range(2):
            for s, w in list(found.items()):
                new = "u" if s in ("", "s", "a") else "a"
                found[new] = least(found[new] + [(c + 2, e + "I", t + (OF[new] + ":",)) for c, e, t in w if len(e) < 40])
        return found

    def least(ways):
        return sorted({(c, e): (c, e, t) for c, e, t in ways}.values())[:12]

    states = defaultdict(list, {"": [(0, "", ())]})
    for (turn, role, text), mark in zip([*rows, (None, None, None)], [*marks, None]):
        wide = defaultdict(list)
        for s, w in states.items():
            for new, ways in inserted(s, w).items():
                wide[new] = least(wide[new] + ways)
        if mark is None:
            ends = [x for s in ("", "a") for x in wide[s]]
            return min(ends)
        states = defaultdict(list)
        more = mark == "truncated"
        for s, w in wide.items():
            for c, e, t in w:
                states[s].append((c + 3, e + "D", t))
                if mark in ("blank", "duplicate"):
                    continue
                i = role[:1]
                if i == "s" and s == "":
                    states["s"].append((c + more, e + "K", (*t, f"{role}:{text}")))
                new = "a" if s == "u" else "u"
                if i == new:
                    states[new].append((c + more, e + "K", (*t, f"{role}:{text}")))
                else:
                    states[new].append((c + 2 + more, e + "R", (*t, f"{OF[new]}:{text}")))
        states = defaultdict(list, {s: least(w) for s, w in states.items()})
    return best


def brute(rows):
    out = {}
    for conv, turns in spoilt(rows).items():
        marks = faults(turns)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, texts = cheapest(turns)
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def told(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_equals_the_contract(spark):
    rows = conversations()
    want = brute(rows)
    assert told(repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))) == want
    assert {x for w in want.values() for x in w[6]} == set("KRDI")


def test_turns_of_a_repair(spark):
    rows = [x for x in conversations(2) if x[0] != 900]
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    turns = defaultdict(list)
    for x in repaired(df).orderBy("conv_id", "place").collect():
        assert x.place == len(turns[x.conv_id])
        turns[x.conv_id].append(f"{x.role}:{x.text}")
    for x in repair(df).collect():
        assert hashlib.sha256("\n".join(turns[x.conv_id]).encode()).hexdigest() == x.repaired_sha256
        initials = "".join(t[:1] for t in turns[x.conv_id])
        assert re.fullmatch("(s?(ua)+)?", initials) or any(not t.startswith(tuple(OF.values())) for t in turns[x.conv_id])


def parsed(turns, settle):
    held, module._SETTLE = module._SETTLE, settle
    try:
        said, seen = [], set()
        now = Repair(lambda edit, role, text: said.append((edit, role, text)))
        most = 0
        for t, (role, text) in enumerate(turns):
            now.turn(t, role, text, (role, text) in seen)
            seen.add((role, text))
            most = max(most, len(now.waiting))
        return now.end(), said, most
    finally:
        module._SETTLE = held


@pytest.mark.parametrize("seed", range(30))
def test_settling_early_changes_nothing(seed):
    r = random.Random(seed)
    turns = [(r.choice(["system", "user", "assistant", "user", "assistant", "tool"]), r.choice(["", "Same.", f"{i}.", f"{i}"])) for i in range(r.randrange(200))]
    assert parsed(turns, 1)[:2] == parsed(turns, 10**9)[:2]
    short = turns[:9]
    cost, audit, _ = cheapest([(i, *t) for i, t in enumerate(short)])
    assert parsed(short, 4)[0][5:] == (cost, audit)


def test_a_long_conversation_waits_for_few_turns():
    r = random.Random(7)
    turns = [(r.choice(["user", "assistant", "system"]), r.choice(["", "Same.", f"{i}."])) for i in range(20_000)]
    (*_, audit), said, most = parsed(turns, 64)
    assert most <= 256 and len([e for e in audit if e != "I"]) == 20_000 and len(said) == len(audit)


def test_conversations_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, None, None), (2, 1, "user", "Well?")], "conv_id long, turn long, role string, text string")
    got = told(repair(as_rows(df)))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KK") and got[2][:7] == (0, 1, 0, 0, 1, 5, "DKI")


def test_nothing(spark):
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = told(repair(damaged(spark.createDataFrame([(7, gone, "user", "Gone.", 1, "x", 1)], SCHEMA))))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}

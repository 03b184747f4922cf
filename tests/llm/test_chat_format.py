import json
import random

import pytest

from tidyspark.llm import chat_format
from tidyspark.llm.chat_format import _needs, canonical, format_chats, parse, violations

SCHEMA = "conv_id long, turn long, role string, text string, place int, calls string"
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}


def call(i, name="add", content=None, **arguments):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": name, "arguments": arguments}]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(format_chats(df, TOOLS, **how).collect(), key=lambda r: (str(r.conv_id), r.place))


def test_linking_and_order(spark):
    rows = [
        (1, 0, "user", "2+3?"),
        (1, 1, "tool", result("c2", "9")),  # before its call: moves behind it
        (1, 2, "assistant", call("c1", a=2, b=3)),
        (1, 3, "tool", result("c1", {"z": 1, "a": [1.0, 2.5]})),
        (1, 4, "assistant", call("c2", a={"$result": "c1"})),
        (1, 5, "assistant", "done"),
        (2, 0, "assistant", call("c1", b=-1)),
        (2, 1, "tool", result("zz", "none asked")),
        (2, 2, "assistant", call("d", a=1)),
        (2, 3, "assistant", call("d", a=1)),
        (2, 4, "assistant", call("e", a={"$result": "f"})),
        (2, 5, "assistant", call("f", a={"$result": "e"})),
        (2, 6, "assistant", call("g", a={"$result": "nowhere"})),
        (None, None, None, None),
        (3, 1, "user", '{"tool_calls": []}'),
        (3, 2, "assistant", "{broken"),
        (3, 2, "assistant", "{broken"),
    ]
    for how in ({}, {"bucket_turns": 2}):
        got = run(spark, rows, **how)
        assert len(got) == len(rows)
        one = [r for r in got if r.conv_id == 1]
        assert [r.turn for r in one] == [0, 2, 3, 4, 1, 5] and [r.place for r in one] == list(range(6)) and {r.status for r in one} == {"ok"}
        assert one[2].message == '{"content":"{\\"a\\":[1,2.5],\\"z\\":1}","role":"tool","tool_call_id":"c1"}'
        assert one[1].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":2,"b":3},"id":"c1","name":"add"}]}'
        two = {r.turn: r for r in got if r.conv_id == 2}
        assert [two[t].status for t in range(7)] == ["invalid_arguments", "orphan", "duplicate_id", "duplicate_id", "cycle", "cycle", "unknown_need"]
        assert two[0].problems == ["$.a: missing", "$.b: size"]
        assert sum(r.n_linked for r in one) == 4
        assert [r.message for r in got if r.conv_id is None] == ['{"content":null,"role":null}']


def test_every_call_precedes_what_needs_it(spark):
    n = 40
    rows = [(7, n - k, "assistant", call(f"k{k}", a={"$result": f"k{k - 1}"} if k else 0)) for k in range(n)]
    got = run(spark, rows)
    assert [r.turn for r in got] == [n - k for k in range(n)]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    rows = [(1, 0, "assistant", call("c", a=1))] * 2 + [(1, 1, "tool", result("c", "x"))]
    got = run(spark, rows)
    assert [r.status for r in got] == ["duplicate_id"] * 3 and [(r.n_calls, r.n_linked) for r in got] == [(1, 1), (1, 1), (0, 1)]


def test_odd_texts(spark):
    """Lone surrogates, deep nesting and numbers beyond doubles are no reason to fail, and what comes out is JSON."""
    deep = '{"content":' + "[" * 3000 + "]" * 3000 + ',"tool_calls":[]}'
    lone = json.dumps({"content": "\ud83d", "tool_calls": [{"id": "\udc00", "name": "add", "arguments": {"\ud800": {"$result": "\udc00x"}, "a": 1}}]})
    rows = [(1, 0, "assistant", lone), (1, 1, "tool", json.dumps({"tool_call_id": "\udc00", "content": ["\ud83d"]})), (1, 2, "assistant", deep), (1, 3, "assistant", '{"content": 1e999, "tool_calls": []}')]
    rows += [(1, 4, "assistant", call("n", a=10**400, b=10**400)), (1, 5, "assistant", '{"tool_calls": [{"id": "s", "name": "add", "arguments": "' + "[" * 3000 + '"}]}'), (1, 6, "user", "x" * 3_000_000), (1, 7, "user", "")]
    got = run(spark, rows)
    assert [r.turn for r in got] == list(range(8))
    told = [json.loads(r.message, parse_constant=lambda c: 1 / 0) for r in got]
    assert told[0]["content"] == "\ud83d" and told[0]["tool_calls"][0]["id"] == "\udc00" and got[0].n_linked == 1 and got[1].n_linked == 1
    assert told[2]["content"] == deep and told[3]["content"] == rows[3][3] and told[4]["tool_calls"][0]["arguments"]["a"] == 10**400
    assert told[5]["tool_calls"][0]["arguments"] == "[" * 3000 and told[6]["content"] == rows[6][3] and told[7]["content"] == ""


def brute(rows):
    """(turn, place, n_linked, status) of each row of one conversation, by hand."""
    known = []
    for turn, role, text in rows:
        _, calls, answers = parse(role, text)
        known.append((turn, [(c["id"], sorted(_needs(c["arguments"]))) for c in calls], answers))
    owner, times, answer_at = {}, {}, {}
    for k, (turn, calls, answers) in enumerate(known):
        for i, _ in calls:
            times[i] = times.get(i, 0) + 1
            owner[i] = min(owner.get(i, (turn, k)), (turn, k))
        if answers is not None:
            answer_at[answers] = max(answer_at.get(answers, -1), turn)
    time, level, path, late = {}, {}, [], set()

    def ready(k):
        if k in time:
            return k not in late
        if k in path:
            return False
        path.append(k)
        at, high, good = known[k][0], 0, True
        for _, needs in known[k][1]:
            for n in needs:
                if n in owner:
                    o = owner[n][1]
                    if not ready(o):
                        good = False
                        continue
                    at, high = max(at, time[o], answer_at.get(n, -1)), max(high, level[o] + 1)
        path.remove(k)
        if good:
            time[k], level[k] = at, high
        return good

    callers = [k for k, x in enumerate(known) if x[1]]
    for k in callers:
        if not ready(k):
            late.add(k)
    out = []
    for k, (turn, calls, answers) in enumerate(known):
        t, stage, linked, status = turn, 0, 0, "ok"
        if calls:
            t, stage, linked = (turn, 0, 0) if k in late else (time[k], 2 * level[k], 0)
            linked = sum(i in answer_at for i, _ in calls)
            status = "cycle" if k in late else "duplicate_id" if any(times[i] > 1 for i, _ in calls) else "unknown_need" if any(n not in owner for _, ns in calls for n in ns) else "unanswered" if linked < len(calls) else "ok"
        elif answers is not None:
            if answers in owner:
                o = owner[answers][1]
                t, stage, linked = max(turn, turn if o in late else time[o]), 1 + (0 if o in late else 2 * level[o]), 1
                status = "duplicate_id" if times[answers] > 1 else "ok"
            else:
                stage, status = 1, "orphan"
        out.append((t, stage, turn, k, linked, status))
    return [(x[2], place, x[4], x[5]) for place, x in enumerate(sorted(out))]


@pytest.mark.parametrize("how", [{}, {"bucket_turns": 3}, {"bucket_turns": 2, "most_calls": 2}])
def test_equals_brute_force(spark, how):
    r = random.Random(5)
    rows = []
    for conv in range(40):
        ids = [f"k{i}" for i in range(r.randint(1, 12))]
        for turn in range(r.randint(1, 25)):
            kind = r.random()
            if kind < 0.5:
                made = [{"id": r.choice(ids) if r.random() < 0.2 else f"u{turn}", "name": "any", "arguments": {str(k): {"$result": r.choice([*ids, *(f"u{x}" for x in range(25))])} for k in range(r.choice([0, 0, 1, 2]))}} for _ in range(r.choice([1, 1, 2]))]
                made = list({c["id"]: c for c in made}.values())
                rows.append((conv, turn, "assistant", json.dumps({"content": f"{turn}", "tool_calls": made})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", result(r.choice([*ids, *(f"u{x}" for x in range(25))]), f"{turn}")))
            else:
                rows.append((conv, turn, "user", f"{turn}"))
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], SCHEMA)
    got = {}
    for x in format_chats(df, None, **how).collect():
        got.setdefault(x.conv_id, []).append((x.turn, x.place, x.n_linked, x.status))
    for conv in range(40):
        own = [(t, role, text) for c, t, role, text in rows if c == conv]
        assert sorted(got.get(conv, [])) == sorted(brute(own)), conv


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, made = 3000, []
    monkeypatch.setattr(chat_format.scratch, "table", lambda df, name, real=chat_format.scratch.table: made.append(name) or real(df, name))
    rows = [(7, n - k, "assistant", call(f"k{k}", a={"$result": f"k{k - 1}"} if k else 0)) for k in range(n)]
    got = run(spark, rows, bucket_turns=500)
    assert [r.turn for r in got] == [n - k for k in range(n)] and made.count("new") <= 8


@pytest.mark.parametrize("turn", [lambda k: 2000 - k, lambda k: k * 7919 % 2000])
def test_chains_through_many_cuts_take_few_rounds(spark, monkeypatch, turn):
    n, made = 2000, []
    monkeypatch.setattr(chat_format.scratch, "table", lambda df, name, real=chat_format.scratch.table: made.append(name) or real(df, name))
    rows = [(7, turn(k), "assistant", call(f"k{k}", a={"$result": f"k{k - 1}"} if k else 0)) for k in range(n)]
    got = run(spark, rows, bucket_turns=500, most_calls=8)
    latest, want = -1, []
    for k in range(n):
        latest = max(latest, turn(k))
        want.append((latest, k, turn(k)))
    assert [r.turn for r in got] == [t for _, _, t in sorted(want)] and made.count("new") <= 14
    assert {r.status for r in got} == {"unanswered"}


def test_canonical_and_schema():
    assert canonical({"b": 1.0, "a": [{"y": "é", "x": None}]}) == '{"a":[{"x":null,"y":"é"}],"b":1}'
    assert violations({"a": 1, "c": 2}, TOOLS["add"]) == ["$.c: unknown"] and violations(True, {"type": "integer"}) == ["$: not integer"]
    assert violations([1, "x"], {"type": "array", "items": {"type": "number"}, "maxItems": 1}) == ["$: length", "$[1]: not number"]
    assert parse("assistant", '{"a": NaN}')[0] == '{"a": NaN}' and parse("user", "{}") == ("{}", [], None)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"pattern": "^[a-z]+$"}, ["abc"], ["a1", ""]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 4], [2]),
        ({"oneOf": [{"minimum": 0}, {"multipleOf": 2}]}, [1, -2], [2, -1]),
        ({"allOf": [{"minimum": 0}, {"exclusiveMaximum": 5}], "not": {"const": 3}}, [0, 4.5], [5, -1, 3]),
        ({"exclusiveMinimum": 1, "multipleOf": 0.1}, [1.1, 2, 1.3], [1, 1.15]),
        ({"uniqueItems": True, "prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1, 2], []], [["a", 1, 1.0], [1], ["a", "b"]]),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": {"type": "string"}, "minProperties": 1}, [{"x1": 1, "y": "s"}], [{}, {"x1": "s"}, {"y": 1}]),
        ({"propertyNames": {"maxLength": 2}, "additionalProperties": True}, [{"ab": 1}], [{"abc": 1}]),
        ({"items": False}, [[]], [[1]]),
    ],
)
def test_words_of_schemas(schema, good, bad):
    from tidyspark.llm.chat_format import checked, violations

    assert [violations(v, checked(schema)) for v in good] == [[] for _ in good]
    assert all(violations(v, schema) for v in bad)


def test_a_schema_with_an_unknown_word_is_an_error(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"items": {"minContains": 1}}}}, {"anyOf": [{"if": {}}]}):
        with pytest.raises(ValueError, match="unknown word"):
            format_chats(df, {"tool": schema})

"""Chat formatting with linked tool calls.

A message's text is plain, or a JSON object: an assistant's ``{"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}``, a tool's
``{"tool_call_id": ..., "content": ...}``.  Calls and results are linked by a hash join on conversation and identifier.  A call may use
earlier results (``{"$result": "<id>"}`` anywhere in its arguments).  Messages are put in topological order: each at its own turn
or behind all that it needs, whichever is later; a call needs the answers to the calls it uses.  Calls in or behind a cycle are marked and keep their turn.  Arguments are
validated against JSON schemas, and each message is serialised as canonical JSON (sorted keys, no blanks, shortest numbers, lone surrogates escaped).

Conversations are never gathered: a message is a row throughout, and places in a conversation are prefix sums over turn ranges.  Calls are
ordered in rounds: a task takes the open calls of a stretch of turns and settles all that need nothing open elsewhere; from round to round the
stretches double as long as they hold no more than ``most_calls`` open ones, and what needs a message that waits for a single other one comes to need that
other, so chains settle in a few rounds however long they are and however they are cut.  Only where messages need several open ones each, all along a
conversation that is cut, a round settles one cut.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

DEEPEST = 200  # levels of nesting; a text with more is plain
_LONE = re.compile("[\ud800-\udfff]")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(kind: str, value) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS.get(kind, object))


#: Words of a JSON schema that assert something, and such as only describe.
_ASSERTING = frozenset(
    "type enum const required properties patternProperties additionalProperties propertyNames minProperties maxProperties items prefixItems minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not".split()
)
_DESCRIBING = frozenset("title description default examples deprecated readOnly writeOnly format $schema $id $comment".split())


def checked(schema: dict | bool) -> dict | bool:
    """The schema itself; a ValueError if it has a word that ``violations`` does not know, as ``$ref``."""
    if isinstance(schema, bool):
        return schema
    for word in schema:
        if word not in _ASSERTING and word not in _DESCRIBING:
            raise ValueError(f"unknown word in a schema: {word}")
    inner = [*schema.get("properties", {}).values(), *schema.get("patternProperties", {}).values(), *schema.get("allOf", []), *schema.get("anyOf", []), *schema.get("oneOf", []), *schema.get("prefixItems", [])]
    inner += [schema[w] for w in ("items", "not", "additionalProperties", "propertyNames") if w in schema]
    for one in inner:
        checked(one)
    for pattern in (schema.get("pattern", ""), *schema.get("patternProperties", {})):
        re.compile(pattern)
    return schema


def _multiple(value, step) -> bool:
    return (Fraction(value) / Fraction(str(step))).denominator == 1 if isinstance(value, int) else (Fraction(repr(value)) / Fraction(str(step))).denominator == 1


def violations(value, schema: dict | bool, path: str = "$") -> list[str]:
    """What a value breaks of a JSON schema, by the words that ``checked`` lets pass; a reference to another call's result breaks nothing, as it is known only when the tool runs."""
    if isinstance(value, dict) and set(value) == {"$result"} or schema is True:
        return []
    if schema is False:
        return [f"{path}: nothing is allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(k, value) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")
    for one in schema.get("allOf", []):
        out += violations(value, one, path)
    if "anyOf" in schema and all(violations(value, one, path) for one in schema["anyOf"]):
        out.append(f"{path}: none of anyOf")
    if "oneOf" in schema and (fit := sum(not violations(value, one, path) for one in schema["oneOf"])) != 1:
        out.append(f"{path}: {fit} of oneOf")
    if "not" in schema and not violations(value, schema["not"], path):
        out.append(f"{path}: not allowed")
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{path}: length"] if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf) else []
        for k in sorted(value):
            if "propertyNames" in schema:
                out += violations(k, schema["propertyNames"], f"{path}.{k}")
            fitting = [known[k]] if k in known else []
            fitting += [one for pattern, one in patterns.items() if re.search(pattern, k)]
            for one in fitting:
                out += violations(value[k], one, f"{path}.{k}")
            if not fitting and schema.get("additionalProperties", True) is not True:
                out += [f"{path}.{k}: unknown"] if schema["additionalProperties"] is False else violations(value[k], schema["additionalProperties"], f"{path}.{k}")
    elif isinstance(value, list):
        out += [f"{path}: length"] if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf) else []
        out += [f"{path}: repeats"] if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value) else []
        first = schema.get("prefixItems", [])
        for i, x in enumerate(value):
            out += violations(x, first[i] if i < len(first) else schema.get("items", {}), f"{path}[{i}]")
    elif isinstance(value, str):
        out += [f"{path}: length"] if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf) else []
        out += [f"{path}: pattern"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        fits = schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf) and schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf)
        out += [] if fits else [f"{path}: size"]
        out += [f"{path}: no multiple"] if "multipleOf" in schema and not _multiple(value, schema["multipleOf"]) else []
    return out


def canonical(value) -> str:
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return printable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def printable(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _needs(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {value["$result"]}
        return set().union(*map(_needs, value.values())) if value else set()
    return set().union(*map(_needs, value)) if isinstance(value, list) and value else set()


def _constant(name: str):
    raise ValueError(name)  # NaN and the infinities are no JSON


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError(digits)
    return value


def _loaded(text: str):
    """The JSON value of a text; a ValueError if it is none, has numbers beyond the range of doubles, or is nested too deeply."""
    try:
        value = json.loads(text, parse_constant=_constant, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    layer, depth = [value], 0
    while layer:
        depth += 1
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        layer = [y for x in layer if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
    return value


def parse(role: str | None, text: str | None) -> tuple[str | None, list[dict], str | None]:
    """Content, calls and the identifier of the call that a tool message answers."""
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return text, [], None
    try:
        found = _loaded(text)
    except ValueError:
        return text, [], None
    if role == "tool" and isinstance(found.get("tool_call_id"), str):
        content = found.get("content")
        return content if isinstance(content, str) or content is None else canonical(content), [], found["tool_call_id"]
    calls = found.get("tool_calls")
    if role != "assistant" or not isinstance(calls, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        return text, [], None
    content = found.get("content")
    out = []
    for c in calls:
        arguments = c.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = _loaded(arguments)
            except ValueError:
                pass
        out.append({"id": c["id"], "name": c["name"], "arguments": arguments})
    return content if isinstance(content, str) or content is None else canonical(content), out, None


_MESSAGE = "conv_id long, turn long, role string, message string, message_id string, n_calls int, answers string, calls array<struct<call_id:string,needs:array<string>,problems:array<string>>>"


def _parsed(df: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, text, name in zip(*(batch.column(i).to_pylist() for i in range(5))):
                content, calls, answers = parse(role, text)
                message = {"role": role, "content": content} | ({"tool_calls": calls} if calls else {}) | ({"tool_call_id": answers} if answers is not None else {})
                told = [
                    {"call_id": canonical(c["id"]), "needs": sorted(map(canonical, _needs(c["arguments"]))), "problems": [printable(x) for x in violations(c["arguments"], schemas[c["name"]])] if c["name"] in schemas else ["$: unknown tool"] if schemas else []}
                    for c in calls
                ]
                out.append((conv, turn, role, canonical(message), name, len(calls), None if answers is None else canonical(answers), told))
            if out:
                call = pa.struct([("call_id", pa.string()), ("needs", pa.list_(pa.string())), ("problems", pa.list_(pa.string()))])
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(call))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "turn", "role", "message", "message_id", "n_calls", "answers", "calls"])

    return df.mapInArrow(rows, _MESSAGE)


_SETTLED = pa.schema([("__conv", pa.string()), ("message_id", pa.string()), ("time", pa.int64()), ("level", pa.int32())])


def _settle(table: pa.Table) -> pa.Table:
    """The messages of one stretch that can be settled: times and levels.

    A row is a message with calls, when (``at``) and at what level it may be ready for all that is settled, and one message it needs that isn't (null if there is none),
    with the time of the answer it waits for (null for none) and how many levels it stands higher; ``near`` tells whether the needed one is among the messages of this table.
    """
    time: dict[str, int] = {}
    level: dict[str, int] = {}
    behind: dict[str, list[tuple[str, int | None, int]]] = {}
    unmet: dict[str, int] = {}
    for message, at, high, need, answer, lift, near in zip(*(table[c].to_pylist() for c in ("message_id", "at", "level", "need", "answer_at", "lift", "near"))):
        time[message], level[message] = at, high
        unmet.setdefault(message, 0)
        if need is not None:
            unmet[message] += 1
            if near:
                behind.setdefault(need, []).append((message, answer, lift))
    ready = [m for m, n in unmet.items() if not n]
    for message in ready:  # grows while it is read
        for other, answer, lift in behind.get(message, ()):
            time[other] = max(time[other], time[message], time[message] if answer is None else answer)
            level[other] = max(level[other], level[message] + lift)
            unmet[other] -= 1
            if not unmet[other]:
                ready.append(other)
    return pa.table([[table["__conv"][0].as_py()] * len(ready), ready, [time[m] for m in ready], [level[m] for m in ready]], schema=_SETTLED)


def _told(waiting: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What waits and what it waits for, once ``new`` messages are settled: those become bounds on the time and level of all that need them."""
    keys = ["__conv", "message_id"]
    found = new.select("__conv", F.col("message_id").alias("need"), F.col("time").alias("__t"), F.col("level").alias("__l"))
    met = scratch.table(edges.join(waiting.select(*keys), keys, "left_semi").join(found, ["__conv", "need"], "left"), "met")
    bounds = met.filter("__t IS NOT NULL").groupBy(*keys).agg(F.max(F.greatest("__t", "answer_at")).alias("__at"), F.max(F.col("__l") + F.col("lift")).alias("__high"))
    waiting = waiting.join(bounds, keys, "left").withColumn("at", F.greatest("at", "__at")).withColumn("level", F.greatest("level", "__high")).drop("__at", "__high")
    return scratch.table(waiting, "bounded"), met.filter("__t IS NULL").drop("__t", "__l")


def _hopped(waiting: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What needs a message that itself waits for one other alone now needs that other: chains halve, wherever they are cut.

    A message ready no earlier than x and than another one is as good as a bound x and the other one for all that need it, so times and levels stay exact.
    """
    keys = ["__conv", "message_id"]
    single = edges.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("need").alias("__via"), F.first("answer_at").alias("__answer"), F.first("lift").alias("__lift")).filter("__n = 1")
    single = single.join(waiting.select(*keys, F.col("at").alias("__at"), F.col("level").alias("__level")), keys).withColumnRenamed("message_id", "need").drop("__n")
    far = edges.join(single, ["__conv", "need"], "left")
    far = scratch.table(far.select(*keys, F.coalesce("__via", "need").alias("need"), F.greatest("answer_at", "__answer", "__at").alias("answer_at"), (F.col("lift") + F.coalesce("__lift", F.lit(0))).cast("int").alias("lift"), (F.col("__level") + F.col("lift")).alias("__high")), "hopped")
    raised = far.groupBy(*keys).agg(F.max("__high").alias("__high"))
    waiting = waiting.join(raised, keys, "left").withColumn("level", F.greatest("level", "__high")).drop("__high")
    return waiting, far.groupBy(*keys, "need").agg(F.max("answer_at").alias("answer_at"), F.max("lift").alias("lift"))


def _placed(waiting: DataFrame, stretch: int, rounds: int, most_nodes: int) -> DataFrame:
    """``waiting`` with the task that each message goes to: the stretch of this round, if it holds few enough, or else the last one that did, or else a run of turns of a first stretch.

    Runs are cut by counts of each turn, so a window holds at most ``stretch`` rows; one turn with more messages than ``most_nodes`` is dealt by hash.
    """
    wide = F.floor(F.col("time") / (stretch << min(rounds, 47)))
    fits = waiting.groupBy("__conv", wide.alias("__wide")).agg((F.count("*") <= most_nodes).alias("__fits"))
    waiting = waiting.drop("__run", "__deal").withColumn("__wide", wide).join(fits, ["__conv", "__wide"])
    first = F.floor(F.col("time") / stretch)
    turns = waiting.filter("NOT __fits AND __width = 0").groupBy("__conv", first.alias("__first"), "time").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__conv", "__first").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("__conv", "time", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / most_nodes).alias("__run"), F.ceil(F.col("__n") / most_nodes).alias("__deals"))
    waiting = waiting.join(turns, ["__conv", "time"], "left")
    kept = F.when(F.col("__width") > 0, F.col("__stretch"))
    place = {
        "__stretch": F.when(F.col("__fits"), F.col("__wide")).otherwise(F.coalesce(kept, first)),
        "__deal": F.when(F.col("__fits") | (F.col("__width") > 0), 0).otherwise(F.pmod(F.xxhash64("message_id"), F.col("__deals"))),
        "__run": F.when(F.col("__fits") | (F.col("__width") > 0), 0).otherwise(F.col("__run")),
        "__width": F.when(F.col("__fits"), rounds + 1).otherwise(F.col("__width")),
    }
    return waiting.select("__conv", "message_id", "time", "at", "level", *(c.alias(name) for name, c in place.items()))


def _ordered(nodes: DataFrame, edges: DataFrame, stretch: int, most_nodes: int) -> DataFrame:
    """``__conv, message_id, time, level, late``: when each message is ready, how many stand behind one another until it, and whether it waits for a cycle.

    ``nodes`` has ``__conv, message_id, time``; ``edges`` ``__conv, message_id, need, answer_at``: the message that it needs, and when the answer is there.
    A round settles what needs nothing open outside its stretch, and then lets all that is left look past single needs.
    """
    keys = ["__conv", "message_id"]
    needy = edges.select(*keys).distinct()
    settled = [nodes.join(needy, keys, "left_anti").withColumn("level", F.lit(0))]
    if not edges.limit(1).count():
        return settled[0].withColumn("late", F.lit(False))
    new = settled[0] = scratch.table(settled[0], "settled")
    waiting = nodes.join(needy, keys, "left_semi").withColumns({"at": F.col("time"), "level": F.lit(0), "__stretch": F.lit(0).cast("long"), "__width": F.lit(0)})
    edges, place = edges.withColumn("lift", F.lit(1)), ["__stretch", "__width", "__run", "__deal"]
    for rounds in range(1 << 62):
        waiting, edges = _told(waiting, edges, new)
        if rounds:
            waiting, edges = _hopped(waiting, edges)
        waiting = scratch.table(_placed(waiting, stretch, rounds, most_nodes), "waiting")
        where = waiting.select("__conv", F.col("message_id").alias("need"), F.struct(*place).alias("__there"))
        pairs = waiting.join(edges, keys, "left").join(where, ["__conv", "need"], "left")
        pairs = pairs.withColumn("near", F.coalesce(F.struct(*place) == F.col("__there"), F.lit(False))).drop("__there")
        new = scratch.table(pairs.groupBy("__conv", *place).applyInArrow(_settle, "__conv string, message_id string, time long, level int"), "new")
        if not new.limit(1).count():  # what waits for no cycle has something among it that needs nothing open
            break
        settled.append(new)
        if len(settled) > 32:
            settled = [scratch.table(reduce(DataFrame.unionByName, settled), "settled")]
        waiting = waiting.join(new.select(*keys), keys, "left_anti")
        if not waiting.limit(1).count():
            break
    late = waiting.select(*keys, "time", F.lit(0).alias("level"), F.lit(True).alias("late"))
    return reduce(DataFrame.unionByName, settled).select(*keys, "time", "level", F.lit(False).alias("late")).unionByName(late)


def format_chats(
    df: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bucket_turns: int = 10_000, most_calls: int = 1 << 17
) -> DataFrame:
    """One row per input row: ``conv_id, turn, place, role, message, n_calls, n_linked, status, problems``.

    ``place`` counts from 0 in topological order, ties by turn and then message; ``status`` is ``ok``, or the first that holds of ``cycle``, ``duplicate_id`` (two
    calls of the conversation have the identifier), ``orphan`` (a result without call), ``invalid_arguments``, ``unknown_need`` and ``unanswered``.
    Null texts have null content, empty ones empty content; null roles and turns are kept, a null turn stands first; rows with a null conversation are one conversation.
    Repeated rows stay, each with its own calls and links, and are told apart by nothing but their place.  Texts of any length are read whole.  A text that is no
    JSON object, has numbers beyond doubles, or is nested deeper than ``DEEPEST`` levels is plain.  An empty table has no rows; other columns play no part,
    whatever their names.  A schema with a word that isn't known (``$ref``) is an error, as its arguments would pass unseen.
    """
    for schema in (schemas or {}).values():
        checked(schema)
    columns = (conv_col, turn_col, role_col, text_col)
    key = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)).cast("string")
    picked = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), key.alias("message_id"))
    messages = scratch.table(_parsed(picked, schemas or {}), "messages")
    # Only messages with calls or answers take part in linking; conversations are joined null-safe through a key that is never null.
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__conv")
    start = F.coalesce("turn", F.lit(-(1 << 62)))
    callers = messages.filter("n_calls > 0").groupBy(conv, "message_id").agg(F.min(start).alias("at"), F.count("*").alias("copies"), F.first("calls").alias("calls"))  # repeated rows are one message here
    calls = callers.select("__conv", "message_id", "at", "copies", F.explode("calls").alias("c")).select("__conv", "message_id", "at", "copies", "c.*")
    calls = scratch.table(calls, "calls")
    answers = messages.filter("answers IS NOT NULL").select(conv, "message_id", start.alias("at"), F.col("answers").alias("call_id"))
    answered = answers.groupBy("__conv", "call_id").agg(F.max("at").alias("answer_at"), F.lit(True).alias("answered"))
    first = calls.groupBy("__conv", "call_id").agg(F.sum("copies").alias("times"), F.min(F.struct("at", "message_id")).getField("message_id").alias("owner")).join(answered, ["__conv", "call_id"], "left")
    first = scratch.table(first, "first")
    linked = answers.dropDuplicates(["__conv", "message_id"]).join(first.select("__conv", "call_id", "times", "owner"), ["__conv", "call_id"], "left")

    # A message is ready behind the answers to all calls that its own calls use, an answer behind the message with its call.
    needs = calls.select("__conv", "message_id", F.explode("needs").alias("need")).distinct()
    target = first.select("__conv", F.col("call_id").alias("need"), "owner", "answer_at")
    known = needs.join(target, ["__conv", "need"]).groupBy("__conv", "message_id", F.col("owner").alias("need")).agg(F.max("answer_at").alias("answer_at"))
    unknown = needs.join(target, ["__conv", "need"], "left_anti").select("__conv", "message_id", F.lit(True).alias("unknown")).distinct()
    nodes = scratch.table(callers.select("__conv", "message_id", F.col("at").alias("time")), "nodes")
    ready = scratch.table(_ordered(nodes, scratch.table(known, "needs"), bucket_turns, most_calls), "ready")

    facts = calls.join(first.select("__conv", "call_id", "times", "answered"), ["__conv", "call_id"])
    of_calls = facts.groupBy("__conv", "message_id").agg(F.count("answered").alias("linked"), F.max("times").alias("times"), F.flatten(F.sort_array(F.collect_set("problems"))).alias("problems"), F.max(F.col("answered").isNull()).alias("open"))
    of_calls = of_calls.join(ready.withColumnRenamed("late", "cycle"), ["__conv", "message_id"]).join(unknown, ["__conv", "message_id"], "left")
    owners = ready.select("__conv", F.col("message_id").alias("owner"), F.col("time").alias("a_time"), F.col("level").alias("a_level"))
    of_answers = linked.join(owners, ["__conv", "owner"], "left").select("__conv", "message_id", "a_time", "a_level", F.col("times").alias("a_times"))
    joined = messages.withColumn("__conv", conv).join(of_calls, ["__conv", "message_id"], "left").join(of_answers, ["__conv", "message_id"], "left")
    status = (
        F.when(F.col("cycle"), "cycle").when(F.greatest("times", "a_times") > 1, "duplicate_id").when(F.col("answers").isNotNull() & F.col("a_times").isNull(), "orphan")
        .when(F.size("problems") > 0, "invalid_arguments").when(F.col("unknown"), "unknown_need").when(F.col("open"), "unanswered").otherwise("ok")
    )
    time = F.greatest(start, F.coalesce("time", start), F.coalesce("a_time", start))
    stage = 2 * F.coalesce("level", "a_level", F.lit(0)) + F.col("answers").isNotNull().cast("int")
    ordered = joined.withColumn("__time", time).withColumn("__stage", stage).withColumn("__range", F.floor(F.col("__time") / bucket_turns))
    ordered = ordered.select("__conv", "conv_id", "turn", "role", "message", "n_calls", F.coalesce("linked", F.when(F.col("a_times").isNotNull(), 1), F.lit(0)).cast("int").alias("n_linked"), status.alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), "__time", "__stage", "__range")
    ordered = scratch.table(ordered, "ordered")
    sums = ordered.groupBy("__conv", "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__conv").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__conv", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__conv", "__range").orderBy("__time", "__stage", "turn", "message")
    out = ordered.withColumn("__nth", F.row_number().over(inside)).join(sums, ["__conv", "__range"])
    return out.select("conv_id", "turn", (F.col("__before") + F.col("__nth") - 1).alias("place"), "role", "message", "n_calls", "n_linked", "status", "problems")

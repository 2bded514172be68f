"""Chat formatting: tool calls linked with their results, in dependency order, as canonical JSON.

Calls and results meet in a hash join on their identifiers. Calls are ordered so that each stands behind the calls it
depends on: positions in the conversation already are such an order except where a call comes before one it needs; the
number of such steps back on a call's longest dependency path is its level, and (level, position) is the order. Only
conversations with a step back are worked on: many together in a task. Those with very many dependencies are worked on
by joins: chains of calls with one need each are shortened by doubling, and what is left settles in rounds, as many as
calls with several needs stand behind one another. Calls on or behind a dependency circle never settle, are marked, and
stand at the end. Arguments are checked against their tool's schema, and every call is written as JSON with sorted keys,
no spaces and no escapes that JSON doesn't ask for; a conversation's lines get places in that order, and documents() puts
them together in pieces of bounded size.

A call without a result is unlinked, and a result without a call is dropped. Null or broken arguments, arguments that
hold NaN, Infinity, a number beyond a double's range, a lone surrogate or more than DEEPEST levels, and a tool without a
schema or with a broken one, are errors of the call; arguments that aren't JSON that can be written are kept as text. Of
results that repeat an identifier the earliest counts (of those, the least content), of schemas with one name the last
in order; repeated calls are repeated. Calls with a null identifier or a null conversation are never linked and have no
dependents. Texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.common import require, written

#: The registered query's tools: name and schema.
SCHEMAS = [
    ("convert", '{"properties":{"amount":{"type":"integer"},"text":{"type":"string"}},"required":["amount","text"]}'),
    ("lookup", '{"properties":{"limit":{"type":"integer"},"query":{"type":"string"}},"required":["query"]}'),
    ("notify", '{"additionalProperties":false,"properties":{"text":{"type":"string"}},"required":["text"]}'),
]

#: Dependencies of conversations that one task settles together; a conversation with more is settled by joins.
TOGETHER = 50_000
#: Levels of nesting that arguments may have.
DEEPEST = 100
#: Lines in a piece of a formatted conversation.
PIECE = 1_000

# What JSON Schema calls the types that json gives.
_kinds = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


class BrokenSchema(ValueError):
    """A schema that isn't one."""


def _float(text: str) -> float:
    found = float(text)
    if found in (float("inf"), float("-inf")):
        raise ArithmeticError
    return found


def _int(text: str) -> int:
    if len(text) > 400:
        raise ArithmeticError
    return int(text)


def _constant(text: str) -> None:
    raise ValueError(text)


def read_json(text: str | None) -> tuple[object, str | None]:
    """(value, None) of strict JSON that can be written again, else (the text, what is wrong)."""
    try:
        value = json.loads(text, parse_float=_float, parse_int=_int, parse_constant=_constant)
        level = [value]
        for _ in range(DEEPEST):
            level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if level:
            return text, "$: nested too deeply"
        json.dumps(value, ensure_ascii=False).encode()
    except RecursionError:
        return text, "$: nested too deeply"
    except UnicodeEncodeError:
        return text, "$: lone surrogate"
    except ArithmeticError:
        return text, "$: number out of range"
    except (TypeError, ValueError):
        return text, "$: not JSON"
    return value, None


def canonical(value) -> str:
    """JSON with sorted keys and without spaces; a float of a whole number is that number."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def same(a, b) -> bool:
    """Equality as JSON has it: 1 is 1.0 and isn't true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or not isinstance(value, float) or value.is_integer())
    if kind not in _kinds:
        raise BrokenSchema(f"type {kind}")
    return isinstance(value, _kinds[kind])


def problems(value, schema, at: str = "$") -> list[str]:
    """Where a value breaks a schema of type (a name or a list of them), properties, required, additionalProperties,
    items, enum, const, minimum, maximum, minLength, maxLength, minItems and maxItems; true and false are schemas too."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: unknown"]
    wants = {"properties": dict, "required": list, "enum": list, "type": (str, list), "items": (dict, bool), "additionalProperties": (dict, bool)}
    if not isinstance(schema, dict) or any(k in schema and not isinstance(schema[k], kind) for k, kind in wants.items()):
        raise BrokenSchema("shape")
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any([_is(value, k) for k in kinds]):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if ("enum" in schema and not any(same(value, x) for x in schema["enum"])) or ("const" in schema and not same(value, schema["const"])):
        out.append(f"{at}: not in enum")
    size = value if _is(value, "number") else None
    out += [f"{at}: {word}" for key, word, n in (("minimum", "too small", size), ("minLength", "too short", len(value) if isinstance(value, str) else None), ("minItems", "too short", len(value) if isinstance(value, list) else None)) if key in schema and n is not None and n < schema[key]]
    out += [f"{at}: {word}" for key, word, n in (("maximum", "too large", size), ("maxLength", "too long", len(value) if isinstance(value, str) else None), ("maxItems", "too long", len(value) if isinstance(value, list) else None)) if key in schema and n is not None and n > schema[key]]
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            out += problems(value[k], known.get(k, more), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        out += [p for k, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{k}]")]
    return out


def judged(text: str | None, name: str | None, tools: dict) -> tuple[object, list[str]]:
    """(arguments, errors) of a call. tools: schemas by name, None for broken ones."""
    value, wrong = read_json(text)
    if wrong:
        return value, [wrong]
    if name not in tools:
        return value, [f"unknown tool {name}"]
    try:
        schema = tools[name]
        if not isinstance(schema, dict):
            raise BrokenSchema("shape")
        return value, problems(value, {"type": "object"} | schema)
    except (BrokenSchema, TypeError, RecursionError):
        return value, [f"broken schema of {name}"]


LEVELS = "conv_id long, call_id string, level int, circular boolean"


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, circular (on or behind a circle; level is null there) of calls in conversations with a
    step back; all others have level 0. calls: conv_id, call_id, turn, needs (ids of calls of the same conversation)."""
    nodes = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    links = calls.where("call_id is not null").select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = links.join(nodes, ["conv_id", "call_id"]).join(nodes.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("before")), ["conv_id", "need"])
    edges = written(edges.select("conv_id", "need", "call_id", F.when((F.col("before") > F.col("turn")) | ((F.col("before") == F.col("turn")) & (F.col("need") >= F.col("call_id"))), 1).otherwise(0).alias("back")), "chat-edges")
    # Only conversations with a step back take part.
    counts = edges.groupBy("conv_id").agg(F.sum("back").alias("most"), F.count("*").alias("links")).where("most > 0").drop("most")
    active = written(edges.join(counts, "conv_id"), "chat-active")
    total, longest = active.agg(F.count("*"), F.max("links")).first()
    if not total:
        return edges.sparkSession.createDataFrame([], LEVELS)
    buckets = max(1, total // TOGETHER)
    grouped = active.where(F.col("links") <= TOGETHER).withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    settled = grouped.groupBy("bucket").applyInArrow(_settled, LEVELS)
    return settled if longest <= TOGETHER else settled.unionByName(_by_joins(active.where(F.col("links") > TOGETHER).drop("links")))


def _settled(table: pa.Table) -> pa.Table:
    """Levels of whole conversations, by taking calls whose needs have all been taken."""
    graphs: dict[int, list[tuple]] = {}
    for conv, need, call, back in zip(*(table.column(c).to_pylist() for c in ("conv_id", "need", "call_id", "back")), strict=True):
        graphs.setdefault(conv, []).append((need, call, back))
    out: list[tuple] = []
    for conv, links in graphs.items():
        behind: dict[str, list[tuple]] = {}
        open_: dict[str, int] = {}
        for need, call, back in links:
            behind.setdefault(need, []).append((call, back))
            open_[call] = open_.get(call, 0) + 1
            open_.setdefault(need, 0)
        level = dict.fromkeys(open_, 0)
        ready = [c for c, n in open_.items() if n == 0]
        while ready:
            need = ready.pop()
            for call, back in behind.get(need, ()):
                level[call] = max(level[call], level[need] + back)
                open_[call] -= 1
                if open_[call] == 0:
                    ready.append(call)
        out += [(conv, c, None if open_[c] else n, open_[c] > 0) for c, n in level.items()]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_())
    names = ("conv_id", "call_id", "level", "circular")
    return pa.table({n: pa.array([row[k] for row in out], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})


def _by_joins(edges: DataFrame) -> DataFrame:
    """The same for conversations too long for one task. A call with one need points at it; pointers are doubled until
    they lead to a call without needs or with several, or have gone round a circle. Calls with several needs then settle
    in rounds over what their needs' pointers lead to."""
    at = ["conv_id", "call_id"]
    edges = edges.withColumn("back", F.col("back").cast("long"))
    # Needs of each call; collecting those that stand alone leaves nothing of calls with many.
    many = edges.groupBy(*at).agg(F.count("*").alias("n"), F.min("need").alias("to"), F.min("back").alias("level"))
    chain = written(many.where("n = 1").select(*at, "to", "level"), "chat-chain")
    longest = chain.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        onward = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        chain = written(chain.join(onward, ["conv_id", "to"], "left").select(*at, F.coalesce("_to", "to").alias("to"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "chat-chain")
    # What still points at a call with one need is on or behind a circle of such calls.
    lost = chain.join(chain.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi").select(*at)
    chain = written(chain.join(lost, at, "left_anti"), "chat-chain")
    ways = edges.join(many.where("n > 1").select(*at), at, "left_semi")
    led = chain.select("conv_id", F.col("call_id").alias("need"), "to", F.col("level").alias("_level"))
    ways = ways.join(led, ["conv_id", "need"], "left").select(*at, F.coalesce("to", "need").alias("need"), (F.col("back") + F.coalesce("_level", F.lit(0))).alias("back"))
    ways = written(ways.groupBy(*at, "need").agg(F.max("back").alias("back")), "chat-ways")
    open_ = written(ways.groupBy(*at).agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("level")), "chat-open")
    # Calls without needs are settled from the start; of those, and of what they lead to, waits are taken off.
    starts = ways.select("conv_id", F.col("need").alias("call_id")).distinct().join(open_, at, "left_anti").join(lost, at, "left_anti")
    front, settled = written(starts.withColumn("level", F.lit(0).cast("long")), "chat-front"), []
    while not front.isEmpty():
        settled.append(front)
        met = ways.join(front.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"]).groupBy(*at).agg(F.count("*").alias("taken"), F.max(F.col("level") + F.col("back")).alias("to"))
        open_ = written(open_.join(met, at, "left").select(*at, (F.col("open") - F.coalesce("taken", F.lit(0))).alias("open"), F.greatest("level", "to").alias("level")), "chat-open")
        front, open_ = open_.where("open = 0").drop("open"), open_.where("open > 0")
    done = reduce(DataFrame.unionByName, settled, front)
    ends = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_level"))
    # A pointer's end that is neither among these nor open is a call without needs that no call with several needs has.
    behind = open_.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("_open"))
    chained = chain.join(ends, ["conv_id", "to"], "left").join(behind, ["conv_id", "to"], "left").select(*at, F.when(F.col("_open").isNull(), F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"))
    never = open_.select(*at).unionByName(lost).withColumn("level", F.lit(None).cast("long"))
    found = done.join(many.select(*at), at, "left_semi").unionByName(chained).unionByName(never)
    return found.select(*at, F.col("level").cast("int").alias("level"), F.col("level").isNull().alias("circular"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments, needs), results (conv_id, call_id, turn, content), schemas
    (name, schema) -> conv_id, call_id, turn, level, circular, linked, valid, errors, line.

    Lines of a conversation in the order (circular, level, turn, call_id) form its formatted tool use."""
    calls = require(calls, "conv_id", "call_id", "turn", "name", "arguments", "needs")
    answers = require(results, "conv_id", "call_id", "turn", "content").where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    met = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"], "left")
    # The tools: as many as the caller lists, shipped with the function.
    tools = {r["name"]: read_json(r["schema"])[0] for r in require(schemas, "name", "schema").orderBy("name", "schema").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, lines = [], []
            for call, name, text, answer in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "answer")), strict=True):
                value, found = judged(text, name, tools)
                errors.append(found)
                lines.append(canonical({"arguments": value, "id": call, "name": name, "result": answer["content"] if answer else None}))
            names = ["conv_id", "call_id", "turn", "level", "circular"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([a is not None for a in batch.column("answer").to_pylist()]), pa.array([not e for e in errors]), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())], names=[*names, "linked", "valid", "errors", "line"])

    ready = met.select("conv_id", "call_id", "turn", F.when(F.coalesce("circular", F.lit(False)), None).otherwise(F.coalesce("level", F.lit(0))).cast("int").alias("level"), F.coalesce("circular", F.lit(False)).alias("circular"), "name", "arguments", "answer")
    return ready.mapInArrow(run, "conv_id long, call_id string, turn long, level int, circular boolean, linked boolean, valid boolean, errors array<string>, line string")


def placed(lines: DataFrame) -> DataFrame:
    """linked_calls() with ``place``: each line's number, from 0, in its conversation. Rows are sorted by ranges, and
    numbered inside each; a range's numbers begin behind those of the ranges before it. A conversation of any length is
    spread over ranges."""
    order = ["conv_id", "circular", "level", "turn", "call_id", "line"]
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(lines.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "chat-ranges")
    held = rows.groupBy("conv_id", "_range").count()
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begin = held.select("conv_id", "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order[1:])) - 1
    met = rows.withColumn("_within", within).alias("r").join(begin.alias("b"), F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r._range") == F.col("b._range")))
    return met.select("r.*", (F.col("_within") + F.col("_begin")).alias("place")).drop("_range", "_within")


def documents(lines: DataFrame) -> DataFrame:
    """conv_id, piece (from 0), n_lines, text: each conversation's lines in order, one a row of text, in pieces of PIECE."""
    rows = placed(lines).withColumn("piece", F.floor(F.col("place") / PIECE))
    held = F.array_sort(F.collect_list(F.struct("place", "line")))
    return rows.groupBy("conv_id", "piece").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text"))


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: an assistant's turn is a call, of a tool chosen by its length, with
    its text as an argument, that needs the call four turns before (some need one two or four turns behind, which makes
    steps back and circles); the next turn is its result."""
    rows = require(turns, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.char_length("text")
    said = rows.where("role = 'assistant'").withColumn("n", n)
    arguments = (
        F.when(n % 3 == 0, F.to_json(F.struct(F.when(n % 4 == 0, n).alias("limit"), F.col("text").alias("query"))))
        .when(n % 3 == 1, F.to_json(F.struct(n.alias("amount"), F.when(n % 2 == 0, F.col("text")).alias("text"))))
        .otherwise(F.to_json(F.struct(F.col("text"), F.when(n % 7 == 0, n).alias("urgent"))))
    )
    needs = F.when(n % 11 == 0, F.col("turn") + 4).when((F.col("turn") % 4 < 2) & (n % 5 == 0), F.col("turn") + 2).otherwise(F.col("turn") - 4)
    calls = said.select(
        "conv_id",
        F.concat(F.lit("call-"), "turn").alias("call_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(n % 3 == 0, "lookup").when(n % 3 == 1, "convert").otherwise("notify").alias("name"),
        arguments.alias("arguments"),
        F.array(F.concat(F.lit("call-"), needs)).alias("needs"),
    )
    results = rows.where("role <> 'assistant'").select("conv_id", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"))
    return calls, results


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool calls of all conversations, linked, ordered, checked and written, with their places."""
    calls, results = derived_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = placed(linked_calls(calls, results, spark.createDataFrame(SCHEMAS, "name string, schema string")))
    return found.select("conv_id", "call_id", "turn", "level", "circular", "linked", "valid", F.array_join("errors", "; ").alias("errors"), "place", "line")

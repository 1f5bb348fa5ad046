"""Tool-call linking (operator 2).

Calls and results meet in a hash join on (conversation, identifier, number of
the use of that identifier), so repeated identifiers pair one to one and never
multiply. Calls are put into a topological order of what they need. Where every
need is an earlier turn, the order of turns is one; only conversations with a
forward need go through Kahn's rounds (a join for each level), and what never
gets free is on a cycle. Arguments are validated against JSON schemas and
written as canonical JSON (sorted keys, no spaces, no escapes but those that
JSON demands; an integral number below 1e21 has neither point nor exponent,
any other the fewest digits that read back as the same double).

Defined results
  null conv_id, turn, text  values like others; a null identifier is the text 'null'
  call without result       status unanswered, result null
  result without call       status orphan: no arguments, not valid
  repeated rows, ties       the k-th call of an identifier has its k-th result, by turn and text
  unknown tool, bad JSON    not valid; the arguments stay as a JSON string
  NaN, 1e999, very deep     bad JSON, as JSON has no such numbers and nothing here reads nesting beyond Python's limit
  lone surrogates           escaped in the canonical form (\\udXXX), as backslash escapes in names and errors
  very long texts           whole
  empty tables              no rows
  other columns             ignored, whatever their names
``turns_as_calls`` takes turns of the roles user and assistant only; other
turns are neither calls nor results. A conversation may be as long as it likes:
positions come from ranges of sorted calls, not from a window over all of it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.operators.prefix import sorted_ranks
from leafloom.session import bound_batches, materialise

#: The adapter's tool: a user's turn is a call, the assistant's next turn its result.
TURN_SCHEMAS = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}}

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, needs array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(text: str) -> float | int:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is not a number of JSON's")
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def parse(text: str):
    """A JSON value; ValueError for anything else, nesting that Python can't follow included."""
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_no_constant)
        canonical(value)  # whatever is read can be written
        return value
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def shown(text: str) -> str:
    """text as UTF-8 can hold it."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


#: Keywords that are checked, by what they hold: one schema, a list, a map of schemas, other values.
_ONE = frozenset("additionalProperties contains else if items not propertyNames then".split())
_MANY = frozenset("allOf anyOf oneOf prefixItems".split())
_MAPS = frozenset("$defs definitions dependentSchemas patternProperties properties".split())
_PLAIN = frozenset("$ref const dependentRequired enum exclusiveMaximum exclusiveMinimum maxContains maxItems maxLength maxProperties maximum minContains minItems minLength minProperties minimum multipleOf pattern required type uniqueItems".split())
#: Keywords that demand nothing (format only describes, as JSON Schema has it by default).
_NOTES = frozenset("$comment $id $schema contentEncoding contentMediaType default deprecated description examples format readOnly title writeOnly".split())
_KNOWN = _ONE | _MANY | _MAPS | _PLAIN | _NOTES


def check_schema(schema, root=None, at: str = "#") -> None:
    """Raises ValueError on what ``violations`` doesn't check: unknown keywords, references out of the schema, patterns re can't read."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    for key, x in schema.items():
        if key not in _KNOWN and not key.startswith("x-"):
            raise ValueError(f"{at}: keyword {key} is not checked")
        if key == "$id" and schema is not root or key.startswith("exclusive") and isinstance(x, bool):
            raise ValueError(f"{at}: {key} {x} is not checked")
        if key == "items" and isinstance(x, list):
            raise ValueError(f"{at}: a list of items is written prefixItems")
        if key in _ONE:
            check_schema(x, root, f"{at}/{key}")
        elif key in _MANY or key in _MAPS:
            for k, part in enumerate(x) if key in _MANY else x.items():
                check_schema(part, root, f"{at}/{key}/{k}")
        elif key == "$ref":
            if not isinstance(_target(root, x), dict | bool):
                raise ValueError(f"{at}: {x} is not a schema")
        elif key == "type" and not ({x} if isinstance(x, str) else set(x)) <= _KINDS.keys() | {"integer", "number"}:
            raise ValueError(f"{at}: type {x}")
    for p in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})]:
        try:
            _pattern(p)
        except re.error as e:
            raise ValueError(f"{at}: pattern {p}: {e}") from e


def _target(root, ref: str):
    """What a reference into the schema (# or #/a/b) names."""
    if ref != "#" and not ref.startswith("#/"):
        raise ValueError(f"reference {ref} is not into the schema")
    for part in unquote(ref[2:]).split("/") if ref != "#" else []:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            root = root[int(part)] if isinstance(root, list) else root[part]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise ValueError(f"reference {ref} names nothing") from e
    return root


@lru_cache(1024)
def _pattern(text: str) -> re.Pattern:
    """As JSON Schema reads it: ASCII classes, $ is the very end."""
    return re.compile(re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\$", lambda m: r"\Z" if m[0] == "$" else m[0], text, flags=re.S), re.ASCII)


def _key(value):
    """Equal for equal JSON values only: 1 and 1.0 are, 1 and true are not."""
    if isinstance(value, dict):
        return "object", frozenset((k, _key(v)) for k, v in value.items())
    if isinstance(value, list):
        return "array", tuple(map(_key, value))
    return "boolean" if isinstance(value, bool) else "other", value


def _multiple(value, step) -> bool:
    return (isinstance(value, int) or math.isfinite(value)) and Fraction(str(value)) % Fraction(str(step)) == 0


def violations(value, schema, at: str = "$", root=None, refs: frozenset = frozenset()) -> list[str]:
    """What of a JSON value breaks a schema; ValueError on a keyword that isn't checked."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not schema.keys() <= _KNOWN:
        for k in schema.keys() - _KNOWN:
            if not k.startswith("x-"):
                raise ValueError(f"keyword {k} is not checked")
    root = schema if root is None else root
    out, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, int | float) and not isinstance(value, bool)

    def is_a(kind: str) -> bool:
        if kind == "integer":
            return number and (isinstance(value, int) or value.is_integer())
        return number if kind == "number" else isinstance(value, _KINDS[kind])

    def breaks(part) -> list[str]:
        return violations(value, part, at, root, refs)

    def inner(x, part, name: str) -> list[str]:
        return violations(x, part, at + name, root)

    if kinds and not any(map(is_a, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and _key(value) not in map(_key, schema["enum"]) or "const" in schema and _key(value) != _key(schema["const"]):
        out.append(f"{at}: not one of the values")
    for key, size, bad in _BOUNDS:
        if key in schema and isinstance(value, size) and not isinstance(value, bool) and bad(value, schema[key]):
            out.append(f"{at}: {key} {schema[key]}")
    if "$ref" in schema and schema["$ref"] not in refs:
        out += violations(value, _target(root, schema["$ref"]), at, root, refs | {schema["$ref"]})
    for part in schema.get("allOf", []):
        out += breaks(part)
    if "anyOf" in schema and all(map(breaks, schema["anyOf"])):
        out.append(f"{at}: anyOf")
    if "oneOf" in schema and sum(not breaks(part) for part in schema["oneOf"]) != 1:
        out.append(f"{at}: oneOf")
    if "not" in schema and not breaks(schema["not"]):
        out.append(f"{at}: not")
    if "if" in schema:
        out += breaks(schema.get("else" if breaks(schema["if"]) else "then", True))
    if isinstance(value, dict):
        known, shaped = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{n}: missing" for k, needs in schema.get("dependentRequired", {}).items() if k in value for n in needs if n not in value]
        for k, part in schema.get("dependentSchemas", {}).items():
            if k in value:
                out += breaks(part)
        for k, v in value.items():
            parts = [known[k]] if k in known else []
            parts += [x for p, x in shaped.items() if _pattern(p).search(k)]
            for part in parts:
                out += inner(v, part, f".{k}")
            if not parts and schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            elif not parts and "additionalProperties" in schema:
                out += inner(v, schema["additionalProperties"], f".{k}")
            if "propertyNames" in schema and violations(k, schema["propertyNames"], at, root):
                out.append(f"{at}.{k}: propertyNames")
    if isinstance(value, list):
        first = schema.get("prefixItems", [])
        for k, v in enumerate(value):
            if k < len(first):
                out += inner(v, first[k], f"[{k}]")
            elif "items" in schema:
                out += inner(v, schema["items"], f"[{k}]")
        if schema.get("uniqueItems") and len(set(map(_key, value))) < len(value):
            out.append(f"{at}: uniqueItems")
        if "contains" in schema:
            met = sum(not inner(v, schema["contains"], f"[{k}]") for k, v in enumerate(value))
            if not schema.get("minContains", 1) <= met <= schema.get("maxContains", len(value)):
                out.append(f"{at}: contains")
    return out


_NUMBER = int | float
_BOUNDS = (
    ("minLength", str, lambda x, n: len(x) < n),
    ("maxLength", str, lambda x, n: len(x) > n),
    ("pattern", str, lambda x, p: not _pattern(p).search(x)),
    ("minItems", list, lambda x, n: len(x) < n),
    ("maxItems", list, lambda x, n: len(x) > n),
    ("minProperties", dict, lambda x, n: len(x) < n),
    ("maxProperties", dict, lambda x, n: len(x) > n),
    ("minimum", _NUMBER, lambda x, n: x < n),
    ("maximum", _NUMBER, lambda x, n: x > n),
    ("exclusiveMinimum", _NUMBER, lambda x, n: x <= n),
    ("exclusiveMaximum", _NUMBER, lambda x, n: x >= n),
    ("multipleOf", _NUMBER, lambda x, n: not _multiple(x, n)),
)


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from messages (conv_id, turn, role, text) whose texts hold them as JSON.

    A call: {"tool_calls": [{"id", "name", "arguments", "needs"?}, ...]}.
    A result: {"tool_call_id", "content"}. Other texts hold neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, turn, text in zip(b.column("conv_id").to_pylist(), b.column("turn").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    body = parse(text) if text and text.lstrip()[:1] == "{" else {}
                except ValueError:
                    body = {}
                listed = body.get("tool_calls")
                for c in listed if isinstance(listed, list) else []:
                    if isinstance(c, dict):
                        args = c.get("arguments", {})
                        needs = c.get("needs")
                        out.append((conv, shown(str(c.get("id"))), turn, shown(str(c.get("name"))), shown(args) if isinstance(args, str) else canonical(args), [shown(str(n)) for n in needs] if isinstance(needs, list) else [], None))
                if "tool_call_id" in body:
                    content = body.get("content")
                    out.append((conv, shown(str(body["tool_call_id"])), turn, None, None, None, shown(content) if isinstance(content, str) else canonical(content)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "call_id", "turn", "name", "arguments", "needs", "content"])

    read = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "text")
    found = read.mapInArrow(run, CALLS + ", content string")
    return found.filter("name is not null").drop("content"), found.filter("name is null").select("conv_id", "call_id", "turn", "content")


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chats: a user's turn calls ``reply``, which needs the user's turn before; the assistant's next turn is the result."""
    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit("null")))
    args = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    needs = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = m.filter("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), args.alias("arguments"), needs.alias("needs"))
    results = m.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def _positions(calls: DataFrame) -> DataFrame:
    """calls with ``level`` (Kahn's, null on a cycle, 0 where turns are in order already) by (conv, call_id)."""
    nodes = materialise(calls.groupBy("conv", "call_id").agg(F.min("turn").alias("turn"), F.flatten(F.collect_set("needs")).alias("needs")), "tool-nodes")
    needs = nodes.select("conv", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("need"))
    known = nodes.select("conv", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = materialise(needs.join(known, ["conv", "need"]), "tool-needs")
    tangled = materialise(edges.filter(~F.coalesce(F.col("need_turn") < F.col("turn"), F.lit(False))).select("conv").distinct(), "tool-tangled")
    if tangled.isEmpty():
        return nodes.select("conv", "call_id", F.lit(0).alias("level"))
    straight = nodes.join(tangled, "conv", "left_anti").select("conv", "call_id", F.lit(0).alias("level"))
    left = nodes.join(tangled, "conv", "left_semi").select("conv", "call_id")
    edges, level = edges.join(tangled, "conv", "left_semi").select("conv", "call_id", "need"), 0
    done = []
    while True:
        left = materialise(left, "tool-left")
        free = materialise(left.join(edges, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(level).alias("level")), "tool-free")
        if free.isEmpty():
            break
        done.append(free)
        left = left.join(free, ["conv", "call_id"], "left_anti")
        edges = materialise(edges.join(free.select("conv", F.col("call_id").alias("need")), ["conv", "need"], "left_anti"), "tool-edges")
        level += 1
    for part in [*done, left.withColumn("level", F.lit(None).cast("int"))]:
        straight = straight.unionByName(part)
    return straight


def _checked(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, errors, texts = [], [], []
            for call, name, args, content, status in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "status")), strict=True):
                wrong: list[str] = []
                try:
                    value = parse(args) if args is not None else None
                except ValueError:
                    value, wrong = args, ["$: not JSON"]
                if status == "orphan":
                    wrong = ["no call"]
                elif name not in schemas:
                    wrong = wrong or ["unknown tool"]
                elif not wrong:
                    try:
                        wrong = violations(value, schemas[name])
                    except RecursionError:
                        wrong = ["$: nested too deeply"]
                valid.append(not wrong)
                errors.append(shown("; ".join(wrong)))
                texts.append(f'{{"arguments":{canonical(value)},{canonical({"id": call, "name": name, "result": content})[1:]}')
            keep = [c for c in b.schema.names if c not in ("arguments", "content")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())], [*keep, "valid", "errors", "json"])

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call or orphaned result: conv_id, call_id, name, call_turn, result_turn, status, position, valid, errors, json.

    position: 1, 2, ... of the calls of a conversation in topological order;
    null for orphans. ValueError where a schema has a keyword that isn't checked.
    """
    for schema in schemas.values():
        check_schema(schema)
    use = lambda last: F.row_number().over(Window.partitionBy("conv", "call_id").orderBy("turn", last))
    bound_batches(calls.sparkSession)
    left = calls.select(F.struct("conv_id").alias("conv"), "call_id", "turn", "name", "arguments", "needs").withColumn("use", use("arguments"))
    right = results.select(F.struct("conv_id").alias("conv"), "call_id", F.col("turn").alias("result_turn"), "content", F.row_number().over(Window.partitionBy(F.struct("conv_id"), "call_id").orderBy("turn", "content")).alias("use"))
    left = left.join(_positions(left), ["conv", "call_id"])
    left = sorted_ranks(left.drop("needs"), ["conv"], [F.col("level").asc_nulls_last(), F.col("turn"), F.col("call_id"), F.col("use")], "position", "tool-positions")
    met = left.join(right.withColumn("answered", F.lit(True)), ["conv", "call_id", "use"], "full")
    status: Column = F.when(F.col("name").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").when(F.col("level").isNull(), "cycle").otherwise("linked")
    rows = met.select("conv.conv_id", "call_id", "name", F.col("turn").alias("call_turn"), "result_turn", status.alias("status"), "position", "arguments", "content")
    schema = "conv_id bigint, call_id string, name string, call_turn bigint, result_turn bigint, status string, position bigint, valid boolean, errors string, json string"
    return rows.mapInArrow(_checked(schemas), schema)


SQL = """
WITH m AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, text, coalesce(CAST(conv_id AS VARCHAR), 'null') || ':' || coalesce(CAST(turn AS VARCHAR), 'null') AS call_id FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, text, coalesce(CAST(conv_id AS VARCHAR), 'null') || ':' || coalesce(CAST(turn - 1 AS VARCHAR), 'null') AS call_id FROM m WHERE role = 'assistant'),
c1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id, text) AS position FROM c),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS n FROM r),
j AS (SELECT coalesce(c1.conv_id, r1.conv_id) AS conv_id, coalesce(c1.call_id, r1.call_id) AS call_id, c1.call_id IS NOT NULL AS called, r1.call_id IS NOT NULL AS answered,
        c1.turn AS call_turn, r1.turn AS result_turn, c1.text AS prompt, r1.text AS content, position
      FROM c1 FULL JOIN r1 ON c1.call_id = r1.call_id AND c1.n = r1.n AND c1.conv_id IS NOT DISTINCT FROM r1.conv_id)
SELECT conv_id, call_id, CASE WHEN called THEN 'reply' END AS name, call_turn, result_turn,
  CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status, position,
  called AND coalesce(length(prompt), 0) >= 1 AND coalesce(call_turn, -1) >= 0 AS valid,
  '{"arguments":' || CASE WHEN called THEN '{"prompt":' || coalesce(CAST(to_json(prompt) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(call_turn AS VARCHAR), 'null') || '}' ELSE 'null' END
    || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END
    || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM j
"""

"""Tool calls in model output and their arguments; canonical JSON and identities."""

from __future__ import annotations

import ast
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CALLS = Ty.ArrayType(Ty.StructType().add("name", Ty.StringType()).add("arguments", Ty.StringType()))
THOUGHT = re.compile(r"<think>.*?</think>", re.S)
TAGGED = re.compile(r"<tool_call>\s*(.*?)\s*(?:</tool_call>|$)", re.S)
FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
XML_NAME, XML_ARGUMENT = re.compile(r"<function=([\w.-]+)>"), re.compile(r"<parameter=([\w.-]+)>\s*(.*?)\s*</parameter>", re.S)
PYTHON_CALLS = re.compile(r"<\|tool_call_start\|>(.*?)(?:<\|tool_call_end\|>|$)", re.S)


def canonical(value) -> str:
    """JSON with sorted keys and without blanks between parts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def with_leaves(value, change):
    """The JSON value with every leaf changed; keys become text."""
    if isinstance(value, dict):
        return dict(zip(map(str, value), with_leaves(list(value.values()), change), strict=True))
    return [with_leaves(v, change) for v in value] if isinstance(value, list) else change(value)


def folded(leaf):
    """Text in lower case with single blanks; any other leaf as it is."""
    return " ".join(leaf.lower().split()) if isinstance(leaf, str) else leaf


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _call(value) -> tuple[str, str] | None:
    """A call from an object with a name and arguments, perhaps under 'function'; arguments may be a JSON string."""
    if not isinstance(value, dict):
        return None
    inner = value.get("function") if isinstance(value.get("function"), dict) else value
    name, arguments = inner.get("name"), inner.get("arguments", inner.get("parameters", {}))
    arguments = _loads(arguments) if isinstance(arguments, str) else arguments
    return (name, canonical(arguments if isinstance(arguments, dict) else {})) if isinstance(name, str) and name else None


def _literal(node: ast.expr):
    """A literal's value, or the source of anything else: the argument then stays as it was written."""
    try:
        return ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError, RecursionError, MemoryError):
        return ast.unparse(node)


def _python_calls(text: str) -> list[tuple[str, str]]:
    """Calls of plain names with keyword arguments: one, or several in a list or tuple."""
    try:
        body = ast.parse(text.strip(), mode="eval").body
        nodes = body.elts if isinstance(body, ast.List | ast.Tuple) else [body]
        named = [n for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
        return [(n.func.id, canonical({k.arg: _literal(k.value) for k in n.keywords if k.arg})) for n in named]
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
        return []


def _objects(text: str) -> list:
    """The JSON objects that stand in prose, from left to right, none inside another."""
    found, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = json.JSONDecoder().raw_decode(text, at)
            found.append(value)
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return found


def lenient_calls(text: str | None) -> list[tuple[str, str]]:
    """Calls in a reply: tagged JSON or XML, Python syntax between call marks, fenced JSON, the reply as JSON, or JSON objects inside prose; thoughts are skipped."""
    text = THOUGHT.sub("", text or "").strip()
    found: list[tuple[str, str]] = []
    for body in TAGGED.findall(text):
        if name := XML_NAME.search(body):
            arguments = {k: v if (parsed := _loads(v)) is None else parsed for k, v in XML_ARGUMENT.findall(body)}
            found.append((name[1], canonical(arguments)))
        elif call := _call(_loads(body)):
            found.append(call)
    for body in PYTHON_CALLS.findall(text):
        found += _python_calls(body)
    if not found:
        for body in [*FENCED.findall(text), text]:
            value = _loads(body)
            found = [c for v in (value if isinstance(value, list) else [value]) if (c := _call(v))]
            if found:
                break
    return found or [c for v in _objects(text) if (c := _call(v))]


@F.pandas_udf(CALLS)
def parse_calls(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"name": n, "arguments": a} for n, a in lenient_calls(t)])


@F.pandas_udf(Ty.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of a JSON text; null if it is none."""
    return text.map(lambda t: None if t is None or (v := _loads(t)) is None else canonical(v))


@F.pandas_udf(Ty.StringType())
def normalized_json(text: pd.Series) -> pd.Series:
    """The canonical form with strings in lower case and single blanks; what is no JSON counts as a string."""
    return text.map(lambda t: canonical(with_leaves(v if t is not None and (v := _loads(t)) is not None else t, folded)))


def call_signature(name: Column, arguments: Column) -> Column:
    """Equal for calls of equal normalized arguments."""
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), normalized_json(arguments))


def coerced(value, declared: str):
    """A value brought to its declared type: text to an array (a list of one if it is no JSON array) or an object, anything but text to text."""
    if declared in ("array", "object") and isinstance(value, str):
        parsed = _loads(value)
        if declared == "array":
            return parsed if isinstance(parsed, list) else [value]
        return parsed if isinstance(parsed, dict) else value
    if declared == "string" and value is not None and not isinstance(value, str):
        return str(value)
    return value


def listed(value) -> list[str]:
    """An argument as a list of strings: a list, a JSON array, or one value; nothing for what is empty."""
    if isinstance(value, str):
        parsed = _loads(value)
        value = parsed if isinstance(parsed, list) else [value]
    return [str(x) for x in value] if isinstance(value, list) else [str(value)] if value else []


def coerce_arguments(arguments: Column, schema: dict[str, str]) -> Column:
    """(arguments, error): the object with its values brought to the declared types; {} and an error for anything but an object with known keys."""

    @F.pandas_udf(Ty.StructType().add("arguments", Ty.StringType()).add("error", Ty.StringType()))
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            value = _loads(t) if t else None
            if not isinstance(value, dict):
                out.append(("{}", "arguments must be an object"))
            elif unknown := sorted(set(value) - set(schema)):
                out.append(("{}", "unknown arguments: " + ", ".join(unknown)))
            else:
                out.append((canonical({k: coerced(v, schema[k]) for k, v in value.items()}), None))
        return pd.DataFrame(out, columns=["arguments", "error"])

    return run(arguments)


def candidate_id(source: Column, line: Column, key: Column) -> Column:
    return F.left(F.sha1(F.concat_ws(":", source, line.cast("string"), key.cast("string"))), F.lit(16))


@F.pandas_udf(Ty.StringType())
def content_identity(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of a JSON text, or of the text itself."""
    return text.map(lambda t: None if t is None else hashlib.sha256((t if (v := _loads(t)) is None else canonical(v)).encode()).hexdigest())

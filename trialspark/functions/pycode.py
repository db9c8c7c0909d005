"""Functions on Python source, which need a parser: code extraction and probe calls."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, which must be just these for the same extractions: a fenced block, and how a line of code can start.
_FENCE = re.compile(r"```(?:python|py)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
_STARTS = re.compile(r"(?m)^(?:async\s+def|def|class|from\s+\S+\s+import|import)\b")


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def extracted(text: str, entrypoint: str | None = None) -> str:
    """The code of an answer.

    All fenced blocks, joined by a blank line; else the text if it parses; else, from the first line at which code can
    start and that has one, the longest run of lines that parses; else the text. Definitions of the entrypoint are
    tried before other starts.
    """
    blocks = [b.strip() for b in _FENCE.findall(text)]
    if blocks:
        return "\n\n".join(blocks).strip()
    whole = text.strip()
    if _parses(whole):
        return whole
    starts = [m.start() for m in _STARTS.finditer(whole)]
    if entrypoint:
        wanted = re.compile(rf"def\s+{re.escape(entrypoint)}\s*\(")
        starts.sort(key=lambda at: wanted.match(whole, at) is None)  # the sort is stable
    for at in starts:
        lines = whole[at:].splitlines()
        parts = ("\n".join(lines[:n]).strip() for n in range(len(lines), 0, -1))
        code = next((p for p in parts if p and _parses(p)), None)
        if code is not None:
            return code
    return whole


def calls_of(test: str, entrypoint: str) -> list[tuple[tuple, tuple]]:
    """(args, kwargs) of every call of entrypoint whose arguments are literals."""
    try:
        tree = ast.parse(test)
    except SyntaxError:
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == entrypoint:
            try:
                args = tuple(ast.literal_eval(a) for a in node.args)
                out.append((args, tuple((k.arg, ast.literal_eval(k.value)) for k in node.keywords if k.arg is not None)))
            except (ValueError, SyntaxError):
                continue
            if any(k.arg is None for k in node.keywords):
                out.pop()
    return out


def mutations(value) -> list:
    """Nearby values by type; a bool is not a number here. The values are fixed: probes must be the same everywhere."""
    match value:
        case bool():
            return [not value]
        case int():
            return [-1, 0, 1, value + 1]
        case str():
            return ["", value.upper(), value * 2 or "x"]
        case list():
            return [[], value[::-1]]
        case tuple():
            return [(), value[::-1]]
        case dict():
            return [{}]
        case None:
            return [0, ""]
    return []


def probes(tests: list[str], entrypoint: str, limit: int = 16) -> list[tuple[tuple, dict]]:
    """Each call of the tests, then its mutations one argument at a time; distinct by their text, at most `limit`."""
    calls = [c for t in tests for c in calls_of(t, entrypoint)] if entrypoint else []
    out: dict[str, tuple] = {}
    for args, kwargs in calls or [((), ())]:
        changed = [(args[:i] + (m,) + args[i + 1 :], kwargs) for i, v in enumerate(args) for m in mutations(v)]
        changed += [(args, tuple((n, m if n == k else w) for n, w in kwargs)) for k, v in kwargs for m in mutations(v)]
        for a, k in [(args, kwargs), *changed]:
            one = (a, dict(k))
            out.setdefault(repr(one), one)
            if len(out) == limit:
                return list(out.values())
    return list(out.values())


def once_each(f: Callable, arguments: Iterable[tuple]) -> list:
    """f of each tuple of arguments, called once for equal ones of a batch: parsing is most of the time."""
    known: dict = {}
    return [known[a] if a in known else known.setdefault(a, f(*a)) for a in arguments]


@F.pandas_udf(T.StringType())
def extract_code(texts: pd.Series, entrypoints: pd.Series) -> pd.Series:
    """extracted() of each text; a null entrypoint is none."""
    return pd.Series(once_each(lambda t, e: None if t is None else extracted(t, e), zip(texts, entrypoints, strict=True)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def probe_calls(tests: pd.Series, entrypoints: pd.Series) -> pd.Series:
    lists = (tuple(t) if t is not None else () for t in tests)
    return pd.Series(once_each(lambda t, e: [repr(p) for p in probes(list(t), e or "")], zip(lists, entrypoints, strict=True)))


def canonical_json(value) -> str:
    """JSON with sorted keys, no blanks, ASCII; sets are sorted lists, complex numbers pairs of parts."""

    def plain(x):
        if isinstance(x, complex):
            return {"__complex__": [x.real, x.imag]}
        if isinstance(x, set | frozenset):
            return {"__set__": sorted(x, key=canonical_json)}
        raise TypeError(f"{type(x).__name__} has no JSON form")

    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=plain)

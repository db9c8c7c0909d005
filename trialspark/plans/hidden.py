"""The wall between public evidence and hidden labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that a selector must never see: those with one of these as a whole part.
HIDDEN = re.compile(r"(?:^|_)(?:plus|hidden)(?:_|$)", re.IGNORECASE)


class HiddenLabelError(ValueError):
    """A table given to a selector holds, or was made from, hidden columns."""


def names_in(kind: T.DataType) -> Iterator[str]:
    """The names of all fields of a type, at any depth."""
    match kind:
        case T.StructType():
            for field in kind.fields:
                yield field.name
                yield from names_in(field.dataType)
        case T.ArrayType():
            yield from names_in(kind.elementType)
        case T.MapType():
            yield from names_in(kind.keyType)
            yield from names_in(kind.valueType)


def _each(seq) -> Iterator:
    """The elements of one of the planner's sequences."""
    for i in range(seq.size()):
        yield seq.apply(i)


def _references(expression) -> set[int]:
    return {x.exprId().id() for x in _each(expression.references().toSeq())}


def _needed_below(node, needed: set[int]) -> list[set[int]]:
    """The attributes that each child of a node of the analyzed plan must give for `needed` ones of its own.

    A projection, an aggregate and a window need what their needed expressions read, and grouping, partition and order
    what they read; a union takes columns by place. Other nodes need all that they read, and where they put out
    attributes that no child has (and that are not made from what they read), all that the children give.
    """
    kind, children = node.getClass().getSimpleName(), list(_each(node.children()))
    if kind == "Union":
        places = [i for i, x in enumerate(_each(node.output())) if x.exprId().id() in needed]
        return [{x.exprId().id() for i, x in enumerate(_each(c.output())) if i in places} for c in children]
    if kind in ("Project", "Aggregate", "Window"):
        made = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}[kind]
        own = [e for e in _each(getattr(node, made)()) if e.exprId().id() in needed]
        below = set(needed) if kind == "Window" else set()
        for e in own:
            below |= _references(e) | {e.exprId().id()}
        if kind == "Aggregate":
            below |= {r for e in _each(node.groupingExpressions()) for r in _references(e)}
        return [below]
    given = {x.exprId().id() for c in children for x in _each(c.output())}
    below = needed | {x.exprId().id() for x in _each(node.references().toSeq())}
    if any(x.exprId().id() not in given for x in _each(node.output())) and kind != "Generate":
        below |= given
    return [below] * len(children)


def carried_names(df: DataFrame) -> set[str]:
    """The names of all attributes, and fields in them, from which df is made, wherever they stand in its analyzed plan.

    Attributes are followed by their ids from df's columns down to the tables, through renames, conditions and
    subqueries, local tables or not; a column that nothing above reads is not looked at.
    """
    found: set[str] = set()
    root = df._jdf.queryExecution().analyzed()
    nodes = [(root, {x.exprId().id() for x in _each(root.output())})]
    while nodes:
        node, needed = nodes.pop()
        for x in _each(node.output()):
            if x.exprId().id() in needed:
                found.add(x.name())
                found.update(names_in(T._parse_datatype_json_string(x.dataType().json())))
        nodes += zip(_each(node.children()), _needed_below(node, needed), strict=True)
        for plan in _each(node.subqueries()):
            nodes.append((plan, {x.exprId().id() for x in _each(plan.output())}))
    return found


def public_only(df: DataFrame) -> DataFrame:
    """df itself, if neither its columns nor those from which its analyzed plan makes them are hidden."""
    found = {n for n in (*df.columns, *names_in(df.schema), *carried_names(df)) if HIDDEN.search(n)}
    if found:
        raise HiddenLabelError(f"hidden columns reach a selector: {sorted(found)}")
    return df


def policy_visible(tasks: DataFrame) -> DataFrame:
    """Tasks without hidden tests, in the column and in the map of what a verifier may read."""
    kept = tasks.drop("hidden_tests")
    if "allowed_verifier_inputs" in kept.columns:
        kept = kept.withColumn("allowed_verifier_inputs", F.map_filter("allowed_verifier_inputs", lambda k, _: k != "hidden_tests"))
    return kept

"""Read-only SQL over the three tables of a star.

Two guards stand in a row. The text must be one SELECT or WITH without the refused words, comments
and quoted parts aside. Then the statement is parsed by Spark, and its plan may hold nothing but
queries over sales, stores, products and its own common table expressions, calling functions that
are built in and run no foreign code.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from tallymart.sources.star import Star

# Statement words that are refused.
FORBIDDEN = [
    "insert", "update", "delete", "drop", "alter", "create",
    "attach", "detach", "pragma", "vacuum", "replace", "truncate",
]

# Built-in functions that call foreign code, read files or tell about the session.
REFUSED_FUNCTIONS = [
    "reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start",
    "input_file_block_length", "read_files", "python_worker_logs",
]

_CATALYST = "org.apache.spark.sql.catalyst."

# Quoted parts and comments in one pass: what opens first decides what it is.
_OPAQUE = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.DOTALL
)
_FORBIDDEN = re.compile(rf"\b({'|'.join(FORBIDDEN)})\s", re.IGNORECASE)


def require_read_only(sql: str) -> str:
    """Return the statement without its final semicolon, or raise.

    One SELECT or WITH statement passes. Text inside quotes and comments is not looked at.
    """
    statement = sql.strip().rstrip(";").rstrip()
    bare = _OPAQUE.sub(lambda m: " " if m[0][0] in "-/" else "''", statement).strip()
    if not bare.lower().startswith(("select", "with")):
        raise ValueError("only SELECT queries are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    if found := _FORBIDDEN.search(bare + " "):
        raise ValueError(f"not allowed in a read-only query: {found.group(1)}")
    return statement


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    for i in range(sequence.length()):
        yield sequence.apply(i)


def _walk(node: JavaObject) -> Iterator[JavaObject]:
    """The node and all below it: inputs, subqueries, table expressions and expressions."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        yield node
        waiting.extend(_items(node.children()))
        waiting.extend(_items(node.innerChildren()))
        if hasattr(node, "plan") and _is(node, "expressions.PlanExpression"):
            waiting.append(node.plan())
        if _is(node, "plans.logical.LogicalPlan"):
            waiting.extend(_items(node.expressions()))


_gateway = None


def _is(node: JavaObject, name: str) -> bool:
    return is_instance_of(_gateway, node, _CATALYST + name)


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def require_plain_query(spark: SparkSession, statement: str, tables: set[str]) -> None:
    """Raise unless the parsed statement is a query over ``tables`` and its own expressions."""
    global _gateway
    _gateway = spark.sparkContext._gateway
    jvm = spark.sparkContext._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    nodes = list(_walk(plan))
    own = set()
    for node in nodes:
        if _name(node) == "UnresolvedWith":
            own |= {relation._1().lower() for relation in _items(node.cteRelations())}
    registries = jvm.org.apache.spark.sql.catalyst.analysis
    identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for node in nodes:
        kind = _name(node)
        if _is(node, "plans.logical.Command") or _is(node, "plans.logical.ParsedStatement"):
            raise ValueError(f"only queries are allowed, not {kind}")
        if kind in ("ScriptTransformation", "ScriptInputOutputSchema", "UnresolvedIdentifier"):
            raise ValueError("calling foreign code is not allowed")
        if kind in ("UnresolvedRelation", "RelationTimeTravel"):
            parts = list(_items(node.multipartIdentifier())) if kind == "UnresolvedRelation" else []
            if len(parts) != 1 or parts[0].lower() not in tables | own:
                raise ValueError(f"not a table of this query: {'.'.join(parts) or kind}")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = list(_items(node.nameParts() if kind == "UnresolvedFunction" else node.name()))
            known = registries.FunctionRegistry if kind == "UnresolvedFunction" else registries.TableFunctionRegistry
            name = parts[0].lower()
            if name in REFUSED_FUNCTIONS or len(parts) > 1:
                raise ValueError(f"calling foreign code is not allowed: {'.'.join(parts)}")
            if not known.builtin().functionExists(identifier(name)):
                raise ValueError(f"not a built-in function: {name}")


def query(spark: SparkSession, star: Star, sql: str) -> DataFrame:
    """Run a guarded statement over ``sales``, ``stores`` and ``products``.

    The tables are common table expressions put in front of the statement, over views with names of
    their own that are gone afterwards: the session's views and settings stay as they are.
    """
    statement = require_read_only(sql)
    tables = star.tables()
    require_plain_query(spark, statement, set(tables))
    views = {name: f"tallymart_{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    heads = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
    # The statement keeps its own WITH in an inner query, where its names come first.
    try:
        return spark.sql(f"WITH {heads} SELECT * FROM (\n{statement}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)

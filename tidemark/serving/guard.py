"""Read-only ad-hoc SQL: one SELECT over allowed relations, with a limit.

Keywords are looked for outside literals and comments, then Spark's own parser decides: a plan with
a command, an insert, a relation that isn't allowed or a table function is refused, and so is every
function that isn't a built-in one of an allowed group. Those that reach beyond the query's data,
among them ``reflect`` and ``java_method``, are in none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Words that no query needs. ``replace`` is a function and may stay.
FORBIDDEN = ("insert", "update", "delete", "drop", "create", "alter", "attach", "detach", "copy", "pragma", "install", "load", "export", "truncate", "merge", "grant", "revoke", "call", "set")
#: Spark's names for groups of built-in functions that only compute on their arguments.
FUNCTION_GROUPS = frozenset(f"{g}_funcs" for g in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "date", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "window"))
DEFAULT_LIMIT, MOST = 200, 500
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)
_FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.S | re.I)


def clean_sql(reply: str) -> str:
    """The first fenced block or the whole text, without a last semicolon."""
    block = _FENCE.search(reply)
    return (block[1] if block else reply).strip().rstrip(";").strip()


def is_safe_select(sql: str) -> bool:
    bare = _LITERAL.sub("''", sql).strip().lower()
    return bool(re.match(r"(select|with)\b", bare)) and ";" not in bare and not re.search(rf"\b({'|'.join(FORBIDDEN)})\b", bare)


def enforce_limit(sql: str, default: int = DEFAULT_LIMIT, most: int = MOST) -> str:
    """The outer limit, at most ``most``; ``default`` where the outer query has none. Limits in parentheses are of other queries."""
    depth, spans, bare = 0, [], _LITERAL.sub(lambda m: "x" * len(m[0]), sql)
    for m in re.finditer(r"[()]|\blimit\s+(\d+)", bare, re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth == 0:
            spans.append(m)
    if not spans:
        return f"{sql}\nLIMIT {default}"
    last = spans[-1]
    return sql if int(last[1]) <= most else sql[: last.start(1)] + str(most) + sql[last.end(1) :]


def build_sql(question: str, complete: Callable[[str], str]) -> str:
    """A model's reply to a question, cleaned, checked and limited; ValueError where it isn't one safe SELECT."""
    sql = clean_sql(complete(question))
    if not is_safe_select(sql):
        raise ValueError("only a single SELECT is allowed")
    return enforce_limit(sql)


def is_allowed_function(spark: SparkSession, name: str) -> bool:
    """Whether a name is a built-in function of an allowed group. A function that a session has put under the name is not."""
    if "." in name:
        return False
    jvm, catalog = spark.sparkContext._jvm, spark._jsparkSession.sessionState().catalog()
    identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier.apply(name)
    if not catalog.functionExists(identifier):
        return False
    info = catalog.lookupFunctionInfo(identifier)
    return info.getSource() == "built-in" and info.getGroup() in FUNCTION_GROUPS


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names that a parsed query reads, without those it defines. ValueError for anything that isn't a query."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    read, defined = set(), set()

    def check(expression) -> None:
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = expression.nameParts().mkString(".").lower()
            if not is_allowed_function(spark, name):
                raise ValueError(f"function not allowed: {name}")
        elif re.search(r"CallMethod|Invoke|UDF|ScalaUDF", kind):
            raise ValueError(f"not allowed: {kind}")
        parts = expression.children()
        for i in range(parts.size()):
            check(parts.apply(i))

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|Insert|Create|Drop|Delete|Update|Merge|Truncate|Alter|Unresolved(?!With|Relation|Attribute|Having|Subquery)\w*(TableValued|TVF)|ScriptTransform|SetCatalog|CacheTable", kind):
            raise ValueError(f"not a query: {kind}")
        if kind == "UnresolvedRelation":
            read.add(".".join(node.multipartIdentifier().mkString(".").split(".")).lower())
        if kind == "UnresolvedWith":
            pairs = node.cteRelations()
            for i in range(pairs.size()):
                defined.add(pairs.apply(i)._1().lower())
                walk(pairs.apply(i)._2())
        own = node.expressions()
        for i in range(own.size()):
            check(own.apply(i))
        for group in (node.children(), node.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))

    walk(plan)
    return read - defined


def ask(spark: SparkSession, sql: str, allowed: set[str]) -> DataFrame:
    """The rows of a safe query over allowed relations, at most ``MOST``."""
    if not is_safe_select(sql):
        raise ValueError("only a single SELECT is allowed")
    beyond = relations(spark, sql) - {a.lower() for a in allowed}
    if beyond:
        raise ValueError(f"not allowed: {', '.join(sorted(beyond))}")
    return spark.sql(enforce_limit(sql)).limit(MOST)


def schema_card(spark: SparkSession, tables: list[str]) -> str:
    """What a model is told of the tables."""
    return "\n".join(f"{t}({', '.join(f'{c} {k}' for c, k in spark.table(t).dtypes)})" for t in tables)

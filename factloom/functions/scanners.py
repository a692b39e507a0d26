"""Scanners of source texts: GraphQL operation heads, and the literals that a source states without evaluating anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[_A-Za-z][_0-9A-Za-z]*"
#: An operation's kind, name, variables, directives, and the first field of its selection.
_HEAD = (
    rf"(?m)^[ \t\r]*(query|mutation|subscription)\b[\s,]*({_NAME})?[\s,]*(?:\((?:[^()]|\([^()]*\))*\))?[\s,]*"
    rf"(?:@{_NAME}(?:\((?:[^()]|\([^()]*\))*\))?[\s,]*)*\{{[\s,]*(?:({_NAME})[\s,]*(?::[\s,]*({_NAME}))?)?"
)
_WRAPPED = r"""^[A-Za-z_][\w.]*[!?]?\(\s*(?:"(/[^"]*)"|'(/[^']*)')\s*\)$"""
_TEMPLATE = r"^`\$\{[^{}`]*\}(/[^`]*)`$"


def operation_heads(text: Column) -> Column:
    """``array<struct<kind,name,field>>`` of the GraphQL operations that a text begins on a line of their own.

    Comments and block strings hold none.  A field's alias is passed over; an operation without a name has an empty one.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'(?s)"""(?:[^"\\]|\\.|"(?!""))*+"""', '""'), r"(?m)#[^\n]*$", "")
    parts = [F.regexp_extract_all(plain, F.lit(_HEAD), F.lit(i)) for i in (1, 2, 3, 4)]
    made = lambda i: F.struct(F.get(parts[0], i).alias("kind"), F.get(parts[1], i).alias("name"), F.when(F.get(parts[3], i) != "", F.get(parts[3], i)).otherwise(F.get(parts[2], i)).alias("field"))
    return F.transform(parts[0], lambda _, i: made(i))


def single_assignments(assignments: DataFrame) -> DataFrame:
    """``file, name, literal`` of names that a file assigns exactly once, to a literal: assignments(file, name, literal), an empty or null literal standing for any other expression."""
    once = assignments.groupBy("file", "name").agg(F.count("*").alias("_n"), F.max("literal").alias("literal"))
    return once.filter("_n = 1 and literal <> ''").select("file", "name", "literal")


def wrapped_path(expression: Column) -> Column:
    """The path in a call with one literal argument that begins with a slash; null for anything else."""
    found = F.concat(F.regexp_extract(expression, _WRAPPED, 1), F.regexp_extract(expression, _WRAPPED, 2))
    return F.when(found != "", found)


def template_path(expression: Column) -> Column:
    """The literal tail behind the interpolated base of a template, later interpolations as ``{}``; null for anything else."""
    tail = F.regexp_extract(expression, _TEMPLATE, 1)
    return F.when(tail != "", F.regexp_replace(tail, r"\$\{[^{}]*\}", "{}"))


def folded(expressions: DataFrame, assignments: DataFrame) -> DataFrame:
    """``expressions(file, expression)`` with the literal that each derives: a name assigned once, a wrapped path or a template's tail; else null."""
    names = single_assignments(assignments).select("file", F.col("name").alias("expression"), F.col("literal").alias("_named"))
    out = expressions.join(names, ["file", "expression"], "left")
    return out.withColumn("literal", F.coalesce("_named", wrapped_path(F.col("expression")), template_path(F.col("expression")))).drop("_named")

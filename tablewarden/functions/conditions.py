"""Match conditions over column tags: from text to postfix arrays, and their value for a set of tags.

A text like ``has_tag('a') AND NOT (has_tag_value('b', 'x') OR has_tag('c')) AS mc, ...``
becomes one clause per alias, its condition in postfix order.  The text is read
by one fold over its tokens with a stack of open operators, the condition by one
fold over its items with a stack of booleans; both run where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG, NOT, AND, OR = "TAG", "NOT", "AND", "OR"
ITEM = "struct<op:string,tag_key:string,tag_value:string>"
CLAUSE = f"struct<alias:string,condition:array<{ITEM}>>"

_TEXT = r"""'(?:[^']|'')*'|"[^"]*\""""
_TEST = rf"has_tag_value\s*\(\s*(?:{_TEXT})\s*,\s*(?:{_TEXT})\s*\)|has_tag\s*\(\s*(?:{_TEXT})\s*\)"
_TOKEN = rf"(?i){_TEST}|`[^`]+`|\w+|\S"
_STATE = f"struct<done:array<{CLAUSE}>,out:array<{ITEM}>,open:array<string>,next:string,error:string>"


def _unquoted(text: Column) -> Column:
    inner = F.substring(text, 2, 1 << 30)
    inner = F.left(inner, F.length(inner) - 1)
    return F.when(F.startswith(text, F.lit("'")), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(inner)


def _test(token: Column) -> Column:
    """A tag test's item, NULL for any other token."""
    parts = F.regexp_extract_all(token, F.lit(_TEXT), F.lit(0))
    item = F.struct(F.lit(TAG).alias("op"), _unquoted(F.get(parts, F.lit(0))).alias("tag_key"), _unquoted(F.get(parts, F.lit(1))).alias("tag_value"))
    return F.when(token.rlike(rf"(?i)^(?:{_TEST})$"), item)


def _rank(op: Column) -> Column:
    return F.when(op == NOT, 3).when(op == AND, 2).when(op == OR, 1).otherwise(0)


def _step(s: Column, token: Column) -> Column:
    """The state after one more token; the first error stays."""
    word = F.upper(token)
    test = _test(token)
    is_name = token.rlike(r"^(?:`[^`]+`|\w+)$") & ~word.isin(AND, OR, NOT, "AS")

    def to(done=None, out=None, open_=None, next_=None, error=None) -> Column:
        return F.struct(
            (s["done"] if done is None else done).alias("done"),
            (s["out"] if out is None else out).alias("out"),
            (s["open"] if open_ is None else open_).alias("open"),
            (s["next"] if next_ is None else F.lit(next_)).alias("next"),
            F.lit(error).cast("string").alias("error"),
        ).cast(_STATE)

    def kept(rank: int) -> Column:
        """How many operators stay open when those of this rank and above are closed."""
        lower = F.transform(s["open"], lambda o, i: F.when(_rank(o) < rank, i + 1).otherwise(0))
        return F.coalesce(F.array_max(lower), F.lit(0))

    def closed(rank: int) -> tuple[Column, Column]:
        n = kept(rank)
        popped = F.reverse(F.slice(s["open"], n + 1, F.size(s["open"])))
        none = F.lit(None).cast("string")
        items = F.transform(popped, lambda o: F.struct(o.alias("op"), none.alias("tag_key"), none.alias("tag_value")))
        return F.concat(s["out"], items), F.slice(s["open"], F.lit(1), n)

    nothing, no_ops = F.array().cast(f"array<{ITEM}>"), F.array().cast("array<string>")
    out_and, open_and = closed(2)
    out_or, open_or = closed(1)
    name = F.replace(token, F.lit("`"), F.lit(""))
    clause = F.struct(name.alias("alias"), out_or.alias("condition"))
    named = to(F.concat(s["done"], F.array(clause)), nothing, no_ops, "comma")
    unexpected = F.concat(F.lit("unexpected "), token)

    operand = (
        F.when(test.isNotNull(), to(out=F.concat(s["out"], F.array(test)), next_="operator"))
        .when(word == NOT, to(open_=F.concat(s["open"], F.array(F.lit(NOT)))))
        .when(token == "(", to(open_=F.concat(s["open"], F.array(F.lit("(")))))
    )
    operator = (
        F.when(word == AND, to(out=out_and, open_=F.concat(open_and, F.array(F.lit(AND))), next_="operand"))
        .when(word == OR, to(out=out_or, open_=F.concat(open_or, F.array(F.lit(OR))), next_="operand"))
        .when((token == ")") & (F.size(open_or) > 0), to(out=out_or, open_=F.slice(open_or, F.lit(1), F.size(open_or) - 1)))
        .when((word == "AS") & (F.size(open_or) == 0), to(next_="alias"))
        .when(is_name & (F.size(open_or) == 0), named)
    )
    moved = (
        F.when(s["next"] == "operand", operand)
        .when(s["next"] == "operator", operator)
        .when((s["next"] == "alias") & is_name, named)
        .when((s["next"] == "comma") & (token == ","), to(next_="operand"))
    )
    wrong = F.struct(s["done"].alias("done"), s["out"].alias("out"), s["open"].alias("open"), s["next"].alias("next"), unexpected.alias("error")).cast(_STATE)
    return F.when(s["error"].isNotNull(), s).otherwise(F.coalesce(moved, wrong))


def parse_conditions(text: Column) -> Column:
    """``struct<done: array<CLAUSE>, ..., error>`` of a MATCH COLUMNS text.

    ``error`` tells the first thing that is no condition; it is NULL only if the
    whole text was read.  An empty or null text is an error.
    """
    start = F.struct(
        F.array().cast(f"array<{CLAUSE}>").alias("done"), F.array().cast(f"array<{ITEM}>").alias("out"), F.array().cast("array<string>").alias("open"),
        F.lit("operand").alias("next"), F.lit(None).cast("string").alias("error"),
    ).cast(_STATE)
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))

    def finish(s: Column) -> Column:
        ended = F.when(s["error"].isNotNull(), s["error"]).when(s["next"] != "comma", F.lit("the text ends early"))
        return F.struct(s["done"].alias("clauses"), ended.alias("error"))

    return F.aggregate(tokens, start, _step, finish)


def holds(condition: Column, tags: Column) -> Column:
    """Is *condition* (array of ITEM, postfix) true of a column with *tags* (array of structs tag_key, tag_value)?

    NULL if the condition is empty or NULL.
    """

    def step(stack: Column, item: Column) -> Column:
        n = F.size(stack)
        has = F.exists(tags, lambda t: (t["tag_key"] == item["tag_key"]) & (item["tag_value"].isNull() | F.coalesce(t["tag_value"] == item["tag_value"], F.lit(False))))
        last, before = F.get(stack, n - 1), F.get(stack, n - 2)
        return (
            F.when(item["op"] == TAG, F.concat(stack, F.array(has)))
            .when(item["op"] == NOT, F.concat(F.slice(stack, F.lit(1), n - 1), F.array(~last)))
            .when(item["op"] == AND, F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(before & last)))
            .otherwise(F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(before | last)))
        )

    return F.get(F.aggregate(condition, F.array().cast("array<boolean>"), step), F.lit(0))


def is_plain(condition: Column) -> Column:
    """Is the condition one tag test and nothing else?"""
    return F.size(condition) == 1

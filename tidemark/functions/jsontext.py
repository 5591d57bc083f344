"""JSON objects in noisy text, by matching brackets with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rest(text: Column) -> Column:
    """The text from its first opening brace on; null without one."""
    at = F.instr(text, "{")
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def _balanced(rest: Column) -> Column:
    """Characters up to the brace that closes the first one; null where none does.

    Escaped characters are masked first, so that every quotation mark that is left opens or closes a string. Then the text is cut
    into whole strings, single braces and what lies between, and a running sum of depth is made over these; an unclosed string
    ends the search, as it hides what follows.
    """
    masked = F.regexp_replace(rest, r"\\[\s\S]", "__")
    tokens = F.regexp_extract_all(masked, F.lit(r'"[^"]*"|[{}]|[^"{}]+|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = acc["at"] + F.length(token)
        closed = acc["end"].isNull() & (token == "}") & (depth == 0)
        # a lone quotation mark opens a string that never ends
        end = F.when(acc["end"].isNull() & (token == '"'), -1).when(closed, at).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    return F.nullif(F.aggregate(tokens, start, step, lambda acc: acc["end"]), F.lit(-1))


def object_end(text: str | Column) -> Column:
    """Where a generator may stop: characters up to the end of the first balanced object, braces in strings left out; else null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.instr(t, "{") - 1 + _balanced(_rest(t))


def first_object(text: str | Column) -> Column:
    """The first complete JSON object of a text, as it is written; null if there is none or the brackets hold no JSON."""
    t = F.col(text) if isinstance(text, str) else text
    rest = _rest(t)
    found = F.substring(rest, F.lit(1), _balanced(rest))
    return F.when(F.try_parse_json(found).isNotNull(), found)

"""The filter language of network views, parsed into a Column.

Operands are numbers, s<k> and r<k> (score and rank of the k-th algorithm, from 0); operators by falling precedence are
* /, + -, < >, =, & and |, with brackets. Truth is any number but 0; = allows for a relative difference of 1e-9.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdnet.operators.ranking import almost_equal

#: Precedence of the operators.
PRECEDENCE = {"*": 13, "/": 13, "+": 12, "-": 12, "<": 10, ">": 10, "=": 9, "&": 5, "|": 4}
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([sr])(\d+)|([-+*/<>=&|()]))")


def _tokens(text: str) -> list[tuple]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at {at}: {text[at:at + 20]!r}")
        out.append(("num", float(m[1])) if m[1] else (m[2], int(m[3])) if m[2] else ("op", m[4]))
        at = m.end()
    return out


def parse(text: str, scores: list[Column], ranks: list[Column], compat: bool = False) -> Column:
    """A boolean Column; compat swaps the operands of - and /, as older filters expect."""
    tokens = _tokens(text)
    at = 0

    def truth(c: Column) -> Column:
        return c != 0

    def apply(op: str, a: Column, b: Column) -> Column:
        if compat and op in "-/":
            a, b = b, a
        as_number = lambda c: F.when(c, 1.0).otherwise(0.0)
        return {
            "*": lambda: a * b, "/": lambda: a / b, "+": lambda: a + b, "-": lambda: a - b,
            "<": lambda: as_number(a < b), ">": lambda: as_number(a > b), "=": lambda: as_number(almost_equal(a, b)),
            "&": lambda: as_number(truth(a) & truth(b)), "|": lambda: as_number(truth(a) | truth(b)),
        }[op]()

    def operand() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("an operand is missing at the end")
        kind, value = tokens[at]
        at += 1
        if kind == "num":
            return F.lit(value)
        if kind in "sr":
            return (scores if kind == "s" else ranks)[value]
        if value == "(":
            inner = climb(0)
            if at >= len(tokens) or tokens[at] != ("op", ")"):
                raise ValueError("a bracket isn't closed")
            at += 1
            return inner
        if value == "-":
            return -operand()
        raise ValueError(f"an operand is missing before {value}")

    def climb(least: int) -> Column:
        nonlocal at
        left = operand()
        while at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in PRECEDENCE and PRECEDENCE[tokens[at][1]] > least:
            op = tokens[at][1]
            at += 1
            left = apply(op, left, climb(PRECEDENCE[op]))
        return left

    found = climb(0)
    if at != len(tokens):
        raise ValueError(f"left over: {tokens[at:]}")
    return truth(found)

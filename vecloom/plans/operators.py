"""Vector operators in SQL text, rewritten to functions: ``<->`` l2, ``<=>`` cosine, ``<~>`` and ``<#>`` negative inner product.

Spark SQL cannot be given new operators, and ``<=>`` is its null-safe equality,
so texts are rewritten before they are parsed: each operand is a name, a call, a
parenthesis, a cast or an array literal.
"""

from __future__ import annotations

import re

from vecloom.functions.vectors import BODIES

#: Fixed values.
OPERATORS = {"<->": "l2_distance", "<=>": "cosine_distance", "<~>": "negative_inner_product", "<#>": "negative_inner_product"}
_OPEN, _CLOSE = "([", ")]"


def _operand(text: str, at: int, step: int) -> int:
    """Index just beyond the operand that begins at ``at`` (step 1) or ends there (step -1)."""
    while 0 <= at < len(text) and text[at].isspace():
        at += step
    opening, closing = (_OPEN, _CLOSE) if step > 0 else (_CLOSE, _OPEN)
    depth, quote = 0, ""
    while 0 <= at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in opening:
            depth += 1
        elif c in closing:
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and not (c.isalnum() or c in "_.:"):
            break
        at += step
    return at


#: Strings, quoted names and comments, in which nothing is an operator.
_SKIPPED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)


def _quoted(sql: str, at: int) -> bool:
    return any(m.start() <= at < m.end() for m in _SKIPPED.finditer(sql))


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose parenthesis opens at ``at``, and the index beyond its end."""
    parts, depth, start, i, quote = [], 0, at + 1, at, ""
    while i < len(sql):
        c = sql[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth == 0:
                return [*parts, sql[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            parts.append(sql[start:i].strip())
            start = i + 1
        i += 1
    raise ValueError("a parenthesis is not closed")


def expand(sql: str) -> str:
    """Calls of the vector functions written out as built-in expressions, which Spark allows anywhere, ORDER BY included."""
    at, call = 0, re.compile(r"\b(" + "|".join(BODIES) + r")\s*(?=\()", re.IGNORECASE)
    while m := call.search(sql, at):
        if _quoted(sql, m.start()):
            at = m.end()
            continue
        args, end = _arguments(sql, m.end())
        if len(args) != 2:
            raise ValueError(f"{m.group(1)} takes two vectors")
        body = "(" + BODIES[m.group(1).lower()].replace("{a}", "\0").replace("{b}", expand(args[1])).replace("\0", expand(args[0])) + ")"
        sql, at = sql[: m.start()] + body + sql[end:], m.start() + len(body)
    return sql


def rewrite(sql: str) -> str:
    """SQL with vector operators and functions as built-in expressions; what is inside quotes stays."""
    at = 0
    while m := re.compile(r"<->|<=>|<~>|<#>").search(sql, at):
        if _quoted(sql, m.start()):
            at = m.end()
            continue
        left, right = _operand(sql, m.start() - 1, -1) + 1, _operand(sql, m.end(), 1)
        call = f"{OPERATORS[m.group()]}({sql[left : m.start()].strip()}, {sql[m.end() : right].strip()})"
        sql = sql[:left] + f" {call} " + sql[right:]
        at = left
    return expand(sql)

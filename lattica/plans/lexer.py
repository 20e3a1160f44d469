"""Tokens of the dataflow language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_RULES = [
    ("skip", r"\s+|/\*.*?\*/"),
    ("number", r"\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?L?"),
    ("string", r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"),
    ("name", r"[A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)*"),
    ("symbol", r":=|->|==|!=|<=|>=|<<|>>|&&|\|\||//|[-+*/%&|^~!<>?:=,;(){}\[\]@#]"),
]
_TOKEN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _RULES), re.S)


class ProgramError(ValueError):
    """A program that can't be read or planned."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ProgramError(f"line {line}: unexpected {source[at]!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return [*out, Token("end", "", line)]


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])

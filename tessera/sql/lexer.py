"""Tokens of the dialect: words, quoted names, strings, blobs, numbers, parameters and signs; comments are skipped."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # word, name, string, blob, number, param, sign, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "sign" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|$))
      | (?P<blob>[xX]'[0-9A-Fa-f]*')
      | (?P<string>'(?:[^']|'')*')
      | (?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])
      | (?P<number>0[xX][0-9A-Fa-f]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)
      | (?P<param>\?\d*|[:@$][A-Za-z_]\w*)
      | (?P<word>[^\W\d]\w*)
      | (?P<sign>->>|->|\|\||<<|>>|<=|>=|==|!=|<>|[-+*/%&|~<>=(),.;])""",
    re.X | re.S,
)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unrecognized token near {sql[at : at + 20]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "name":
            text = text[1:-1].replace('""', '"') if text[0] == '"' else text[1:-1].replace("``", "`")
        elif kind == "blob":
            text = text[2:-1]
            if len(text) % 2:
                raise SqlError("a blob literal has an even number of digits")
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


def statements(sql: str) -> list[str]:
    """Statements of a script; semicolons in quotes, comments and trigger bodies don't end one."""
    out, begin, depth, opened = [], 0, 0, False
    found = tokens(sql)
    for i, t in enumerate(found):
        if t.upper == "TRIGGER" and i and found[i - 1].upper in ("CREATE", "TEMP", "TEMPORARY"):
            opened = True
        elif opened and t.upper in ("BEGIN", "CASE"):
            depth += 1
        elif opened and t.upper == "END":
            depth -= 1
            opened = depth > 0
        if (t.text == ";" and t.kind == "sign" and not depth) or t.kind == "end":
            if sql[begin : t.at].strip():
                out.append(sql[begin : t.at].strip())
            begin = t.at + 1
    return [s for s in out if len(tokens(s)) > 1]

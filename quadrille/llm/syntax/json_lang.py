"""JSON (RFC 8259): lexer and grammar."""

from __future__ import annotations

import re

from ...syntax.lalr import SyntaxFault, Tables, parse

GRAMMAR = r"""
value : object | array | STR | NUM | 'true' | 'false' | 'null' ;
object : '{' '}' | '{' members '}' ;
members : pair {[]} | members ',' pair {+} ;
pair : STR ':' value ;
array : '[' ']' | '[' items ']' ;
items : value {[]} | items ',' value {+} ;
"""

_TOK = re.compile(r'([ \t\r\n]+)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|([{}\[\]:,])|(true|false|null)(?![A-Za-z0-9_])')


def lex(src: str) -> list[tuple]:
    out, pos, line = [], 0, 1
    while pos < len(src):
        m = _TOK.match(src, pos)
        if not m:
            raise SyntaxFault(f"unexpected character {src[pos]!r}", line)
        k, v = m.lastindex, m.group()
        if k == 2:
            out.append(("STR", v, line, pos))
        elif k == 3:
            out.append(("NUM", v, line, pos))
        elif k != 1:
            out.append((v, v, line, pos))
        line += v.count("\n")
        pos = m.end()
    return out


def read(tables: Tables, src: str):
    return parse(tables, lex(src))

"""Python: lexer with indentation and grammar of version 3 up to 3.13."""

from __future__ import annotations

import re

from ...syntax.lalr import Machine, SyntaxFault, Tables

GRAMMAR = r"""
%nonassoc 'lambda'
%left 'or'
%left 'and'
%right 'not'
%left '|'
%left '^'
%left '&'
%left SHIFT
%left '+' '-'
%left '*' MUL '@'
%right UNARY
%right '**'

file : {[]} | file stmt {+} ;
stmt : simple {$0} | compound ;
simple : smalls NEWLINE {$0} | smalls ';' NEWLINE {$0} ;
smalls : small {[]} | smalls ';' small {+} ;
small : exprs {expr} | assign | exprs AUG rhs {aug} | exprs ':' E {ann} | exprs ':' E '=' rhs {ann} | 'pass' | 'break' | 'continue' | 'return' {return} | 'return' exprs {return} | 'raise' | 'raise' E | 'raise' E 'from' E
  | 'global' names | 'nonlocal' names | 'del' exprs {del} | 'assert' E | 'assert' E ',' E | yield_s | import_s | TYPE NAME tparams '=' E ;
assign : exprs '=' rhs {assign} | exprs '=' assign {assign} ;
rhs : exprs | yield_s ;
names : NAME | names ',' NAME ;
import_s : 'import' dotted_as | 'from' dots dotted 'import' import_names | 'from' dotted 'import' import_names | 'from' dots 'import' import_names ;
dots : DOTS | dots DOTS ;
dotted_as : das | dotted_as ',' das ;
das : dotted | dotted 'as' NAME ;
dotted : NAME | dotted '.' NAME ;
import_names : '*' | nas | '(' nas ')' | '(' nas ',' ')' ;
nas : na | nas ',' na ;
na : NAME | NAME 'as' NAME ;
yield_s : 'yield' | 'yield' exprs | 'yield' 'from' E ;
exprs : se {$0} | se_list | se_list ',' ;
se_list : se ',' se {tuple} | se_list ',' se {tuple} ;
exprs : se ',' {tuple} ;
se : E | '*' B {star} ;
N : E | NAME ':=' E ;
E : D | D 'if' D 'else' E {cond} | 'lambda' ':' E {lambda} | 'lambda' params ':' E {lambda} ;
D : D 'or' D {op} | D 'and' D {op} | 'not' D {op} | C ;
C : B | C cmp B {op} ;
cmp : CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
B : B '|' B {op} | B '^' B {op} | B '&' B {op} | B SHIFT B {op} | B '+' B {op} | B '-' B {op} | B '*' B {op} | B MUL B {op} | B '@' B {op} | '+' B %prec UNARY {op} | '-' B %prec UNARY {op} | '~' B %prec UNARY {op} | B '**' B {op} | 'await' P {op} | P ;
P : atom | P '.' NAME {attr} | P '(' ')' {call} | P '(' args ')' {call} | P '(' args ',' ')' {call} | P '[' subs ']' {sub} | P '[' subs ',' ']' {sub} ;
atom : NAME {name} | NUM {lit} | strs {str} | 'None' {lit} | 'True' {lit} | 'False' {lit} | '...' {lit} | '(' ')' {tuple} | '(' yield_s ')' {lit} | '(' N ')' {paren} | '(' '*' B ')' {bad_star} | '(' ne_list ')' {tuple} | '(' ne_list ',' ')' {tuple} | '(' ne ',' ')' {tuple} | '(' ne comp ')' {lit}
  | '[' ']' {list} | '[' ne ']' {list} | '[' ne ',' ']' {list} | '[' ne_list ']' {list} | '[' ne_list ',' ']' {list} | '[' ne comp ']' {lit} | '{' '}' {lit} | '{' pairs '}' {lit} | '{' pairs ',' '}' {lit} | '{' E ':' E comp '}' {lit} | '{' ne '}' {lit} | '{' ne ',' '}' {lit} | '{' ne_list '}' {lit} | '{' ne_list ',' '}' {lit} | '{' ne comp '}' {lit} ;
strs : STR {[]} | strs STR {+} ;
ne : N | '*' B {star} ;
ne_list : ne ',' ne {tuple} | ne_list ',' ne {tuple} ;
pairs : pair | pairs ',' pair ;
pair : E ':' E | '**' B ;
comp : comp_for | comp comp_for | comp 'if' cond_nc ;
cond_nc : D | NAME ':=' D ;
comp_for : 'for' targets 'in' D {for} | 'async' 'for' targets 'in' D {for} ;
targets : target {$0} | target ',' {tuple} | tlist {$0} | tlist ',' {$0} ;
tlist : target ',' target {tuple} | tlist ',' target {tuple} ;
target : B | '*' B {star} ;
args : arg | args ',' arg ;
arg : N | N comp | '*' E | '**' E | NAME '=' E ;
subs : subi | subs ',' subi ;
subi : N | '*' B | ':' | E ':' | ':' E | E ':' E | ':' ':' | E ':' ':' | ':' E ':' | E ':' E ':' | ':' ':' E | E ':' ':' E | ':' E ':' E | E ':' E ':' E ;
params : param {[]} | params ',' param {+} ;
param : NAME {p} | NAME '=' E {pd} | '*' {pstar} | '*' NAME {pstar} | '**' NAME {pkw} | '/' {pslash} ;
tparamlist : | dparams {$0} | dparams ',' {$0} ;
dparams : dparam {[]} | dparams ',' dparam {+} ;
dparam : NAME {p} | NAME ':' E {p} | NAME '=' E {pd} | NAME ':' E '=' E {pd} | '*' {pstar} | '*' NAME {pstar} | '*' NAME ':' E {pstar} | '*' NAME ':' '*' B {pstar} | '**' NAME {pkw} | '**' NAME ':' E {pkw} | '/' {pslash} ;
tparams : | '[' tps ']' | '[' tps ',' ']' ;
tps : tp | tps ',' tp ;
tp : NAME | NAME ':' E | NAME '=' E | NAME ':' E '=' E | '*' NAME | '**' NAME ;
compound : 'if' N ':' suite elifs else_ | 'while' N ':' suite else_ | for_s | 'async' for_s | try_s | with_s | 'async' with_s | def_s | class_s | deco | match_s ;
elifs : | elifs 'elif' N ':' suite ;
else_ : | 'else' ':' suite ;
for_s : 'for' targets 'in' exprs ':' suite else_ {for} ;
try_s : 'try' ':' suite excepts else_ fin | 'try' ':' suite 'finally' ':' suite ;
fin : | 'finally' ':' suite ;
excepts : exc | excepts exc ;
exc : 'except' ':' suite | 'except' E ':' suite | 'except' E 'as' NAME ':' suite | 'except' '*' E ':' suite | 'except' '*' E 'as' NAME ':' suite | 'except' elist ':' suite ;
elist : E ',' E | elist ',' E ;
with_s : 'with' witems ':' suite | 'with' WPAREN witems_as ')' ':' suite | 'with' WPAREN witems_as ',' ')' ':' suite ;
witems : witem | witems ',' witem ;
witem : E | E 'as' B {as} ;
witems_as : witem | witems_as ',' witem ;
def_s : 'def' NAME tparams '(' tparamlist ')' ':' suite {def} | 'def' NAME tparams '(' tparamlist ')' '->' E ':' suite {def} | 'async' 'def' NAME tparams '(' tparamlist ')' ':' suite {adef} | 'async' 'def' NAME tparams '(' tparamlist ')' '->' E ':' suite {adef} ;
class_s : 'class' NAME tparams ':' suite {class} | 'class' NAME tparams '(' ')' ':' suite {class} | 'class' NAME tparams '(' args ')' ':' suite {class} | 'class' NAME tparams '(' args ',' ')' ':' suite {class} ;
deco : '@' N NEWLINE deco {$3} | '@' N NEWLINE def_s {$3} | '@' N NEWLINE class_s {$3} ;
suite : simple {suite1} | NEWLINE INDENT body DEDENT {suite} ;
body : stmt {[]} | body stmt {+} ;
match_s : MATCH exprs ':' NEWLINE INDENT cases DEDENT ;
cases : case | cases case ;
case : CASE pats guard ':' suite ;
guard : | 'if' N ;
pats : pat | pats_l | pats_l ',' | pat ',' ;
pats_l : pat ',' pat | pats_l ',' pat ;
pat : orpat | orpat 'as' NAME | '*' NAME ;
orpat : cpat | orpat '|' cpat ;
cpat : NUM | '-' NUM | NUM '+' NUM | NUM '-' NUM | '-' NUM '+' NUM | '-' NUM '-' NUM | strs | 'None' | 'True' | 'False' | dotted | dotted '(' ')' | dotted '(' pargs ')' | dotted '(' pargs ',' ')' | '(' ')' | '(' pats ')' | '[' ']' | '[' pats ']' | '{' '}' | '{' ppairs '}' | '{' ppairs ',' '}' ;
pargs : parg | pargs ',' parg ;
parg : pat | NAME '=' pat ;
ppairs : ppair | ppairs ',' ppair ;
ppair : cpat ':' pat | '**' NAME ;
"""

#: The reserved words of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_TOK = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r?\n)|(?P<com>\#[^\n]*)|(?P<str>[A-Za-z]{0,2}(?:\"\"\"|'''|"|'))|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:.;=])""",
    re.X,
)
_PREFIX = frozenset(["", "r", "u", "b", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"])
_AUG = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
_CMP = frozenset(["==", "!=", "<", ">", "<=", ">="])


def lex(src: str, start_line: int = 1, flat: bool = False) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """Tokens (terminal, text, line, start, end), comments, strings (start, text, line, prefix) and inner sources (text, line) of f-strings."""
    out: list[tuple] = []
    comments, strings, inner = [], [], []
    pos, line, n = 0, start_line, len(src)
    depth: list[str] = []
    indents = [0]
    bol = not flat
    match = _TOK.match
    first = 0  # index of the first token of the logical line
    if "\x00" in src:
        raise SyntaxFault("unexpected character '\\x00'", 1 + src.count("\n", 0, src.find("\x00")))
    while pos < n:
        if bol:
            m = re.compile(r"[ \t\f]*").match(src, pos)
            rest = m.end()
            if rest >= n:
                break
            if src[rest] in "\r\n#":
                if src[rest] == "#":
                    e = src.find("\n", rest)
                    e = n if e < 0 else e
                    comments.append((rest, src[rest:e], line))
                    rest = e
                elif src[rest] == "\r":
                    rest += 1
                pos = min(rest + 1, n)
                line += 1
                continue
            col = 0
            for ch in m.group():
                col = 0 if ch == "\f" else (col // 8 + 1) * 8 if ch == "\t" else col + 1
            pos = rest
            if col > indents[-1]:
                indents.append(col)
                out.append(("INDENT", "indent", line, pos, pos))
            while col < indents[-1]:
                indents.pop()
                out.append(("DEDENT", "dedent", line, pos, pos))
            if col != indents[-1]:
                raise SyntaxFault("unindent does not match any outer level", line)
            bol, first = False, len(out)
        m = match(src, pos)
        if not m:
            raise SyntaxFault(f"unexpected character {src[pos]!r}", line)
        k, v, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if k == "ws":
            line += v[0] == "\\"
        elif k == "nl":
            if not depth and not flat:
                out.append(("NEWLINE", "newline", line, start, start))
                _soft(out, first)
                bol = True
            line += 1
        elif k == "com":
            comments.append((start, v, line))
        elif k == "name":
            out.append((v if v in KEYWORDS else "NAME", v, line, start, pos))
        elif k == "num":
            if pos < n and (src[pos].isalnum() or src[pos] == "_") and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(src, pos):
                raise SyntaxFault("invalid number", line)
            if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", v):
                raise SyntaxFault("leading zeros in decimal integer", line)
            out.append(("NUM", v, line, start, pos))
        elif k == "str":
            q = v.lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
            prefix = v[: len(v) - len(q)].lower()
            if prefix not in _PREFIX:
                out.append(("NAME", v[: len(v) - len(q)], line, start, start + len(prefix)))
                pos = start + len(prefix)
                continue
            at = line
            pos, line = _string(src, pos, line, q, "f" in prefix or "t" in prefix, inner)
            out.append(("STR", src[start:pos], at, start, pos))
            strings.append((start, src[m.end():pos - len(q)], at, prefix))
        else:
            if v in "([{":
                depth.append(v)
                t = v
                if v == "(" and out and out[-1][0] == "with" and _as_inside(src, pos):
                    t = "WPAREN"
            elif v in ")]}":
                if not depth or {"(": ")", "[": "]", "{": "}"}[depth.pop()] != v:
                    raise SyntaxFault(f"unmatched '{v}'", line)
                t = v
            elif v in _AUG:
                t = "AUG"
            elif v in _CMP:
                t = "CMP"
            elif v in ("<<", ">>"):
                t = "SHIFT"
            elif v in ("//", "%"):
                t = "MUL"
            elif v == "/":
                t = "MUL" if not (out and out[-1][0] in ("(", ",", "lambda") and depth or out and out[-1][0] in (",", "lambda")) else "/"
            elif v in (".", "...") and out and (out[-1][0] == "from" or out[-1][0] == "DOTS"):
                t = "DOTS"
            else:
                t = v
            out.append((t, v, line, start, pos))
    if depth:
        raise SyntaxFault(f"'{depth[-1]}' was never closed", line)
    if not flat:
        if out and not bol:
            out.append(("NEWLINE", "newline", line, n, n))
            _soft(out, first)
        while indents.pop():
            out.append(("DEDENT", "dedent", line, n, n))
    return out, comments, strings, inner


def _as_inside(src: str, pos: int) -> bool:
    """Whether the bracket that opens just before pos holds ``as`` at its own level and a colon follows it."""
    depth = 1
    found = False
    for m in re.compile(r"[()\[\]{}]|\bas\b|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"").finditer(src, pos):
        t = m.group()
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
            if not depth:
                return found and src[m.end():].lstrip(" \t").startswith(":")
        elif t == "as" and depth == 1:
            found = True
    return False


def _soft(out: list[tuple], first: int) -> None:
    """Soft keywords at the start of a logical line."""
    if first >= len(out) or out[first][0] != "NAME" or len(out) - first < 3:
        return
    v, nxt = out[first][1], out[first + 1][0]
    if v in ("match", "case") and out[-2][0] == ":" and nxt not in ("=", ".", ",", ")", ":", "AUG", ":=", "CMP", "in", "is", "and", "or", "NEWLINE") or v == "case" and nxt in ("NAME", "[", "(", "{", "STR", "NUM", "-", "*", "None", "True", "False") and ":" in [t[0] for t in out[first:]] and any(t[0] == "MATCH" for t in out[:first]):
        out[first] = (v.upper(), *out[first][1:])
    elif v == "type" and nxt == "NAME" and out[first + 2][0] in ("=", "["):
        out[first] = ("TYPE", *out[first][1:])


def _string(src: str, pos: int, line: int, q: str, formatted: bool, inner: list) -> tuple[int, int]:
    n, start_line = len(src), line
    stop = re.compile(r"\\|\n|" + re.escape(q) + (r"|\{\{|\{" if formatted else ""))
    while True:
        m = stop.search(src, pos)
        if not m or m.group() == "\n" and len(q) == 1:
            raise SyntaxFault(f"missing terminator: {q}", start_line)
        t, pos = m.group(), m.end()
        if t == q:
            return pos, line
        if t == "\n":
            line += 1
        elif t == "\\":
            line += src.startswith("\n", pos)
            pos += 1
        elif t == "{":
            begin, depth = pos, 0
            piece = re.compile(r"[\[({]|[\])}]|\n|(?:\"\"\"|'''|[\"'])|!=|[!:]")
            end = None
            while True:
                m = piece.search(src, pos)
                if not m:
                    raise SyntaxFault("f-string: expecting '}'", start_line)
                c, pos = m.group(), m.end()
                if c in "([{":
                    depth += 1
                elif c == "}" and not depth:
                    end = end if end is not None else m.start()
                    break
                elif c in ")]}":
                    depth -= 1
                elif c == "\n":
                    line += 1
                elif c in ("!", ":") and not depth:
                    end = m.start() if end is None else end
                    if c == ":":  # format spec: up to the closing brace, nested fields allowed
                        level = 0
                        while pos < n and (src[pos] != "}" or level):
                            if src.startswith(q, pos):
                                raise SyntaxFault("f-string: expecting '}'", start_line)
                            level += {"{": 1, "}": -1}.get(src[pos], 0)
                            pos += 1
                elif c == "!=" or c in "!:":
                    pass
                else:
                    prefix = re.compile(r"[A-Za-z]{0,2}$").search(src, begin, m.start()).group().lower()
                    pos, line = _string(src, pos, line, c, "f" in prefix and prefix in _PREFIX, inner)
            text = src[begin:end].rstrip()
            inner.append((text[:-1] if text.endswith("=") and text[-2:-1] not in ("=", "!", "<", ">") else text, line))


def _target(x, star: bool = True) -> bool:
    while type(x) is tuple and x[0] == "paren":
        x = x[1][1]
    if type(x) is not tuple:
        return False
    if x[0] in ("name", "attr", "sub"):
        return True
    if x[0] in ("tuple", "list"):
        return all(_target(y) for y in x[1] if type(y) is tuple)
    return x[0] == "star" and _target(x[1][1])


def _check(tree) -> None:
    todo = [tree]
    while todo:
        x = todo.pop()
        if type(x) is list:
            todo.extend(x)
            continue
        if type(x) is not tuple:
            continue
        label, kids = x[0], x[1]
        bad = False
        if label == "assign":
            bad = not _target(kids[0])
        elif label in ("aug", "ann"):
            y = kids[0]
            while type(y) is tuple and y[0] == "paren":
                y = y[1][1]
            bad = not (type(y) is tuple and y[0] in ("name", "attr", "sub"))
        elif label == "for":
            i = 2 if kids[0] == "async" else 1
            bad = not _target(kids[i])
        elif label == "as":
            bad = not _target(kids[2])
        elif label == "del":
            bad = not _target(kids[1]) or type(kids[1]) is tuple and kids[1][0] == "star"
        elif label == "bad_star":
            bad = True
        elif label in ("def", "adef", "lambda"):
            params = next((k for k in kids if type(k) is list and k and type(k[0]) is tuple and k[0][0] in ("p", "pd", "pstar", "pkw", "pslash")), [])
            seen_default = seen_star = seen_kw = False
            for i, p in enumerate(params):
                bad |= seen_kw
                if p[0] == "pd" and not seen_star:
                    seen_default = True
                elif p[0] == "p" and seen_default and not seen_star:
                    bad = True
                elif p[0] == "pstar":
                    bad |= seen_star or len(p[1]) == 1 and (i + 1 == len(params) or params[i + 1][0] == "pkw")
                    seen_star = True
                elif p[0] == "pkw":
                    seen_kw = True
                elif p[0] == "pslash":
                    bad |= seen_star or i == 0
        if bad:
            raise SyntaxFault(f"invalid {label}", 0)
        todo.extend(kids)


def read(tables: Tables, src: str, lexed=None):
    toks, _, _, inner = lexed or lex(src)
    for text, line in inner:
        sub, _, _, deeper = lex(text, line, flat=True)
        inner_tokens = [("(", "(", line), *sub, (")", ")", line), ("NEWLINE", "newline", line)]
        _drive(tables, inner_tokens)
        for more in deeper:
            inner.append(more)
    tree = _drive(tables, toks)
    _check(tree)
    return tree


def _drive(tables: Tables, toks):
    m = Machine(tables)
    line = 1
    for t in toks:
        line = t[2]
        m.feed(t[0], t[1], line)
    return m.end(line)

"""Elixir: lexer and grammar.

The lexer marks what the grammar cannot see: calls without parentheses, the call that owns a ``do`` block (the outermost open call without
parentheses of its bracket, else the call just before), access brackets, and line ends that separate expressions.  Code inside ``#{}`` is a
token stream of its own, parsed by the same tables.
"""

from __future__ import annotations

import re

from .lalr import Machine, SyntaxFault, Tables

GRAMMAR = r"""
%left 'do'
%right 'stab_prec'
%left 'in_match'
%right 'when'
%right '::'
%right '|'
%right '=>'
%nonassoc '&'
%right '='
%left OR
%left AND
%left COMP
%left REL
%left ARROW
%left IN
%left XOR
%right TERN
%right CONCAT
%right '..'
%left '+' '-'
%left '*' '/'
%left POW
%nonassoc UNARY
%left 'acc['
%left '.'
%nonassoc '@'
%nonassoc INT_CAP

program : {[]} | stmts | 'sep' | 'sep' stmts {$1} ;
stmts : E {[]} | stmts 'sep' E {+} | stmts 'sep' {$0} ;
items : item {[]} | items 'sep' item {+} | items 'sep' {$0} ;
item : E | stab_args '->' E {stab} | stab_args '->' {stab} | '->' E {stab0} | '->' {stab0} | E '->' E {stab} | E '->' {stab} ;
stab_args : E ',' stab_rest | kws | kws 'when' E ;
stab_rest : E | stab_rest ',' E | kws | stab_rest ',' kws ;
E : E '=' E {bin} | E OR E {bin} | E AND E {bin} | E COMP E {bin} | E REL E {bin} | E ARROW E {bin} | E IN E {bin} | E XOR E {bin} | E TERN E {bin}
  | E CONCAT E {bin} | E '..' E {bin} | E '+' E {bin} | E '-' E {bin} | E '*' E {bin} | E '/' E {bin} | E POW E {bin} | E 'in_match' E {bin} | E 'when' E {bin}
  | E 'when' kws {bin} | E '::' E {bin} | E '|' E {bin} | '+' E %prec UNARY {un} | '-' E %prec UNARY {un} | UN E %prec UNARY {un} | '&' E {un} | '@' E {at} | '..' %prec INT_CAP
  | NP args_np {call} | NP_DO args_np block {call_do} | ID_DO block {call_do} | ID_DOT_DO block {call_do} | P_DO '(' ')' block {call_do} | P_DO '(' args ')' block {call_do} | P_DO '(' args ')' '(' ')' block {call_do} | P_DO '(' args ')' '(' args ')' block {call_do}
  | primary ;
primary : ID | INT | FLOAT | CHAR | ATOM | ALIAS | STR | CHARS | SIGIL | LIT | INT_CAP
  | PID '(' ')' {call} | PID '(' args ')' {call} | primary 'call(' ')' {call} | primary 'call(' args ')' {call}
  | primary 'acc[' E ']' {access} | primary 'acc[' kws ']' {access} | primary 'acc[' E ',' ']' {access}
  | primary '.' dotted {dot} | primary '.(' ')' {dotcall} | primary '.(' args ')' {dotcall} | primary '.' '{' '}' | primary '.' '{' args '}' {dotalias}
  | '(' ')' | '(' items ')' {paren} | '(' 'sep' items ')' {paren} | '[' ']' {list} | '[' args ']' {list} | '{' '}' {tuple} | '{' args '}' {tuple} | '<<' '>>' | '<<' args '>>'
  | '%' '{' map_body '}' {map} | '%' map_name '{' map_body '}' {struct}
  | 'fn' items 'end' {fn} | 'fn' 'sep' items 'end' {fn} | 'block' block {$1} ;
map_name : ALIAS | ID | map_name '.' ALIAS | '@' ID | UN ID | SIGIL | LIT | PID '(' ')' | PID '(' args ')' ;
dotted : ID | ALIAS | PID '(' ')' {call} | PID '(' args ')' {call} | QID | QPID '(' ')' {call} | QPID '(' args ')' {call} ;
map_body : | assocs | assocs ',' | kws_t | assocs ',' kws_t | E | E '|' kws_t | E '|' assocs | E '|' assocs ',' | E '|' assocs ',' kws_t ;
assocs : assoc {[]} | assocs ',' assoc {+} ;
assoc : E '=>' E ;
args : plain {$0} | plain ',' {$0} | plain ',' kws_t {+} | kws_t {[]} ;
plain : E {[]} | plain ',' E {+} ;
kws_t : kws | kws ',' {$0} ;
kws : kw {[]} | kws ',' kw {+} ;
kw : KW E {kw} ;
args_np : plain {$0} | plain ',' kws {+} | kws {[]} ;
block : 'do' 'end' {do} | 'do' items 'end' {do} | 'do' 'sep' 'end' {do} | 'do' 'sep' items 'end' {do} | 'do' clauses 'end' {do} | 'do' items clauses 'end' {do} | 'do' 'sep' clauses 'end' {do} | 'do' 'sep' items clauses 'end' {do} ;
clauses : blk {[]} | clauses blk {+} ;
blk : BLOCK | BLOCK items | BLOCK 'sep' | BLOCK 'sep' items ;
"""

#: The operators of the language by precedence class.
_CLASS = {
    **dict.fromkeys(["||", "|||", "or"], "OR"), **dict.fromkeys(["&&", "&&&", "and"], "AND"), **dict.fromkeys(["==", "!=", "=~", "===", "!=="], "COMP"),
    **dict.fromkeys(["<", ">", "<=", ">="], "REL"), **dict.fromkeys(["|>", "<<<", ">>>", "<<~", "~>>", "<~", "~>", "<~>", "<|>"], "ARROW"), "in": "IN", "not in": "IN",
    "^^^": "XOR", "//": "TERN", **dict.fromkeys(["++", "--", "+++", "---", "<>"], "CONCAT"), **dict.fromkeys(["<-", "\\\\"], "in_match"), "**": "POW",
    **dict.fromkeys(["!", "^", "not", "~~~"], "UN"),
}
_BLOCK = frozenset(["else", "rescue", "catch", "after"])
_OPS = r"===|!==|<<<|>>>|\|\|\||&&&|\^\^\^|~~~|<<~|~>>|<~>|<\|>|\+\+\+|---|\.\.\.|==|!=|=~|<=|>=|&&|\|\||<>|\+\+|--|\*\*|\|>|<~|~>|<-|\\\\|//|::|->|=>|<<|>>|\.\.|[-+*/<>=!&|^@.%(){}\[\],;]"
_KW_OPS = _OPS.replace("::|", "").replace("->|", "").replace("<<|>>|", "").partition(r"|[-+")[0] + r"|[-+*/<>=!&|^@.]"
_NAME = r"(?![A-Z])[^\W\d]\w*[?!]?"
_TOK = re.compile(
    rf"""(?P<ws>(?:[ \t\r\f]|\\\r?\n)+)|(?P<nl>\n)|(?P<com>\#[^\n]*)|(?P<num>0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d+(?:_\d+)*(?:\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?)?)|(?P<char>\?(?:\\(?:x[0-9a-fA-F]{{1,2}}|u\{{[0-9a-fA-F]+\}}|u[0-9a-fA-F]{{4}}|.)|[^\\\s]))"""
    rf"""|(?P<heredoc>\"\"\"[ \t]*\r?\n|'''[ \t]*\r?\n)|(?P<sigil>~(?:[a-z]|[A-Z][A-Z0-9]*)(?=\"\"\"|'''|[/|"'(\[{{<]))|(?P<quote>["'])|(?P<qatom>:["'])|(?P<kw>(?:[^\W\d][\w@]*[?!]?):(?![:\w"'\[{{(<>=+*/&|^~.%-])|(?:{_KW_OPS}):(?=\s))"""
    rf"""|(?P<atom>:(?:[^\W\d][\w@]*[?!]?|<<>>|%{{}}|{{}}|\.\.//|{_OPS}))|(?P<alias>[A-Z]\w*)|(?P<id>{_NAME})|(?P<cap>&\d+)|(?P<op>{_OPS})""",
    re.X | re.S,
)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_START = frozenset(["ID", "PID", "NP", "INT", "FLOAT", "CHAR", "ATOM", "ALIAS", "STR", "CHARS", "SIGIL", "LIT", "INT_CAP", "KW", "[", "{", "(", "%", "<<", "&", "@", "UN", "fn", "block", "QID"])
_CONT = frozenset(["OR", "AND", "COMP", "REL", "ARROW", "IN", "XOR", "TERN", "CONCAT", "in_match", "POW", "=", "when", "::", "|", "=>", "*", "/", ".", "->", ",", ")", "]", "}", ">>", "end", "BLOCK", "do"])
_OPEN_END = frozenset(["OR", "AND", "COMP", "REL", "ARROW", "IN", "XOR", "TERN", "CONCAT", "in_match", "POW", "=", "when", "::", "|", "=>", "*", "/", "+", "-", ".", ",", "(", "[", "{", "<<", "acc[", "call(", ".(", "UN", "&", "@", "KW", "%", "do", "fn", "->", "BLOCK", "sep"])


class Lexed:
    """Tokens (terminal, text, line, start, end), comments (start, text, line), texts (start, text, line, kind) and inner token lists."""

    __slots__ = ("tokens", "comments", "texts", "inner")

    def __init__(self):
        self.tokens, self.comments, self.texts, self.inner = [], [], [], []


def lex(src: str) -> Lexed:
    out = Lexed()
    end, line = _run(src, 0, 1, out, out.tokens, False)
    return out


def _string(src: str, pos: int, line: int, close: str, raw: bool, out: Lexed) -> tuple[int, int, str]:
    """Text up to ``close``; code in #{} becomes an inner token list.  The text has a blank for each piece of code."""
    parts, n, start_line = [], len(src), line
    stops = re.compile(r"\\|\n|#\{|" + re.escape(close)) if not raw else re.compile(r"\\|\n|" + re.escape(close))
    while True:
        m = stops.search(src, pos)
        if not m:
            raise SyntaxFault(f"missing terminator: {close}", start_line)
        parts.append(src[pos:m.start()])
        t, pos = m.group(), m.end()
        if t == close:
            return pos, line, "".join(parts)
        if t == "\n":
            line += 1
            parts.append("\n")
        elif t == "\\":
            if pos >= n:
                raise SyntaxFault(f"missing terminator: {close}", start_line)
            c = src[pos]
            line += c == "\n"
            parts.append({"n": "\n", "t": "\t", "s": " "}.get(c, c) if not raw else "\\" + c)
            pos += 1
        else:
            inner: list = []
            pos, line = _run(src, pos, line, out, inner, True)
            out.inner.append(inner)
            parts.append(" ")


def _heredoc(src: str, pos: int, line: int, quote: str, raw: bool, out: Lexed) -> tuple[int, int, str]:
    """Body of a heredoc that began on the line before ``pos``; ends at the quotes that stand first on a line."""
    m = re.compile(r"^[ \t]*" + quote, re.M).search(src, pos)
    start_line = line
    while True:
        if not m:
            raise SyntaxFault(f"missing terminator: {quote}", start_line)
        if raw:
            break
        body_end, p, inner_line = m.start(), pos, line
        # code inside the text may hold the quotes itself
        while True:
            i = re.compile(r"\\.|#\{", re.S).search(src, p)
            if not i or i.start() >= body_end:
                break
            p = i.end()
            if i.group() == "#{":
                inner: list = []
                p, _ = _run(src, p, inner_line + src.count("\n", pos, p), out, inner, True)
                out.inner.append(inner)
        if p <= body_end:
            break
        m = re.compile(r"^[ \t]*" + quote, re.M).search(src, p)
        out.inner.clear()
    body = src[pos:m.start()]
    indent = len(m.group()) - len(quote)
    text = "\n".join(x[indent:] if x[:indent].isspace() else x for x in body.split("\n")) if indent else body
    return m.end(), line + body.count("\n"), text if raw else re.sub(r"#\{[^{}]*\}", " ", text)


def _run(src: str, pos: int, line: int, out: Lexed, toks: list, inner: bool) -> tuple[int, int]:
    match, n = _TOK.match, len(src)
    stack: list[str] = []
    raw: list[list] = []  # [terminal, text, line, start, end, space before, newline before]
    space = nl = False

    def put(kind, text, start, end):
        nonlocal space, nl
        raw.append([kind, text, line, start, end, space, nl])
        space = nl = False

    while pos < n:
        m = match(src, pos)
        if not m:
            raise SyntaxFault(f"unexpected character {src[pos]!r}", line)
        k, v, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if k == "ws":
            space = True
            line += v.count("\n")
            continue
        if k == "nl":
            line += 1
            nl = space = True
            continue
        if k == "com":
            out.comments.append((start, v, line))
            continue
        if k == "id":
            if v in ("do", "end", "fn", "when"):
                k = v
            elif v in _BLOCK:
                k = "BLOCK"
            elif v in ("and", "or", "in", "not"):
                k = _CLASS[v]
            elif v in ("true", "false", "nil"):
                k = "LIT"
            else:
                k = "ID"
            if raw and raw[-1][0] == "." and not nl:
                k = "ID"
            if k == "IN" and raw and raw[-1][0] == "UN" and raw[-1][1] == "not":
                raw.pop()
            put(k, v, start, pos)
        elif k == "op":
            if v in ("(", "[", "{", "<<"):
                stack.append(v)
                put(v, v, start, pos)
            elif v in (")", "]", "}", ">>"):
                if not stack:
                    if v == "}" and inner:
                        toks.extend(_shape(raw))
                        return pos, line
                    raise SyntaxFault(f"unexpected token: {v}", line)
                want = {"(": ")", "[": "]", "{": "}", "<<": ">>"}[stack.pop()]
                if v != want:
                    raise SyntaxFault(f"unexpected token: {v}", line)
                put(v, v, start, pos)
            elif v == ";":
                put("sep", v, start, pos)
            elif raw and raw[-1][0] == "." and not nl and v != "(" and v != "{" and v not in ".,":
                put("ID", v, start, pos)
            elif v == "...":
                put("LIT", v, start, pos)
            else:
                put(_CLASS.get(v, v), v, start, pos)
        elif k == "alias":
            put("ALIAS", v, start, pos)
        elif k == "kw":
            put("KW", v, start, pos)
        elif k == "atom":
            put("ATOM", v, start, pos)
        elif k == "num":
            if pos < n and (src[pos].isalnum() or src[pos] == "_"):
                raise SyntaxFault(f"invalid number {v + src[pos]}", line)
            put("INT" if v.isdigit() or v[:2] in ("0x", "0b", "0o") or "." not in v else "FLOAT", v, start, pos)
        elif k == "char":
            put("CHAR", v, start, pos)
        elif k == "cap":
            put("INT_CAP", v, start, pos)
        elif k == "heredoc":
            put("STR" if v[0] == '"' else "CHARS", None, start, pos)
            at = line
            pos, line, text = _heredoc(src, pos, line + 1, v[:3], False, out)
            raw[-1][1], raw[-1][4] = text, pos
            out.texts.append((start, text, at, "heredoc"))
        elif k == "quote" or k == "qatom":
            at = line
            begin_space, begin_nl = space, nl
            pos, line, text = _string(src, pos, line, v[-1], False, out)
            space, nl = begin_space, begin_nl
            if k == "qatom":
                put("ATOM", text, start, pos)
            elif src.startswith(":", pos) and not src.startswith("::", pos) and pos + 1 < n and src[pos + 1] in " \t\r\n":
                pos += 1
                put("KW", text + ":", start, pos)
            elif raw and raw[-1][0] == ".":
                put("QID", text, start, pos)
            else:
                put("STR" if v == '"' else "CHARS", text, start, pos)
            raw[-1][2] = at
            out.texts.append((start, text, at, "string"))
        elif k == "sigil":
            upper, at = v[1].isupper(), line
            begin_space, begin_nl = space, nl
            if src.startswith(('"""', "'''"), pos):
                q = src[pos:pos + 3]
                e = src.find("\n", pos)
                if e < 0 or src[pos + 3:e].strip():
                    raise SyntaxFault("heredoc must start on a new line", line)
                pos, line, text = _heredoc(src, e + 1, line + 1, q, upper, out)
            else:
                c = src[pos]
                pos, line, text = _string(src, pos + 1, line, _CLOSE.get(c, c), upper, out)
            mod = re.compile(r"[A-Za-z]*").match(src, pos)
            pos = mod.end()
            space, nl = begin_space, begin_nl
            put("SIGIL", text, start, pos)
            raw[-1][2] = at
            out.texts.append((start, text, at, "sigil_" + v[1:]))
    if inner:
        raise SyntaxFault("missing terminator: }", line)
    if stack:
        raise SyntaxFault(f"missing terminator: { {'(': ')', '[': ']', '{': '}', '<<': '>>'}[stack[-1]] }", line)
    toks.extend(_shape(raw))
    return pos, line


def _shape(raw: list[list]) -> list[list]:
    """Final terminals: separators, calls and owners of do blocks."""
    out: list[list] = []
    n = len(raw)
    # separators from line ends
    seq: list[list] = []
    for t in raw:
        if t[6] and seq and seq[-1][0] not in _OPEN_END and t[0] not in _CONT and not (t[0] == "sep") and not (seq[-1][0] == ".." and False):
            seq.append(["sep", "\n", t[2], t[3], t[3], False, False])
        if t[0] == "sep" and seq and seq[-1][0] == "sep":
            continue
        if t[0] in ("end", "BLOCK", ")", "]", "}", ">>") and seq and seq[-1][0] == "sep" and seq[-1][1] == "\n":
            seq.pop()
        seq.append(t)
    n = len(seq)
    calls: list[list] = [[]]  # by open bracket: calls without parentheses that are still open
    opener: list = [None]  # token before the bracket, for calls with parentheses
    last_close: list | None = None
    for i, t in enumerate(seq):
        k = t[0]
        prev = seq[i - 1] if i else None
        nxt = seq[i + 1] if i + 1 < n else None
        glued = prev is not None and not t[5] and prev[4] == t[3]
        if k in ("ID", "QID") and nxt is not None:
            if nxt[0] == "(" and not nxt[5] and nxt[3] == t[4]:
                t[0] = "PID" if k == "ID" else "QPID"
            elif nxt[5] and not nxt[6] and t[1] is not None:
                nk = nxt[0]
                after = seq[i + 2] if i + 2 < n else None
                tight = after is not None and not after[5]
                starts = nk in _START or nk in ("+", "-", "&", "UN", "%") and tight and nk in ("+", "-") and after[3] == nxt[4]
                if nk == ".." or nk == "UN" and nxt[1] == "^" and not tight:
                    starts = False
                if starts and not (nk == "[" and False):
                    t[0] = "NP"
                    calls[-1].append(t)
            elif not nxt[5] and nxt[0] in ("STR", "CHARS", "ATOM", "SIGIL") and not nxt[6] and nxt[0] != "ATOM":
                t[0] = "NP"
                calls[-1].append(t)
        elif k == "(":
            if glued and prev[0] in ("PID", "QPID"):
                opener.append(prev)
            elif glued and prev[0] == ".":
                prev[0] = ".drop"
                t[0] = ".("
                opener.append(None)
            elif glued and prev[0] == ")" and last_close is not None:
                t[0] = "call("
                opener.append(last_close)
            else:
                opener.append(None)
            calls.append([])
        elif k in ("[", "{", "<<"):
            if k == "[" and glued and prev[0] in ("ID", "PID", ")", "]", "}", "ALIAS", "STR", "SIGIL", "INT_CAP", "LIT", "end"):
                t[0] = "acc["
            opener.append(None)
            calls.append([])
        elif k in (")", "]", "}", ">>"):
            if len(calls) == 1:
                raise SyntaxFault(f"unexpected token: {t[1]}", t[2])
            if opener[-1] == "do":
                raise SyntaxFault("missing terminator: end", t[2])
            calls.pop()
            last_close = opener.pop()
        elif k == "fn":
            calls.append([])
            opener.append("do")
        elif k == "do":
            own = calls[-1]
            if own:
                own[0][0] = "NP_DO"
                calls[-1] = []
            elif prev is not None and prev[0] in ("ID", "QID"):
                prev[0] = "ID_DO" if i < 2 or seq[i - 2][0] != "." else "ID_DOT_DO"
            elif prev is not None and prev[0] == ")" and isinstance(last_close, list):
                last_close[0] = "P_DO"
            else:
                raise SyntaxFault("unexpected token: do", t[2])
            calls.append([])
            opener.append("do")
        elif k == "end":
            if len(calls) == 1 or opener[-1] != "do":
                raise SyntaxFault("unexpected reserved word: end", t[2])
            calls.pop()
            opener.pop()
            last_close = None
        elif k in ("sep", "->", "BLOCK"):
            calls[-1] = []
    if "do" in opener:
        raise SyntaxFault("missing terminator: end", seq[-1][2] if seq else 1)
    # a dotted call gives its kind to the whole remote call: the name token keeps it, the grammar joins them
    i = 0
    while i < n:
        t = seq[i]
        if t[0] == ".drop":
            i += 1
            continue
        out.append(t)
        i += 1
    # calls through a dot without parentheses, or with a do block: fold "primary ." into one terminal
    return _fold(out)


def _fold(seq: list[list]) -> list[list]:
    """``a.b c`` and ``a.b(c) do``: the callee path becomes part of the call's terminal when it is a plain path."""
    out: list[list] = []
    for t in seq:
        if t[0] in ("NP", "NP_DO", "ID_DOT_DO", "P_DO") and out and out[-1][0] == ".":
            j = len(out)
            while j >= 2 and out[j - 1][0] == "." and out[j - 2][0] in ("ALIAS", "ID", "ATOM", "LIT"):
                j -= 2
            if j < len(out) and (j == 0 or out[j - 1][0] != "."):
                path = "".join(str(x[1]) for x in out[j:])
                first = out[j]
                del out[j:]
                t = [{"ID_DOT_DO": "ID_DO"}.get(t[0], t[0]), path + str(t[1]), first[2], first[3], t[4], first[5], first[6]]
            else:  # a computed callee: the arguments follow as an ordinary call
                t = [t[0], t[1], t[2], t[3], t[4], t[5], t[6]]
                base = out.pop()
                k = _back(out)
                del out[k:]
                t[0] = {"ID_DOT_DO": "ID_DO"}.get(t[0], t[0])
                t[3] = base[3]
        out.append(t)
    return out


def _back(out: list[list]) -> int:
    """Start of the operand that ends ``out``."""
    depth, i = 0, len(out)
    while i > 0:
        k = out[i - 1][0]
        if k in (")", "]", "}", "end", ">>"):
            depth += 1
        elif k in ("(", "[", "{", "acc[", "call(", ".(", "do", "fn", "<<"):
            depth -= 1
        i -= 1
        if depth <= 0 and not (i > 0 and (out[i - 1][0] in (".", "PID", "QPID", "%") or out[i][0] in ("acc[", "call(", ".(", ".", "do") or out[i][0] == "(" and out[i - 1][0] == "PID")):
            return i
    return 0


def _check(node) -> None:
    """Arrows: a fn holds only clauses, a block either clauses or expressions."""
    todo = [node]
    while todo:
        x = todo.pop()
        if type(x) is list:
            todo.extend(x)
        elif type(x) is tuple:
            label, kids = x[0], x[1]
            if label in ("fn", "do", "paren"):
                for part in kids:
                    if type(part) is list and part and type(part[0]) in (tuple, str, list) and label != "call":
                        arrows = [type(y) is tuple and y[0] in ("stab", "stab0") for y in part]
                        if any(arrows) and not arrows[0] or label == "fn" and not arrows[0]:
                            raise SyntaxFault("unexpected operator ->", 0)
            todo.extend(kids)


def read(tables: Tables, src: str, lexed: Lexed | None = None):
    lexed = lexed or lex(src)
    for toks in [*lexed.inner, lexed.tokens]:
        m = Machine(tables)
        line = 1
        for t in toks:
            line = t[2]
            m.feed(t[0], t[1] if t[1] is not None else "", line)
        tree = m.end(line)
        _check(tree)
    return tree

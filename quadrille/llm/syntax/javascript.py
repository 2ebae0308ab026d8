"""JavaScript (ECMAScript 2024 modules): lexer driven by the parser's state, and grammar.

Whether ``/`` begins a regular expression, ``{`` a block or ``function`` a declaration is decided by what the parser's state accepts; line ends
insert semicolons only where the next token is not accepted.
"""

from __future__ import annotations

import re

from ...syntax.lalr import END, Machine, SyntaxFault, Tables

GRAMMAR = r"""
%nonassoc LOW
%nonassoc 'else'
%left ','
%right '=' ASSIGN '=>' 'yield'
%right '?'
%left '??'
%left '||'
%left '&&'
%left '|'
%left '^'
%left '&'
%left EQ
%left REL 'in' 'instanceof'
%left SHIFT
%left '+' '-'
%left '*' '/x' '%'
%right UNARY
%right '**'
%nonassoc '++' '--' 'post'

program : {[]} | program stmt {+} ;
semi : ';' | ASI ;
stmt : 'block{' '}' {block} | 'block{' stmts '}' {block} | ';' {empty} | expr semi {expr} | var_kw decls semi {var} | 'if' '(' expr ')' stmt %prec LOW {if} | 'if' '(' expr ')' stmt 'else' stmt {if}
  | 'do' stmt 'while' '(' expr ')' semi | 'do' stmt 'while' '(' expr ')' %prec LOW | 'while' '(' expr ')' stmt | for_s | 'continue' semi | 'continue' ident semi | 'break' semi | 'break' ident semi
  | 'return' semi | 'return' expr semi | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' 'body{' cases '}' | LABEL ':' stmt | 'throw' expr semi | try_s | 'debugger' semi | fdecl | cdecl | import_s | export_s ;
stmts : stmt {[]} | stmts stmt {+} ;
var_kw : 'var' | 'let' | 'const' ;
decls : decl {[]} | decls ',' decl {+} ;
decl : bind {decl} | bind '=' A {decl} ;
bind : ident | pattern ;
pattern : '[' ']' | '[' belems ']' | 'obj{' '}' | 'obj{' bprops '}' | 'obj{' bprops ',' '}' ;
belems : belem | ',' | belems ',' belem | belems ',' | ',' belem ;
belem : bind | bind '=' A | '...' bind ;
bprops : bprop | bprops ',' bprop ;
bprop : ident | ident '=' A | pname ':' bind | pname ':' bind '=' A | '...' bind ;
for_s : 'for' '(' for_init ';' opt_expr ';' opt_expr ')' stmt | 'for' '(' var_kw bind 'for_in' expr ')' stmt | 'for' '(' var_kw bind 'of' A ')' stmt | 'for' '(' L 'for_in' expr ')' stmt | 'for' '(' L 'of' A ')' stmt | 'for' 'await' '(' var_kw bind 'of' A ')' stmt | 'for' 'await' '(' L 'of' A ')' stmt ;
for_init : | var_kw decls | expr ;
opt_expr : | expr ;
cases : {[]} | cases case_c ;
case_c : 'case' expr ':' | 'case' expr ':' stmts | 'default' ':' | 'default' ':' stmts ;
try_s : 'try' blk 'catch' blk | 'try' blk 'catch' '(' bind ')' blk | 'try' blk 'finally' blk | 'try' blk 'catch' blk 'finally' blk | 'try' blk 'catch' '(' bind ')' blk 'finally' blk ;
blk : 'body{' '}' | 'body{' stmts '}' ;
fdecl : 'function' ident fparams fbody {fun} | 'function' '*' ident fparams fbody {gen} | 'async' 'function' ident fparams fbody {afun} | 'async' 'function' '*' ident fparams fbody {agen} ;
fexpr : 'function_x' fparams fbody {fun0} | 'function_x' ident fparams fbody {fun} | 'function_x' '*' fparams fbody {gen0} | 'function_x' '*' ident fparams fbody {gen} | 'async_x' 'function' fparams fbody {afun0} | 'async_x' 'function' ident fparams fbody {afun} | 'async_x' 'function' '*' fparams fbody {agen0} | 'async_x' 'function' '*' ident fparams fbody {agen} ;
fparams : '(' ')' {params} | '(' plist ')' {params} | '(' plist ',' ')' {params} ;
plist : param {[]} | plist ',' param {+} ;
param : bind | bind '=' A {pdef} | '...' bind {rest} ;
fbody : 'body{' '}' {body} | 'body{' stmts '}' {body} ;
cdecl : 'class' ident cbody {class} | 'class' ident 'extends' L cbody {class} ;
cexpr : 'class_x' cbody {class0} | 'class_x' ident cbody {class} | 'class_x' 'extends' L cbody {class0} | 'class_x' ident 'extends' L cbody {class} ;
cbody : 'body{' '}' {members} | 'body{' members '}' {members} ;
members : member {[]} | members member {+} ;
member : ';' | mdef | 'static' mdef {$1} | field semi {$0} | 'static' field semi {$1} | 'static' blk ;
field : pname {field} | pname '=' A {field} ;
mdef : pname fparams fbody {method} | 'get' pname fparams fbody {getter} | 'set' pname fparams fbody {setter} | '*' pname fparams fbody {mgen} | 'async' pname fparams fbody {amethod} | 'async' '*' pname fparams fbody {amgen} ;
pname : IDENT | KWNAME | STR | NUM | PRIVATE | '[' A ']' ;
import_s : 'import' STR semi | 'import' iclause 'from' STR semi | 'import' iclause 'from' STR 'with' 'body{' attrs '}' semi ;
attrs : | attr | attrs ',' attr ;
attr : pname ':' STR ;
iclause : ident | ident ',' ispec | ispec ;
ispec : '*' 'as' ident | 'body{' '}' | 'body{' inames '}' | 'body{' inames ',' '}' ;
inames : iname | inames ',' iname ;
iname : pname | pname 'as' pname ;
export_s : 'export' '*' 'from' STR semi | 'export' '*' 'as' pname 'from' STR semi | 'export' 'block{' '}' semi | 'export' 'block{' inames '}' semi | 'export' 'block{' inames ',' '}' semi | 'export' 'block{' inames '}' 'from' STR semi | 'export' 'block{' inames ',' '}' 'from' STR semi | 'export' 'block{' '}' 'from' STR semi
  | 'export' var_kw decls semi {export} | 'export' fdecl {export} | 'export' cdecl {export} | 'export' 'default' A semi {export} | 'export' 'default' fdecl {export} | 'export' 'default' cdecl {export} | 'export' 'default' 'function' fparams fbody {export} | 'export' 'default' 'class' cbody {export} | 'export' 'default' 'class' 'extends' L cbody {export} ;
ident : IDENT ;
expr : A {$0} | expr ',' A {seq} ;
A : C {$0} | arrow | L '=' A {assign} | L ASSIGN A {assign} | 'yield' | 'yield' A | 'yield' '*' A ;
arrow : IDENT '=>' abody {arrow1} | 'cover(' ')' '=>' abody {arrow} | 'cover(' plist ')' '=>' abody {arrow} | 'cover(' plist ',' ')' '=>' abody {arrow} | 'async_x' IDENT '=>' abody {arrow1} | 'async_x' 'cover(' ')' '=>' abody {arrow} | 'async_x' 'cover(' plist ')' '=>' abody {arrow} | 'async_x' 'cover(' plist ',' ')' '=>' abody {arrow} ;
abody : fbody | A ;
C : B {$0} | B '?' A ':' A {cond} ;
B : B '??' B {op} | B '||' B {op} | B '&&' B {op} | B '|' B {op} | B '^' B {op} | B '&' B {op} | B EQ B {op} | B REL B {op} | B 'in' B {op} | PRIVATE 'in' B {op} | B 'instanceof' B {op} | B SHIFT B {op} | B '+' B {op} | B '-' B {op} | B '*' B {op} | B '/x' B {op} | B '%' B {op} | B '**' B {op}
  | UN B %prec UNARY {op} | '+' B %prec UNARY {op} | '-' B %prec UNARY {op} | 'await' B %prec UNARY {op} | '++' L %prec UNARY {op} | '--' L %prec UNARY {op} | L 'post' {op} | L ;
L : 'new' L_new {new} | call | mem ;
L_new : mem_new %prec LOW | 'new' L_new | mem_new cargs ;
mem_new : prim | mem_new '.' pname | mem_new '.' '[' expr ']' | mem_new 'idx[' expr ']' | mem_new tpl ;
mem : prim | mem '.' pname {dot} | mem '?.' pname {dot} | mem '?.' 'idx[' expr ']' | mem '?.' cargs {call} | mem 'idx[' expr ']' {index} | mem tpl | 'new' L_new '.' pname | 'new' L_new 'idx[' expr ']' ;
call : mem cargs {call} | call cargs {call} | call '.' pname {dot} | call '?.' pname {dot} | call '?.' 'idx[' expr ']' | call '?.' cargs {call} | call 'idx[' expr ']' {index} | call tpl | 'super' cargs | 'importx' cargs | 'new' L_new '.' pname cargs | 'new' L_new 'idx[' expr ']' cargs ;
cargs : 'args(' ')' {args} | 'args(' alist ')' {args} | 'args(' alist ',' ')' {args} ;
alist : A {[]} | '...' A {[]} | alist ',' A {+} | alist ',' '...' A {+} ;
prim : IDENT | 'this' | 'null' | 'true' | 'false' | NUM | STR | REGEX | 'super' '.' pname | 'super' 'idx[' expr ']' | 'new.target' | 'importx' '.' pname | tpl | array | object | fexpr | cexpr | '(' expr ')' {paren} ;
tpl : TPL {tpl} | TPL_HEAD expr tpl_rest {tpl} ;
tpl_rest : TPL_TAIL | TPL_MID expr tpl_rest ;
array : '[' ']' | '[' elems ']' ;
elems : elem | ',' | elems ',' elem | elems ',' | ',' elem ;
elem : A | '...' A ;
object : 'obj{' '}' | 'obj{' props '}' | 'obj{' props ',' '}' ;
props : prop | props ',' prop ;
prop : IDENT %prec LOW | IDENT '=' A | pname ':' A | mdef | '...' A ;
"""

#: The reserved words of the language.
KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield await".split())
_TOK = re.compile(
    r"""(?P<ws>[ \t\r\f\v\u00a0\ufeff]+)|(?P<nl>[\n\u2028\u2029])|(?P<com>//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\(?:\r\n|.))*"|'(?:[^'\\\n]|\\(?:\r\n|.))*')|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<id>(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)|(?P<priv>\#[^\W\d]\w*)|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*%=<>!~&|^?:;,.(){}\[\]`/])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_ASSIGN = frozenset("*= %= += -= <<= >>= >>>= &= |= ^= **= &&= ||= ??= /=".split())
_TPL = re.compile(r"\\|`|\$\{")


class Lexed:
    __slots__ = ("tokens", "comments", "strings")

    def __init__(self):
        self.tokens, self.comments, self.strings = [], [], []


_BRACKET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[()\[\]{}]", re.S)
_ARROW = re.compile(r"\s*(?:/\*.*?\*/\s*)*=>", re.S)


def _arrow_after(src: str, pos: int, known: dict[int, bool]) -> bool:
    """Whether the bracket that opens at pos closes before ``=>``; brackets within are answered by the same scan."""
    if pos in known:
        return known[pos]
    open_at: list[int] = []
    for m in _BRACKET.finditer(src, pos):
        t = m.group()
        if t in "([{" and len(t) == 1:
            open_at.append(m.start())
        elif t in ")]}" and len(t) == 1:
            known[open_at.pop()] = bool(_ARROW.match(src, m.end()))
            if not open_at:
                break
    known.update(dict.fromkeys(open_at, False))
    return known.get(pos, False)


def read(tables: Tables, src: str, lexed: Lexed | None = None):
    out = lexed if lexed is not None else Lexed()
    m = Machine(tables)
    accepts = m.accepts
    pos, line, n = 0, 1, len(src)
    if src.startswith("#!"):
        pos = src.find("\n") if "\n" in src else n
    braces: list[bool] = []  # True: a template's ${
    arrows: dict[int, bool] = {}
    nl = False
    prev = None
    match = _TOK.match

    def asi(at):
        m.feed("ASI", ";", line)
        out.tokens.append(("ASI", "", line, at, at))

    def feed(kind, text, start, end):
        nonlocal nl, prev
        if nl and prev in ("return", "break", "continue", "yield") and accepts("ASI") and not (kind == ";"):
            asi(start)
        if not accepts(kind) and accepts("ASI") and (nl or kind in ("}", END)):
            asi(start)
            kind = pick(text, kind, end)
        m.feed(kind, text, line)
        out.tokens.append((kind, text, line, start, end))
        nl, prev = False, kind

    def first(*kinds):
        for k in kinds:
            if accepts(k):
                return k
        if nl and accepts("ASI"):
            return kinds[-1]
        return kinds[-1]

    def pick(text, kind, end):
        """Terminal of a text in the present state."""
        if text == "{":
            return first("block{", "body{", "obj{")
        if text == "(":
            if _arrow_after(src, end - 1, arrows) and accepts("cover("):
                return "cover("
            return first("args(", "(")
        if text == "[":
            return first("idx[", "[")
        if text == "function":
            return first("function", "function_x")
        if text == "class":
            return first("class", "class_x")
        if text in ("++", "--"):
            return "post" if not nl and accepts("post") else text
        if text == "import":
            return first("importx" if re.compile(r"\s*[.(]").match(src, end) else "import", "importx")
        if text == "in":
            return first("for_in", "in")
        if text == "async" and kind == "async_x":
            return first("async", "async_x")
        if kind in ("LABEL",):
            return kind if accepts("LABEL") else "IDENT"
        return kind

    while True:
        if pos >= n:
            break
        c = src[pos]
        if c == "/" and not src.startswith(("//", "/*"), pos):
            if accepts("/x") or (prev in ("IDENT", ")", "]", "NUM", "STR") and accepts("ASSIGN")):
                if src.startswith("/=", pos):
                    feed("ASSIGN", "/=", pos, pos + 2)
                    pos += 2
                else:
                    feed("/x", "/", pos, pos + 1)
                    pos += 1
                continue
            r = _REGEX.match(src, pos)
            if not r:
                raise SyntaxFault("invalid regular expression", line)
            feed("REGEX", r.group(), pos, r.end())
            pos = r.end()
            continue
        g = match(src, pos)
        if not g:
            raise SyntaxFault(f"unexpected character {c!r}", line)
        k, v, start = g.lastgroup, g.group(), pos
        pos = g.end()
        if k == "ws":
            continue
        if k == "nl":
            line += 1
            nl = True
            continue
        if k == "com":
            if v.startswith("/*"):
                nl |= "\n" in v
            out.comments.append((start, v, line))
            line += v.count("\n")
            continue
        if k == "str":
            out.strings.append((start, v[1:-1], line))
            feed("STR", v, start, pos)
            line += v.count("\n")
        elif k == "num":
            if pos < n and (src[pos].isalnum() or src[pos] in "_$"):
                raise SyntaxFault("invalid number", line)
            feed("NUM", v, start, pos)
        elif k == "priv":
            feed("PRIVATE", v, start, pos)
        elif k == "id":
            if prev in (".", "?.") or v in KEYWORDS and re.compile(r"\s*:(?!:)").match(src, pos) and v not in ("default", "case") and not accepts("?") and accepts("KWNAME"):
                feed("IDENT" if v not in KEYWORDS else "KWNAME", v, start, pos)
            elif v in KEYWORDS:
                if v in ("typeof", "void", "delete"):
                    kind = "UN"
                elif v == "new" and re.compile(r"\s*\.\s*target\b").match(src, pos):
                    pos = re.compile(r"\s*\.\s*target").match(src, pos).end()
                    v = kind = "new.target"
                else:
                    kind = pick(v, v, pos)
                if v == "await" and not accepts("await"):
                    kind = "IDENT"
                if not accepts(kind) and accepts("KWNAME") and not nl:
                    kind = "KWNAME"
                feed(kind, v, start, pos)
            else:
                kind = "IDENT"
                if v in ("get", "set", "static") and accepts(v) and re.compile(r"[ \t]+(?:[\w$\"'\[#*]|\{)" if v == "static" else r"[ \t]+[\w$\"'\[#]").match(src, pos):
                    kind = v
                elif v == "async":
                    a = re.compile(r"[ \t]+(?:function\b|[\w$]+\s*=>|(?=\())|(?=\()").match(src, pos)
                    if a and (src[a.end() - 1:a.end()] != "(" and "function" in a.group() or "=>" in a.group() or src[a.end():a.end() + 1] == "(" and _arrow_after(src, a.end(), arrows)):
                        kind = pick("async", "async_x", pos) if "function" in a.group() else "async_x"
                    elif accepts("async") and re.compile(r"[ \t]+[\w$\"'\[#*]|\s*\*").match(src, pos) and not accepts("async_x"):
                        kind = "async"
                elif v in ("of", "from", "as") and accepts(v):
                    kind = v
                if kind == "IDENT" and (accepts("LABEL") or nl) and re.compile(r"\s*:(?!:)").match(src, pos) and accepts("LABEL"):
                    kind = "LABEL"
                elif kind == "IDENT" and not accepts("IDENT") and nl and accepts("ASI"):
                    asi(start)
                    if accepts("LABEL") and re.compile(r"\s*:(?!:)").match(src, pos):
                        kind = "LABEL"
                feed(kind, v, start, pos)
        elif v == "`" or v == "}" and braces and braces[-1]:
            if v == "}":
                braces.pop()
            at = line
            while True:
                t = _TPL.search(src, pos)
                if not t:
                    raise SyntaxFault("missing terminator: `", at)
                pos = t.end()
                if t.group() == "\\":
                    pos += 1
                    continue
                break
            text = src[start + 1:t.start()]
            out.strings.append((start, text, at))
            head = v == "`"
            if t.group() == "`":
                feed("TPL" if head else "TPL_TAIL", src[start:pos], start, pos)
            else:
                feed("TPL_HEAD" if head else "TPL_MID", src[start:pos], start, pos)
                braces.append(True)
            line += text.count("\n")
        else:
            if v in _ASSIGN:
                kind = "ASSIGN"
            elif v in ("==", "!=", "===", "!=="):
                kind = "EQ"
            elif v in ("<", ">", "<=", ">="):
                kind = "REL"
            elif v in ("<<", ">>", ">>>"):
                kind = "SHIFT"
            elif v in ("!", "~"):
                kind = "UN"
            else:
                kind = pick(v, v, pos)
            if v == "{":
                braces.append(False)
            elif v == "}" and braces:
                braces.pop()
            feed(kind, v, start, pos)
    if not accepts(END) and accepts("ASI"):
        asi(pos)
    return m.end(line)

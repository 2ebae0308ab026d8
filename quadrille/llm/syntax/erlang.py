"""Erlang: lexer and grammar of forms, expressions, types and macros."""

from __future__ import annotations

import re

from ...syntax.lalr import SyntaxFault, Tables, parse

#: The reserved words of the language.
RESERVED = frozenset("after and andalso band begin bnot bor bsl bsr bxor case catch cond div else end fun if let maybe not of or orelse receive rem try when xor".split()) - {"cond", "let", "maybe", "else"}

GRAMMAR = r"""
%nonassoc 'catch'
%right '=' '!' '?='
%right 'orelse'
%right 'andalso'
%nonassoc CMP
%right '++' '--'
%left '+' '-' ADD
%left '*' '/' MUL
%left UNARY
%nonassoc '#'
%nonassoc ':'

forms : {[]} | forms form {+} ;
form : attribute '.' {$0} | function '.' {$0} | MACRO '(' args ')' '.' | MACRO '.' ;
attribute : '-' name {attr} | '-' name attr_body {attr} | '-' name '(' attr_body ')' {attr} | '-' name '(' ')' {attr}
  | '-' SPEC sigs {spec} | '-' SPEC '(' sigs ')' {spec} | '-' TYPE typedef {typedef} | '-' TYPE '(' typedef ')' {typedef} | '-' RECORD '(' name ',' '{' '}' ')' {record} | '-' RECORD '(' name ',' '{' rec_fields '}' ')' {record}
  | '-' DEFINE '(' define_head ',' exprs ')' {define} | '-' DEFINE '(' define_head ',' ')' {define} | '-' DEFINE '(' define_head ',' exprs ';' exprs ')' {define} | '-' DEFINE '(' define_head ',' exprs 'when' exprs ')' {define} ;
attr_body : expr | attr_body ',' expr ;
define_head : name | VAR | name '(' ')' | VAR '(' ')' | name '(' args ')' | VAR '(' args ')' ;
name : ATOM | 'if' | 'else_word' ;
function : clause {[]} | function ';' clause {+} ;
clause : fname '(' ')' guard '->' exprs {fclause0} | fname '(' args ')' guard '->' exprs {fclause} ;
fname : ATOM | MACRO ;
guard : | 'when' guards ;
guards : exprs | guards ';' exprs ;
exprs : expr {[]} | exprs ',' expr {+} ;
args : expr {[]} | args ',' expr {+} ;
expr : 'catch' expr | expr '=' expr | expr '?=' expr | expr '!' expr | expr 'orelse' expr | expr 'andalso' expr | expr CMP expr
  | expr '++' expr | expr '--' expr | expr '+' expr | expr '-' expr | expr ADD expr | expr '*' expr | expr '/' expr | expr MUL expr
  | '+' expr %prec UNARY | '-' expr %prec UNARY | NOT expr %prec UNARY
  | map_expr | call | remote | primary ;
remote : primary ':' primary ;
call : primary '(' ')' | primary '(' args ')' | remote '(' ')' | remote '(' args ')' | record_expr '(' ')' ;
map_expr : '#' '{' '}' | '#' '{' map_fields '}' | primary '#' '{' '}' | primary '#' '{' map_fields '}' | map_expr '#' '{' map_fields '}' | call '#' '{' map_fields '}' | record_expr ;
record_expr : '#' rname '.' ATOM | '#' rname '{' '}' | '#' rname '{' rec_fields '}' | primary '#' rname '.' ATOM | primary '#' rname '{' '}' | primary '#' rname '{' rec_fields '}' | record_expr '#' rname '.' ATOM | record_expr '#' rname '{' rec_fields '}' | call '#' rname '.' ATOM | call '#' rname '{' rec_fields '}' ;
rname : ATOM | MACRO ;
map_fields : map_field {[]} | map_fields ',' map_field {+} ;
map_field : expr '=>' expr | expr ':=' expr ;
rec_fields : rec_field {[]} | rec_fields ',' rec_field {+} ;
rec_field : fieldname | fieldname '=' expr | fieldname '=' expr '::' type | fieldname '::' type ;
fieldname : ATOM | VAR ;
primary : VAR | ATOM | INT | FLOAT | CHAR | MACRO | '?' '?' VAR | strings | list | binary | tuple | '(' expr ')' | 'begin' exprs 'end' | if_e | case_e | recv | fun_e | try_e | maybe_e ;
strings : STR {[]} | strings STR {+} ;
list : '[' ']' | '[' args ']' | '[' args '|' expr ']' | '[' expr '||' quals ']' ;
quals : qual | quals ',' qual | quals '&&' qual ;
qual : expr | expr '<-' expr | expr '<=' expr | expr '<:-' expr | expr '<:=' expr | map_field '<-' expr ;
tuple : '{' '}' | '{' args '}' ;
binary : '<<' '>>' | '<<' bin_elems '>>' | '<<' bin_value '||' quals '>>' ;
bin_elems : bin_elem | bin_elems ',' bin_elem ;
bin_elem : bin_value | bin_value ':' bin_size | bin_value '/' bin_types | bin_value ':' bin_size '/' bin_types ;
bin_value : primary | '-' primary | '+' primary | NOT primary ;
bin_size : INT | VAR | CHAR | MACRO | '(' expr ')' ;
bin_types : bin_type | bin_types '-' bin_type ;
bin_type : ATOM | ATOM ':' INT ;
if_e : 'if' if_clauses 'end' ;
if_clauses : if_clause | if_clauses ';' if_clause ;
if_clause : guards '->' exprs ;
case_e : 'case' expr 'of' clauses 'end' ;
clauses : cr_clause | clauses ';' cr_clause ;
cr_clause : expr guard '->' exprs ;
recv : 'receive' clauses 'end' | 'receive' 'after' expr '->' exprs 'end' | 'receive' clauses 'after' expr '->' exprs 'end' ;
fun_e : 'fun' ATOM '/' INT | 'fun' mod ':' mod '/' arity_of | 'fun' MACRO '/' INT | 'fun' fun_clauses 'end' ;
mod : ATOM | VAR | MACRO ;
arity_of : INT | VAR | MACRO ;
fun_clauses : fun_clause | fun_clauses ';' fun_clause ;
fun_clause : '(' ')' guard '->' exprs | '(' args ')' guard '->' exprs | VAR '(' ')' guard '->' exprs | VAR '(' args ')' guard '->' exprs ;
try_e : 'try' exprs try_of try_tail ;
try_of : | 'of' clauses ;
try_tail : 'catch' try_clauses 'end' | 'catch' try_clauses 'after' exprs 'end' | 'after' exprs 'end' ;
try_clauses : try_clause | try_clauses ';' try_clause ;
try_clause : expr guard '->' exprs | primary ':' primary ':' VAR guard '->' exprs ;
maybe_e : 'maybe' exprs 'end' | 'maybe' exprs 'else_word' clauses 'end' ;
sigs : spec_name sig {sig} | sigs ';' sig ;
spec_name : ATOM | ATOM ':' ATOM | MACRO ':' ATOM ;
sig : '(' ')' '->' type | '(' types ')' '->' type | '(' ')' '->' type 'when' constraints | '(' types ')' '->' type 'when' constraints ;
constraints : constraint | constraints ',' constraint ;
constraint : VAR '::' type | ATOM '(' types ')' ;
typedef : ATOM '(' ')' '::' type | ATOM '(' types ')' '::' type ;
types : type | types ',' type ;
type : VAR '::' type | union ;
union : tterm | union '|' tterm ;
tterm : trange | trange '..' trange ;
trange : tadd ;
tadd : tmul | tadd '+' tmul | tadd '-' tmul | tadd ADD tmul ;
tmul : tunary | tmul '*' tunary | tmul MUL tunary ;
tunary : tprim | '-' tprim | '+' tprim | NOT tprim ;
tprim : VAR | ATOM | INT | CHAR | MACRO | MACRO '(' ')' | MACRO '(' types ')' | ATOM '(' ')' | ATOM '(' types ')' | ATOM ':' ATOM '(' ')' | ATOM ':' ATOM '(' types ')' | MACRO ':' ATOM '(' ')' | MACRO ':' ATOM '(' types ')'
  | '(' type ')' | '[' ']' | '[' type ']' | '[' type ',' '...' ']' | '{' '}' | '{' types '}' | '#' '{' '}' | '#' '{' tpairs '}' | '#' ATOM '{' '}' | '#' ATOM '{' tfields '}'
  | '<<' '>>' | '<<' tbins '>>' | 'fun' '(' ')' | 'fun' '(' '(' '...' ')' '->' type ')' | 'fun' '(' '(' ')' '->' type ')' | 'fun' '(' '(' types ')' '->' type ')' ;
tpairs : tpair | tpairs ',' tpair ;
tpair : type '=>' type | type ':=' type ;
tfields : ATOM '::' type | tfields ',' ATOM '::' type ;
tbins : tbin | tbins ',' tbin ;
tbin : VAR ':' tunary | VAR ':' VAR '*' tunary ;
"""

_TOK = re.compile(
    r"""(?P<ws>[ \t\r\f ]+)|(?P<nl>\n)|(?P<com>%[^\n]*)|(?P<tq>\"\"\"[ \t]*\r?\n)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<qatom>'(?:[^'\\\n]|\\.)*')|(?P<sigil>~[a-zA-Z]*(?:"(?:[^"\\]|\\.)*"|\((?:[^)\\]|\\.)*\)|\[(?:[^\]\\]|\\.)*\]|\{(?:[^}\\]|\\.)*\}|<(?:[^>\\]|\\.)*>|/(?:[^/\\]|\\.)*/|\|(?:[^|\\]|\\.)*\|))"""
    r"""|(?P<char>\$(?:\\(?:x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|\^.|[0-7]{1,3}|.)|[^\n\\]))|(?P<float>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?)|(?P<int>\d{1,2}\#[0-9a-zA-Z_]+|\d[\d_]*)(?![A-Za-z_@])"""
    r"""|(?P<macro>\?[A-Za-z_][\w@]*)|(?P<var>[A-Z_À-ÖØ-Þ][\w@]*)|(?P<atom>[a-zß-öø-ÿ][\w@]*)|(?P<dot>\.(?=[\s%]|$))"""
    r"""|(?P<op><:-|<:=|=:=|=/=|\.\.\.|<<|>>|<-|<=|=>|:=|::|\?=|\|\||&&|\+\+|--|->|==|/=|=<|>=|\.\.|[-+*/=<>!?:;,.|\#(){}\[\]])""",
    re.X | re.S,
)
_CMP = frozenset(["==", "/=", "=<", "<", ">=", ">", "=:=", "=/="])
_ADD, _MUL = frozenset("bor bxor bsl bsr or xor".split()), frozenset("div rem band and".split())


def lex(src: str) -> tuple[list[tuple], list[tuple]]:
    """Tokens (terminal, text, line, start) and comments (start, text, line)."""
    out: list[tuple] = []
    comments: list[tuple] = []
    pos, line, n = 0, 1, len(src)
    if src.startswith("#!"):
        pos = src.find("\n") if "\n" in src else n
    match = _TOK.match
    while pos < n:
        m = match(src, pos)
        if not m:
            if src[pos] == '"':
                raise SyntaxFault('missing terminator: "', line)
            raise SyntaxFault(f"unexpected character {src[pos]!r}", line)
        k, v, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if k == "ws":
            continue
        if k == "nl":
            line += 1
            continue
        if k == "com":
            comments.append((start, v, line))
            continue
        if k == "tq":
            end = re.compile(r'\n[ \t]*"""').search(src, pos - 1)
            if not end:
                raise SyntaxFault('missing terminator: """', line)
            out.append(("STR", src[start:end.end()], line, start))
            line += src.count("\n", start, end.end())
            pos = end.end()
            continue
        if k == "atom":
            if v in _ADD:
                k = "ADD"
            elif v in _MUL:
                k = "MUL"
            elif v in ("not", "bnot"):
                k = "NOT"
            elif v in RESERVED:
                k = v
            elif v == "else" and out and out[-1][0] != "-":
                k = "else_word"
            else:
                k = "ATOM"
                if out and out[-1][0] == "-" and (len(out) == 1 or out[-2][0] == "."):
                    k = {"spec": "SPEC", "callback": "SPEC", "type": "TYPE", "opaque": "TYPE", "nominal": "TYPE", "record": "RECORD", "define": "DEFINE"}.get(v, "ATOM")
        elif k == "op":
            k = "CMP" if v in _CMP else v
        elif k == "dot":
            k = "."
        elif k in ("str", "sigil"):
            k = "STR"
            line += 0
        elif k == "qatom":
            k = "ATOM"
        elif k == "macro":
            k = "MACRO"
        else:
            k = {"char": "CHAR", "float": "FLOAT", "int": "INT", "var": "VAR"}[k]
        out.append((k, v, line, start))
        if k == "STR":
            line += v.count("\n")
    return out, comments


def check(tree, tokens) -> None:
    """Clauses of one function have one name and one number of arguments."""
    for form in tree:
        if type(form) is list and len(form) > 1 and all(type(c) is tuple and c[0].startswith("fclause") for c in form):
            heads = [(c[1][0], len(c[1][2]) if c[0] == "fclause" else 0) for c in form]
            for c, h in zip(form[1:], heads[1:]):
                if h != heads[0] and not (h[0].startswith("?") or heads[0][0].startswith("?")):
                    raise SyntaxFault("head mismatch", tokens[c[2]][2])


def read(tables: Tables, src: str):
    tokens = lex(src)[0]
    tree = parse(tables, tokens)
    check(tree, tokens)
    return tree

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm.syntax import fault_of, functions, language_of, lalr, normal, parse_source

GOOD = {
    "elixir": [
        "", "# only a comment\n", 'defmodule A do\n  @doc """\n  x #{1 + 1} "q"\n  """\n  def f(a, b \\\\ 1) when a > 0, do: %{a | b: c}\nend\n', "import Config\nconfig :a, b: 1, c: [d: 2]\n", "fn a, b when a -> b\n  _ -> 1 end",
        "x |> f(1)\n|> g\n", "if a do b else c end", "case x do\n  {:ok, v} -> v\n  _ -> nil\nend", "~r/[(]\"/", "?( ; ?\\n", "with {:ok, a} <- f(), do: a", "&(&1 + 1)", "f a, b: 1 do\n  c\nend", "x = a not in b", "<<h::8, r::binary>> = x",
        "a.b.c(1)[:d].e", "quote do: unquote(x)", "for {k, v} <- m, into: %{}, do: {v, k}", '"#{x}: #{y}"', "@spec f(a) :: b when a: c", "try do\n 1\nrescue\n  e in E -> 2\nafter\n  3\nend",
    ],
    "erlang": ["", "-module(a).\n-export([f/1]).\nf(X) when X > 1 -> {ok, $(, \"s\"};\nf(_) -> [Y || Y <- l(), Y =/= 1].\n", "f() -> case g() of {a, B} -> B; _ -> try h() of N -> N catch error:E:S -> {E, S} after ok end end.\n", "-spec f(term(), [atom()]) -> term().\n", "f() -> fun(X) -> X end, fun m:f/2, #r{a = 1}, #{k => v}, <<1:8/integer>>, ?M.\n", "-record(r, {a = 1 :: integer(), b}).\n"],
    "javascript": ["", "// c\n", "const f = (a, {b, c = 1}, ...r) => ({ x: a }).x;\nexport default function () {}\n", "let a = 1\nlet b = a / 2 / 3\nvar r = /[/]x/g.test(s)\n", "for (const x of y) { z(`a${x}b`) }", "class A extends B { static x = 1; get y() { return 1 } async *z() {} #p = 2 }", "if (a) b(); else { c?.d ?? e }", "async (x) => { await x; };", "x = a ? b : c\n(function(){})()", "import a, { b as c } from \"d\";", "l: for (;;) { break l }", "return_ = 1\n++x", "switch (a) { case 'b': c(); default: d }", "do x++; while (x < 5) y()", "({ get a() { return 1 }, async b() {}, [c]: 1, ...d })"],
    "json": ['{"a": [1, -2.5e3, null, true, "\\u00e9"]}', "[]", "1"],
}
BAD = {
    "elixir": ["defmodule A do\n", "{:ok, 1 2}", "x = (1, 2]", "def f do\nend\nend\n", '"open', "<<<<<<< ours\n", "if x do\n 1\n", "[a: 1 b: 2]", "a do -> end end"],
    "erlang": ["f(X) -> {ok, [1, 2}.\n", "f(X) =>\n 1.\n", "f() -> a", "<<<<<<< HEAD\n", "f() -> case x of a -> b.\n", "f(X) -> X;\ng(Y) -> Y.\n", "f(X) -> X;\nf(Y, Z) -> Y.\n"],
    "javascript": ["function f( {", "const a = { b: 1 c: 2 };", "<!doctype html>", "if (a) }", "let = = 1", "/* open", "x = `a${b", "{ \"a\": 1, \"b\": 2 }", "a b"],
    "json": ["", "{a: 1}", "[1, ]", '{"a": 1', "01", "[1] x"],
    "python": ["def f(:\n  1", "x = (1, 2", "if a:\nb", "print 'x'", "def f(a=1, b): pass", "f() = 1", "class\n", "x = 'a", "  x = 1\n y = 2\n", "return = 1", "for 1 in x: pass"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(lang, text):
    assert fault_of(lang, normal(text)) is None


@pytest.mark.parametrize("lang,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(lang, text):
    assert fault_of(lang, normal(text)) is not None


PY = ["x = 1\n", "def f(a, /, b: int = 1, *c, d, **e) -> int:\n    return a if b else [y for y in c if y]\n", "async def g():\n    async with a as b, c: await d\n", "match x:\n    case {'a': 1, **r}: pass\n    case [1, *_] | None: y\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\nfinally:\n    pass\n", "print(f'{a!r:>{w}} {b=} {{c}}')\n", "x: int = yield_\nlambda *a, b=1: (yield)\n", "with (open(a) as f, open(b)): pass\n", "@d.e(1)\nclass A(B, m=C):\n    '''doc'''\n    x[1:2, ::3] += 1\n", "del a, b[0]\nglobal_ = not a in b\n", "type X[T] = list[T]\n", "a = b = c, *d = e\n", "if (n := 10) > 5: pass\nelif x: y\nelse: z\n", "\n\n# c\n", "while 1:\n\tbreak\n", "from . import (a as b, c,)\nfrom ..x.y import *\n", "assert a, b; raise\n"]


@pytest.mark.parametrize("text", PY + BAD["python"])
def test_python_agrees_with_its_own_parser(text):
    try:
        ast.parse(text)
        ok = True
    except SyntaxError:
        ok = False
    assert (fault_of("python", normal(text)) is None) == ok


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12), st.integers(0, 40), st.sampled_from("{}[],:\"x1"))
def test_json_agrees_with_the_standard_parser(value, at, insert):
    text = json.dumps(value, ensure_ascii=False)
    broken = text[:at] + insert + text[at:]
    for t in (text, broken):
        try:
            json.loads(t)
            ok = True
        except ValueError:
            ok = False
        assert (fault_of("json", normal(t)) is None) == ok


def test_line_ends_and_marks_do_not_matter():
    t = "defmodule A do\n  def f, do: 1\nend"
    for x in (t, t + "\n", "\ufeff" + t, t.replace("\n", "\r\n"), t.replace("\n", "\r")):
        assert fault_of("elixir", normal(x)) is None
    assert normal(None) == ""


def test_error_lines():
    assert fault_of("elixir", "a = 1\nb = [1 2]\n").line == 2
    assert fault_of("erlang", "f() ->\n  a b.\n").line == 2


def test_endings():
    assert [language_of(p) for p in ("a/b.ex", "B.EXS", "c.erl", "d.min.js", "e.py", "f.json", "README", "x.md", None, "")] == ["elixir", "elixir", "erlang", "javascript", "python", "json", None, None, None, None]


def _functions(lang, text):
    return [(f.name, f.arity, f.doc, f.hidden) for f in functions(parse_source(lang, text), text)]


def test_documentation():
    ex = 'defmodule A do\n  @doc "old"\n  @doc "new"\n  @doc since: "1"\n  @spec f(a) :: b\n  # c\n  def f(a, b \\\\ 1) when a, do: a\n  def f(a, b), do: b\n  @doc false\n  def g, do: 1\n  def h(x), do: x\nend\n'
    assert _functions("elixir", ex) == [("f", 2, "new", False), ("f", 2, None, False), ("g", 0, None, True), ("h", 1, None, False)]
    assert _functions("erlang", "%% @doc Says\n%% more.\n-spec f(a) -> b.\nf(X) -> X.\n%% plain\ng() -> 1.\n%% @hidden\nh() -> 1.\n") == [("f", 1, "Says\nmore.", False), ("g", 0, None, False), ("h", 0, None, True)]
    js = "/** First.\n * @param {x} a\n */\nexport function f(a, b = 1) {}\n/* no */\nconst g = (x) => x\n/** H */\nexport const h = async ({a}, ...r) => 1;\nclass K { /** M */ static m(a) {} }\n"
    assert [x[:3] for x in _functions("javascript", js)] == [("f", 2, "First."), ("g", 1, None), ("h", 2, "H"), ("m", 1, "M")]
    assert [x[:3] for x in _functions("python", 'def f(a, *b, c=1, **d):\n    """Doc."""\n    def g(): return 1\nasync def h(): "x"\n')] == [("f", 4, "Doc."), ("g", 0, None), ("h", 0, "x")]


def test_tables_report_conflicts_and_precedence():
    t = lalr.Tables("%left '+'\n%left '*'\nE : E '+' E {add} | E '*' E {mul} | N ;")
    assert not t.conflicts
    tree = lalr.parse(t, [(k, k, 1) for k in ("N", "+", "N", "*", "N")])
    assert tree[0] == "add" and tree[1][2][0] == "mul"
    assert lalr.Tables("E : E '+' E | N ;").conflicts


@pytest.mark.parametrize("depth", [30, 3000])
def test_deep_nesting_is_no_fault(depth):
    assert fault_of("elixir", 'x = ' + '"#{' * depth + "1" + '}"' * depth) is None
    assert fault_of("python", "x = " + "(" * 90 + "1" + ")" * 90) is None
    assert fault_of("json", "[" * depth + "]" * depth) is None
    assert fault_of("javascript", "x = " + "`${" * depth + "1" + "}`" * depth) is None
    assert fault_of("elixir", 'x = ' + '"#{' * depth + "1") is not None

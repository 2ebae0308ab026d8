"""LALR(1) table generator and table-driven parser.

A grammar is text: optional ``%left`` / ``%right`` / ``%nonassoc`` lines, lowest precedence first, then rules
``name : symbol symbol {action} | ... ;``.  Quoted symbols and upper-case names are terminals.  Actions:

* ``{$i}``  the i-th child (0-based) is the result,
* ``{[]}``  a new list with the last child (empty for an empty rule),
* ``{+}``   the last child is appended to the list that is the first child,
* ``{name}`` a node ``(name, [children], token index of the first child)``.

Without an action a rule of one symbol passes its child through and any other makes a node named like the rule.
Look-aheads are found by the DeRemer-Pennello relations; sets of terminals are integers used as bit sets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

END = "$end"
_SYM = re.compile(r"\s*(?:#[^\n]*)?(?:('(?:[^'\\]|\\.)+')|(\{[^}]*\})|(%[a-z]+)|([A-Za-z_][A-Za-z_0-9]*)|([:|;]))")


class SyntaxFault(Exception):
    """The first token that no rule allows, with its place."""

    def __init__(self, message: str, line: int = 0, index: int = 0):
        super().__init__(message)
        self.message, self.line, self.index = message, line, index


@dataclass
class Rule:
    lhs: str
    rhs: tuple[str, ...]
    action: str
    prec: str | None


def read_grammar(text: str) -> tuple[list[Rule], dict[str, tuple[int, str]]]:
    """Rules and the precedence of terminals."""
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    toks, pos = [], 0
    while pos < len(text.rstrip()):
        m = _SYM.match(text, pos)
        if not m:
            raise ValueError(f"grammar: cannot read {text[pos:pos + 40]!r}")
        pos = m.end()
        if m.lastindex:
            toks.append((m.lastindex, m.group(m.lastindex)))
    rules: list[Rule] = []
    prec: dict[str, tuple[int, str]] = {}
    level, i = 0, 0
    sym = lambda t: t[1][1:-1].replace("\\", "") if t[0] == 1 else t[1]
    while i < len(toks):
        if toks[i][0] == 3:
            kind, level, i = toks[i][1][1:], level + 1, i + 1
            while i < len(toks) and toks[i][0] in (1, 4) and not (i + 1 < len(toks) and toks[i + 1][1] == ":" and toks[i + 1][0] == 5):
                prec[sym(toks[i])] = (level, kind)
                i += 1
            continue
        lhs, i = toks[i][1], i + 2
        rhs: list[str] = []
        action, own = "", None
        while True:
            t = toks[i]
            i += 1
            if t[0] == 5:
                rules.append(Rule(lhs, tuple(rhs), action, own or next((s for s in reversed(rhs) if s in prec), None)))
                rhs, action, own = [], "", None
                if t[1] == ";":
                    break
            elif t[0] == 2:
                action = t[1][1:-1].strip()
            elif t[0] == 3:  # %prec X
                own, i = sym(toks[i]), i + 1
            else:
                rhs.append(sym(t))
    return rules, prec


class Tables:
    """Action and goto tables; small enough to be pickled into a closure."""

    def __init__(self, grammar: str):
        rules, prec = read_grammar(grammar)
        start = rules[0].lhs
        rules = [Rule("$accept", (start, END), "$0", None), *rules]
        nonterms = {r.lhs for r in rules}
        by_lhs: dict[str, list[int]] = {}
        for n, r in enumerate(rules):
            by_lhs.setdefault(r.lhs, []).append(n)
        nullable: set[str] = set()
        while True:
            more = {r.lhs for r in rules if r.lhs not in nullable and all(s in nullable for s in r.rhs)}
            if not more:
                break
            nullable |= more
        closure_of: dict[str, list[int]] = {}
        for nt in nonterms:
            seen, todo = {nt}, [nt]
            while todo:
                for n in by_lhs[todo.pop()]:
                    s = rules[n].rhs[0] if rules[n].rhs else None
                    if s in nonterms and s not in seen:
                        seen.add(s)
                        todo.append(s)
            closure_of[nt] = [n for x in sorted(seen) for n in by_lhs[x]]
        first_kernel = frozenset({(0, 0)})
        states, number, trans = [first_kernel], {first_kernel: 0}, []
        k = 0
        while k < len(states):
            moves: dict[str, set] = {}
            added: set[int] = set()
            for n, d in states[k]:
                rhs = rules[n].rhs
                if d < len(rhs):
                    moves.setdefault(rhs[d], set()).add((n, d + 1))
                    if rhs[d] in nonterms:
                        added.update(closure_of[rhs[d]])
            for n in added:
                if rules[n].rhs:
                    moves.setdefault(rules[n].rhs[0], set()).add((n, 1))
            out = {}
            for s, kernel in moves.items():
                key = frozenset(kernel)
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                out[s] = number[key]
            trans.append(out)
            k += 1
        terms = sorted({s for r in rules for s in r.rhs if s not in nonterms})
        bit = {t: 1 << i for i, t in enumerate(terms)}
        nts = [(p, a) for p in range(len(states)) for a in trans[p] if a in nonterms]
        index = {x: i for i, x in enumerate(nts)}
        reads = [0] * len(nts)
        rel: list[list[int]] = [[] for _ in nts]
        for i, (p, a) in enumerate(nts):
            r = trans[p][a]
            for s, _ in trans[r].items():
                if s in bit:
                    reads[i] |= bit[s]
                elif s in nullable:
                    rel[i].append(index[(r, s)])
        follow = _digraph(rel, reads)
        includes: list[list[int]] = [[] for _ in nts]
        lookback: dict[tuple[int, int], list[int]] = {}
        for i, (p, a) in enumerate(nts):
            for n in by_lhs[a]:
                q, rhs = p, rules[n].rhs
                for d, s in enumerate(rhs):
                    if s in nonterms and all(x in nullable for x in rhs[d + 1:]):
                        includes[index[(q, s)]].append(i)
                    q = trans[q][s]
                lookback.setdefault((q, n), []).append(i)
        follow = _digraph(includes, follow)
        self.conflicts: list[str] = []
        self.action: list[dict[str, int]] = []
        self.goto: list[dict[str, int]] = []
        for q, kernel in enumerate(states):
            act: dict[str, int] = {s: t for s, t in trans[q].items() if s in bit}
            done = [n for n, d in kernel if d == len(rules[n].rhs)] + [n for n in {m for kn, d in kernel if d < len(rules[kn].rhs) and rules[kn].rhs[d] in nonterms for m in closure_of[rules[kn].rhs[d]]} if not rules[n].rhs]
            for n in sorted(set(done)):
                if n == 0:
                    continue
                la = 0
                for i in lookback.get((q, n), ()):
                    la |= follow[i]
                for t in terms:
                    if not la & bit[t]:
                        continue
                    if t not in act:
                        act[t] = -n
                    elif act[t] < 0:
                        self.conflicts.append(f"reduce/reduce on {t}: {rules[-act[t]]} / {rules[n]}")
                    else:
                        own, other = prec.get(rules[n].prec or ""), prec.get(t)
                        if own and other:
                            if own[0] > other[0] or own[0] == other[0] and other[1] == "left":
                                act[t] = -n
                            elif own[0] == other[0] and other[1] == "nonassoc":
                                act[t] = -(1 << 30)
                        else:
                            self.conflicts.append(f"shift/reduce on {t}: {rules[n]}")
            self.action.append({t: a for t, a in act.items() if a != -(1 << 30)})
            self.goto.append({s: t for s, t in trans[q].items() if s in nonterms})
        self.rules = []
        for r in rules:
            a, n = r.action, len(r.rhs)
            if a.startswith("$"):
                op, arg = 0, int(a[1:])
            elif a == "[]":
                op, arg = 1, None
            elif a == "+":
                op, arg = 2, None
            elif a:
                op, arg = 3, a
            elif n == 1:
                op, arg = 0, 0
            else:
                op, arg = 3, r.lhs
            self.rules.append((r.lhs, n, op, arg))


def _digraph(rel: list[list[int]], base: list[int]) -> list[int]:
    """Least sets with f(x) = base(x) | union of f(y) for x rel y; strongly connected parts share a set."""
    n = len(rel)
    out, depth, stack = list(base), [0] * n, []
    for root in range(n):
        if depth[root]:
            continue
        work = [(root, 0)]
        stack.append(root)
        depth[root] = len(stack)
        low = {root: depth[root]}
        while work:
            x, i = work.pop()
            if i < len(rel[x]):
                work.append((x, i + 1))
                y = rel[x][i]
                if not depth[y]:
                    stack.append(y)
                    depth[y] = low[y] = len(stack)
                    work.append((y, 0))
                else:
                    low[x] = min(low[x], depth[y])
                    out[x] |= out[y]
                continue
            if low[x] == depth[x]:
                while True:
                    y = stack.pop()
                    depth[y] = 1 << 60
                    out[y] = out[x]
                    if y == x:
                        break
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[x])
                out[p] |= out[x]
    return out


class Machine:
    """One run over a token source.  ``feed`` takes a terminal and its value and raises SyntaxFault."""

    __slots__ = ("t", "states", "values", "count", "starts")

    def __init__(self, tables: Tables):
        self.t, self.states, self.values, self.starts, self.count = tables, [0], [None], [0], 0

    def accepts(self, kind: str) -> bool:
        """Whether the terminal can be shifted here, after whatever reductions it needs."""
        action, goto, rules = self.t.action, self.t.goto, self.t.rules
        a = action[self.states[-1]].get(kind)
        if a is None or a > 0:
            return a is not None
        states = self.states[:]
        while a is not None and a < 0:
            lhs, n, _, _ = rules[-a]
            if n:
                del states[-n:]
            states.append(goto[states[-1]][lhs])
            a = action[states[-1]].get(kind)
        return a is not None

    def feed(self, kind: str, value, line: int = 0) -> None:
        action, goto, rules = self.t.action, self.t.goto, self.t.rules
        states, values, starts = self.states, self.values, self.starts
        while True:
            a = action[states[-1]].get(kind)
            if a is None:
                raise SyntaxFault(f"syntax error before: {value if value is not None else 'end of input'}"[:200], line, self.count)
            if a > 0:
                states.append(a)
                values.append(value)
                starts.append(self.count)
                self.count += 1
                return
            lhs, n, op, arg = rules[-a]
            if n == 0:
                v = [] if op == 1 else None if op == 0 else (arg, [], self.count, self.count)
                start = self.count
            else:
                start = starts[-n]
                if op == 0:
                    v = values[arg - n]
                elif op == 1:
                    v = [values[-1]]
                elif op == 2:
                    v = values[-n]
                    v.append(values[-1])
                else:
                    v = (arg, values[-n:], start, self.count)
                del states[-n:], values[-n:], starts[-n:]
            states.append(goto[states[-1]][lhs])
            values.append(v)
            starts.append(start)

    def end(self, line: int = 0):
        self.feed(END, None, line)
        return self.values[1]


def parse(tables: Tables, tokens) -> object:
    """Tokens are (terminal, value, line, ...)."""
    m = Machine(tables)
    line = 0
    for t in tokens:
        line = t[2]
        m.feed(t[0], t[1], line)
    return m.end(line)

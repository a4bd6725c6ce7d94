"""From a grammar text to LALR(1) tables that keep every conflict.

Notation: ``name : alternative | alternative``, one rule from its name to the
next.  'x' and UPPER names are terminals.  ``?`` ``*`` ``+`` and groups are as
usual; ``X % s`` is a list of X separated by s, ``X %% s`` allows one
separator at the end.  The first rule is the start.
"""

from __future__ import annotations

import re
from itertools import product

_SYMBOL = re.compile(r"\s*(?:('(?:[^']+)')|([A-Za-z_][A-Za-z_0-9]*)|(%%|%|[|()?*+]))")


class Grammar:
    def __init__(self, text: str):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self._seen: dict[tuple, str] = {}
        lines = [x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
        blocks = re.split(r"(?m)^([A-Za-z_]\w*)[ \t]*:(?=\s)", "\n".join(lines))
        names, bodies = blocks[1::2], blocks[2::2]
        self.names = set(names)
        self.start = names[0]
        for name, body in zip(names, bodies):
            tokens = self._tokens(body, name)
            for alt in self._alternatives(tokens, [0]):
                self.rules.append((name, alt))
        used = {s for _, alt in self.rules for s in alt}
        self.terminals = sorted(s for s in used if s[0] == "'" or (s not in self.names and not s.startswith("_")))
        lost = [s for s in self.terminals if s[0] != "'" and not s.isupper()]
        if lost:
            raise ValueError(f"undefined: {lost}")

    @staticmethod
    def _tokens(body: str, name: str) -> list[str]:
        out, at, body = [], 0, body.rstrip()
        while at < len(body):
            m = _SYMBOL.match(body, at)
            if not m:
                raise ValueError(f"{name}: {body[at : at + 30]!r}")
            out.append(m[1] or m[2] or m[3])
            at = m.end()
        return out

    def _alternatives(self, tokens: list[str], at: list[int]) -> list[tuple[str, ...]]:
        alts: list[tuple[str, ...]] = []
        parts: list[list[tuple[str, ...]]] = []

        def close():
            for choice in product(*parts):
                alt = tuple(s for piece in choice for s in piece)
                if alt not in alts:
                    alts.append(alt)
            parts.clear()

        while at[0] < len(tokens):
            t = tokens[at[0]]
            at[0] += 1
            if t == ")":
                break
            if t == "|":
                close()
                continue
            if t == "(":
                item = self._alternatives(tokens, at)
            elif t in "?*+" or t in ("%", "%%"):
                last = parts.pop()
                if t == "?":
                    item = [*last, ()] if () not in last else last
                elif t in "*+":
                    many = [(self._plus(last),)]
                    item = [*many, ()] if t == "*" else many
                else:
                    sep = tokens[at[0]]
                    at[0] += 1
                    many = self._list(last, sep)
                    item = [(many,), (many, sep)] if t == "%%" else [(many,)]
            else:
                item = [(t,)]
            parts.append(item)
        close()
        return alts

    def _plus(self, alts) -> str:
        key = ("+", tuple(alts))
        if key not in self._seen:
            self._seen[key] = name = f"_{len(self._seen)}"
            for a in alts:
                if a:
                    self.rules += [(name, a), (name, (name, *a))]
        return self._seen[key]

    def _list(self, alts, sep) -> str:
        key = ("%", tuple(alts), sep)
        if key not in self._seen:
            self._seen[key] = name = f"_{len(self._seen)}"
            for a in alts:
                self.rules += [(name, a), (name, (name, sep, *a))]
        return self._seen[key]


def build(text: str) -> dict:
    """Tables: terminal -> id; per state {terminal: action or tuple of actions}, {nonterminal: state}.

    An action >= 0 shifts to that state; one < 0 reduces by rule -action - 1.
    """
    g = Grammar(text)
    end = "$"
    rules = [("_start", (g.start,)), *g.rules]
    nts = sorted({n for n, _ in rules})
    nt_id = {n: i for i, n in enumerate(nts)}
    terms = [end, *g.terminals]
    t_id = {t: i for i, t in enumerate(terms)}
    # Symbols as ints: terminals >= 0, nonterminals < 0.
    sym = lambda s: t_id[s] if s in t_id else -nt_id[s] - 1
    lhs = [nt_id[n] for n, _ in rules]
    rhs = [tuple(map(sym, alt)) for _, alt in rules]
    by_nt: dict[int, list[int]] = {}
    for i, n in enumerate(lhs):
        by_nt.setdefault(n, []).append(i)

    nullable: set[int] = set()
    changed = True
    while changed:
        changed = False
        for n, r in zip(lhs, rhs):
            if n not in nullable and all(s < 0 and (-s - 1) in nullable for s in r):
                nullable.add(n)
                changed = True

    # Which rules a nonterminal's closure brings in.
    first_rules: dict[int, frozenset[int]] = {}
    for n in by_nt:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            for r in by_nt[x]:
                if rhs[r] and rhs[r][0] < 0:
                    todo.append(-rhs[r][0] - 1)
        first_rules[n] = frozenset(r for x in seen for r in by_nt[x])

    states: dict[frozenset, int] = {}
    kernels: list[frozenset] = []
    moves: list[dict[int, int]] = []

    def state_of(kernel: frozenset) -> int:
        if kernel not in states:
            states[kernel] = len(kernels)
            kernels.append(kernel)
            moves.append({})
        return states[kernel]

    state_of(frozenset([(0, 0)]))
    k = 0
    reductions: list[list[int]] = []
    while k < len(kernels):
        items = set(kernels[k])
        for r, d in kernels[k]:
            if d < len(rhs[r]) and rhs[r][d] < 0:
                items.update((x, 0) for x in first_rules[-rhs[r][d] - 1])
        ahead: dict[int, set] = {}
        done = []
        for r, d in items:
            if d < len(rhs[r]):
                ahead.setdefault(rhs[r][d], set()).add((r, d + 1))
            else:
                done.append(r)
        reductions.append(done)
        for s, kernel in ahead.items():
            moves[k][s] = state_of(frozenset(kernel))
        k += 1

    # Lookaheads by the relations between nonterminal transitions.
    trans = [(p, s) for p, m in enumerate(moves) for s in m if s < 0]
    number = {t: i for i, t in enumerate(trans)}
    direct = [0] * len(trans)
    reads: list[list[int]] = [[] for _ in trans]
    for i, (p, s) in enumerate(trans):
        q = moves[p][s]
        for x in moves[q]:
            if x >= 0:
                direct[i] |= 1 << x
            elif (-x - 1) in nullable:
                reads[i].append(number[q, x])
    direct[number[0, sym(g.start)]] |= 1 << t_id[end]

    def digraph(relation, base):
        n = len(base)
        value, mark, stack = list(base), [0] * n, []
        for root in range(n):
            if mark[root]:
                continue
            work = [(root, iter(relation[root]))]
            stack.append(root)
            mark[root] = depth = len(stack)
            depths = {root: depth}
            while work:
                x, rest = work[-1]
                for y in rest:
                    if not mark[y]:
                        stack.append(y)
                        mark[y] = depths[y] = len(stack)
                        work.append((y, iter(relation[y])))
                        break
                    mark[x] = min(mark[x], mark[y])
                    value[x] |= value[y]
                else:
                    work.pop()
                    if mark[x] == depths[x]:
                        while True:
                            y = stack.pop()
                            mark[y] = 1 << 60
                            value[y] = value[x]
                            if y == x:
                                break
                    if work:
                        up = work[-1][0]
                        mark[up] = min(mark[up], mark[x])
                        value[up] |= value[x]
        return value

    read = digraph(reads, direct)
    includes: list[list[int]] = [[] for _ in trans]
    lookback: dict[tuple[int, int], list[int]] = {}
    for i, (p, s) in enumerate(trans):
        for r in by_nt[-s - 1]:
            q = p
            body = rhs[r]
            for d, x in enumerate(body):
                if x < 0 and all(y < 0 and (-y - 1) in nullable for y in body[d + 1 :]):
                    includes[number[q, x]].append(i)
                q = moves[q][x]
            lookback.setdefault((q, r), []).append(i)
    follow = digraph(includes, read)

    actions: list[dict] = []
    gotos: list[dict[int, int]] = []
    for p, m in enumerate(moves):
        acts: dict[int, list[int]] = {}
        for s, q in m.items():
            if s >= 0:
                acts.setdefault(s, []).append(q)
        for r in reductions[p]:
            if r == 0:
                continue
            mask = 0
            for i in lookback.get((p, r), ()):
                mask |= follow[i]
            t = 0
            while mask:
                if mask & 1:
                    acts.setdefault(t, []).append(-r - 1)
                mask >>= 1
                t += 1
        actions.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in acts.items()})
        gotos.append({-s - 1: q for s, q in m.items() if s < 0})
    return {"terminals": t_id, "actions": actions, "gotos": gotos, "lhs": lhs, "sizes": [len(r) for r in rhs], "accept": moves[0][sym(g.start)]}

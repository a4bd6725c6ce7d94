"""The generalised LR run: one stack where the tables agree, several where they do not.

Stacks are linked (state, below) pairs.  Where an action forks, equal stacks
are merged by interning, so alternatives that come together again cost nothing
from there on.  The whole token stream is read; the answer is the index of the
first token that no stack can take, or -1.
"""

from __future__ import annotations


#: Remembered chains of unit rules per grammar.
_CHAINS = 300_000


def _advance(tables: dict, frontier: list, term: int, interned: dict) -> list:
    """All stacks after every possible reduction and the shift of ``term``.

    ``interned`` holds the stacks built since the fork by state and identity of
    what lies below; so equal stacks are one object, and what it holds stays
    alive, which keeps identities unique.
    """
    actions, gotos, lhs, sizes = tables["actions"], tables["gotos"], tables["lhs"], tables["sizes"]
    seen: set[int] = set()
    out: dict[int, tuple] = {}
    todo = list(frontier)
    while todo:
        node = todo.pop()
        while id(node) not in seen:
            seen.add(id(node))
            acts = actions[node[0]].get(term)
            if acts is None:
                break
            after = None
            for a in (acts,) if type(acts) is int else acts:
                if a >= 0:
                    key = (a, id(node))
                    made = interned.get(key)
                    if made is None:
                        made = interned[key] = (a, node)
                    out[id(made)] = made
                    continue
                r = -a - 1
                base = node
                for _ in range(sizes[r]):
                    base = base[1]
                key = (gotos[base[0]][lhs[r]], id(base))
                made = interned.get(key)
                if made is None:
                    made = interned[key] = (key[0], base)
                if after is None:
                    after = made
                else:
                    todo.append(made)
            if after is None:
                break
            node = after
    return list(out.values())


def _states(node) -> tuple:
    """The top of a stack, as deep as stacks differ in practice; the rest by identity."""
    path = []
    while node is not None and len(path) < 24:
        path.append(node[0])
        node = node[1]
    return (*path, id(node))


def first_error(tables: dict, terms: list[int], inserted: int = -1, may_insert=None) -> int:
    """Index of the first token no stack can take, len(terms) for the end, -1 if all is valid.

    ``inserted`` is a terminal that may be put before token i where
    ``may_insert(i)`` holds and the token itself is not possible.
    """
    actions, gotos, lhs, sizes = tables["actions"], tables["gotos"], tables["lhs"], tables["sizes"]
    states, width, chains = len(actions), len(tables["terminals"]) + 1, tables.setdefault("chains", {})
    node = (0, None)
    many: list | None = None
    n = len(terms)
    i = 0
    while i <= n:
        term = terms[i] if i < n else 0
        if many is None:
            start = node
            while True:
                a = actions[node[0]].get(term)
                if a is None:
                    if term == 0 and node[0] == tables["accept"] and node[1] == (0, None):
                        return -1
                    many = []
                    break
                if type(a) is not int:
                    interned: dict = {}
                    many = _advance(tables, [node], term, interned)
                    break
                if a >= 0:
                    node = (a, node)
                    break
                r = -a - 1
                size = sizes[r]
                if size == 1:
                    # A chain of unit rules ends in a state that only the two top states and the terminal decide.
                    base = node[1]
                    under = base[0]
                    key = (node[0] * states + under) * width + term
                    state = chains.get(key)
                    if state is None:
                        state = gotos[under][lhs[r]]
                        while type(b := actions[state].get(term)) is int and b < 0 and sizes[-b - 1] == 1:
                            state = gotos[under][lhs[-b - 1]]
                        if len(chains) > _CHAINS:
                            chains.clear()
                        chains[key] = state
                    node = (state, base)
                    continue
                for _ in range(size):
                    node = node[1]
                node = (gotos[node[0]][lhs[r]], node)
            before = [start]
        else:
            before = many
            if term == 0:
                many = []
                if _accepts(tables, before):
                    return -1
            else:
                many = _advance(tables, before, term, interned)
        if many is not None:
            if not many and inserted >= 0 and may_insert(i):
                interned = {}
                patched = _advance(tables, before, inserted, interned)
                if term == 0:
                    if _accepts(tables, patched):
                        return -1
                elif patched:
                    many = _advance(tables, patched, term, interned)
            if not many:
                return i
            if len(many) == 1:
                node, many = many[0], None
        i += 1
    return n


def _accepts(tables: dict, frontier: list) -> bool:
    actions, gotos, lhs, sizes = tables["actions"], tables["gotos"], tables["lhs"], tables["sizes"]
    todo, seen = list(frontier), set()
    while todo:
        node = todo.pop()
        key = _states(node)
        if key in seen:
            continue
        seen.add(key)
        if node[0] == tables["accept"] and node[1] is not None and node[1][1] is None:
            return True
        acts = actions[node[0]].get(0)
        for a in () if acts is None else (acts,) if type(acts) is int else acts:
            if a < 0:
                r = -a - 1
                base = node
                for _ in range(sizes[r]):
                    base = base[1]
                todo.append((gotos[base[0]][lhs[r]], base))
    return False

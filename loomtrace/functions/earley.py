"""A small weighted Earley parser for per-line grammars. Pure helper: Spark decides which lines each task parses."""

from __future__ import annotations

from collections import defaultdict


class Grammar:
    """Rules read from text, one a line: ``Name weight: symbols | symbols``. Lower-case symbols in quotes or names without
    rules are terminals. A parse scores the sum of its rules' weights; the highest score wins, ties go to the rule that
    stands first."""

    def __init__(self, text: str, start: str):
        self.rules: list[tuple[str, float, tuple[str, ...]]] = []
        self.by: dict[str, list[int]] = defaultdict(list)
        for line in text.strip().splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            head, _, bodies = line.partition(" : ")
            name, weight = head.split()
            for body in bodies.split(" | "):
                self.by[name].append(len(self.rules))
                self.rules.append((name, float(weight), tuple(s.strip("'") if len(s) > 2 else s.strip("'") or "'" for s in body.split())))
        self.start = start
        self.first = {n: self._first(n) for n in self.by}

    def _first(self, name: str) -> set[str]:
        seen, todo, out = set(), [name], set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            for r in self.by[n]:
                s = self.rules[r][2][0]
                if s in self.by:
                    todo.append(s)
                else:
                    out.add(s)
        return out


Item = tuple[int, int, int]  # rule, dot, origin
HERE = -1  # the origin of what begins at the column itself


class _Column:
    """The items at one place between tokens. Where what was read into a place and what follows are the same as at an
    earlier one, both places share a column: in running text one does for all, however long it is."""

    __slots__ = ("items", "waiting", "scans")

    def __init__(self, kernel: dict[Item, float], token: frozenset[str], grammar: Grammar, columns: list[_Column], i: int):
        rules, by, first = grammar.rules, grammar.by, grammar.first
        items: dict[Item, tuple[float, tuple | None]] = {k: (v, None) for k, v in kernel.items()}
        waiting: dict[str, dict[Item, None]] = defaultdict(dict)
        scans: dict[str, dict[Item, None]] = defaultdict(dict)
        agenda = list(items)
        for item in agenda:  # grows while it is read
            r, dot, origin = item
            name, _, body = rules[r]
            if dot == len(body):
                score = items[item][0]
                for parent in columns[origin].waiting.get(name, ()):
                    new = (parent[0], parent[1] + 1, origin if parent[2] == HERE else parent[2])
                    total = columns[origin].items[parent][0] + score
                    old = items.get(new)
                    if old is None or total > old[0] + 1e-9:
                        items[new] = (total, (parent, origin, item))
                        agenda.append(new)
                continue
            s = body[dot]
            if s not in by:
                scans[s][item] = None
                continue
            new_here = s not in waiting
            waiting[s][item] = None
            if new_here and not first[s].isdisjoint(token):
                for k in by[s]:
                    f = rules[k][2][0]
                    if (f in by and not first[f].isdisjoint(token)) or f in token:
                        new = (k, 0, HERE)
                        if new not in items:
                            items[new] = (rules[k][1], None)
                            agenda.append(new)
        self.items, self.waiting, self.scans = items, waiting, scans

    def read(self, token: frozenset[str], i: int) -> dict[Item, float]:
        """What a token leads on to."""
        out: dict[Item, float] = {}
        for t in token & self.scans.keys():
            for item in self.scans[t]:
                new = (item[0], item[1] + 1, i if item[2] == HERE else item[2])
                score = self.items[item][0]
                if score > out.get(new, float("-inf")):
                    out[new] = score
        return out


def parse(grammar: Grammar, tokens: list[frozenset[str]], keep: frozenset[str]) -> tuple[float, list[tuple[str, int, int]]] | None:
    """The best parse of all tokens (each a set of terminals that it can be): its score and the spans of the kept names.

    None if the tokens have no parse. Spans are (name, from, to) in order of their beginnings. Time and memory follow the
    number of tokens.
    """
    rules, by = grammar.rules, grammar.by
    n = len(tokens)
    columns: list[_Column] = []
    known: dict[tuple, _Column] = {}
    kernel = {(r, 0, HERE): rules[r][1] for r in by[grammar.start]}
    for i in range(n + 1):
        token = tokens[i] if i < n else frozenset()
        key = (frozenset(kernel.items()), token)
        column = known.get(key)
        if column is None:
            column = known[key] = _Column(kernel, token, grammar, columns, i)
        columns.append(column)
        if i < n:
            kernel = column.read(token, i)
            if not kernel:
                return None
    last = columns[n].items
    best = max(((last[(r, len(rules[r][2]), 0)][0], -r) for r in by[grammar.start] if (r, len(rules[r][2]), 0) in last), default=None)
    if best is None:
        return None
    spans: list[tuple[str, int, int]] = []
    stack: list[tuple[Item, int]] = [((-best[1], len(rules[-best[1]][2]), 0), n)]
    while stack:
        item, end = stack.pop()
        r, dot, origin = item
        begin = end if origin == HERE else origin
        if dot == len(rules[r][2]) and rules[r][0] in keep:
            spans.append((rules[r][0], begin, end))
        if dot == 0:
            continue
        back = columns[end].items[item][1]
        if back is None:  # a token was read
            stack.append(((r, dot - 1, HERE if begin == end - 1 else begin), end - 1))
            continue
        parent, at, child = back
        stack.append((parent, at))
        stack.append((child, end))
    return best[0], sorted(spans, key=lambda s: (s[1], -s[2]))

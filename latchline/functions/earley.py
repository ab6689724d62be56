"""A weighted Earley recogniser that shares its chart between lines.

Lines of one layout have the same token classes in their headers, so charts are
kept in a trie over token classes: a line walks the trie and only computes the
columns nobody walked before.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Added for every token a parse covers: more than the rules above one token can cost, so of two parses the one that explains more wins.
PER_TOKEN = 100.0
#: Terminal that stands for any token, and its cost.
ANY, ANY_COST = "*", -3.0


@dataclass(frozen=True)
class Rule:
    left: str
    right: tuple[str, ...]
    weight: float


Tree = tuple  # (name, first token, last token + 1, children)


@dataclass
class _Column:
    depth: int
    path: tuple[_Column, ...]
    items: dict[tuple[int, int, int], tuple[float, tuple]] = field(default_factory=dict)
    next: dict[str, _Column | None] = field(default_factory=dict)
    accepted: tuple[float, Tree] | None = None
    #: What callers keep about the accepted parse.
    notes: object = None


class Grammar:
    """Rules as text: ``Left -> right parts : weight``, one a line; weights are probabilities."""

    def __init__(self, text: str, start: str, also: dict[str, tuple[tuple[str, float], ...]] | None = None, keep: int = 60_000):
        self.rules: list[Rule] = []
        for line in filter(None, (x.strip() for x in text.splitlines())):
            if line.startswith("#"):
                continue
            left, rest = line.split(" -> ")
            right, weight = rest.rsplit(" : ", 1)
            self.rules.append(Rule(left.strip(), tuple(right.split()), math.log(float(weight))))
        self.start = start
        self.by_left: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_left.setdefault(r.left, []).append(i)
        #: A token class may also stand for other terminals, at a cost.
        self.also = also or {}
        self.keep, self.columns = keep, 0
        self.root = self._root()

    def _root(self) -> _Column:
        self.columns = 1
        col = _Column(0, ())
        self._close(col, {(i, 0, 0): (self.rules[i].weight, ()) for i in self.by_left[self.start]})
        return col

    def _close(self, col: _Column, seed: dict) -> None:
        """Completes and predicts until nothing better is found."""
        work = list(seed.items())
        while work:
            key, (score, kids) = work.pop()
            known = col.items.get(key)
            if known is not None and known[0] >= score:
                continue
            col.items[key] = (score, kids)
            rule, dot, origin = key
            r = self.rules[rule]
            if dot == len(r.right):
                tree = (r.left, origin, col.depth, kids)
                if r.left == self.start and origin == 0 and (col.accepted is None or score > col.accepted[0]):
                    col.accepted = (score, tree)
                back = col if origin == col.depth else col.path[origin]
                base = [(k, v) for k, v in back.items.items() if k[1] < len(self.rules[k[0]].right) and self.rules[k[0]].right[k[1]] == r.left]
                for (r2, d2, o2), (s2, k2) in base:
                    work.append(((r2, d2 + 1, o2), (s2 + score, (*k2, tree))))
            elif (name := r.right[dot]) in self.by_left:
                for i in self.by_left[name]:
                    if (i, 0, col.depth) not in col.items:
                        work.append(((i, 0, col.depth), (self.rules[i].weight, ())))

    def _step(self, col: _Column, token: str) -> _Column | None:
        allowed = {ANY: ANY_COST, token: 0.0, **{t: math.log(w) for t, w in self.also.get(token, ())}}
        seed = {}
        for (rule, dot, origin), (score, kids) in col.items.items():
            right = self.rules[rule].right
            if dot < len(right) and right[dot] in allowed:
                got = score + allowed[right[dot]] + PER_TOKEN
                key = (rule, dot + 1, origin)
                if key not in seed or seed[key][0] < got:
                    seed[key] = (got, (*kids, (right[dot], col.depth, col.depth + 1, ())))
        if not seed:
            return None
        out = _Column(col.depth + 1, (*col.path, col))
        self._close(out, seed)
        self.columns += 1
        return out

    def parse(self, classes: Iterable[str]) -> tuple[_Column | None, int]:
        """The column of the highest-scoring parse of any beginning of ``classes``, and how far any rule reached.

        Tokens are taken one by one and no further than a rule can use them.
        """
        if self.columns > self.keep:
            self.root = self._root()
        col, found = self.root, None
        for token in classes:
            if token in col.next:
                nxt = col.next[token]
            else:
                nxt = col.next[token] = self._step(col, token)
            if nxt is None:
                break
            col = nxt
            if col.accepted and (found is None or col.accepted[0] > found.accepted[0]):
                found = col
        return found, col.depth

    def best(self, classes: Iterable[str]) -> tuple[float, Tree] | None:
        """Score and tree of the highest-scoring parse; the tree says how far it reaches."""
        found, _ = self.parse(classes)
        return found.accepted if found else None


def spans(tree: Tree, roles: frozenset[str]) -> list[tuple[str, int, int]]:
    """Outermost nodes named in ``roles`` with their token ranges, in order."""
    out, work = [], [tree]
    while work:
        name, a, b, kids = work.pop()
        if name in roles:
            out.append((name, a, b))
        else:
            work.extend(reversed(kids))
    return out

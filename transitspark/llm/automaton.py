"""Regular expressions over bytes as one minimal deterministic automaton in arrays.

A rule's syntax tree becomes a nondeterministic automaton, the subset construction makes one deterministic automaton
of all rules, repeated refinement of groups of states (Moore's way) merges equal ones, and bytes that no state tells
apart share a column of the transition table.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

import numpy as np


def _byte_set(op, arg) -> frozenset[int]:
    """Bytes that one character node matches; rules are ASCII. Byte 255 is in no UTF-8 text and matches nothing."""
    if op is sre.LITERAL:
        return frozenset([arg])
    if op is sre.NOT_LITERAL:
        return frozenset(range(255)) - {arg}
    if op is sre.ANY:
        return frozenset(range(255)) - {10}
    found: set[int] = set()
    negated = False
    for kind, value in arg:
        if kind is sre.NEGATE:
            negated = True
        elif kind is sre.LITERAL:
            found.add(value)
        elif kind is sre.RANGE:
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"{kind} is not supported in a rule")
    return frozenset(range(255)) - found if negated else frozenset(found)


class _Nfa:
    """Thompson's construction; edges[state] = [(bytes, next state)], empty[state] = [next state]."""

    def __init__(self):
        self.edges: list[list] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def sequence(self, tree, at: int, backwards: bool, either_case: bool) -> int:
        for node in reversed(tree) if backwards else tree:
            at = self.node(node, at, backwards, either_case)
        return at

    def node(self, node, at: int, backwards: bool, fold: bool) -> int:
        op, arg = node
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
            found = _byte_set(op, arg)
            if fold:
                found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
            end = self.state()
            self.edges[at].append((found, end))
            return end
        if op is sre.SUBPATTERN:
            _, add, _, tree = arg
            return self.sequence(tree, at, backwards, fold or bool(add & sre.SRE_FLAG_IGNORECASE))
        if op is sre.BRANCH:
            end = self.state()
            for tree in arg[1]:
                self.empty[self.sequence(tree, at, backwards, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                at = self.sequence(tree, at, backwards, fold)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.sequence(tree, loop, backwards, fold)].append(loop)
                return loop
            end = self.state()
            self.empty[at].append(end)
            for _ in range(most - least):
                at = self.sequence(tree, at, backwards, fold)
                self.empty[at].append(end)
            return end
        raise ValueError(f"{op} is not supported in a rule")

    def closure(self, states) -> int:
        """A set of states with all that empty steps reach, as a bit set."""
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return sum(1 << s for s in seen)


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


class Automaton:
    """table[state, classes[byte]] is the next state, accepts[state] a bit per rule that ends there; 0 is the start.

    States that accept come last, from number `quiet` on. searching: a match may start at every byte (else only at the
    first). backwards: the rules read from their ends.
    """

    def __init__(self, patterns: list[str], searching: bool = False, backwards: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for k, p in enumerate(patterns):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends[nfa.sequence(list(_parser.parse(p)), begin, backwards, False)] = 1 << k
        sets = {found for out in nfa.edges for found, _ in out}
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        classes = np.array([kinds[s] for s in signature], "uint8")
        sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]
        first = nfa.closure([start])
        again = first if searching else 0
        step: dict[int, list[int]] = {}  # of an NFA state with edges: what it reaches by each class of bytes
        for q, out in enumerate(nfa.edges):
            if out:
                step[q] = [nfa.closure([t for found, t in out if b in found]) for b in sample]
        moves = sum(1 << q for q in step)
        index, rows, todo = {first: 0}, [], [first]
        while todo:  # subset construction, breadth first
            for s in todo:
                own = [step[q] for q in _bits(s & moves)]
                out = []
                for c in range(len(sample)):
                    to = again
                    for x in own:
                        to |= x[c]
                    out.append(index.setdefault(to, len(index)))
                rows.append(out)
            todo = list(index)[len(rows) :]
        table = np.array(rows, "int64")
        accepts = np.array([sum(bit for q, bit in ends.items() if s >> q & 1) for s in index], "int64")
        group = np.unique(accepts, return_inverse=True)[1]
        while True:  # states stay together while they accept alike and go to the same groups
            _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        _, one = np.unique(group, return_index=True)
        one = one[np.lexsort((one, accepts[one] != 0))] if not accepts[0] else np.sort(one)
        number = np.empty(len(one), "int64")
        number[group[one]] = np.arange(len(one))
        self.table = number[group[table[one]]].astype("int32")
        self.accepts = accepts[one]
        self.quiet = int((self.accepts == 0).sum()) if not accepts[0] else 0
        self.classes = classes
        # a state from which nothing is reached any more, in an automaton that does not search
        self.dead = next((i for i in range(len(one)) if not self.accepts[i] and (self.table[i] == i).all()), -1)

    def farthest(self, data: bytes, at: int, step: int = 1, stop: int | None = None) -> int:
        """The end of the longest match from `at`, read in direction `step` up to `stop`; -1 if there is none.

        Backwards, places count bytes that are still to be read: a match that ends after data[at - 1] is read from
        `at` and its place is where it begins.
        """
        state, best, (table, ends, classes) = 0, -1, self._lists()
        here = range(at, len(data) if stop is None else stop) if step > 0 else range(at - 1, (0 if stop is None else stop) - 1, -1)
        for k in here:
            state = table[state][classes[data[k]]]
            if ends[state]:
                best = k + 1 if step > 0 else k
            if state == self.dead:
                break
        return best

    def _lists(self) -> tuple[list, list, list]:
        if not hasattr(self, "_listed"):
            self._listed = self.table.tolist(), self.accepts.tolist(), self.classes.tolist()
        return self._listed

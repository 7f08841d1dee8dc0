"""Regexes of several rules compiled into one deterministic byte automaton.

Rules are read with the standard library's regex parser, made into one
position automaton, determinised by subset construction over classes of
equivalent bytes, and minimised by partition refinement. Supported: literals,
classes, groups, alternation and greedy counts, over ASCII patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_parser = re._parser


@dataclass(frozen=True)
class Automaton:
    """next[state, kinds[byte]] and the bit mask of the rules that accept in a state."""

    kinds: bytes
    next: np.ndarray
    accepts: np.ndarray
    start: int


def _byte_set(items, ignore_case: bool) -> frozenset[int]:
    found, negate = set(), False
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            negate = True
        elif name == "LITERAL":
            found.add(value)
        elif name == "RANGE":
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported in a class: {name}")
    if ignore_case:
        found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
    if max(found, default=0) > 127:
        raise ValueError("patterns must be ASCII")
    return frozenset(set(range(256)) - found if negate else found)


class _Nfa:
    """States with one byte set or with empty moves."""

    def __init__(self):
        self.on: list[tuple[frozenset[int], int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.on.append(None)
        self.empty.append([])
        return len(self.on) - 1

    def add(self, nodes, source: int, ignore_case: bool, backwards: bool) -> int:
        """Adds nodes in sequence after source; the state where they end."""
        for op, value in reversed(list(nodes)) if backwards else nodes:
            name = str(op)
            if name in ("LITERAL", "IN", "NOT_LITERAL"):
                items = value if name == "IN" else [("LITERAL", value)]
                chosen = _byte_set(items, ignore_case)
                if name == "NOT_LITERAL":
                    chosen = frozenset(range(256)) - chosen
                # a state holds one move: enter through a fresh one
                entry, target = self.state(), self.state()
                self.empty[source].append(entry)
                self.on[entry] = (chosen, target)
                source = target
            elif name == "SUBPATTERN":
                source = self.add(value[3], source, ignore_case or bool(value[1] & re.I), backwards)
            elif name == "BRANCH":
                target = self.state()
                for way in value[1]:
                    self.empty[self.add(way, source, ignore_case, backwards)].append(target)
                source = target
            elif name == "MAX_REPEAT":
                least, most, body = value
                for _ in range(least):
                    source = self.add(body, source, ignore_case, backwards)
                if most is _parser.MAXREPEAT or str(most) == "MAXREPEAT":
                    loop = self.state()
                    self.empty[source].append(loop)
                    self.empty[self.add(body, loop, ignore_case, backwards)].append(loop)
                    source = loop
                else:
                    target = self.state()
                    self.empty[source].append(target)
                    for _ in range(most - least):
                        source = self.add(body, source, ignore_case, backwards)
                        self.empty[source].append(target)
                    source = target
            else:
                raise ValueError(f"unsupported: {name}")
        return source


def compile_rules(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One minimal automaton for all patterns.

    backwards reads the mirrored patterns, for a pass from right to left;
    anywhere lets a match begin at every byte instead of the first only.
    """
    nfa = _Nfa()
    root = nfa.state()
    accepts: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        parsed = _parser.parse(pattern)
        head = nfa.state()
        nfa.empty[root].append(head)
        end = nfa.add(parsed, head, bool(parsed.state.flags & re.I), backwards)
        accepts[end] = accepts.get(end, 0) | 1 << rule

    def closed(states) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for s in nfa.empty[left.pop()]:
                if s not in found:
                    found.add(s)
                    left.append(s)
        return frozenset(s for s in found if nfa.on[s] or s in accepts)

    sets = [on[0] for on in nfa.on if on]
    kind_of = np.unique(
        np.array([[b in s for s in sets] for b in range(256)], dtype=np.uint8), axis=0, return_inverse=True
    )[1].reshape(-1)
    samples = [int(np.argmax(kind_of == k)) for k in range(kind_of.max() + 1)]

    first = closed([root])
    number, left, rows = {first: 0}, [first], []
    while left:
        state = left.pop(0)
        row = []
        for byte in samples:
            moved = [nfa.on[s][1] for s in state if nfa.on[s] and byte in nfa.on[s][0]]
            target = closed(moved) | (first if anywhere else frozenset())
            if target not in number:
                number[target] = len(number)
                left.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows)
    masks = np.array([sum({accepts[s] for s in state if s in accepts}) for state in number])

    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    least = np.unique(block, return_index=True)[1]
    # accepting states last, so that one comparison tells them
    order = np.argsort(masks[least] > 0, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    small = place[block[table[least[order]]]]
    return Automaton(
        bytes(kind_of.tolist()), small.astype(np.int32), masks[least[order]], int(place[block[0]])
    )

"""Finite-state transducers as transition tables: composition, minimising and running.

A machine reads symbols and writes at most one for each it reads; None written is nothing. States are
numbers, the start is 0, and every state has a move for every symbol. `compose` builds the machine that
does what two do one after another; `minimal` joins states that no input can tell apart.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

Symbol = Hashable


@dataclass(frozen=True)
class Machine:
    """moves[state][symbol] is (next state, what is written)."""

    moves: tuple[dict[Symbol, tuple[int, Symbol | None]], ...]

    def run(self, symbols: Iterable[Symbol], state: int = 0) -> tuple[list[Symbol], int]:
        """What is written for a sequence, and the state after it."""
        out = []
        for s in symbols:
            state, made = self.moves[state][s]
            if made is not None:
                out.append(made)
        return out, state


def machine(start: Hashable, alphabet: Iterable[Symbol], step: Callable[[Hashable, Symbol], tuple[Hashable, Symbol | None]]) -> Machine:
    """The table of a rule (state, symbol) -> (next state, written), of the states that can be reached."""
    alphabet, number, moves, todo = list(alphabet), {start: 0}, [], [start]
    for state in todo:  # grows as states are met
        row = {}
        for s in alphabet:
            after, made = step(state, s)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row[s] = (number[after], made)
        moves.append(row)
    return Machine(tuple(moves))


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds what `first` writes to `second`."""

    def step(state: tuple[int, int], symbol: Symbol):
        a, made = first.moves[state[0]][symbol]
        if made is None:
            return (a, state[1]), None
        b, made = second.moves[state[1]][made]
        return (a, b), made

    return machine((0, 0), first.moves[0], step)


def minimal(whole: Machine) -> Machine:
    """The least machine of the same behaviour: states are split until members of a class write alike and move to like classes."""
    alphabet = list(whole.moves[0])
    kind = [0] * len(whole.moves)
    count = 0
    while True:
        seen: dict[tuple, int] = {}
        marks = [(kind[n], tuple((kind[row[s][0]], row[s][1]) for s in alphabet)) for n, row in enumerate(whole.moves)]
        kind = [seen.setdefault(m, len(seen)) for m in marks]
        if len(seen) == count:
            break
        count = len(seen)
    chosen: dict[int, int] = {}
    for n, k in enumerate(kind):
        chosen.setdefault(k, n)  # classes are numbered as they are met, so that of the start is 0
    return Machine(tuple({s: (kind[whole.moves[n][s][0]], whole.moves[n][s][1]) for s in alphabet} for n in chosen.values()))

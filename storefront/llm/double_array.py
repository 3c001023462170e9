"""Double-array tries over numbered symbols, built and walked with numpy.

``base`` and ``check`` hold the trie: a node s has a child by symbol c in slot
t = base[s] + c if check[t] == s. Slot 0 is the root. A trie is prefix-closed;
``accepts`` marks the phrases it was built for.

Nodes get their bases level by level, those with most children first. All nodes
of one size try a base at once, drawn from a seeded generator; those whose slots
are free and claimed by no one before them are settled, the others draw again.
At most a ROOM-th of the slots is taken, so few draws are needed.
"""

from __future__ import annotations

import numpy as np

#: Slots per node of the trie, besides one run of slots for the alphabet.
ROOM = 3
#: Slots looked at in one step of the placement.
CELLS = 1 << 21


class DoubleArray:
    """A trie of the rows of ``phrases`` (int matrix, padded with -1), whose
    symbols are numbers from 0 to ``symbols`` - 1."""

    def __init__(self, phrases: np.ndarray, symbols: int):
        phrases = np.asarray(phrases, np.int64)
        self.symbols, self.used = symbols, 1
        self._draw = np.random.default_rng(0)
        self.base, self.check = np.zeros(symbols + 2, np.int32), np.full(symbols + 2, -1, np.int32)
        self.check[0] = -2
        slot = np.zeros(len(phrases), np.int64)  # where each row's prefix ends
        for k in range(phrases.shape[1]):
            live = np.flatnonzero(phrases[:, k] >= 0)
            if not len(live):
                break
            edges = np.unique(slot[live] * symbols + phrases[live, k])
            self._place(edges // symbols, edges % symbols)
            slot[live] = self.base[slot[live]] + phrases[live, k]
        self.slots = slot
        self.accepts = np.zeros(len(self.check), bool)
        self.accepts[slot] = True
        self.accepts[0] = False

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Give slots to children (sorted by parent, then symbol) of nodes that have none yet."""
        self.used += len(parents)
        self._grow(self.symbols + 2 + ROOM * self.used)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(first, len(parents)))
        for size in np.unique(sizes)[::-1].tolist():
            nodes = first[sizes == size]
            step = max(1, CELLS // size)
            for at in range(0, len(nodes), step):
                part = nodes[at:at + step]
                self._settle(parents[part], symbols[part[:, None] + np.arange(size)])

    def _settle(self, parents: np.ndarray, own: np.ndarray) -> None:
        """Bases for nodes with equally many children (a row of symbols each)."""
        size, rounds = own.shape[1], 0
        while len(parents):
            base = self._draw.integers(1, len(self.check) - self.symbols, len(parents))
            slots = base[:, None] + own
            free = np.flatnonzero((self.check[slots] == -1).all(axis=1))
            claims = slots[free].ravel()
            winner = np.unique(claims, return_index=True)[1] // size  # of each slot, the first node that claims it
            won = free[np.bincount(winner, minlength=len(free)) == size]
            self.base[parents[won]] = base[won]
            self.check[slots[won].ravel()] = np.repeat(parents[won], size)
            rest = np.ones(len(parents), bool)
            rest[won] = False
            parents, own = parents[rest], own[rest]
            rounds += 1
            if rounds % 64 == 0:  # hardly ever: many wide nodes of one size
                self._grow(len(self.check) * 5 // 4)

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Child slots by ``symbols`` (-1: none), or -1 where there is none or the state is -1."""
        at = self.base[states] + symbols
        ok = (states >= 0) & (symbols >= 0) & (at >= 0) & (at < len(self.check))
        at = np.where(ok, at, 0)
        return np.where(ok & (self.check[at] == states), at, -1)

    def walk(self, phrases: np.ndarray) -> np.ndarray:
        """The slots that rows of symbols (padded with -1) lead to, -1 if none."""
        state = np.zeros(len(phrases), np.int64)
        for k in range(phrases.shape[1]):
            live = phrases[:, k] >= 0
            state[live] = self.advance(state[live], phrases[live, k])
        return state

"""Double-array tries over sequences of 64-bit keys, built and walked with NumPy.

A key of the alphabet is spelled by the bytes of its code, most frequent keys first, so that a node has at most 256
children and the array stays dense however many keys there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trie:
    """``child = base[state] + byte + 1`` holds where ``check[child] == state``; state 0 is the root.

    ``symbols`` are the sorted keys of the alphabet, ``codes`` their numbers, spelled by ``width`` bytes, and ``accept``
    is the number of the sequence that ends in a state, or -1.
    """

    symbols: np.ndarray
    codes: np.ndarray
    width: int
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    sequences: int

    def code(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key, -1 for keys that are in no sequence."""
        at = np.minimum(np.searchsorted(self.symbols, keys), len(self.symbols) - 1)
        return np.where(self.symbols[at] == keys, self.codes[at], -1)

    def count(self, keys: np.ndarray, linked: np.ndarray) -> np.ndarray:
        """Occurrences of each sequence among ``keys``; ``linked[i]`` tells whether i + 1 continues i.

        All positions advance together, level by level; those without a child drop out.
        """
        total = np.zeros(self.sequences, np.int64)
        if not len(self.symbols) or not len(keys):
            return total
        code = self.code(keys)
        at = np.flatnonzero(code >= 0)
        state = np.zeros(len(at), np.int32)
        while len(at):
            for digit in spelled(code[at], self.width).T:
                alive = np.flatnonzero(state >= 0)
                child = self.base[state[alive]] + digit[alive]
                state_next = np.full(len(state), -1, np.int32)
                state_next[alive] = np.where(self.check[child] == state[alive], child, -1)
                state = state_next
            alive = state >= 0
            at, state = at[alive], state[alive]
            reached = self.accept[state]
            total += np.bincount(reached[reached >= 0], minlength=self.sequences)
            alive = linked[at]
            at, state = at[alive] + 1, state[alive]
            alive = code[at] >= 0
            at, state = at[alive], state[alive]
        return total

    def weigh(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sum of ``n`` over the ``rows`` (keys; 0 fills short ones at the end) that are each sequence as a whole."""
        total = np.zeros(self.sequences, np.int64)
        if not len(self.symbols) or not len(rows):
            return total
        state = np.zeros(len(rows), np.int32)
        for keys in rows.T:
            at = np.flatnonzero((keys != 0) & (state >= 0))
            code = self.code(keys[at])
            state[at[code < 0]] = -1
            at, digits = at[code >= 0], spelled(code[code >= 0], self.width)
            for j in range(self.width):
                child = self.base[state[at]] + digits[:, j]
                found = self.check[child] == state[at]
                state[at] = np.where(found, child, -1)
                at, digits = at[found], digits[found]
        reached = np.where(state >= 0, self.accept[state], -1)
        np.add.at(total, reached[reached >= 0], n[reached >= 0])
        return total


def spelled(codes: np.ndarray, width: int) -> np.ndarray:
    """Bytes of each code, the highest first, each plus one."""
    return (codes[:, None] >> (8 * np.arange(width - 1, -1, -1))[None] & 255).astype(np.int32) + 1


def build(sequences: np.ndarray, numbers: np.ndarray, room: float = 2.0, seed: int = 7) -> Trie:
    """Trie of the rows of ``sequences`` (keys; 0 fills short rows at the end); row i is accepted as ``numbers[i]``.

    Children of one node take the slots base + byte + 1.  Nodes draw their bases at random, those with many children
    first, and keep them if no slot is taken.  ``room`` times the number of nodes is the space; a node that finds no place
    gets one at the end.
    """
    filled = sequences != 0
    symbols, uses = np.unique(sequences[filled], return_counts=True)
    codes = np.zeros(len(symbols), np.int64)
    codes[np.argsort(-uses, kind="stable")] = np.arange(len(symbols))
    width = max(1, -(-max(len(symbols) - 1, 1).bit_length() // 8))
    place = np.minimum(np.searchsorted(symbols, sequences), max(len(symbols) - 1, 0))
    digits = np.where(filled[:, :, None], spelled(codes[place].ravel(), width).reshape(*sequences.shape, width), 0) if len(symbols) else np.zeros((0, 0, 1), int)
    digits = digits.reshape(len(sequences), -1)
    # nodes are numbered from the root (0) on; a node is a distinct prefix
    node, parents, letters, count = np.zeros(len(digits), np.int64), [], [], 1
    for level in range(digits.shape[1]):
        has = np.flatnonzero(digits[:, level])
        pairs, which = np.unique(node[has] * 257 + digits[has, level], return_inverse=True)
        parents.append(pairs // 257)
        letters.append(pairs % 257)
        node[has] = which + count
        count += len(pairs)
    parent = np.concatenate([[0], *parents]).astype(np.int64)
    letter = np.concatenate([[0], *letters]).astype(np.int64)
    base, slots = _place(parent, letter, room, np.random.default_rng(seed))
    state = np.zeros(count, np.int64)
    state[1:] = base[parent[1:]] + letter[1:]
    out = Trie(symbols, codes, width, np.zeros(slots, np.int32), np.full(slots, -1, np.int32), np.full(slots, -1, np.int32), int(numbers.max(initial=-1)) + 1)
    out.base[state] = base
    out.check[state[1:]] = state[parent[1:]]
    out.accept[state[node]] = numbers
    return out


def _place(parent: np.ndarray, letter: np.ndarray, room: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Base of each node, and the number of slots that any base + byte + 1 stays within."""
    children = np.bincount(parent[1:], minlength=len(parent))
    first = np.concatenate([[0], np.cumsum(children)])
    letters = letter[1:][np.argsort(parent[1:], kind="stable")]
    span = int(room * len(parent)) + 64
    used = np.zeros(span + 257, bool)
    used[0] = True
    base = np.zeros(len(parent), np.int64)
    waiting = np.flatnonzero(children)
    waiting = waiting[np.argsort(-children[waiting], kind="stable")]
    late = []
    for n in waiting[:int((children[waiting] >= 32).sum())].tolist():
        mine = letters[first[n]:first[n + 1]]
        for b in rng.integers(0, span, 50).tolist():
            if not used[b + mine].any():
                base[n] = b
                used[b + mine] = True
                break
        else:
            late.append(n)
    waiting = waiting[int((children[waiting] >= 32).sum()):]
    for size in (32, 16, 8, 4, 2, 1):
        group = waiting[(children[waiting] <= size) & (children[waiting] > size // 2)]
        for _ in range(60):
            if not len(group):
                break
            sizes = children[group]
            owner = np.repeat(np.arange(len(group)), sizes)
            mine = letters[np.repeat(first[group], sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            drawn = rng.integers(0, span, len(group))
            slot = drawn[owner] + mine
            order = np.argsort(slot, kind="stable")
            again = np.zeros(len(slot), bool)
            again[order[1:]] = slot[order[1:]] == slot[order[:-1]]
            lost = np.bincount(owner[used[slot] | again], minlength=len(group)) > 0
            base[group[~lost]] = drawn[~lost]
            used[slot[~lost[owner]]] = True
            group = group[lost]
        late += group.tolist()
    base[late] = len(used) + 257 * np.arange(len(late))
    return base, len(used) + 257 * len(late)

"""A minimal acyclic transducer over sorted terms: the number of a term is its place in byte order."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Arcs sorted by (state, byte), each with its target and the number of terms that it steps over.

    States with the same continuations are one state. The numbers along the path of a term add up to its ordinal.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.targets, self.skips, self.final, self.root = keys, targets, skips, final, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending byte order. An open path is closed from its end, state by state."""
        known: dict[tuple, int] = {}
        finals: list[bool] = []
        sizes: list[int] = []
        arcs: list[tuple[int, int, int, int]] = []
        path: list[list] = [[False, []]]

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = known.get(key)
            if state is None:
                state = known[key] = len(finals)
                passed = int(node[0])
                for byte, target in node[1]:
                    arcs.append((state, byte, target, passed))
                    passed += sizes[target]
                finals.append(node[0])
                sizes.append(passed)
            return state

        def shorten(depth: int) -> None:
            while len(path) > depth + 1:
                state = close(path.pop())
                path[-1][1][-1] = (path[-1][1][-1][0], state)

        before = b""
        for term in terms:
            if before and term <= before:
                raise ValueError("terms are not in ascending order")
            same = 0
            while same < min(len(before), len(term)) and before[same] == term[same]:
                same += 1
            shorten(same)
            for byte in term[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = term
        shorten(0)
        root = close(path[0])
        table = np.array(arcs, np.int64).reshape(-1, 4)
        keys = table[:, 0] * 256 + table[:, 1]
        order = np.argsort(keys)
        return cls(keys[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32), np.array(finals, bool), root)

    def parts(self) -> tuple[bytes, bytes, bytes, bytes, int]:
        return self.keys.tobytes(), self.targets.tobytes(), self.skips.tobytes(), self.final.tobytes(), self.root

    @classmethod
    def of_parts(cls, keys: bytes, targets: bytes, skips: bytes, final: bytes, root: int) -> Transducer:
        kinds = (np.int64, np.int32, np.int32, bool)
        return cls(*(np.frombuffer(b, k) for b, k in zip((keys, targets, skips, final), kinds, strict=True)), root)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the byte spans, -1 where a span is not a term. All spans take a step at once."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        left, at = np.arange(len(starts)), starts.astype(np.int64)
        state, passed = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        while len(left):
            over = at >= ends[left]
            ended = over & self.final[state]
            out[left[ended]] = passed[ended]
            left, at, state, passed = (x[~over] for x in (left, at, state, passed))
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            arc, left = arc[hit], left[hit]
            at, state, passed = at[hit] + 1, self.targets[arc].astype(np.int64), passed[hit] + self.skips[arc]
        return out

"""Search for many patterns at once, overlapping hits included."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Bytes that one lane of a pass reads.
LANE = 1024


class Automaton:
    """A finite automaton of byte patterns (none of them empty or with a zero byte), as one table of transitions.

    Rows are laid one after the other with a zero byte between, which leads back to the start.  As a state depends on the
    last bytes only, as many as the longest pattern has, the bytes are cut into lanes that overlap by so many, and all
    lanes take a step at a time: a pass is one table look-up a byte, whatever the number of patterns.
    """

    def __init__(self, patterns: list[bytes]):
        if not patterns or any(not p or 0 in p for p in patterns):
            raise ValueError("patterns have one byte at least, and none that is zero")
        self.patterns = patterns
        self.longest = max(map(len, patterns))
        steps: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, pattern in enumerate(patterns):
            at = 0
            for byte in pattern:
                if byte not in steps[at]:
                    steps[at][byte] = len(steps)
                    steps.append({})
                    ends.append([])
                at = steps[at][byte]
            ends[at].append(number)
        self.next = np.zeros((len(steps), 256), np.int32)
        back = [0] * len(steps)  # the longest proper suffix that is a state
        queue = deque()
        for byte, to in steps[0].items():
            self.next[0, byte] = to
            queue.append(to)
        while queue:
            state = queue.popleft()
            ends[state] = ends[state] + ends[back[state]]
            self.next[state] = self.next[back[state]]
            for byte, to in steps[state].items():
                back[to] = int(self.next[state, byte])
                self.next[state, byte] = to
                queue.append(to)
        self.first_end = np.cumsum([0] + [len(x) for x in ends])
        self.ends = np.array([x for own in ends for x in own], np.int64)

    def hits(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place after the last byte within the row, number of the pattern) of every hit, by row and place."""
        return self.hits_in(*joined(rows))

    def hits_in(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of rows that are laid out by `joined`."""
        lead = self.longest - 1
        lanes = -(-len(raw) // LANE) or 1
        padded = np.zeros(lead + lanes * LANE, np.uint8)
        padded[lead : lead + len(raw)] = raw
        # one column a lane, so that a step reads neighbours
        view = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (LANE + lead, lanes), (1, LANE)))
        has = np.diff(self.first_end) > 0
        state = np.zeros(lanes, np.int32)
        table = self.next.ravel()
        spots, states = [], []
        for step in range(LANE + lead):
            state = table[state * 256 + view[step]]
            if step >= lead:
                lane = np.flatnonzero(has[state])
                if len(lane):
                    spots.append(lane * LANE + step - lead)
                    states.append(state[lane])
        if not spots:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        spot, state = np.concatenate(spots), np.concatenate(states)
        order = np.argsort(spot, kind="stable")
        spot, state = spot[order], state[order]
        each = self.first_end[state + 1] - self.first_end[state]
        k = np.repeat(self.first_end[state], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        spot = np.repeat(spot, each)
        row = np.searchsorted(offsets, spot, "right") - 1
        return row, spot + 1 - offsets[row], self.ends[k]


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a zero byte after each, and where each begins (one place more than rows)."""
    sizes = np.array([len(x) + 1 for x in rows], np.int64)
    return np.frombuffer(b"\0".join(rows) + b"\0", np.uint8) if rows else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])

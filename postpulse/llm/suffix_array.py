"""Two-stage suffix sorting and adjacent common prefixes over byte strings.

Suffixes that are smaller than their successor are sorted directly; every other suffix
is larger than its successor, so one scan over the buckets in alphabetical order puts
it behind those already placed: the suffix one byte to the left of a sorted suffix is
appended to the bucket of its own first byte. Scans work on whole buckets with numpy.
"""

from __future__ import annotations

import numpy as np


class Block:
    """The strings of one block in one array, a zero byte after each.

    Only suffixes starting at the first ``starts[k]`` bytes of string k are asked for; those
    behind them are left out, but for the few that the scan needs to reach a directly
    sorted one. Order is exact to ``depth`` bytes.
    """

    def __init__(self, strings: list[bytes], starts: list[int], depth: int):
        self.depth = depth
        self.raw = b"\0".join(strings) + b"\0" + b"\0" * 8
        self.text = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.end = self.begin + sizes                     # place of the zero byte
        self.asked = self.begin + np.asarray(starts, dtype=np.int64)   # end of what is asked for
        self._types()

    def _types(self) -> None:
        """smaller[i]: the suffix at i is smaller than the one at i + 1."""
        n = int(self.end[-1]) + 1
        text = self.text[:n + 1].astype(np.int16)
        text[self.end] = -1                               # an end is below every byte
        turn = text[:n] != text[1:n + 1]
        turn[self.end] = True
        at = np.flatnonzero(turn)
        up = text[at] < text[at + 1]
        up[np.isin(at, self.end)] = True                  # the end itself is sorted directly
        self.smaller = np.repeat(up, np.diff(at, prepend=-1))
        following = np.flatnonzero(self.smaller)          # every end is one of them
        last = following[np.searchsorted(following, self.asked)]
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, self.begin, 1)
        np.add.at(mark, np.minimum(last, self.end) + 1, -1)
        self.needed = np.cumsum(mark[:n]) > 0
        self.first = np.zeros(n, bool)
        self.first[self.begin] = True

    def order(self) -> np.ndarray:
        """Needed suffixes in order, equal ones (to ``depth`` bytes) next to each other."""
        raw, depth = self.raw, self.depth
        induced = self.needed & ~self.smaller
        direct = np.flatnonzero(self.needed & self.smaller)
        is_end = np.zeros(len(self.needed), bool)
        is_end[self.end] = True
        ends, direct = direct[is_end[direct]], direct[~is_end[direct]]
        limit = np.minimum(direct + depth, self.end[np.searchsorted(self.end, direct)])
        keys = [raw[a:b] for a, b in zip(direct.tolist(), limit.tolist())]
        by_key = sorted(range(len(keys)), key=keys.__getitem__)
        del keys
        direct = direct[np.array(by_key, dtype=np.int64)]
        cut = np.searchsorted(self.text[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

        def deal(placed: np.ndarray) -> None:
            left = placed[~self.first[placed]] - 1
            left = left[induced[left]]
            if len(left):
                byte = self.text[left]
                by_byte = np.argsort(byte, kind="stable")
                left, byte = left[by_byte], byte[by_byte]
                edge = np.flatnonzero(np.diff(byte)) + 1
                for part, b in zip(np.split(left, edge), byte[np.concatenate([[0], edge])].tolist()):
                    waiting[b].append(part)

        deal(ends)
        out = []
        for b in range(256):
            while waiting[b]:                             # runs of one byte come in waves
                wave = np.concatenate(waiting[b])
                waiting[b] = []
                out.append(wave)
                deal(wave)
            own = direct[cut[b]:cut[b + 1]]
            if len(own):
                out.append(own)
                deal(own)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repeated(self) -> list[np.ndarray]:
        """Per string, which of its asked-for places start a ``depth``-byte string that
        another asked-for place of the block starts too."""
        suffixes = self.order()
        string = np.searchsorted(self.end, suffixes)
        suffixes = suffixes[suffixes < self.asked[string]]
        same = self._equal(suffixes[:-1], suffixes[1:])
        again = np.zeros(len(self.needed), bool)
        again[suffixes[:-1][same]] = True
        again[suffixes[1:][same]] = True
        return [again[a:b] for a, b in zip(self.begin.tolist(), self.asked.tolist())]

    def _equal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether adjacent suffixes have a common prefix of ``depth`` bytes."""
        words = np.ndarray((len(self.text) - 7,), "<u8", self.raw, 0, (1,))
        common = np.zeros(len(left), np.int32)
        alive = np.arange(len(left))
        for k in [*range(0, self.depth - 7, 8), self.depth - 8]:
            alive = alive[words[left[alive] + k] == words[right[alive] + k]]
            if not len(alive):
                break
        common[alive] = self.depth
        return common >= self.depth

"""A suffix automaton of several words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Of all the given words, each a sequence of small integers."""

    def __init__(self, words: Iterable[Sequence[int]]) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for word in words:
            last = 0
            for c in word:
                if c in nxt[last]:
                    q = nxt[last][c]
                    last = q if length[q] == length[last] + 1 else self._clone(nxt, link, length, last, c, q)
                    continue
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(nxt, link, length, p, c, q)
                last = cur
        self.next, self.link, self.length = nxt, link, length

    @staticmethod
    def _clone(nxt: list, link: list, length: list, p: int, c: int, q: int) -> int:
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def state(self, word: Sequence[int]) -> int:
        s = 0
        for c in word:
            s = self.next[s][c]
        return s

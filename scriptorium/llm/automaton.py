"""A generalised suffix automaton over sequences of words."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Accepts every run of words of the sequences added to it; each addition is linear.

    Sequences have owners; of each state it is known who its first two owners are, which
    tells for any owner whether another one has its runs.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owners: list[tuple] = [()]

    def _new(self, length: int, moves: dict, link: int, owners: tuple) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        self.owners.append(owners)
        return len(self.length) - 1

    def _own(self, state: int, owner: Hashable) -> None:
        """Gives the runs of a state, and all their suffixes, an owner; who has a run has its suffixes."""
        while state > 0 and len(self.owners[state]) < 2 and owner not in self.owners[state]:
            self.owners[state] += (owner,)
            state = self.link[state]

    def _other(self, state: int, owner: Hashable) -> bool:
        return any(o != owner for o in self.owners[state])

    def _split(self, state: int, word: Hashable, target: int) -> int:
        """The state for the runs of `target` up to one word longer than `state`."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target], self.owners[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: Iterable[Hashable], owner: Hashable = "") -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
                self._own(last, owner)
                continue
            new = self._new(self.length[last] + 1, {}, 0, ())
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word, self.next[state][word])
            last = new
            self._own(last, owner)

    def inherited(self, words: Sequence[Hashable], least: int, owner: Hashable = object()) -> list[bool]:
        """For each word whether it is within a run of `least` or more words that another owner's sequence has."""
        out = [False] * len(words)
        state, length, marked = 0, 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
            while state and not self._other(state, owner):
                state = self.link[state]
                length = self.length[state]
            if length >= least:
                for k in range(max(marked, i - length + 1), i + 1):
                    out[k] = True
                marked = i + 1
        return out

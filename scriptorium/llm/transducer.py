"""Byte-pair merges compiled into a lazily determinised finite-state transducer.

A token sequence is the one the merges give exactly if each pair of neighbouring tokens is
(each pair alone is merged to just these two). So the non-deterministic transducer has the
states (token before, node of the vocabulary's trie); it reads a byte, and at a node that
is a token which may follow the one before, it may emit it and return to the root. At any
prefix of the text just one path stands at the root. Determinised, a state is the set of
live paths with what each has yet to emit; what all have in common is emitted at once, so
the lookahead is bounded by the longest token. States and their moves are made when first
met and kept in a table that is emptied at a fixed size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import regex

#: Table sizes at which a worker starts afresh; results don't depend on them.
MAX_STATES = 200_000
MAX_PIECES = 200_000
MAX_PAIRS = 2_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from the lines `base64 id`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encodes byte strings one byte at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            if self._merge(token) != [i]:
                continue  # no text is merged to it
            node = 0
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self.ids = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple]]] = [{}]
        self.finals: list[tuple | None] = [()]

    def _merge(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first; used for single tokens and pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _may_follow(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(self.tokens[before] + self.tokens[token]) == [before, token]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        paths = []
        for before, node, due in self.states[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                paths.append((before, nxt, due))
            token = self.token_at[nxt]
            if token >= 0 and self._may_follow(before, token):
                paths.append((token, 0, (*due, token)))
        if not paths:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        shared = 0
        first = paths[0][2]
        while all(len(p[2]) > shared and p[2][shared] == first[shared] for p in paths) and shared < len(first):
            shared += 1
        emitted = first[:shared]
        key = tuple(sorted((b, n, d[shared:]) for b, n, d in paths))
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.finals.append(next((d for _, n, d in key if n == 0), None))
        self.moves[state][byte] = (target, emitted)
        return target, emitted

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text."""
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            step = moves[state].get(byte)
            if step is None:
                step = self._move(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.finals[state]
        return out


class Encoder:
    """Texts to ids: split by the tokenizer's pattern, each piece through the transducer."""

    def __init__(self, ranks_data: bytes, pattern: str):
        self.transducer = Transducer(read_ranks(ranks_data))
        self.pattern = regex.compile(pattern)
        self.held: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.held.get(text)
        if ids is None:
            ids = self.transducer.encode(text.encode("utf-8", "replace"))
            if len(text) <= 64:
                if len(self.held) > MAX_PIECES:
                    self.held.clear()
                self.held[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        out: list[int] = []
        if text:
            piece = self.piece
            for found in self.pattern.findall(text):
                out += piece(found)
        return out

    def count(self, text: str | None) -> int:
        piece = self.piece
        return sum(len(piece(found)) for found in self.pattern.findall(text)) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8()
        return "".join(machine.feed(self.transducer.tokens[i]) for i in ids) + machine.close()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as the ids come in; a character split over tokens comes with its last."""
        machine = Utf8()
        for i in ids:
            text = machine.feed(self.transducer.tokens[i])
            if text:
                yield text
        if text := machine.close():
            yield text


class Utf8:
    """An incremental UTF-8 machine: states are the bytes still due and the next byte's range.

    A malformed sequence gives U+FFFD once for its longest well-formed beginning.
    """

    def __init__(self) -> None:
        self.due = 0
        self.value = 0
        self.low, self.high = 0x80, 0xBF

    def _lead(self, byte: int) -> str:
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            return chr(byte)
        if 0xC2 <= byte <= 0xDF:
            self.due, self.value = 1, byte & 0x1F
        elif 0xE0 <= byte <= 0xEF:
            self.due, self.value = 2, byte & 0x0F
            self.low = 0xA0 if byte == 0xE0 else 0x80
            self.high = 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.due, self.value = 3, byte & 0x07
            self.low = 0x90 if byte == 0xF0 else 0x80
            self.high = 0x8F if byte == 0xF4 else 0xBF
        else:
            return "�"
        return ""

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if not self.due:
                out.append(self._lead(byte))
            elif self.low <= byte <= self.high:
                self.value = self.value << 6 | byte & 0x3F
                self.due -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.due:
                    out.append(chr(self.value))
            else:
                self.due = 0
                out.append("�")
                out.append(self._lead(byte))
        return "".join(out)

    def close(self) -> str:
        cut, self.due = self.due, 0
        return "�" if cut else ""

"""Byte-level BPE as a streaming transducer with bounded lookahead.

The merge list itself tells how far to the right a token boundary can be influenced. Let a rule (x, y) merge across a
boundary. It needs y to stand there, which the bytes of y decide, unless some token s on the right edge of y is first taken by
a rule (s, z) of lower rank than the rule that would use s on the way to y, or than (x, y) itself where s is y. Ranks fall strictly along such
a chain, so the reach of a rule is ``len(y)`` plus the largest reach of a rule that can interfere, and is found for
all rules in rank order. The largest reach of any rule is the merge list's sufficient lookahead: a token that ends that many bytes before the
end of what has been read is the same whatever follows.

The transducer reads bytes, merges inside a buffer of bounded size, emits the tokens that are stable and keeps the
rest; no merge crosses a boundary that stays, so the rest can be merged afresh from there. A token is stable as soon as the
lookahead has been read behind it, or its piece has ended. Every piece of every text takes this way, whatever
its length; the table of pieces only remembers what the transducer gave for a piece that lies within the lookahead.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import regex

#: How the texts of the byte-level rank files are split before merging: a fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
_CLASSES = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]
#: Characters that are split at a time, bytes that the transducer takes up before it emits, and pieces whose ids are kept.
SLICE, BLOCK, KEPT = 4_096, 256, 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class MergeList:
    """Ranks of byte strings: of two neighbours whose joint string has the least rank, the leftmost merge first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._lookahead: int | None = None

    def merge(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Tokens of a whole byte string; ``below``: only merges of a lower rank."""
        return self._merge_short(piece, below) if len(piece) < 80 else self._merge_long(piece, below)

    def _merge_short(self, piece: bytes, below: int | None) -> list[bytes]:
        rank, none = self.ranks.get, 1 << 60
        limit = none if below is None else below
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < limit:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, piece: bytes, below: int | None) -> list[bytes]:
        """The same with a heap over a linked list, for long pieces."""
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if below is not None and r >= below:
                break
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def lookahead(self) -> int:
        """Bytes after a token's end that decide it, whatever follows them.

        `ValueError` where a byte has no token, or a token's own bytes don't merge to it: such a list has no merges to reckon with.
        """
        if self._lookahead is None:
            if lost := [i for i in range(256) if bytes([i]) not in self.ranks]:
                raise ValueError(f"no token for the bytes {lost}")
            parts: dict[bytes, tuple[bytes, bytes]] = {}
            taken: dict[bytes, tuple[list[int], list[int]]] = {}  # by left token: ranks of its rules, largest reach up to each
            most = 1
            for token, r in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) < 2:
                    continue
                if len(two := self.merge(token, below=r)) != 2:
                    raise ValueError(f"no merge reaches the token {token!r}")
                x, y = parts[token] = (two[0], two[1])
                reach, s, limit = 0, y, r
                while True:
                    if (own := taken.get(s)) and (k := bisect_left(own[0], limit)):
                        reach = max(reach, own[1][k - 1])
                    if s not in parts:
                        break
                    limit, s = self.ranks[s], parts[s][1]
                reach += len(y)
                ranks, reaches = taken.setdefault(x, ([], []))
                ranks.append(r)
                reaches.append(max(reach, reaches[-1] if reaches else 0))
                most = max(most, reach)
            self._lookahead = most
        return self._lookahead


class Transducer:
    """Bytes of one piece after another in, ids of stable tokens out; holds at most two blocks and the lookahead."""

    def __init__(self, merges: MergeList, block: int = BLOCK) -> None:
        self.merges, self.block, self.held, self.ahead = merges, block, b"", merges.lookahead()

    def push(self, data: bytes) -> Iterator[int]:
        """Ids that no further byte of the piece can change."""
        for i in range(0, len(data), self.block):
            self.held += data[i : i + self.block]
            if len(self.held) > self.block + self.ahead:
                at = 0
                for token in self.merges.merge(self.held):
                    if at + len(token) > len(self.held) - self.ahead:
                        break
                    at += len(token)
                    yield self.merges.ranks[token]
                self.held = self.held[at:]

    def finish(self) -> Iterator[int]:
        """The other ids of the piece, which ends here."""
        rest, self.held = self.held, b""
        yield from (self.merges.ranks[t] for t in self.merges.merge(rest))


class Encoder(dict):
    """Texts to ids. As a dict it is the table of what the transducer gave for short pieces, at most ``KEPT``."""

    def __init__(self, merges: MergeList, slice_chars: int = SLICE, block: int = BLOCK) -> None:
        super().__init__()
        self.merges, self.slice, self.block = merges, slice_chars, block
        self.transducer = Transducer(merges, block)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data, t = piece.encode(), self.transducer
        ids = (*t.push(data), *t.finish())
        if len(data) <= t.ahead:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        """Ids of a text; none for an empty or null text."""
        return array("i", chain.from_iterable(self.stream(text[i : i + self.slice] for i in range(0, len(text or ""), self.slice))))

    def stream(self, slices: Iterable[str]) -> Iterator[Iterable[int]]:
        """Ids of a text that comes in slices, piece by piece, with memory for a few slices only.

        What follows can change at most the last two pieces seen (a contraction takes up to three characters), so these wait for the next
        slice; of a piece that grows beyond two slices the stable ids are given before it ends.
        """
        held, run, kind = "", None, None
        for part in slices:
            if held and run is None:
                pieces = _SPLIT.findall(held)
                yield from map(self.__getitem__, pieces[:-2])
                held = "".join(pieces[-2:])
                if len(pieces[-1]) > 2 * self.slice:
                    last = pieces[-1]
                    yield from map(self.__getitem__, pieces[-2:-1])
                    run, kind = Transducer(self.merges, self.block), next(c for c in _CLASSES if c.match(last[-1]))
                    n = len(last) - (kind is _CLASSES[2])
                    yield run.push(last[:n].encode())
                    held = last[n:]
            held += part
            if run is not None:
                same = kind.match(held)
                # the last white space before another character is a piece of its own or leads the next one
                n = (same.end() if same else 0) - (kind is _CLASSES[2])
                if n > 0:
                    yield run.push(held[:n].encode())
                    held = held[n:]
                if len(held) > (kind is _CLASSES[2]) or (held and not kind.match(held)):
                    yield run.finish()
                    run = None
        if run is not None:
            yield run.push(held.encode())
            yield run.finish()
        else:
            yield from map(self.__getitem__, _SPLIT.findall(held))


class Decoder:
    """Ids to text, a few at a time: an incremental UTF-8 state machine keeps the bytes of an unfinished character."""

    def __init__(self, merges: MergeList, errors: str = "replace") -> None:
        self.tokens, self.state = merges.tokens, codecs.getincrementaldecoder("utf-8")(errors)

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)

    def decode(self, ids: Iterable[int] | None) -> str:
        self.state.reset()
        return self.push(ids or ()) + self.finish()

"""Byte-pair merging of one pre-token with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class RankQueue:
    """Buckets of linked-list positions, one for each merge rank, under three levels of 64-way bitmaps.

    A set bit says that something below it is not empty; find-first-set from the top gives the least rank in three
    steps, whatever the length of the pre-token. Entries are never removed when they become stale, only skipped.
    """

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self) -> None:
        self.top, self.mid, self.low, self.buckets = 0, {}, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def least(self) -> int:
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        return a << 6 | (w & -w).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all adjacent pairs the one of least rank is merged first, the leftmost among equals."""
    whole = ranks.get(token)
    if whole is not None:
        return [whole]
    n = len(token)
    end = list(range(1, n + 1))  # the part at i is token[i:end[i]]
    before = list(range(-1, n - 1))
    at = [-1] * n  # rank of the part at i with the next one, -1: none or no such part
    queue = RankQueue()
    push, get = queue.push, ranks.get
    for i in range(n - 1):
        r = get(token[i : i + 2])
        if r is not None:
            at[i] = r
            push(r, i)
    while queue.top:
        rank = queue.least()
        places = sorted(queue.take(rank))
        for k, i in enumerate(places):
            if at[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            at[j] = at[i] = -1
            lower = False
            if stop < n:
                before[stop] = i
                r = get(token[i : end[stop]])
                if r is not None:
                    at[i] = r
                    push(r, i)
                    lower = r < rank
            p = before[i]
            if p >= 0:
                r = get(token[p:stop])
                if r is not None:
                    at[p] = r
                    push(r, p)
                    lower |= r < rank
                else:
                    at[p] = -1
            if lower:  # a pair made just now goes first; the rest of this bucket waits
                for rest in places[k + 1 :]:
                    push(rank, rest)
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i : end[i]]])
        i = end[i]
    return ids

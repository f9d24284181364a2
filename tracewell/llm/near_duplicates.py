"""Near-duplicate records: T-occurrence search over word shingles, in the manner of DivideSkip.

The inverted lists of all shingles are split in two for each record: of a record with n shingles that must share T of
them with another, the T - K longest lists are set aside, and the short ones are merged. What occurs at least K times in
the short lists of both is a candidate, and its shingles are then probed in the long ones by binary search. All pairs
that reach the overlap are found: a pair that shares T shingles shares at least K in the first n - T + K of each. Where
T is less than K, as with records that repeat few shingles, all their lists are short and T occurrences are enough.

Lists are told long from short by their lengths, counted for all shingles of all records: records go in chunks, a chunk
asks each range of shingles for its lists' lengths, and the answers meet the chunk again. Nothing of this grows but the
number of chunks and ranges. A short list that is long all the same, as its records have only such, is split into groups
of records, and each pair of groups is merged by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import pin, spread

SHINGLE, MIN_WORDS, SIMILARITY = 3, 40, 0.5
#: Occurrences in short lists that make a candidate (K above).
SHORT_HITS = 4
#: Bytes of text for which there is one range of shingle hashes, and the most ranges.
RANGE_BYTES, MOST_RANGES = 20_000_000, 16_384
#: Bits of a shingle's hash by which lists are told apart; verification uses 64.
BITS = 48
#: Records of a short list that are merged at once; a longer one is split.
LIST = 512
#: Postings of a chunk of records; pairs that one task's arrays hold at a time.
CHUNK = 1_000_000
#: Characters that are taken at a time.
CHARACTERS = 500_000
#: A filter for classes has 2 ** FILTER_BITS bits.
FILTER_BITS = 24

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NONE, _ONE = np.zeros(1, np.uint64), np.ones(1, np.uint64)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = int(_MIX[0])
    return tuple(np.cumprod(np.concatenate([_ONE, np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 2**64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


def _pieces(low: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts with the number of each, as lists of about CHARACTERS characters; a longer text is cut between words."""
    held, owners, size = [], [], 0
    for i, t in enumerate(low):
        at = 0
        while at < len(t) or (at == 0 and not t):
            end = min(len(t), at + CHARACTERS)
            while at < end < len(t) and t[end - 1].isalnum() and t[end].isalnum():
                end -= 1
            if end == at and t:  # within one word
                end = at + CHARACTERS
                while end < len(t) and t[end].isalnum():
                    end += 1
            held.append(t[at:end])
            owners.append(i)
            size += end - at
            at = max(end, at + 1)
            if size >= CHARACTERS:
                yield held, owners
                held, owners, size = [], [], 0
    yield held, owners


def _word_hashes(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of lower-case texts and the number of its text: differences of one running sum over all characters, moved to the same place."""
    hashes, texts = [], []
    for pieces, owners in _pieces(low):
        codes = np.frombuffer(" ".join(pieces).encode("utf-32-le"), np.uint32)
        edge = np.diff(np.concatenate([[False], _letters()[codes], [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(1 << max(10, len(codes).bit_length()))
        total = np.concatenate([_NONE, np.cumsum((codes + np.uint32(1)).astype(np.uint64) * up[: len(codes)])])
        hashes.append(_mixed((total[end] - total[begin]) * down[begin]))
        ends = np.cumsum([len(t) + 1 for t in pieces])
        texts.append(np.asarray(owners, np.int64)[np.searchsorted(ends, begin, side="right")])
    return np.concatenate(hashes), np.concatenate(texts)


class Shingles:
    """Distinct shingles of a batch of texts as 64-bit hashes: kept (places of the texts with enough words), cls (hash of all words of each), starts and hashes (sorted within a text)."""

    def __init__(self, texts: list[str], width: int, min_words: int) -> None:
        words, doc = _word_hashes([(t or "").lower() for t in texts])
        count = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(count) - count
        place = (np.arange(len(words)) - first[doc]).astype(np.uint64)
        sums = np.concatenate([_NONE, np.cumsum(_mixed(words + (place + np.uint64(1)) * _MIX[0]))])
        self.kept = np.flatnonzero(count >= max(min_words, width))
        whole = _mixed(sums[first[self.kept] + count[self.kept]] - sums[first[self.kept]] + count[self.kept].astype(np.uint64))
        self.cls = whole.astype(np.int64)
        n = len(words) - width + 1
        if n <= 0 or not len(self.kept):
            self.hashes, self.starts = np.zeros(0, np.uint64), np.zeros(len(self.kept) + 1, np.int64)
            return
        s = np.zeros(n, np.uint64)
        for i in range(width):
            s = (s ^ (s >> np.uint64(31))) * _MIX[0] + words[i : i + n] * _MIX[1]
        s = _mixed(s)
        number = np.full(len(texts), -1)
        number[self.kept] = np.arange(len(self.kept))
        own = number[doc[:n]]
        good = (doc[:n] == doc[width - 1 :]) & (own >= 0)
        s, own = s[good], own[good]
        order = np.lexsort((s, own))
        s, own = s[order], own[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
        self.hashes, own = s[new], own[new]
        self.starts = np.searchsorted(own, np.arange(len(self.kept) + 1))


def shingled(texts: list[str | None], shingler: tuple[int, int]) -> Iterator[tuple[int, Shingles]]:
    """The shingles of texts in chunks of bounded size, with the place of each chunk's first text."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size < CHARACTERS):
            size += len(texts[to] or "")
            to += 1
        yield at, Shingles(texts[at:to], *shingler)
        at = to


def _put(*columns: np.ndarray) -> bytes:
    """Columns of numbers as bytes: of each the lowest bytes of all numbers, then the next ones, as far as they are not all zero."""
    out = []
    for c in columns:
        planes = np.ascontiguousarray(c.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
        used = max((i + 1 for i in range(8) if planes[:, i].any()), default=0)
        out += [struct.pack("<IB", len(c), used), np.ascontiguousarray(planes[:, :used].T).tobytes()]
    return b"".join(out)


def _take(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, used = struct.unpack_from("<IB", blob, at)
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :used] = np.frombuffer(blob, np.uint8, n * used, at + 5).reshape(used, n).T
        out.append(planes.view(np.uint64).ravel())
        at += 5 + n * used
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _join(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The columns of several blobs, each with ascending numbers first."""
    parts = [_take(b) for b in blobs]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=np.uint64)
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(n)]


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_ROW = "to int, chunk bigint, part int, blob binary"
_ROW_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
_ROW_NAMES = ["to", "chunk", "part", "blob"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(_ROW_NAMES, _ROW_KINDS, rows)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash of BITS bits; ranges ascend with the hashes."""
    return ((h >> np.uint64(BITS - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _home(chunk: int, ranges: int) -> int:
    """Where a chunk's answers meet: chunks of one task and those of one number go round the ranges."""
    return ((chunk >> 32) + (chunk & 0xFFFFFFFF) * 7) % ranges


def _ask(shingler: tuple[int, int], ranges: int, most: int):
    """Chunks of records: to each range the chunk's distinct shingles with how many of its records have them (part is the range), and home what the chunk needs again (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # hashes of each class: equal records of a chunk are one
        size, number, partition = 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            chunk = (partition << 32) + number
            sizes = np.array([len(x) for x in held.values()], np.uint64)
            h = np.concatenate([*held.values(), np.zeros(0, np.uint64)]) >> np.uint64(64 - BITS)
            own = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            distinct, times = h[first], np.diff(np.append(first, len(h)))
            at = np.searchsorted(_range_of(distinct, ranges), np.arange(ranges + 1))
            rows = [(p, chunk, p, _put(_steps(distinct[at[p] : at[p + 1]]), times[at[p] : at[p + 1]])) for p in np.flatnonzero(np.diff(at)).tolist()]
            rows.append((_home(chunk, ranges), chunk, -1, _put(np.fromiter(held, np.int64, len(held)).view(np.uint64), sizes, own, new)))
            held.clear()
            number, size = number + 1, 0
            return _rows(rows)

        for batch in batches:
            for _, found in shingled(batch.column(0).to_pylist(), shingler):
                for i, cls in enumerate(found.cls.tolist()):
                    if cls not in held:
                        held[cls] = found.hashes[found.starts[i] : found.starts[i + 1]]
                        size += len(held[cls])
                if size >= most:
                    yield flush()
        if held:
            yield flush()

    return run


def level(counts: np.ndarray) -> np.ndarray:
    """Lengths of lists on a scale of 255: exact up to 127, beyond in eighths of a power of two."""
    return np.where(counts < 128, counts, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128)))).astype(np.uint64)


def _groups(levels: np.ndarray, most: int) -> np.ndarray:
    """Into how many groups of records a list of each level is split."""
    longest = np.where(levels < 128, levels, 128 * 2 ** ((levels.astype(np.float64) - 127) / 8))
    return np.maximum(1, np.ceil(longest / most)).astype(np.int64)


def _answer(ranges: int):
    """A range of shingles: the lengths of their lists over all chunks, back to each chunk that asked; with the shingles that it has in common with another record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            home = batch.filter(pa.compute.less(batch.column(2), 0))
            if home.num_rows:
                yield home
            for _, chunk, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part >= 0:
                    asked.setdefault(part, []).append((chunk, blob))
        for part, rows in asked.items():
            h, times = _join([b for _, b in rows], 2)
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(h[order]) > 0])
            distinct, levels = h[order][first], level(np.add.reduceat(times[order].astype(np.int64), first))
            for chunk, blob in rows:
                own = np.cumsum(_take(blob)[0], dtype=np.uint64)
                found = levels[np.searchsorted(distinct, own)]
                yield _rows([(_home(chunk, ranges), chunk, part, _put(_steps(own[found > 1]), found))])

    return run


def _share(similarity: float) -> float:
    return similarity / (1 + similarity)


def overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The least common shingles of sets of a and b shingles that are similar enough."""
    return np.ceil(_share(similarity) * (a.astype(np.int64) + b) - 1e-9).astype(np.int64)


def _short(similarity: float, ranges: int, most: int):
    """A chunk at home: its records' entries in short lists, packed by range: (to, -, -, blob of list, class, size, place, side). Rows come by chunk, its own first."""

    def entries(cls: np.ndarray, sizes: np.ndarray, own: np.ndarray, new: np.ndarray, answers: list[bytes]) -> pa.RecordBatch:
        parts = [_take(b) for b in answers]
        levels = np.concatenate([p[1] for p in parts])
        hashes = np.zeros(len(levels), np.uint64)
        hashes[levels > 1] = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        which = np.cumsum(new.astype(np.int64)) - 1
        own, sizes = own.astype(np.int64), sizes.astype(np.int64)
        long = levels[which]
        alone = np.bincount(own[long == 1], minlength=len(cls))  # lists without another record come first
        keep = np.flatnonzero(long > 1)
        keep = keep[np.argsort(own[keep] * 256 + long[keep].astype(np.int64), kind="stable")]
        o, h, lev = own[keep], hashes[which[keep]], long[keep]
        place = alone[o] + np.arange(len(o)) - np.searchsorted(o, o)
        # the shortest record similar enough to one of n shingles has similarity * n of them
        short = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + SHORT_HITS
        good = place < short[o]
        o, h, lev, place = o[good], h[good], lev[good], place[good]
        groups = _groups(lev, most)
        mine = (_mixed(cls[o] ^ h) % groups.astype(np.uint64)).astype(np.int64)
        # each pair of groups of a split list is a list of its own: side 1 meets side 2, or all meet where both are one group
        other = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
        o, h, place, mine, split = (np.repeat(x, groups) for x in (o, h, place, mine, groups))
        side = np.where(other == mine, 0, np.where(mine < other, 1, 2))
        cell = (np.minimum(mine, other) * split + np.maximum(mine, other)).astype(np.uint64)
        h = np.where(split > 1, _mixed(h + cell * _MIX[0]) >> np.uint64(64 - BITS), h)
        order = np.argsort(h, kind="stable")
        o, h, place, side = o[order], h[order], place[order], side[order]
        at = np.searchsorted(_range_of(h, ranges), np.arange(ranges + 1))
        rows = []
        for p in np.flatnonzero(np.diff(at)).tolist():
            x = slice(at[p], at[p + 1])
            rows.append((p, 0, 0, _put(_steps(h[x]), cls[o[x]], sizes[o[x]], place[x], side[x])))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, mine, answers = None, None, []
        for batch in batches:
            for _, c, part, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != chunk:
                    if answers:
                        yield entries(*mine, answers)
                    chunk, mine, answers = c, None, []
                if part < 0:
                    mine = _take(blob)
                else:
                    answers.append(blob)
        if answers:
            yield entries(*mine, answers)

    return run


def _merge(similarity: float, ranges: int):
    """Merges the short lists of a range: the pairs of classes that occur together, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, n, place, side = _join([b for batch in batches for b in batch.column(3).to_pylist()], 5)
        cls = cls.view(np.int64)
        order = np.lexsort((cls, h))
        h, cls, n, place, side = h[order], cls[order], n[order].astype(np.int64), place[order].astype(np.int64), side[order]
        first = np.ones(len(h), bool)  # classes that stand in a list more than once: equal records of several chunks
        first[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, place, side = h[first], cls[first], n[first], place[first], side[first]
        follow = np.searchsorted(h, h, side="right") - np.arange(len(h)) - 1  # entries after this one in its list
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
            held.clear()
            a, b, hits = _added(a, b, np.ones(len(a), np.int64))
            to = (_mixed((a ^ (b * 31)).view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at = np.searchsorted(to[order], np.arange(ranges + 1))
            rows = []
            for p in np.flatnonzero(np.diff(at)).tolist():
                o = order[at[p] : at[p + 1]]
                rows.append((p, 0, 0, _put(_steps(a[o].view(np.uint64)), b[o].view(np.uint64), hits[o])))
            return _rows(rows)

        live, step = np.arange(len(h)), max(1, CHUNK // 4)
        for k in range(1, int(follow.max()) + 1 if len(follow) else 1):
            live = live[follow[live] >= k]
            for at in range(0, len(live), step):
                x = live[at : at + step]
                y = x + k
                need = overlap(n[x], n[y], similarity)
                # both must be among the lists that are short for a record of this size with one of that size
                good = (place[x] < n[x] - need + SHORT_HITS) & (place[y] < n[y] - need + SHORT_HITS) & (np.minimum(n[x], n[y]) >= need)
                good &= (side[x] == 0) | (side[x] != side[y])
                x, y = x[good], y[good]
                if len(x):
                    # occurrences weigh more where fewer than SHORT_HITS are needed, so that as many reach it
                    x, y = (np.repeat(e, -(-SHORT_HITS // np.clip(need[good], 1, SHORT_HITS))) for e in (x, y))
                    held.append((cls[x], cls[y]))  # within a list classes ascend
                    size += len(x)
                    if size >= 2 * CHUNK:
                        yield counted()
                        size = 0
        yield counted()

    return run


def _added(a: np.ndarray, b: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs with the sums of their hits, sorted by bytes of a as unsigned numbers."""
    order = np.lexsort((b, a.view(np.uint64)))
    a, b, hits = a[order], b[order], hits[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[start], b[start], np.add.reduceat(hits, start) if len(a) else hits


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up how often pairs of classes occurred together, and keeps those that did so often enough."""
    a, b, hits = _join([x for batch in batches for x in batch.column(3).to_pylist()], 3)
    a, b, total = _added(a.view(np.int64), b.view(np.int64), hits.astype(np.int64))
    keep = total >= SHORT_HITS
    yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def _class_bits(classes: DataFrame) -> np.ndarray:
    """A bit for each class, of fixed size: records without their bit can be left out before a join."""
    slots = classes.select(F.expr(f"cls & {(1 << FILTER_BITS) - 1}L").alias("slot")).select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    words = slots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _members(records: DataFrame, needed: DataFrame, shingler: tuple[int, int]) -> DataFrame:
    """Each record's class (table_name, key, cls), with its shingles where the class may be needed."""
    bits = records.sparkSession.sparkContext.broadcast(_class_bits(needed))
    names, kinds = ["table_name", "key", "cls", "shingles"], [pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            tables, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for at, found in shingled(batch.column(2).to_pylist(), shingler):
                slot = found.cls & ((1 << FILTER_BITS) - 1)
                wanted = (words[slot >> 6] >> (slot & 63)) & 1
                for i, (place, cls, there) in enumerate(zip(found.kept.tolist(), found.cls.tolist(), wanted.tolist(), strict=True)):
                    own = found.hashes[found.starts[i] : found.starts[i + 1]].tobytes() if there else None
                    rows.append((tables[at + place], keys[at + place], cls, own))
            yield _batch(names, kinds, rows)

    return records.mapInArrow(run, "table_name string, key string, cls bigint, shingles binary")


def _verify(similarity: float):
    """Keeps the pairs that are similar enough, by probing the one's shingles in the other's by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(t, s), max(0, len(t) - 1))
                common = int((t[at] == s).sum()) if len(t) else 0
                union = len(s) + len(t) - common
                if union and common >= similarity * union - 1e-9:
                    rows.append((a, b, common / union))
            yield _batch(["a", "b", "similarity"], [pa.int64(), pa.int64(), pa.float64()], rows)

    return run


def similar_classes(
    records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, min_words: int = MIN_WORDS, chunk: int = CHUNK, longest: int = LIST
) -> tuple[DataFrame, DataFrame]:
    """Members (table_name, key, cls) and links (a, b, similarity; a < b) between classes of equal word sequences.

    records: (table_name, key, content). Links lose no pair of classes whose similarity (common shingles by all shingles)
    reaches the threshold. Classes are hashes of the word sequence; repeated rows and copies are one class, so that a
    text with many copies is searched for once. Records with a null key or content, or fewer than min_words words, are
    in no class. chunk and longest (postings of a chunk, records of a list that are merged at once) bound what a task holds;
    results don't depend on them.
    """
    spark, shingler = records.sparkSession, (width, min_words)
    records = spread(records.select("table_name", "key", "content").filter(F.col("key").isNotNull() & F.col("content").isNotNull()))
    size = records.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    # a partition for each range of hashes: none holds two by chance
    asked = records.select("content").mapInArrow(_ask(shingler, ranges, chunk), _ROW).repartitionById(ranges, "to")
    answers = asked.mapInArrow(_answer(ranges), _ROW).repartitionById(ranges, "to").sortWithinPartitions("chunk", "part")
    lists = answers.mapInArrow(_short(similarity, ranges, longest), _ROW).repartitionById(ranges, "to")
    hits = lists.mapInArrow(_merge(similarity, ranges), _ROW).repartitionById(ranges, "to")
    links = pin(hits.mapInArrow(_count, "a bigint, b bigint"), "near-candidates")
    needed = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    members = pin(_members(records, needed, shingler), "near-members")
    shingles = members.filter("shingles is not null").select("cls", "shingles").join(needed, "cls", "left_semi").dropDuplicates(["cls"])
    shingles = pin(shingles, "near-shingles")
    pairs = links.join(shingles.toDF("a", "x"), "a").join(shingles.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = pairs.mapInArrow(_verify(similarity), "a bigint, b bigint, similarity double")
    return members.select("table_name", "key", "cls").distinct(), links


def similar_pairs(records: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, min_words: int = MIN_WORDS, **bounds: int) -> DataFrame:
    """All pairs of records of one table that are similar enough: table_name, key_a, key_b (key_a < key_b), equal texts included.

    See similar_classes() for what is compared. Pairs are as many as the data hold: copies are expanded here only.
    """
    members, links = similar_classes(records, similarity, width, min_words, **bounds)
    members = pin(members, "near-members")
    left, right = members.toDF("table_name", "key_a", "a"), members.toDF("table_name", "key_b", "b")
    far = left.join(links.select("a", "b"), "a").join(right, ["table_name", "b"]).select("table_name", "key_a", "key_b")
    equal = left.join(right.withColumnRenamed("b", "a"), ["table_name", "a"]).filter("key_a < key_b").select("table_name", "key_a", "key_b")
    return far.select("table_name", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionByName(equal).distinct()

"""Texts read with the wrong encoding, found and restored by noisy-channel decoding."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.codecs import CHANNELS, LOST, Lattice, fits, from_bytes, to_bytes
from tracewell.llm.lookup import Asked, by_chunks
from tracewell.session import pin, spread

#: Costs in nats: of a stretch being garbled at all, of going on or changing in it, of a character that was lost.
ENTER, CHANGE, LOST_COST = 6.9, 3.0, 1.5
#: A whole UTF-8 sequence out of unrelated characters would be a coincidence of this size.
SEQUENCE = 3.5
#: A spelling with less than this share of another's occurrences is no word of its own if a channel makes it of the other.
#: For up to three characters, and for longer ones; and for tokens of whole UTF-8 sequences, which are no chance.
SHARES, SHARE_WHOLE = (0.035, 0.15), 0.5
#: Cost of a word that was not seen; letters that make a word long.
UNSEEN, LONG = 3.0, 8
#: Cost of a stretch that goes on beyond the end of a line.
LINE = 1.5
#: A lost character is rarely written on purpose.
LOST_GAIN = 7.5
#: A single character is hardly evidence, as which one follows depends on its neighbours; it goes with a stretch but makes none.
SINGLE = 0.05
#: Words and pairs of characters up to which the model is broadcast whole; beyond, each chunk of texts gets the part that it asks for.
MODEL_ENTRIES = 600_000
TOKEN_CACHE = 200_000

#: A token ends at white space; a hard space is part of it only where a byte of a wrongly read sequence may stand.
TOKEN = re.compile(r"(?:[^ \t\n\r\f\v\xa0]|(?<=[ÂÃĂВГРС])\xa0|(?<=[^\x00-\x7f\w])\xa0|(?<=[à-ï])\xa0(?=[^\x00-\x7f\w]))+")
FOREIGN = re.compile(r"[^\x00-\x7f]")
GAIN = operator.itemgetter(1)
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(token: str) -> str:
    return token.strip(EDGE).lower()


def tokens(text: str) -> list[tuple[int, int, str]]:
    """The tokens with a character beyond ASCII, and their places. Only these can be garbled."""
    found, end = [], 0
    for m in FOREIGN.finditer(text):
        at = m.start()
        if at < end or text[at] == "\xa0":
            continue
        start = max(end, *(text.rfind(space, end, at) + 1 for space in " \n\t\r"))
        token = TOKEN.match(text, start)
        if token is None or token.end() <= at:  # other white space stands between
            token = TOKEN.match(text, at)
            if token is None:
                continue
        end = token.end()
        found.append((token.start(), end, token.group()))
    return found


#: Occurrences of all words; of each first and each second character of a pair. No larger than there are characters.
Totals = tuple[int, dict[str, int], dict[str, int]]


def shapes(words: dict[str, int]) -> dict[str, list[str]]:
    """The words of each shape, a word with its characters beyond ASCII left open, the most frequent first."""
    found: dict[str, list[str]] = {}
    for w, c in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        if c > 1 and LOST not in w:
            found.setdefault(FOREIGN.sub(LOST, w), []).append(w)
    return found


class Model:
    """Corpus frequencies of words with characters beyond ASCII, and of pairs of characters in them for words unseen; and their totals (see totals())."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int], totals: Totals, gaps: dict[str, list[str]] | None = None) -> None:
        self.words, self.pairs = words, pairs
        total, self.firsts, seen = totals
        self.log_total = math.log(total + 1)
        self.common = {ch: math.log(c + 0.5) for ch, c in seen.items() if ch > "\x7f"}
        self.characters = max(1, len(seen))
        self.gaps = shapes(words) if gaps is None else gaps
        self.cache: dict[str, list[tuple[int, float, str]]] = {}

    def spelled(self, word: str) -> float:
        pairs, firsts, score, a = self.pairs, self.firsts, 0.0, "^"
        for b in word + "$":
            score += math.log((pairs.get(a + b, 0) + 0.02) / (firsts.get(a, 0) + 0.02 * self.characters + 1))
            a = b
        return score

    def seen(self, word: str) -> float:
        count = self.words.get(word, 0)
        return math.log(count) - self.log_total if count > 1 else -math.inf

    def gain(self, a: str, known: float, spelled: float, restored: str, whole: int) -> float:
        """How much likelier the restored word is than the token. A long word that is new is compared by its spelling only, as copies of one text make any word frequent."""
        b = normal(restored)
        if not b or b.isascii():
            return -2.0 - max(known, spelled)
        own, best = self.words.get(a, 0), self.words.get(b, 0)
        # occurrences that are themselves readings of a far more frequent word are no evidence that the word was written so
        here = spelled if own < (SHARE_WHOLE if whole else SHARES[len(a) > 3]) * best else max(known, spelled)
        if best > 1:  # what is spelled alike is not likelier than what was seen
            gain = self.seen(b) - here
        else:
            gain = self.spelled(b) - UNSEEN - (spelled if len(a) >= LONG else here)
        return min(gain, SINGLE) if len(a) < 2 else gain

    def rarity(self, token: str) -> float:
        """Mean log frequency of a token's characters beyond ASCII."""
        found = [self.common.get(ch, -1.0) for ch in token.lower() if ch > "\x7f" and ch != LOST]
        return sum(found) / len(found) if found else 10.0

    def fill(self, token: str, left: list[tuple[int, ...]] | None = None) -> str:
        """Lost characters put back by the most frequent word that has what is there: all other characters, and the bytes that are left of the lost ones."""
        word = normal(token)
        gap = FOREIGN.sub(LOST, word)
        at = token.lower().find(word)
        if len(gap) - gap.count(LOST) < 2 or at < 0 or len(token.lower()) != len(token):  # else any character fits
            return token
        marks = iter(left if left is not None and len(left) == word.count(LOST) else [()] * word.count(LOST))
        places = [(i, next(marks)) for i, ch in enumerate(word) if ch == LOST]
        for known in self.gaps.get(gap, ()):
            if len(known) != len(word) or any(a not in (b, LOST) for a, b in zip(word, known, strict=True)):
                continue
            out = list(token[at : at + len(word)])
            for i, bytes_left in places:
                # a capital where the bytes say so, or where the word's other letters are
                forms = [known[i].upper(), known[i]] if word != "".join(out) and "".join(out).isupper() else [known[i], known[i].upper()]
                out[i] = next((f for f in forms if len(f) == 1 and fits(bytes_left, f)), "")
            if all(out):
                return token[:at] + "".join(out) + token[at + len(word) :]
        return token

    def readings(self, token: str) -> list[tuple[int, float, str]]:
        """(channel, gain over the token as it stands, restored) for each channel that can give the token; -1 is the token itself."""
        found = self.cache.get(token)
        if found is not None:
            return found
        found = []
        rarity, word = self.rarity(token), normal(token)
        known, spelled = self.seen(word), self.spelled(word) - UNSEEN
        for c, (wrong, true) in enumerate(CHANNELS):
            data = to_bytes(token, wrong)
            if data is None:
                continue
            again = from_bytes(data, true)
            if again is None or again[0] == token:
                continue
            text, whole, lost, left = again
            if true == "utf_8" and not whole and not lost:
                continue
            if true != "utf_8" and self.rarity(text) < rarity - 3.0:
                continue  # a channel that makes the characters rarer explains nothing
            if not text.isprintable() and not text.replace("\xa0", " ").isprintable():
                continue
            for _ in range(2):  # wrongly read more than once
                data = to_bytes(text, wrong) if true == "utf_8" else None
                more = from_utf8_again(data) if data is not None and not text.isascii() else None
                if more is None or not more[1]:
                    break
                text, whole, lost, left = more[0], whole + more[1], more[2], more[3]
            if LOST in text:
                text = self.fill(text, left)
            if text == token:
                continue
            found.append((c, self.gain(word, known, spelled, text, whole if true == "utf_8" else 0) + SEQUENCE * whole - LOST_COST * text.count(LOST), text))
        if LOST in token:
            filled, lost = self.fill(token), token.count(LOST)
            found = [(c, g + LOST_GAIN, t) for c, g, t in found]
            found.append((len(CHANNELS), LOST_GAIN + (min(4, lost) + 3.0 if filled != token else 2.0 * min(10, lost - 1)), filled))
        if len(self.cache) >= TOKEN_CACHE:
            self.cache.clear()
        self.cache[token] = found
        return found

    def decode(self, text: str) -> tuple[float, str]:
        """Viterbi search over a text's tokens: each was written so, or is what a channel made of another. The gain, and the text restored."""
        if text.isascii():
            return 0.0, text
        spots = tokens(text)
        if sum(max(0.0, max(r, key=GAIN)[1]) for *_, t in spots if (r := self.readings(t))) < ENTER:
            return 0.0, text
        last = 0
        paths: dict[int, tuple[float, tuple | None]] = {-1: (0.0, None)}
        for at in spots:
            readings = self.readings(at[2])
            clean = paths[-1]
            out = max(paths.values(), key=lambda p: p[0])
            line = LINE if text.find("\n", last, at[0]) >= 0 else 0.0
            last = at[0]
            new = {-1: (max(clean[0], out[0]), clean[1] if clean[0] >= out[0] else out[1])}
            for c, gain, restored in readings:
                # into the channel from clean text, from the same channel, or from another one
                options = [(clean[0] - ENTER, clean[1])]
                if c in paths:
                    options.append((paths[c][0] - line, paths[c][1]))
                if out[0] > clean[0]:
                    options.append((out[0] - CHANGE - line, out[1]))
                score, back = max(options, key=lambda p: p[0])
                new[c] = (score + gain, ((at[0], at[1], restored), back))
            best = max(p[0] for p in new.values())
            paths = {c: p for c, p in new.items() if c == -1 or p[0] > best - 40}
        score, back = max(paths.values(), key=lambda p: p[0])
        edits = []
        while back is not None:
            edits.append(back[0])
            back = back[1]
        for a, b, restored in edits:
            text = text[:a] + restored + text[b:]
        return score, text


def from_utf8_again(data: list[int]) -> Lattice | None:
    again = from_bytes(data, "utf_8")
    return again if again and again[1] else None


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(kind, item, n): words with characters beyond ASCII, and pairs of characters in them, counted over all texts. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            pairs: Counter[str] = Counter()
            for w, n in words.items():
                marked = f"^{w}$"
                for i in range(len(marked) - 1):
                    pairs[marked[i : i + 2]] += n
            kinds = [0] * len(words) + [1] * len(pairs)
            out = [pa.array(kinds, pa.int32()), pa.array([*words, *pairs], pa.string()), pa.array([*words.values(), *pairs.values()], pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(out, names=["kind", "item", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    words.update(w for _, _, token in tokens(t) if (w := normal(token)))
            if len(words) > TOKEN_CACHE:
                yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "kind int, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str) -> DataFrame:
    """(kind, item, n): words (0) and pairs of characters (1) of the whole corpus that occur more than once."""
    return pin(_counts(df, text).filter("n > 1"), "garbled-counts")


def totals(counts: DataFrame) -> Totals:
    """What the model knows of all words and pairs together."""
    pairs = counts.filter("kind = 1")

    def sums(place: int) -> dict[str, int]:
        return dict(map(tuple, pairs.groupBy(F.substring("item", place, 1)).agg(F.sum("n")).collect()))

    return counts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0, sums(1), sums(2)


def restore(df: DataFrame, text: str, counts: DataFrame | None = None, entries: int = MODEL_ENTRIES) -> DataFrame:
    """Adds `garbled` (whether text shows characters other than those written) and `restored` (the text with them put back).

    The model is trained on all of df's texts unless counts of others (see train()) are given. If it has more than so
    many entries, it is not broadcast: chunks of texts get what they ask for in a join, with the same results. Null,
    empty and ASCII texts are not garbled; restored is then the text itself. Characters that nothing tells stay as they
    are. Rows keep their number, other columns pass through; ones named garbled or restored are replaced.
    """
    kept = spread(df.drop("garbled", "restored"))
    counts = train(kept, text) if counts is None else counts
    known = totals(counts)
    schema = T.StructType([*kept.schema, T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType())])
    place = kept.columns.index(text)

    def decoded(decoder: Model, columns: list[pa.Array], texts: list[str | None]) -> list[pa.Array]:
        found = [decoder.decode(t) if t else (0.0, t) for t in texts]
        return [*columns, pa.array([g > 0 for g, _ in found], pa.bool_()), pa.array([t for _, t in found], pa.string())]

    if counts.count() <= entries:
        tables = [dict(map(tuple, counts.filter(F.col("kind") == k).select("item", "n").collect())) for k in (0, 1)]
        shared = df.sparkSession.sparkContext.broadcast((*tables, known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decoder = Model(*shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(decoded(decoder, batch.columns, batch.column(place).to_pylist()), names=schema.names)

        return kept.mapInArrow(run, schema)

    shared = df.sparkSession.sparkContext.broadcast(known)

    def asks():
        words, pairs, gaps = Asked(0), Asked(0), Asked(())
        model = Model(words, pairs, shared.value, gaps)
        told: dict[str, set[str]] = {}

        def of(t: str) -> set[str]:
            out: set[str] = set()
            for *_, token in tokens(t):
                if token not in told:
                    for a in (words, pairs, gaps):
                        a.keys_asked.clear()
                    model.readings(token)
                    if len(told) > TOKEN_CACHE:
                        told.clear()
                        model.cache.clear()
                    told[token] = {f"{k}{x}" for k, a in enumerate((words, pairs, gaps)) for x in a.keys_asked}
                out |= told[token]
            return out

        return of

    shape = F.regexp_replace("item", r"[^\x00-\x7f]", LOST)
    table = counts.select(F.concat(F.col("kind").cast("string"), "item").alias("ask"), "item", F.col("n").alias("a"), F.col("kind").cast("bigint").alias("b"))
    words = counts.filter("kind = 0").filter(~F.contains("item", F.lit(LOST)))
    table = table.unionByName(words.select(F.concat(F.lit("2"), shape).alias("ask"), "item", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")))

    def work(rows: pa.Table, found: list[tuple]) -> pa.Table:
        tables: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for item, n, kind, _ in found:
            tables[kind][item] = n
        rows = rows.combine_chunks()
        columns = decoded(Model(*tables, shared.value), [c.combine_chunks() for c in rows.columns], rows.column(place).to_pylist())
        return pa.table(columns, names=schema.names)

    return by_chunks(kept, text, asks, table, work, schema)

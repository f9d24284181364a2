"""Wrong readings of bytes: single-byte tables with their inverses, and decoding of byte lattices with lost bytes."""

from __future__ import annotations

from functools import cache

LOST = "�"
#: How texts are read wrongly (first) and how they had been written (second). "latin" is Windows-1252 with the C1 controls in its gaps.
WRONG = ["latin", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8_r"]
TRUE = ["latin", "cp1251", "gbk", "mac_roman", "cp437", "cp850", "koi8_r", "cp866"]
CHANNELS = [(w, "utf_8") for w in [*WRONG, "gbk"]] + [(w, t) for w in WRONG for t in TRUE if w != t]


@cache
def table(name: str) -> dict[str, int]:
    """Byte of each non-ASCII character that a reading can give."""
    codec = "cp1252" if name == "latin" else name
    found = {}
    for b in range(128, 256):
        try:
            found[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if name in ("latin", "cp1250", "cp1251"):  # gaps, and readers that keep the C1 controls
            found.setdefault(chr(b), b) if b < 160 or name == "latin" else None
    return found


def to_bytes(text: str, wrong: str) -> list[int] | None:
    """The bytes that were read as `text`, -1 for a lost one; None if this reading can't give the text."""
    if wrong == "gbk":
        out: list[int] = []
        for part in text.split(LOST):
            try:
                out += part.encode("gbk")
            except UnicodeEncodeError:
                return None
            out.append(-1)
        return out[:-1]
    known = table(wrong)
    out = []
    for ch in text:
        if ch < "\x80":
            out.append(ord(ch))
        elif ch == LOST:
            out.append(-1)
        else:
            b = known.get(ch)
            if b is None:
                return None
            out.append(b)
    return out


Lattice = tuple[str, int, int, list[tuple[int, ...]]]


def fits(bytes_left: tuple[int, ...], ch: str) -> bool:
    """Whether a character may have had these bytes: those that are left (others are -1) stand in its UTF-8 form in this order, a first one first."""
    form = iter(ch.encode("utf-8", "replace"))
    first = bytes_left[0] if bytes_left else -1
    if first >= 0xC0 and next(form) != first:
        return False
    return all(b in form for b in bytes_left[first >= 0xC0 :] if b >= 0)


def utf8_lattice(data: list[int]) -> Lattice | None:
    """Text, whole sequences and lost characters, of which the bytes that are left are kept. A sequence may lack bytes if they were lost; None for bytes that were never UTF-8."""
    out, whole, lost, i, n = [], 0, 0, 0, len(data)
    left: list[tuple[int, ...]] = []
    while i < n:
        b = data[i]
        if 0 <= b < 128:
            out.append(chr(b))
            i += 1
            continue
        need = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
        if b == -1 or need == 0:
            if b != -1 and not 0x80 <= b < 0xC0:
                return None
            j = i + 1  # a lost first byte, or bytes that follow a lost one
            while j < n and (data[j] == -1 or 0x80 <= data[j] < 0xC0) and j - i < 3:
                j += 1
            if -1 not in data[i:j] and (not out or out[-1] != LOST):
                return None
            if not out or out[-1] != LOST or b == -1:
                out.append(LOST)
                left.append(tuple(data[i:j]))
                lost += 1
            else:
                left[-1] += tuple(data[i:j])
            i = j
            continue
        tail = data[i + 1 : i + 1 + need]
        ok = 0
        while ok < len(tail) and (tail[ok] == -1 or 0x80 <= tail[ok] < 0xC0):
            ok += 1
        if ok == need and -1 not in tail:
            try:
                out.append(bytes([b, *tail]).decode())
            except UnicodeDecodeError:
                return None
            whole += 1
        elif -1 in tail[:ok] or (ok < need and (need > 1 or i + 1 == n)):
            out.append(LOST)
            left.append((b, *tail[:ok]))
            lost += 1
        else:
            return None
        i += 1 + ok
    return "".join(out), whole, lost, left


def from_utf8(data: list[int]) -> tuple[str, int, int] | None:
    found = utf8_lattice(data)
    return found and found[:3]


def from_bytes(data: list[int], true: str) -> Lattice | None:
    """The text that bytes with lost ones (-1) are in an encoding; see utf8_lattice()."""
    if true == "utf_8":
        return utf8_lattice(data)
    codec = "cp1252" if true == "latin" else true
    parts, part, lost = [], bytearray(), 0
    for b in [*data, -1]:
        if b >= 0:
            part.append(b)
            continue
        try:
            parts.append(part.decode(codec))
        except UnicodeDecodeError:
            if true != "gbk":
                return None
            text = part.decode(codec, "replace")  # a stretch may begin or end within a character
            if len(text) < 6 * text.count(LOST) or not any("\u4e00" <= c <= "\u9fff" for c in text):
                return None
            parts.append(text)
        part = bytearray()
    text = LOST.join(parts)
    return text, 0, text.count(LOST), [(-1,)] * text.count(LOST)

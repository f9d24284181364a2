"""High-recall generators of candidate mentions of personal information, with features of their format and context."""

from __future__ import annotations

import math
import re
from collections import Counter

# Spellings of addresses, numbers and words around them.
AT = re.compile(r"[@＠]|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s(?=[\w-]+\sdot\s)", re.I)
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
LOCAL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,99}\Z")
DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![\w.,:/+(-])(?:\+|\(|)\d[\d ().\-/]{5,22}\d(?![\w])")
CODE = re.compile(r"\b(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[XYZ]?\d{7,8}-?[A-Z])\b")
_CAP = r"[A-ZÀ-ÖØ-Þ]"
ADDRESSES = [
    re.compile(
        r"\b\d{1,4}[a-z]? [A-Za-zÀ-ÿ][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*)? (?i:street|st|road|rd|avenue|ave|lane|ln|close|drive|dr|court|ct|way|place|square|terrace|boulevard|blvd|crescent)\b"
    ),
    re.compile(r"\b[A-Za-zÀ-ÿ][\w-]*?(?i:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer) ?\d{1,4}[a-z]?\b"),
    re.compile(
        r"\b\d{1,4}(?: ?(?:bis|ter)|[a-z])?,? (?i:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours) (?i:de la |de l['’]|du |des |de |d['’])?[\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*"
    ),
    re.compile(r"\b(?i:calle|avenida|avda\.?|plaza|paseo|camino|carrera|rua) (?i:de la |de los |de las |del |de |da |do )?[\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*,? (?:n[º°.] ?)?\d{1,4}[a-z]?\b"),
]
#: An address of each form has one of these in lower case: texts without are passed over.
ADDRESS_MARKS = [
    (" street", " st", " road", " rd", " ave", " lane", " ln", " close", " dr", " court", " ct", " way", " place", " square", " terrace", " boulevard", " blvd", " crescent"),
    ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer"),
    (" rue ", " avenue ", " boulevard ", " place ", " chemin ", " impasse ", " allée ", " quai ", " route ", " cours "),
    ("calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "carrera ", "rua "),
]
PARTICLES = "van|von|de|del|der|den|da|di|dos|du|la|le|bin|ibn|al|el|ter|zu"
_WORD = rf"(?:{_CAP}[a-zß-öø-ÿ'’]+(?:{_CAP}[a-zß-öø-ÿ]+)?|{_CAP}{{2,}})"
_FAMILY = rf"(?:(?:{PARTICLES}|{PARTICLES.upper()}) ){{0,2}}{_WORD}(?:-{_WORD})*"
_INITIAL = rf"{_CAP}\."
NAME = re.compile(rf"(?<![\w@.-])(?=((?P<given>{_WORD}(?:-{_WORD})?|{_INITIAL})(?P<middle>(?: {_INITIAL}| {_WORD})??) (?P<family>{_FAMILY}))(?![\w@]))")
TURNED = re.compile(rf"(?<![\w@.-])(?=((?P<family>{_FAMILY}), (?P<given>{_WORD}|{_INITIAL})(?P<middle>(?: {_INITIAL})?))(?![\w@]))")
PHONE_FORMS = [re.compile(x) for x in (
    r"^\+\d{1,3}[ \d()./-]{6,16}\d$", r"^00[1-9]\d?[ -]?[\d ()./-]{6,15}\d$", r"^\(\d{2,4}\) ?\d{3}[ -]?\d{3,4}$", r"^\d{3}\.\d{3}\.\d{4}$",
    r"^0\d{2,4}[ /-]\d{5,8}$", r"^0\d(?:[ .]\d\d){4}$", r"^[2-9]\d{2}-\d{3}-\d{4}$", r"^0\d{3} \d{3} \d{3,4}$")]
ID_FORMS = [re.compile(x) for x in (
    r"^\d{3}-\d\d-\d{4}$", r"^[12378] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d$", r"^\d{4} \d{4} \d{4}$", r"^[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]$",
    r"^[XYZ]?\d{7,8}-?[A-Z]$", r"^\d{3}\.\d{3}\.\d{3}-\d\d$")]
PHONE_CUES = re.compile(r"(?:phone|call|text|tel|mobile|number|unter|anrufen|appel|voicemail|try|at|on|ruf|fax|handy|contact|dial|whatsapp)\W*(?:me )?(?:on |at )?\W*$", re.I)
ID_CUES = re.compile(r"(?:ssn|national id|id|dni|nie|kennung|num[ée]ro|record|row|passport|ausweis|nino|insee|security|identity|cpf|persons?nummer)\W*(?:is |no\.? )?\W*$", re.I)
NUMBERS = {"phone": (PHONE_FORMS, PHONE_CUES), "id_number": (ID_FORMS, ID_CUES)}
NUMBER_NOT = re.compile(r"(?:(?<![^\W\d_])(?:sku|build|range|epoch|commit|port|version|order|invoice|line|offset|ticket|part|bind|isbn|v|ip)|#)\W*(?:\d+ ms, build )?\W*$", re.I)
ADDRESS_CUES = re.compile(r"(?:[,(:;\n]|\b(?:at|in|to|on|near|en|an|am|a|au|chez|jetzt|nach|address|adresse|street|calle|rue|from|from:))\s*\(?$|^$", re.I)
ADDRESS_NOT = re.compile(r"(?:[\d./=#_-]|\b(?:step|line|version|took|after|of|every|about|another|only)) ?$", re.I)
ADDRESS_NEXT = re.compile(r"\s*(?:[,.;:)\]\"'\n|]|$|à |in )")
RUNS_ON = re.compile(r" (?!à |in |and |und |et |y |or |,)[a-zß-ÿ]")
TITLES = re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|herr|herrn|frau|sr|sra|se[ñn]or|se[ñn]ora|m|mme|monsieur|madame|dona|don)\.? $", re.I)
NAME_CUES = re.compile(
    r"(?:\bby|\bfor|\bfrom|\bto|\bwith|\bowner|\bping|reporter:|card:|nom de|\bde|\bchez|\bbitte|\bvon|\bà|gez\.|demander|—|user = [\"'“]|\bat|author:|signed|cc:|regards,|\|) ?[\"'“]?$", re.I
)
NAME_NEXT = re.compile(r"^ ?(?:<|\(|wrote|asked|moved|wohnt|vive|lives|unter|at |,? ?(?:national|\d)|\||[\"'”]|is done|yesterday|will|said|[;:]|en la)", re.I)
FILE_ENDS = {"png", "jpg", "jpeg", "gif", "svg", "js", "ts", "py", "css", "html", "json", "md", "txt", "yaml", "toml", "rs", "go", "sh", "sql"}

KINDS = ["email", "phone", "id_number", "address", "name"]
FEATURES = [
    *KINDS, "form", "digits", "groups", "plus", "cue", "cue_not", "next_colon", "local_git", "numeric_domain", "file_end", "alone",
    "listed", "initial", "middle", "particle", "turned", "title", "next_cue", "upper", "mixed", "families", "givens", "lower_family", "repeats", "family_given", "capital", "runs_on", "cue_other",
]


def title(word: str) -> str:
    return word[:1] + word[1:].lower() if word.isupper() else word


def family_parts(family: str) -> list[str]:
    """The words of a family name that can be known: without particles, each part of a double name."""
    return [title(p) for p in family.split(" ")[-1].split("-")]


#: Never a name, though written alike (fixed values).
NO_NAME = {"Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Señor", "Señora", "Mme", "Sr", "Sra", "Don", "Doña", "Bitte", "Calle", "Avenida", "Plaza", "Paseo"}


def name_parts(text: str):
    """All spans that may be names, overlapping ones too: start, end, given, middle, family, turned."""
    for pattern in (NAME, TURNED):
        for m in pattern.finditer(text):
            if title(m["given"]) in NO_NAME or title(m["family"].split(" ")[-1]) in NO_NAME:
                continue
            yield m.start(1), m.end(1), m["given"], m["middle"].strip(), m["family"], pattern is TURNED


#: Words in lower case that are no part of an address, identifier or path.
WORDS = re.compile(r"(?<![\w'’.@+/-])[a-zß-öø-ÿ]{3,20}(?![\w'’@+/-]|\.\w)")


class Survey:
    """What a pass over the texts counts: words in lower case, and pairs of words that may be family and given name."""

    def __init__(self) -> None:
        self.lower: Counter[str] = Counter()
        self.pairs: Counter[tuple[str, str]] = Counter()

    def add(self, text: str) -> None:
        self.lower.update(WORDS.findall(text))
        for _, _, given, middle, family, _ in name_parts(text):
            if not given.endswith(".") and (not middle or middle.endswith(".")):
                for part in family_parts(family):
                    self.pairs[part, title(given)] += 1


class Generator:
    """Proposes spans of a text with their features. families: how many listed given names a word goes with, and how often; givens: how many such families; lower: how often a word stands in lower case."""

    def __init__(self, listed: set[str], families: dict[str, tuple[int, int]], givens: dict[str, int], lower: dict[str, int]) -> None:
        self.listed, self.families, self.givens, self.lower = listed, families, givens, lower

    def __call__(self, text: str) -> list[tuple[int, int, str, list[float]]]:
        found = []
        low = text.lower()
        for m in AT.finditer(text) if any(x in low for x in ("@", "＠", "at)", "at]", "at }", "at ")) else ():
            begin = max(0, m.start() - 120)
            local = LOCAL.search(text[begin : m.start()])
            domain = local and DOMAIN.match(text, m.end())
            if domain and (not found or begin + local.start() >= found[-1][1]):
                a, b = begin + local.start(), domain.end()
                found.append((a, b, "email", self.email(text, a, b)))
        taken = [(a, b) for a, b, *_ in found]
        for m in NUMBER.finditer(text):
            value = m.group()
            a, b = m.start(), m.end()
            if value.count("(") != value.count(")"):
                continue
            if sum(c.isdigit() for c in value) < 7:
                continue
            for kind in NUMBERS:
                found.append((a, b, kind, self.number(text, a, b, kind)))
        for m in CODE.finditer(text):
            found.append((m.start(), m.end(), "id_number", self.number(text, m.start(), m.end(), "id_number")))
        for pattern, marks in zip(ADDRESSES, ADDRESS_MARKS, strict=True):
            for m in pattern.finditer(text) if any(x in low for x in marks) else ():
                taken.append(m.span())
                found.append((m.start(), m.end(), "address", self.address(text, m.start(), m.end())))
        for a, b, given, middle, family, turned in name_parts(text):
            first, parts = title(given), family_parts(family)
            initial = given.endswith(".")
            known = min(self.families.get(p, (0, 0)) for p in parts)
            if not (known[0] or first in self.listed) or (initial and not known[0]):
                continue
            if any(x < b and a < y for x, y in taken):  # a street is no given name, however often it stands behind a family name and a comma
                continue
            found.append((a, b, "name", self.name(text, a, b, first, middle, family, parts, turned, initial, known)))
        return found

    @staticmethod
    def features(kind: str, **values: float) -> list[float]:
        values[kind] = 1.0
        return [float(values.get(f, 0.0)) for f in FEATURES]

    def email(self, text: str, a: int, b: int) -> list[float]:
        value = text[a:b].lower()
        local, _, domain = value.replace("＠", "@").partition("@")
        end = re.split(r"[^a-z0-9]+", value.rstrip(")]}"))[-1]
        numeric = bool(domain) and domain.split(".")[0].isdigit()
        return self.features(
            "email", form=end.isalpha() and len(end) > 1, next_colon=text[b : b + 1] == ":" and text[b + 1 : b + 2].isalnum(), local_git=local in ("git", "hg", "svn"),
            numeric_domain=numeric or end.isdigit(), file_end=end in FILE_ENDS, digits=sum(c.isdigit() for c in value), groups=value.count("."),
        )

    def address(self, text: str, a: int, b: int) -> list[float]:
        value, before, after = text[a:b], text[max(0, a - 30) : a], text[b : b + 12]
        street = re.search(r"[^\W\d]", value)
        return self.features(
            "address", form=1, digits=sum(c.isdigit() for c in value), groups=len(value.split()), capital=bool(street) and street.group().isupper(), cue=bool(ADDRESS_CUES.search(before)),
            cue_not=bool(ADDRESS_NOT.search(before)), next_cue=bool(ADDRESS_NEXT.match(after)), runs_on=bool(RUNS_ON.match(after)),
        )

    def number(self, text: str, a: int, b: int, kind: str) -> list[float]:
        value, before = text[a:b], text[max(0, a - 30) : a]
        (forms, cue), (others, other) = NUMBERS[kind], NUMBERS["id_number" if kind == "phone" else "phone"]
        form = next((i + 1 for i, f in enumerate(forms) if f.match(value)), 0)
        return self.features(
            kind, form=form, digits=sum(c.isdigit() for c in value), groups=len(re.findall(r"\d+", value)), plus=value[0] == "+", cue=bool(cue.search(before)),
            cue_not=bool(NUMBER_NOT.search(before)), cue_other=bool(other.search(before)) and any(f.match(value) for f in others), alone=text[a - 1 : a] in ("", "\n") and text[b : b + 1] in ("", "\n"),
        )

    def name(self, text: str, a: int, b: int, first: str, middle: str, family: str, parts: list[str], turned: bool, initial: bool, known: tuple[int, int]) -> list[float]:
        before, after = text[max(0, a - 24) : a], text[b : b + 16]
        return self.features(
            "name", listed=first in self.listed, initial=initial, middle=0 if not middle else 1 if middle.endswith(".") else 2, particle=" " in family, turned=turned,
            title=bool(TITLES.search(before)), cue=bool(NAME_CUES.search(before)), next_cue=bool(NAME_NEXT.search(after)), upper=text[a:b].isupper(),
            mixed=any(w.isupper() and len(w) > 2 for w in text[a:b].split()) and not text[a:b].isupper(), families=math.log1p(known[0]), repeats=math.log1p(known[1] / max(1, known[0])),
            givens=math.log1p(self.givens.get(first, 0)), family_given=first in self.families and first not in self.listed, lower_family=math.log1p(max(self.lower.get(p.lower(), 0) for p in parts)),
        )

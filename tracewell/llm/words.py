"""Words of a text: maximal runs of letters and digits of any script, in lower case."""

from __future__ import annotations

import re

#: \w without the underscore
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []

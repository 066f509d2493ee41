"""Transliteration of Latin text to ASCII.

Single letters come from Unicode decomposition: a letter whose canonical form is
an ASCII letter plus combining marks becomes that ASCII letter.  The symbols and
letters without such a form are listed below.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions.binding import bound

# One character to one character.
SYMBOLS = {
    "\u00a0": " ", "¡": "!", "¦": "|", "¨": '"', "ª": "a", "¬": "!", "¯": "-", "²": "2", "³": "3", "´": "'",
    "µ": "u", "¶": "P", "·": "*", "¸": ",", "¹": "1", "º": "o", "¿": "?", "Ð": "D", "×": "x", "Ø": "O",
    "ð": "d", "÷": "/", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l",
    "Ŧ": "T", "ŧ": "t", "ſ": "s", "ƒ": "f", "′": "'", "‹": "<", "›": ">", "‐": "-", "‑": "-", "–": "-", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"',
}
# One character to several, or to none.
EXPANSIONS = {
    "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "§": "SS", "©": "(c)", "«": "<<", "\u00ad": "", "®": "(r)",
    "°": "deg", "±": "+-", "»": ">>", "¼": "1/4", "½": "1/2", "¾": "3/4", "Æ": "AE", "Þ": "Th", "ß": "ss",
    "æ": "ae", "þ": "th", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "—": "--", "„": ",,", "…": "...",
    "Ŋ": "NG", "ŋ": "ng", "ŉ": "'n", "ẞ": "SS", "€": "EUR", "™": "(tm)", "″": "''", "Ə": "@", "ə": "@",
    "Ǆ": "DZ", "ǅ": "Dz", "ǆ": "dz", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz",
}
# Marks that decomposed text puts after a letter; they go.
COMBINING = "[\u0300-\u036f]"

_LATIN = (range(0x00C0, 0x0250), range(0x1E00, 0x1F00))


def _base_letters() -> dict[str, str]:
    found = {}
    for block in _LATIN:
        for char in map(chr, block):
            base, *marks = unicodedata.normalize("NFD", char)
            if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
                found[char] = base
    return found


LETTERS = {**_base_letters(), **SYMBOLS}


_GONE = [char for char, replacement in EXPANSIONS.items() if not replacement] + [chr(c) for c in range(0x0300, 0x0370)]
_LONGER = {char: replacement for char, replacement in EXPANSIONS.items() if replacement}


def to_ascii(text: Column) -> Column:
    """Latin letters and common symbols as ASCII; other characters stay.

    One pass maps and drops single characters by a table.  A text that has one which
    becomes several is cut at those, each is looked up, and the pieces are joined.
    Pure ASCII text, the usual case, is recognised by one scan and passed on.
    """
    plain = F.translate(text, "".join(LETTERS) + "".join(_GONE), "".join(LETTERS.values()))
    one = f"[{''.join(_LONGER)}]"
    table = F.create_map(*[F.lit(x) for pair in _LONGER.items() for x in pair])

    def expanded(t: Column) -> Column:
        pieces = F.split(t, f"(?<={one})|(?={one})")
        return F.when(t.rlike(one), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(table, p), p)), "")).otherwise(t)

    return F.when(text.rlike(r"[^\x00-\x7F]"), bound(plain, expanded)).otherwise(text)

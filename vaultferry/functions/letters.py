"""Comparing texts letter by letter, ignoring case."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kept_apart() -> tuple[str, str]:
    """Letters whose upper case would be several letters, or plain ASCII, and stand-ins.

    Upper-casing turns them into other texts ("\u00df" into "SS"); letter by letter they
    only equal themselves and their single-letter other case. The stand-ins are from the
    private use area, one per pair.
    """
    letters, stand_ins, given = [], [], {}
    for point in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        letter = chr(point)
        if not unicodedata.category(letter).startswith("L"):
            continue
        upper = letter.upper()
        if len(upper) > 1 or (upper.isascii() and upper != letter):
            title = letter.title()
            pair = title if len(title) == 1 and not title.isascii() else letter
            given.setdefault(pair, chr(0xE000 + len(given)))
            letters.append(letter)
            stand_ins.append(given[pair])
    return "".join(letters), "".join(stand_ins)


LETTERS, STAND_INS = _kept_apart()


def ignore_case(text: Column) -> Column:
    """A form that is equal for texts that differ in the case of single letters only.

    Upper case does not depend on the letters around, so a final sigma equals any sigma; the
    Kelvin sign, the dotless i and the long s stay letters of their own.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.upper(text)).otherwise(F.upper(F.translate(text, LETTERS, STAND_INS)))

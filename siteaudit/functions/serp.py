"""How wide titles and descriptions show in search results."""

from __future__ import annotations

import unicodedata

#: Advance widths of a common sans-serif face in thousandths of the font size, from a
#: space to a tilde.
_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
TITLE_SIZE, DESCRIPTION_SIZE = 20, 14


def width(text: str | None, size: int) -> int | None:
    """Whole pixels; None for nothing. Letters outside ASCII count as their base letter, else as an
    average one, and wide scripts as a full square."""
    if not text:
        return None
    total = 0
    for c in text:
        if not " " <= c <= "~":
            wide = unicodedata.east_asian_width(c) in "WF"
            c = unicodedata.normalize("NFD", c)[0]
            if not " " <= c <= "~":
                total += 1000 if wide else 556
                continue
        total += _WIDTHS[ord(c) - 32]
    return int(total * size / 1000 + 0.5)

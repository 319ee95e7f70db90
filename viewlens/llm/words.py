"""Words between ASCII white space, read from a text in stretches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters in a stretch; a longer word makes a longer stretch.
STRETCH = 1 << 20
_GAP = re.compile(r"[\x20\x09-\x0D]")


def stretches(text: str) -> Iterator[str]:
    """``text`` in parts that end where a word ends."""
    start = 0
    while start < len(text):
        end = start + STRETCH
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def words(stretch: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``, in UTF-8: bytes know no other white space."""
    return stretch.encode().split()

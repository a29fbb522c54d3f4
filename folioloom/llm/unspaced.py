"""Words in scripts that put no spaces between them: each character is one."""

from __future__ import annotations

import re

from .decontaminate import SPACELESS

#: Bytes with which characters of these scripts begin in UTF-8 (and others).
LEADS = re.compile(rb"[\xe0-\xf0]")
_SIGN = re.compile(f"[{SPACELESS}]")


def word_count(word: bytes) -> int:
    """Words of a run between white space: one, or the characters of these scripts if it has two or more."""
    if not LEADS.search(word):
        return 1
    return max(1, len(_SIGN.findall(word.decode("utf-8", "ignore"))))


def spaced(text: bytes) -> bytes:
    """The text with spaces around each character of these scripts."""
    if not LEADS.search(text):
        return text
    return _SIGN.sub(r" \g<0> ", text.decode("utf-8", "replace")).encode()

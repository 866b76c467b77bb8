"""Character classes shared by the two tokenizing operators.

Python's ``re`` has no ``\\p{L}``. For texts made only of the characters listed
here, the explicit classes below mean the same as ``\\p{L}``, ``\\p{N}`` and the
Unicode white space of the tokenizer files, and neither NFC nor case mapping has
a special case. Any other text takes the slower general way.
"""

from __future__ import annotations

import re

# Letters, digits, white space and symbols that all definitions agree on.
LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ŉŊ-ſ"
DIGITS = "0-9"
SPACE = "\t-\r "
SYMBOLS = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-›€"

#: White space as Unicode's White_Space property has it; ``\\s`` of ``re`` also takes U+001C to U+001F.
WHITE = "\t-\r \x85\xa0  -     　"

_odd = re.compile(f"[^{LETTERS}{DIGITS}{SPACE}{SYMBOLS}²³¹]|[²³¹]")


def is_plain(text: str) -> bool:
    """True if every character is in the lists above."""
    return _odd.search(text) is None

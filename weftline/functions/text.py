"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word that are kept; longer words are cut.
WORD_CHARS = 31


def space_tokens(text: Column | str) -> Column:
    """The tokens between single or repeated spaces; tabs and line feeds do not separate."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def cut_word(word: Column | str, chars: int = WORD_CHARS) -> Column:
    return F.substring(word, 1, chars)

"""Pre-tokenization patterns of the supported families, for Java regular expressions in Spark and for `regex`.

Java's `\\s` is ASCII only and its Unicode classes need names, so white space is spelled as the property
IsWhite_Space; case-insensitive contractions need Unicode folding, because the long s folds to s.
"""

from __future__ import annotations

from enum import Enum
from string import punctuation

import regex


class Family(str, Enum):
    """How a vocabulary's texts are cut and normalized."""

    GPT2 = "gpt2"
    LLAMA3 = "llama3"
    QWEN25 = "qwen25"
    DEEPSEEK_V3 = "deepseek_v3"
    GEMMA3 = "gemma3"


_S, _NS = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
#: English contractions, in the order in which they are tried.
_SUFFIXES = "|".join("'" + x for x in "s t re ve m ll d".split())
_TAIL = rf"{_S}*[\r\n]+|{_S}+(?!{_NS})|{_S}+"


def _word_digit_other(digits: str) -> str:
    return rf"(?iu:{_SUFFIXES})|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|{digits}| ?[^{_S}\p{{L}}\p{{N}}]+[\r\n]*|{_TAIL}"


_ASCII_MARKS = "".join("\\" + c for c in punctuation)
_KANA_HAN = "一-龥぀-ゟ゠-ヿ"
#: What the last pass leaves unmatched: runs of characters of none of its classes, up to one before a letter.
_GAP = rf"[^{_S}\p{{L}}\p{{M}}\p{{P}}\p{{S}}]+(?![\p{{L}}\p{{M}}])"
_DEEPSEEK_LAST = rf"[{_ASCII_MARKS}][A-Za-z]+|[^\r\n\p{{L}}\p{{P}}\p{{S}}]?[\p{{L}}\p{{M}}]+| ?[\p{{P}}\p{{S}}]+[\r\n]*|{_TAIL}|{_GAP}"

#: The passes of each byte-level family; every pass cuts each piece of the one before and covers it wholly.
PASSES: dict[Family, tuple[str, ...]] = {
    Family.GPT2: (rf"{_SUFFIXES}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?!{_NS})|{_S}+",),
    Family.LLAMA3: (_word_digit_other(r"\p{N}{1,3}"),),
    Family.QWEN25: (_word_digit_other(r"\p{N}"),),
    Family.DEEPSEEK_V3: (r"\p{N}{1,3}|\P{N}+", rf"[{_KANA_HAN}]+|[^{_KANA_HAN}]+", _DEEPSEEK_LAST),
}


def _python(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace("IsWhite_Space", "White_Space").replace("(?iu:", "(?i:"))


_COMPILED = {family: tuple(map(_python, passes)) for family, passes in PASSES.items()}


def cut(family: Family, text: str) -> list[str]:
    """The pre-tokens of a text without literals, in Python; the Column form is in functions.pretokens."""
    pieces = [text] if text else []
    for p in _COMPILED[family]:
        pieces = [m for piece in pieces for m in p.findall(piece)]
    return pieces

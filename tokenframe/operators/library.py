"""The upstream encoder `tiktoken` as an engine, where it provably gives the same ids.

It merges any two neighbours whose concatenation is a token, by that token's id; a vocabulary merges listed pairs
by their rank. The two agree on every text if (1) merges make tokens in the order of their ids, each token by one
merge, and (2) every token, encoded alone, comes out as itself. For then neighbours whose concatenation is the
lowest token within reach can only be its listed pair: no merge has crossed the bounds of that stretch, so inside
it everything went as it does for the token alone. Both conditions are checked over the whole vocabulary, and a
few texts are compared besides, before the engine is used.

It takes texts of characters up to U+017E without very long white space; in them the regular-expression
engines agree on every class and nothing needs normalizing. All other texts go through the JVM's patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from ..functions.patterns import Family, cut
from ..sources.vocabulary import Vocabulary, literal_pattern
from .merge import Merger

#: Texts that the engine takes.
PLAIN, LONG_SPACE = r"\A[\x00-\x{17E}]*\z", r"\s{1000}"
_END = r"\s+(?!\S)|\s+"
_PATTERNS = {
    Family.GPT2: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" + _END,
    Family.LLAMA3: r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|" + _END,
    Family.QWEN25: r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|" + _END,
}
CANARIES = ("", "a", " the  Theory\tof it's\n\n\nWE'LL 12345 x9", "  \r\n -- !?.. naïve café x ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x1c\x85 <|x|> {}[]", "zq" * 40 + " " * 70 + "y")
_known: dict[str, bool] = {}
_merging: dict[str, bool] = {}


def merges_differ(vocab: Vocabulary) -> str | None:
    """The reason for which the engine may merge a piece otherwise; None if it can't."""
    if vocab.sentence_piece:
        return "its pieces aren't bytes"
    made = [new for _, _, new in vocab.merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        return "merges don't make tokens in the order of their ids"
    if set(vocab.model_ids.values()) != set(made) | set(vocab.byte_ids) or set(made) & set(vocab.byte_ids):
        return "a token is neither a byte nor the product of a merge"
    own = Merger(vocab)
    for raw, i in vocab.model_ids.items():
        if own.scan(own.first_ids(raw)) != [i]:
            return f"token {i} isn't reached by merging"
    return None


def single(vocab: Vocabulary):
    """The engine's own merge of one piece of bytes, if it has one."""
    import tiktoken

    encoder = tiktoken.Encoding(vocab.family.value, pat_str=_END, mergeable_ranks=vocab.model_ids, special_tokens={})
    return getattr(encoder, "_encode_single_piece", None)


def merges(vocab: Vocabulary) -> bool:
    """Whether the engine merges every piece as the vocabulary does, however its texts are cut; worked out once."""
    if vocab.digest not in _merging:
        try:
            run, own = None if merges_differ(vocab) else single(vocab), Merger(vocab)
            _merging[vocab.digest] = run is not None and all(run(t.encode()) == own.scan(own.first_ids(t)) for t in CANARIES if t)
        except ImportError:
            _merging[vocab.digest] = False
    return _merging[vocab.digest]


def why_not(vocab: Vocabulary) -> str | None:
    """The reason for which the engine can't be used; None if it can."""
    if vocab.family not in _PATTERNS:
        return "its texts aren't cut by one pattern"
    literals = sorted(vocab.added)
    if any(b.startswith(a) for a, b in zip(literals, literals[1:])):
        return "a literal begins another one"
    if (reason := merges_differ(vocab)) is not None:
        return reason
    own = Merger(vocab)
    try:
        engine = Engine(vocab)
    except ImportError:
        return "tiktoken isn't installed"
    for text in CANARIES:
        if engine.plain(text).tolist() != [i for p in cut(vocab.family, text) for i in own.piece(p)]:
            return f"the engines differ on {text!r}"
    return None


@dataclass
class Engine:
    """What a worker needs; the encoder itself is made where it is used."""

    vocab: Vocabulary

    def __post_init__(self):
        import tiktoken

        self.encoder = tiktoken.Encoding(self.vocab.family.value, pat_str=_PATTERNS[self.vocab.family], mergeable_ranks=self.vocab.model_ids, special_tokens={})
        literal = literal_pattern(self.vocab)
        self.literal = re.compile(f"({literal})") if literal else None

    def plain(self, text: str) -> np.ndarray:
        return self.encoder.encode_to_numpy(text, disallowed_special=()).view(np.int32)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, literals included."""
        if self.literal is None or not self.literal.search(text):
            return self.plain(text)
        parts = self.literal.split(text)
        return np.concatenate([np.array([self.vocab.added[p]], np.int32) if i % 2 else self.plain(p) for i, p in enumerate(parts)])


def usable(vocab: Vocabulary) -> bool:
    """Whether the engine gives the vocabulary's ids; worked out once for each vocabulary."""
    if vocab.digest not in _known:
        _known[vocab.digest] = why_not(vocab) is None
    return _known[vocab.digest]


def takes(text: Column) -> Column:
    return text.rlike(PLAIN) & ~text.rlike(LONG_SPACE)

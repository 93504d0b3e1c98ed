"""Vocabularies in tokenizer.json form: loading, checking, family detection.

A vocabulary that isn't exactly of a supported family is an error, never a near match.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.patterns import Family

#: The published split patterns, as tokenizer.json files spell them: of Llama 3 and Qwen 2.5, which differ in
#: their digits, and the three of DeepSeek V3, the last with raw line breaks.
_WORDS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|%s| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_LAST = (
    r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~][A-Za-z]+"""
    + "|[^\r\n\\p{L}\\p{P}\\p{S}]?[\\p{L}\\p{M}]+| ?[\\p{P}\\p{S}]+[\r\n]*|\\s*[\r\n]+|\\s+(?!\\S)|\\s+"
)
_SPLITS = {"three": _WORDS % r"\p{N}{1,3}", "single": _WORDS % r"\p{N}", "digits": r"\p{N}{1,3}", "han": "[一-龥぀-ゟ゠-ヿ]+", "last": _LAST}
LOW_BAR = "▁"
EOS_NAMES = ("<|end_of_text|>", "<|endoftext|>", "<｜end▁of▁sentence｜>")


class VocabularyError(ValueError):
    """A vocabulary that isn't exactly of a supported kind."""


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies spell each byte."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    hidden = iter(range(0x100, 0x100 + 256))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = byte_letters()
_BYTE_OF = {c: b for b, c in enumerate(_LETTERS)}


def spelled_bytes(token: str) -> bytes:
    """Raw bytes of a byte-level spelling."""
    try:
        return bytes(_BYTE_OF[c] for c in token)
    except KeyError as e:
        raise VocabularyError(f"{token!r} isn't a byte-level spelling") from e


@dataclass
class Vocabulary:
    """Everything that encoding and decoding need; small enough to broadcast."""

    family: Family
    tokens: dict[int, bytes]
    model_ids: dict[bytes, int]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]
    special: frozenset[int]
    bos_ids: tuple[int, ...] = ()
    eos_ids: tuple[int, ...] = ()
    nfc: bool = False
    ignore_merges: bool = False
    byte_ids: tuple[int, ...] = ()
    path: str | None = None
    added_flags: dict[str, dict] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return max(self.tokens) + 1

    @cached_property
    def digest(self) -> str:
        """A digest of everything that ids depend on; workers know vocabularies by it."""
        return hashlib.sha256(repr((self.family.value, sorted(self.tokens.items()), self.merges, sorted(self.added.items()), self.nfc, self.ignore_merges, self.byte_ids)).encode()).hexdigest()

    @property
    def sentence_piece(self) -> bool:
        return self.family is Family.GEMMA3

    def require(self, literal: str) -> int:
        if literal not in self.added:
            raise VocabularyError(f"the vocabulary has no special token {literal!r}")
        return self.added[literal]

    def eos(self) -> tuple[int, ...]:
        """The ids that close a document: the post-processor's, else the first known literal's."""
        return self.eos_ids or next(((self.added[x],) for x in EOS_NAMES if x in self.added), ())

    def describe(self) -> dict:
        """What the vocabulary is and which engine serves it."""
        from ..operators import library

        note = library.why_not(self)
        return {
            "family": self.family.value, "size": self.size, "merges": len(self.merges), "added": len(self.added), "special": len(self.special), "path": self.path, "digest": self.digest,
            "normalizes": self.nfc, "engine": "own" if note else "tiktoken", "engine_note": note,
        }

    def info_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(self.describe().values())], "family string, size int, merges int, added int, special int, path string, digest string, normalizes boolean, engine string, engine_note string")

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        added = {i: s for s, i in self.added.items()}
        rows = [
            (i, added.get(i) or (b.decode("utf-8") if self.sentence_piece else "".join(_LETTERS[x] for x in b)), bytearray(b), self.model_ids.get(b) == i and i not in added, i in added, i in self.special)
            for i, b in sorted(self.tokens.items())
        ]
        return spark.createDataFrame(rows, "id int, token string, bytes binary, is_model boolean, is_added boolean, special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, *m) for r, m in enumerate(self.merges)], "rank int, left_id int, right_id int, new_id int")


def _is_byte_level(x, trim: bool, use_regex: bool) -> bool:
    return isinstance(x, dict) and x.get("type") == "ByteLevel" and x.get("add_prefix_space") is False and x.get("trim_offsets", True) is trim and x.get("use_regex", True) is use_regex


def _is_split(x, pattern: str) -> bool:
    return isinstance(x, dict) and x.get("type") == "Split" and x.get("pattern") == {"Regex": pattern} and x.get("behavior") == "Isolated" and x.get("invert", False) is False


def detect_family(spec: dict) -> Family:
    """The family whose pre-tokenizer and normalizer the specification has exactly."""
    cutter, normal = spec.get("pre_tokenizer"), spec.get("normalizer")
    if normal is None and _is_byte_level(cutter, True, True):
        return Family.GPT2
    steps = cutter.get("pretokenizers") if isinstance(cutter, dict) and cutter.get("type") == "Sequence" else None
    if isinstance(steps, list):
        if normal is None and len(steps) == 2 and _is_split(steps[0], _SPLITS["three"]) and _is_byte_level(steps[1], True, False):
            return Family.LLAMA3
        if isinstance(normal, dict) and normal.get("type") == "NFC" and len(steps) == 2 and _is_split(steps[0], _SPLITS["single"]) and _is_byte_level(steps[1], False, False):
            return Family.QWEN25
        empty = isinstance(normal, dict) and normal.get("type") == "Sequence" and normal.get("normalizers") == []
        if empty and len(steps) == 4 and all(_is_split(s, _SPLITS[k]) for s, k in zip(steps, ("digits", "han", "last"))) and _is_byte_level(steps[3], True, False):
            return Family.DEEPSEEK_V3
    if isinstance(normal, dict) and normal.get("type") == "Replace" and normal.get("pattern") == {"String": " "} and normal.get("content") == LOW_BAR:
        if isinstance(cutter, dict) and cutter.get("type") == "Split" and cutter.get("pattern") == {"String": " "} and cutter.get("behavior") == "MergedWithPrevious" and cutter.get("invert", False) is False:
            return Family.GEMMA3
    raise VocabularyError("the pre-tokenizer and normalizer are of no supported family")


def _check_options(model: dict, family: Family) -> None:
    if model.get("dropout") is not None or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise VocabularyError("dropout, prefixes and suffixes aren't supported")
    for name, only in (("byte_fallback", Family.GEMMA3), ("fuse_unk", Family.GEMMA3), ("ignore_merges", Family.LLAMA3)):
        if bool(model.get(name, False)) != (family is only) and not (family is not only and not model.get(name, False)):
            raise VocabularyError(f"{name} must be {family is only} for {family.value}")
    if (model.get("unk_token") != "<unk>") if family is Family.GEMMA3 else (model.get("unk_token") is not None):
        raise VocabularyError("unexpected unk_token")


def _template_ids(processor, added: dict[str, int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Ids before and after the sequence in a TemplateProcessing, also inside a Sequence of processors."""
    if not isinstance(processor, dict):
        return (), ()
    if processor.get("type") == "Sequence":
        for inner in processor.get("processors", []):
            if (found := _template_ids(inner, added)) != ((), ()):
                return found
        return (), ()
    if processor.get("type") != "TemplateProcessing":
        return (), ()
    known = processor.get("special_tokens", {})
    before: list[int] = []
    after: list[int] = []
    target = before
    for part in processor.get("single", []):
        if "Sequence" in part:
            target = after
        elif name := part.get("SpecialToken", {}).get("id"):
            ids = known.get(name, {}).get("ids") or ([added[name]] if name in added else [])
            target += ids[:1]
    return tuple(before), tuple(after)


def _check_literals(literals: list[str], family: Family) -> None:
    """A literal may not hold, beyond its start, the first character of any literal: matches would overlap."""
    firsts = {x[0] for x in literals}
    for x in literals:
        if not (family is Family.GEMMA3 and len(set(x)) == 1) and firsts & set(x[1:]):
            raise VocabularyError(f"the literal {x!r} may overlap another one")


def _check_runs(model: dict, literals: list[str]) -> None:
    """A sentence-piece vocabulary's merges may not cross the bounds of runs of line breaks, tabs or low bars.

    The one exception is a closing bracket before a low bar and an opening tag; other literals hold no such character.
    """
    for m in model["merges"]:
        left, right = m.split(" ", 1) if isinstance(m, str) else m
        if any((set(left) == {c}) != (set(right) == {c}) for c in "\n\t") or (set(left) != {LOW_BAR} and right.startswith(LOW_BAR) and (left, right) != (">", LOW_BAR + "</")):
            raise VocabularyError(f"the merge {left!r} {right!r} crosses a run")
    for x in literals:
        if len(set(x)) > 1 and set(x) & {"\n", "\t", LOW_BAR}:
            raise VocabularyError(f"the literal {x!r} overlaps a run")


def load(source: str | dict) -> Vocabulary:
    """A vocabulary from a tokenizer.json path or its parsed content."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            spec = json.load(f)
    else:
        spec = source
    model = spec.get("model")
    if not isinstance(model, dict) or model.get("type", "BPE") != "BPE":
        raise VocabularyError("a BPE model is asked for")
    if "vocab" not in model or "merges" not in model:
        raise VocabularyError("vocab and merges are asked for")
    family = detect_family(spec)
    _check_options(model, family)
    pieces = family is Family.GEMMA3
    added: dict[str, int] = {}
    flags: dict[str, dict] = {}
    for x in spec.get("added_tokens") or []:
        content, own = x["content"], int(x["id"])
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise VocabularyError(f"{content!r}: single_word, lstrip and rstrip aren't supported")
        if x.get("normalized") and spec.get("normalizer") is not None:
            raise VocabularyError(f"{content!r} is matched after normalization, which isn't supported")
        if added.get(content, own) != own or own in {i for c, i in added.items() if c != content}:
            raise VocabularyError(f"{content!r} conflicts with another added token")
        if model["vocab"].get(content, own) != own:
            raise VocabularyError(f"{content!r} has another id in the model")
        added[content], flags[content] = own, x
    by_id: dict[int, str] = {}
    for token, i in model["vocab"].items():
        if by_id.setdefault(int(i), token) != token:
            raise VocabularyError(f"id {i} has two tokens")
    for content, i in added.items():
        if by_id.get(i, content) != content:
            raise VocabularyError(f"{content!r} has the id of another token")
    tokens: dict[int, bytes] = {}
    model_ids: dict[bytes, int] = {}
    for token, i in model["vocab"].items():
        tokens[int(i)] = raw = token.encode("utf-8") if pieces or token in added else spelled_bytes(token)
        if token not in added or pieces:
            model_ids[raw] = int(i)
    tokens |= {i: c.encode("utf-8") for c, i in added.items()}
    merges = []
    for m in model["merges"]:
        left, right = m.split(" ", 1) if isinstance(m, str) else m
        try:
            merges.append((model["vocab"][left], model["vocab"][right], model["vocab"][left + right]))
        except KeyError as e:
            raise VocabularyError(f"the merge {left!r} {right!r} needs {e.args[0]!r}") from e
    try:
        byte_ids = tuple(model["vocab"][f"<0x{b:02X}>"] for b in range(256)) if pieces else tuple(model["vocab"][c] for c in _LETTERS)
    except KeyError as e:
        raise VocabularyError(f"the byte token {e.args[0]!r} is missing") from e
    _check_literals(list(added), family)
    if pieces:
        _check_runs(model, list(added))
    bos, eos = _template_ids(spec.get("post_processor"), added)
    return Vocabulary(
        family, tokens, model_ids, merges, added, frozenset(i for c, i in added.items() if flags[c].get("special")), bos, eos, family is Family.QWEN25, bool(model.get("ignore_merges", False)), byte_ids, source if isinstance(source, str) else None, flags
    )


def variant(spec: dict, family: Family, literals: tuple[str, ...] = ()) -> dict:
    """A byte-level specification with another family's pre-tokenizer and normalizer and further special tokens."""
    byte_level = lambda trim: {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": trim, "use_regex": False}
    split = lambda k: {"type": "Split", "pattern": {"Regex": _SPLITS[k]}, "behavior": "Isolated", "invert": False}
    normal, cutter = {
        Family.GPT2: (None, byte_level(True) | {"use_regex": True}),
        Family.LLAMA3: (None, {"type": "Sequence", "pretokenizers": [split("three"), byte_level(True)]}),
        Family.QWEN25: ({"type": "NFC"}, {"type": "Sequence", "pretokenizers": [split("single"), byte_level(False)]}),
        Family.DEEPSEEK_V3: ({"type": "Sequence", "normalizers": []}, {"type": "Sequence", "pretokenizers": [split("digits"), split("han"), split("last"), byte_level(True)]}),
    }[family]
    model = dict(spec["model"])
    if family is Family.LLAMA3:
        model["ignore_merges"] = True
    tokens = list(spec["added_tokens"])
    at = max([*model["vocab"].values(), *(x["id"] for x in tokens)]) + 1
    have = {x["content"] for x in tokens}
    for text in literals:
        if text not in have:
            tokens.append({"id": at, "content": text, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
            at += 1
    return spec | {"model": model, "added_tokens": tokens, "normalizer": normal, "pre_tokenizer": cutter}


def literal_pattern(vocab: Vocabulary) -> str:
    """An alternation of the added tokens, longest first, for Python."""
    return "|".join(re.escape(x) for x in sorted(vocab.added, key=lambda x: (-len(x), x)))

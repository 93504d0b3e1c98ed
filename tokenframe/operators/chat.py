"""Chat templates: arrays of (role, content) to pieces of text and special ids, to text, and to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.vocabulary import Vocabulary, VocabularyError
from .encode import encode, merged, pretokens_of

LLAMA3 = tuple(f"<|{x}|>" for x in "begin_of_text start_header_id end_header_id eot_id".split())
QWEN25 = ("<|im_start|>", "<|im_end|>")
DEEPSEEK_V3 = tuple(f"<｜{x}｜>" for x in ("begin▁of▁sentence", "User", "Assistant", "end▁of▁sentence"))
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."


def detect_template(vocab: Vocabulary) -> str | None:
    """The chat template that the vocabulary's special tokens belong to."""
    for name, needed in (("llama3", LLAMA3[:2]), ("qwen25", QWEN25), ("deepseek_v3", DEEPSEEK_V3[:2])):
        if all(x in vocab.added for x in needed):
            return name
    return None


def _text(x) -> Column:
    return F.struct(F.lit(False).alias("special"), (F.lit(x) if isinstance(x, str) else x).alias("text"))


def _mark(x: str) -> Column:
    return F.struct(F.lit(True).alias("special"), F.lit(x).alias("text"))


def _known_roles(turns: Column) -> Column:
    bad = F.filter(turns, lambda t: ~F.coalesce(t["role"].isin("system", "user", "assistant"), F.lit(False)))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(bad[0]["role"], F.lit("null")))).cast("array<struct<role:string,content:string>>")).otherwise(turns)


def _llama3(turns: Column, prompt: bool) -> Column:
    bos, start, end, close = LLAMA3
    each = F.flatten(F.transform(turns, lambda t: F.array(_mark(start), _text(t["role"]), _mark(end), _text(F.concat(F.lit("\n\n"), t["content"])), _mark(close))))
    tail = [F.array(_mark(start), _text("assistant"), _mark(end), _text("\n\n"))] if prompt else []
    return F.concat(F.array(_mark(bos)), each, *tail)


def _qwen25(turns: Column, prompt: bool) -> Column:
    start, close = QWEN25
    one = lambda role, content: F.array(_mark(start), _text(F.concat(role, F.lit("\n"), content)), _mark(close), _text("\n"))
    each = F.flatten(F.transform(_known_roles(turns), lambda t: one(t["role"], t["content"])))
    default = F.when(F.exists(turns, lambda t: t["role"] == "system"), F.array().cast("array<struct<special:boolean,text:string>>")).otherwise(one(F.lit("system"), F.lit(DEFAULT_SYSTEM)))
    tail = [F.array(_mark(start), _text("assistant\n"))] if prompt else []
    return F.concat(default, each, *tail)


def _deepseek_v3(turns: Column, prompt: bool) -> Column:
    bos, user, assistant, eos = DEEPSEEK_V3
    turns = _known_roles(turns)
    system = F.coalesce(F.get(F.reverse(F.filter(turns, lambda t: t["role"] == "system")), 0)["content"], F.lit(""))
    asked = lambda t: F.array(_mark(user), _text(t["content"]))
    said = lambda t: F.array(_mark(assistant), _text(t["content"]), _mark(eos))
    each = F.flatten(F.transform(F.filter(turns, lambda t: t["role"] != "system"), lambda t: F.when(t["role"] == "user", asked(t)).otherwise(said(t))))
    tail = [F.array(_mark(assistant))] if prompt else []
    return F.concat(F.array(_mark(bos)), F.array(_text(system)), each, *tail)


TEMPLATES = {"llama3": _llama3, "qwen25": _qwen25, "deepseek_v3": _deepseek_v3}


def render(turns: Column, template: str, generation_prompt: bool = False) -> Column:
    """array<struct<special, text>>: literals of special tokens and the texts between them, adjacent texts merged."""
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))
    pieces = F.filter(TEMPLATES[template](clean, generation_prompt), lambda p: p["special"] | (p["text"] != ""))

    def add(done, p):
        last = F.get(done, F.size(done) - 1)
        join = (F.size(done) > 0) & ~p["special"] & ~F.coalesce(last["special"], F.lit(True))
        merged = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.struct(F.lit(False).alias("special"), F.concat(last["text"], p["text"]).alias("text")))
        return F.when(join, merged).otherwise(F.array_append(done, p))

    return F.aggregate(pieces, F.array().cast("array<struct<special:boolean,text:string>>"), add)


def render_text(turns: Column, template: str, generation_prompt: bool = False) -> Column:
    """The rendered conversation with special tokens as their literals."""
    return F.array_join(F.transform(render(turns, template, generation_prompt), lambda p: p["text"]), "")


def turns_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """(key, turns) of rows by turn."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(content, F.lit("")).alias("content"))))
    return rows.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))


def chat_json(text: Column) -> Column:
    """Turns of a chat in JSON: a bare array, or an object with messages; missing fields are empty."""
    kind = "array<struct<role:string,content:string>>"
    bare = F.from_json(text, kind)
    inside = F.from_json(text, f"struct<messages:{kind}>")["messages"]
    found = F.when(F.ltrim(text).startswith("["), bare).otherwise(inside)
    return F.transform(found, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))


def encode_chat(df: DataFrame, vocab: Vocabulary, turns: str = "turns", template: str | None = None, generation_prompt: bool = False, out: str = "ids") -> DataFrame:
    """Adds a conversation's ids: special tokens directly, every text between them encoded on its own.

    Literals inside contents still match, as anywhere in a text.
    """
    template = template or detect_template(vocab)
    if template is None:
        raise VocabularyError("the vocabulary has the special tokens of no chat template")
    for literal in {"llama3": LLAMA3, "qwen25": QWEN25, "deepseek_v3": DEEPSEEK_V3}[template]:
        vocab.require(literal)
    pieces = render(F.col(turns), template, generation_prompt)
    if vocab.nfc or vocab.sentence_piece:  # pre-tokens come from Python, which takes whole columns
        return encode(df.withColumn("__chat", F.array_join(F.transform(pieces, lambda p: p["text"]), "")), vocab, "__chat", out).drop("__chat")
    cut = F.flatten(F.transform(pieces, lambda p: F.when(p["special"], F.array(p["text"])).otherwise(pretokens_of(vocab, p["text"]))))
    return df.withColumn(out, merged(vocab, cut, df.sparkSession))

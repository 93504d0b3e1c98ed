"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; DataFrame functions only.

Method: a record's nested field paths (its JSON schema without leaf types) are hashed; the hash selects one of
the declared layouts (messages, prompt and completion, instruction and input, ...), whose mapping turns the
record into an array of (role, text). Canonical turns are formatted with a template that marks every turn and
escapes control characters inside texts reversibly, with the loss mask as character spans of assistant texts.

The template: `[TAG]body</s>` per turn, TAG being SYS, INST, OUT or `R:` and the escaped role. Inside bodies
`\\`, `<` and `[` become `\\b`, `\\l` and `\\o` (in roles `]` becomes `\\c` too), so no control string survives
in a text and reading back is exact.

Records are JSON texts or structs. A struct's paths are those of its fields that aren't null, and its turns come
straight from its fields, so conversations made of rows never pass through JSON. Malformed JSON and unknown
layouts give null turns, and null turns null formats. A JSON text of over LONGEST characters that the parser
doesn't take is an error, for it may be well formed: the parser takes strings of 20 million characters.

Null roles and texts are empty strings. A record without turns gives empty turns and an empty format, an empty
table no records. Turns that tie on their number are ordered by role, then text; repeated rows stay. A row with a
null conv_id belongs to no known conversation and is one of its own. A conversation has to fit in one value
(2 GB). Other columns, whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import table

TURNS = "array<struct<role:string,text:string>>"
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
#: The shape of a list without turns, which layouts may share; the first declared has it.
EMPTY = "ARRAY<VOID>"
#: Characters of a JSON text beyond which a parser that gives up is an error.
LONGEST = 16_000_000
TAGS = {"system": "SYS", "user": "INST", "assistant": "OUT"}


@dataclass(frozen=True)
class Messages:
    """A list of turns at `path`, each with a role and a text field; the record may have other fields beside it."""

    path: str
    role: str
    text: str
    aliases: bool = False
    beside: tuple[str, ...] = ()

    def shapes(self) -> list[str]:
        inner = ", ".join(sorted((self.role, self.text)))
        own = f"{self.path}: ARRAY<OBJECT<{inner}>>"
        every = [c for n in range(len(self.beside) + 1) for c in combinations(self.beside, n)]
        return ["OBJECT<" + ", ".join(sorted((*c, x), key=lambda x: x.split(":")[0])) + ">" for x in (own, f"{self.path}: {EMPTY}") for c in every]

    def turns(self, v: Column, own: StructType | None = None) -> Column:
        """The turns of a variant, or of a struct of the type `own`."""
        kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
        if own is not None and not _has(own, self.path, (self.role, self.text)):
            return F.lit(None).cast(TURNS)
        role = lambda x: x[self.role]
        if self.aliases:
            names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
            role = lambda x: F.coalesce(names[x[self.role]], x[self.role])
        found = F.try_variant_get(v, f"$.{self.path}", kind) if own is None else v[self.path]
        return F.transform(found, lambda x: _turn(role(x), x[self.text]))


@dataclass(frozen=True)
class Fields:
    """Fields that are one turn each, in order; those in `optional` may be missing. `joined` goes below the text of another."""

    turns_of: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    joined: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> list[str]:
        names = [f for _, f in self.turns_of] + [b for _, b in self.joined]
        needed = [n for n in names if n not in self.optional]
        every = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return ["OBJECT<" + ", ".join(sorted((*needed, *c))) + ">" for c in every]

    def turns(self, v: Column, own: StructType | None = None) -> Column:
        """The turns of a variant, or of a struct of the type `own`."""
        names = own.names if own is not None else []
        get = lambda name: F.try_variant_get(v, f"$.{name}", "string") if own is None else v[name].cast("string") if name in names else F.lit(None).cast("string")
        below = dict(self.joined)
        parts = []
        for role, name in self.turns_of:
            text = F.concat(F.coalesce(get(name), F.lit("")), F.when(F.coalesce(get(below[name]), F.lit("")) != "", F.concat(F.lit("\n\n"), get(below[name]))).otherwise("")) if name in below else get(name)
            turn = F.array(_turn(F.lit(role), text))
            parts.append(F.when(get(name).isNotNull(), turn).otherwise(F.array().cast(TURNS)) if name in self.optional else turn)
        return F.concat(*parts)


def _has(own: StructType, path: str, fields: tuple[str, ...]) -> bool:
    kind = own[path].dataType if path in own.names else None
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and set(fields) <= set(kind.elementType.names)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


#: Layouts by name. Their shapes must differ.
LAYOUTS: dict[str, Messages | Fields] = {
    "messages_text": Messages("messages", "role", "text", beside=("conv_id", "id")),
    "messages_content": Messages("messages", "role", "content", beside=("conv_id", "id")),
    "conversations": Messages("conversations", "from", "value", aliases=True, beside=("id",)),
    "prompt_completion": Fields((("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    "prompt_response": Fields((("system", "system"), ("user", "prompt"), ("assistant", "response")), ("system",)),
    "question_answer": Fields((("user", "question"), ("assistant", "answer"))),
    "instruction": Fields((("system", "system"), ("user", "instruction"), ("assistant", "output")), ("system", "input"), (("instruction", "input"),)),
}


def shape(v: Column) -> Column:
    """A variant's nested field paths: its schema without leaf types."""
    return F.regexp_replace(F.schema_of_variant(v), r": (?!ARRAY<|OBJECT<)[A-Z]+(\([^)]*\))?", "")


def struct_shape(record: Column, own: StructType) -> Column:
    """The same of a struct: of its fields that aren't null. Lists have the paths of their elements' type."""

    def path(field) -> Column:
        kind, name = field.dataType, field.name
        if isinstance(kind, ArrayType):
            inner = f"OBJECT<{', '.join(sorted(kind.elementType.names))}>" if isinstance(kind.elementType, StructType) else ""
            return F.when(record[name].isNotNull(), f"{name}: ARRAY<{inner}>")
        if isinstance(kind, StructType):
            return F.when(record[name].isNotNull(), F.concat(F.lit(f"{name}: "), struct_shape(record[name], kind)))
        return F.when(record[name].isNotNull(), name)

    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *(path(own[n]) for n in sorted(own.names))), F.lit(">"))


def fingerprint(v: Column, own: StructType | None = None) -> Column:
    return F.xxhash64(shape(v) if own is None else struct_shape(v, own))


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def canonical(records: DataFrame, column: str = "record", layouts: dict | None = None) -> DataFrame:
    """Adds layout (string) and turns (array of role, text) to records in `column`: JSON texts or structs."""
    layouts = LAYOUTS if layouts is None else layouts
    by_hash = {}
    for name, layout in layouts.items():
        for s in layout.shapes():
            if by_hash.setdefault(_hash(s), name) != name and EMPTY not in s:
                raise ValueError(f"two layouts have the shape {s}")
    v, known = F.col("__variant"), F.create_map(*(F.lit(x) for pair in by_hash.items() for x in pair))
    own = records.schema[column].dataType if isinstance(records.schema[column].dataType, StructType) else None
    if own is None:
        given_up = F.try_parse_json(column).isNull() & (F.length(column) > LONGEST)
        text = F.when(given_up, F.raise_error(F.concat(F.lit("a JSON text that the parser doesn't take has characters: "), F.length(column).cast("string"))).cast("string")).otherwise(F.col(column))
        parsed = records.withColumn("__variant", F.try_parse_json(text))
    else:
        parsed = records.withColumn("__variant", F.col(column))
    parsed = parsed.withColumn("layout", known[fingerprint(v, own)])
    turns = F.lit(None).cast(TURNS)
    for name, layout in layouts.items():
        turns = F.when(F.col("layout") == name, layout.turns(v, own)).otherwise(turns)
    return parsed.withColumn("turns", turns).drop("__variant")


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("[", "\\o")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\l", "<"), ("\\o", "["), ("\\c", "]"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _tag(role: Column) -> Column:
    tag = F.concat(F.lit("R:"), F.replace(escape(role), F.lit("]"), F.lit("\\c")))
    for name, short in TAGS.items():
        tag = F.when(role == name, short).otherwise(tag)
    return tag


def formatted(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted (string) and loss (array of start, length in characters) for an array of (role, text)."""
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit("["), _tag(t["role"]), F.lit("]")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    out = conversations.withColumn("__parts", parts)
    out = out.withColumn("formatted", F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, p):
        begin, size = acc["at"] + F.length(p["head"]), F.length(p["body"])
        return F.struct((begin + size + 4).alias("at"), F.when(p["learn"], F.array_append(acc["spans"], F.struct(begin.alias("start"), size.alias("length")))).otherwise(acc["spans"]).alias("spans"))

    return out.withColumn("loss", F.aggregate("__parts", start, step, lambda acc: acc["spans"])).drop("__parts")


def read_back(text: Column) -> Column:
    """The turns (array of role, text) of a formatted string."""
    names = F.create_map(*(F.lit(x) for role, tag in TAGS.items() for x in (tag, role)))
    pieces = F.split(text, "</s>", -1)

    def turn(piece):
        tag, body = F.regexp_extract(piece, r"(?s)^\[([^\]]*)\](.*)$", 1), F.regexp_extract(piece, r"(?s)^\[([^\]]*)\](.*)$", 2)
        return F.struct(F.coalesce(names[tag], unescape(F.substring(tag, 3, 1 << 30))).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of rows by turn: one struct with a list of messages each."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("__alone")
    return rows.withColumn("__alone", alone).groupBy("conv_id", "__alone").agg(F.struct(messages.alias("messages")).alias("record")).drop("__alone")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    out = formatted(canonical(records_of(rows.unionByName(extra)))).withColumn("back", read_back(F.col("formatted"))).withColumn("learned", loss_text(F.col("formatted"), F.col("loss")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '[', '\o')) AS body,
    CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 WHEN 'assistant' THEN 3
      ELSE 2 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\o'), ']', '\c')) END AS tag
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(tag + 2 + body + 4)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""

"""The registered queries of the engine, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import is_nfc, nfc
from ..functions.patterns import Family
from ..functions.pretokens import pretokens, split_literals
from ..functions.routing import is_multilingual, size_class
from ..operators import chat, specials
from ..operators.batches import LANE_ROWS, LEAST_LANES, pack_batches
from ..operators.decode import decode, decode_bytes
from ..operators.encode import batch_offsets, encode, encode_bytes, encode_deduplicated, explain_pretokens, tokens_flat
from ..session import read_parquet, ship
from ..sources.files import unpacked, with_packed_ids
from ..sources.vocabulary import Vocabulary, load, variant
from . import oracle

END = "<|endoftext|>"
TOY_LETTERS = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,!?-'▁"]
TOY_MERGES = [("t", "h"), ("th", "e"), ("▁", "the"), ("i", "n"), ("e", "r"), ("▁", "a"), ("o", "n"), ("a", "n"), ("an", "d"), ("▁", "and"), ("e", "n")]


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=8)
def vocabulary(family: Family = Family.GPT2, literals: tuple[str, ...] = ()) -> Vocabulary:
    if family is Family.GPT2 and not literals:
        return load(default_vocabulary_path())
    with open(default_vocabulary_path(), encoding="utf-8") as f:
        return load(variant(json.load(f), family, literals))


@lru_cache(maxsize=1)
def toy_pieces() -> Vocabulary:
    """A small sentence-piece-style vocabulary: single letters, byte tokens, runs and a few merges."""
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *TOY_LETTERS, *(a + b for a, b in TOY_MERGES)]
    runs = ["\n" * n for n in range(1, 32)] + ["\t" * n for n in range(1, 32)] + ["▁" * n for n in range(2, 32)]
    vocab = {t: i for i, t in enumerate(names)}
    added = [{"id": 0, "content": "<unk>", "special": True}] + [{"id": len(names) + i, "content": r, "special": False} for i, r in enumerate(runs)]
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    return load(
        {
            "added_tokens": [x | flags for x in added],
            "normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "▁"},
            "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "MergedWithPrevious", "invert": False},
            "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in TOY_MERGES], "byte_fallback": True, "fuse_unk": True, "unk_token": "<unk>"},
        }
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_docs(spark, sf_dir), vocabulary()).select("doc_id", "ids")


def token_count_per_doc(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))


def _digest(ids="ids"):
    """The md5 of the ids in decimal, with commas between."""
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ",")).alias("ids_md5")


def _counted(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), _digest())


def token_count_deduplicated(spark, sf_dir):
    return _counted(encode_deduplicated(_docs(spark, sf_dir), vocabulary()))


def _family_ids(family: Family):
    def query(spark, sf_dir):
        return _counted(encode(_docs(spark, sf_dir), vocabulary(family)))

    return query


def ids_with_literals(spark, sf_dir):
    joined = _docs(spark, sf_dir).withColumn("text", F.concat(F.lit(END), "text", F.lit(END + END)))
    return _counted(encode(joined, vocabulary()))


def ids_nfc_literals(spark, sf_dir):
    marked = F.concat(F.translate("text", "ae", "\u1100\u1161"), F.lit("e" + END + "\u0301 e\u0301"))
    return _counted(encode(_docs(spark, sf_dir).withColumn("text", marked), vocabulary(Family.QWEN25)))


def ids_long_pieces(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", " \n\t.,", "").alias("text"))
    return _counted(encode(items, vocabulary()), "item_id")


def ids_sentencepiece(spark, sf_dir):
    return _counted(encode(_docs(spark, sf_dir), toy_pieces()))


def encode_malformed(spark, sf_dir):
    raw = _docs(spark, sf_dir).select("doc_id", F.concat(F.unhex(F.lit("80")), F.col("text").cast("binary"), F.unhex(F.lit("0AF09F98"))).alias("bytes"))
    return _counted(encode_bytes(raw, vocabulary()))


def decode_skipping(spark, sf_dir):
    joined = _docs(spark, sf_dir).withColumn("text", F.concat(F.lit(END), "text", F.lit(END)))
    return decode(encode(joined, vocabulary()).select("doc_id", "ids"), vocabulary(), skip_special=True).select("doc_id", F.md5("text").alias("text_md5"))


def _classes(family: Family, there: str, here: str):
    """Pre-tokens of texts with some letters swapped for characters that the tables lack."""

    def query(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", F.posexplode(pretokens(F.translate("text", there, here), family, [])).alias("pos", "piece"))

    return query


def nfc_marks(spark, sf_dir):
    swapped = _docs(spark, sf_dir).select("doc_id", F.translate("text", "aeior", "\u1100\u1161\u11a8\u0301\u0327").alias("text"))
    return swapped.select("doc_id", F.md5(nfc(F.col("text"))).alias("nfc_md5"), is_nfc(F.col("text")).alias("was_nfc"))


def chat_templates(spark, sf_dir):
    rows = []
    for family, literals in ((Family.GPT2, ()), (Family.LLAMA3, chat.LLAMA3), (Family.QWEN25, chat.QWEN25), (Family.DEEPSEEK_V3, chat.DEEPSEEK_V3)):
        own = vocabulary(family, literals)
        rows += [(own.family.value, chat.detect_template(own), text, i) for text, i in sorted(own.added.items())]
    return spark.createDataFrame(rows, "family string, template string, literal string, id int")


def id_files_round_trip(spark, sf_dir):
    packed = with_packed_ids(_encoded(spark, sf_dir)).select("doc_id", "packed")
    return _counted(packed.select("doc_id", unpacked(F.col("packed")).alias("ids")))


def chat_tokens_deepseek(spark, sf_dir):
    return _counted(chat.encode_chat(_turns(spark, sf_dir), vocabulary(Family.DEEPSEEK_V3, chat.DEEPSEEK_V3)), "conv_id")


def tokens_flat_query(spark, sf_dir):
    return tokens_flat(_encoded(spark, sf_dir))


def benchmark_tokens(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return tokens_flat(encode(items, vocabulary()), "item_id")


def _pretokens(family: Family):
    def query(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", F.posexplode(pretokens(F.col("text"), family, [])).alias("pos", "piece"))

    return query


def pretoken_byte_spans(spark, sf_dir):
    return explain_pretokens(_docs(spark, sf_dir), vocabulary()).select("doc_id", "pos", "byte_start", "byte_len")


def batch_offsets_query(spark, sf_dir):
    return batch_offsets(_encoded(spark, sf_dir))


def decode_roundtrip(spark, sf_dir):
    return decode(_encoded(spark, sf_dir), vocabulary()).select("doc_id", F.md5("text").alias("text_md5"))


def decode_bytes_length(spark, sf_dir):
    return decode_bytes(_encoded(spark, sf_dir), vocabulary()).select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("bytes_md5"))


def encode_binary(spark, sf_dir):
    raw = _docs(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("bytes"))
    return _counted(encode_bytes(raw, vocabulary()))


def add_bos_eos(spark, sf_dir):
    framed = _encoded(spark, sf_dir).select("doc_id", specials.add_bos_eos(F.col("ids"), vocabulary()).alias("ids"))
    return framed.select("doc_id", F.size("ids").cast("long").alias("n"), F.get("ids", 0).alias("first_id"), F.get("ids", F.size("ids") - 1).alias("last_id"), _digest())


def truncate_ids(spark, sf_dir):
    cut = _encoded(spark, sf_dir).select("doc_id", specials.framed(F.col("ids"), (50256,), (50256,), 512).alias("ids"))
    mask = F.aggregate(specials.attention_mask(F.col("ids")), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("doc_id", mask.alias("n_mask"), F.size(specials.attention_mask(F.col("ids"))).cast("long").alias("mask_length"), _digest())


def packed_ids(spark, sf_dir):
    return with_packed_ids(_encoded(spark, sf_dir)).select("doc_id", F.octet_length("packed").cast("long").alias("n_bytes"), F.md5("packed").alias("packed_md5"))


def literal_split(spark, sf_dir):
    joined = _docs(spark, sf_dir).withColumn("text", F.concat(F.lit(END), "text", F.lit(END + "<|end")))
    return joined.select("doc_id", F.posexplode(split_literals(F.col("text"), [END])).alias("pos", "piece")).withColumn("is_added", F.col("piece") == END)


def _turns(spark, sf_dir):
    return chat.turns_of(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _chat_text(template: str):
    def query(spark, sf_dir):
        return _turns(spark, sf_dir).select("conv_id", F.md5(chat.render_text(F.col("turns"), template, True)).alias("chat_md5"))

    return query


def chat_tokens(spark, sf_dir):
    vocab = vocabulary(Family.GPT2, chat.QWEN25)
    return chat.encode_chat(_turns(spark, sf_dir), vocab, generation_prompt=True).select("conv_id", F.size("ids").cast("long").alias("n_tokens"), _digest())


def chat_from_json(spark, sf_dir):
    as_json = _turns(spark, sf_dir).select("conv_id", F.to_json(F.struct(F.col("turns").alias("messages"))).alias("record"))
    return as_json.select("conv_id", F.posexplode(chat.chat_json(F.col("record"))).alias("pos", "t")).select("conv_id", "pos", "t.role", "t.content")


def multilingual(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", is_multilingual(F.col("text")).alias("multilingual"))


def size_classes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", size_class(F.octet_length("text")).alias("size_class"))


def nfc_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(nfc(F.col("text"))).alias("nfc_md5"), is_nfc(F.col("text")).alias("was_nfc"))


def token_stats_by_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    counted = encode(docs, vocabulary()).select("lang", F.size("ids").cast("long").alias("n"), F.octet_length("text").cast("long").alias("b"))
    return counted.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.sum("b").alias("bytes"))


def dedupe_ratio(spark, sf_dir):
    pieces = _docs(spark, sf_dir).select(F.explode(pretokens(F.col("text"), Family.GPT2, [])).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n")).agg(F.sum("n").alias("pretokens"), F.count("*").alias("distinct_pretokens"))


def vocab_table(spark, sf_dir):
    return vocabulary().vocab_df(ship(spark)).where(~F.col("is_added")).select("id", F.hex("bytes").alias("token_hex"))


def merges_table(spark, sf_dir):
    vocab = vocabulary()
    names = vocab.vocab_df(ship(spark)).select("id", F.hex("bytes").alias("h"))
    merges = vocab.merges_df(spark)
    for side in ("left", "right", "new"):
        merges = merges.join(names.withColumnsRenamed({"id": f"{side}_id", "h": f"{side}_hex"}), f"{side}_id")
    return merges.select("rank", "new_id", F.concat("left_hex", "right_hex").alias("joined_hex"))


def packed_batches(spark, sf_dir):
    return pack_batches(_docs(spark, sf_dir), None, 16, 65_536)


def pieces_round_trip(spark, sf_dir):
    vocab = toy_pieces()
    there = encode(_docs(spark, sf_dir), vocab).select("doc_id", "ids")
    return decode(there, vocab).select("doc_id", F.md5("text").alias("text_md5"))


_QUERIES = {
    "token_count_per_doc": token_count_per_doc, "token_count_deduplicated": token_count_deduplicated, "tokens_flat": tokens_flat_query, "benchmark_tokens": benchmark_tokens,
    "pretokens_gpt2": _pretokens(Family.GPT2), "pretokens_llama3": _pretokens(Family.LLAMA3), "pretokens_qwen25": _pretokens(Family.QWEN25), "pretokens_deepseek": _pretokens(Family.DEEPSEEK_V3),
    "pretoken_byte_spans": pretoken_byte_spans, "batch_offsets": batch_offsets_query, "decode_roundtrip": decode_roundtrip, "decode_bytes": decode_bytes_length, "encode_binary": encode_binary, "add_bos_eos": add_bos_eos,
    "truncate_ids": truncate_ids, "packed_ids": packed_ids, "literal_split": literal_split, "chat_text_llama3": _chat_text("llama3"), "chat_text_qwen25": _chat_text("qwen25"), "chat_text_deepseek": _chat_text("deepseek_v3"),
    "chat_tokens": chat_tokens, "chat_from_json": chat_from_json, "is_multilingual": multilingual, "size_class": size_classes, "nfc_texts": nfc_texts, "token_stats_by_lang": token_stats_by_lang, "dedupe_ratio": dedupe_ratio,
    "vocab_table": vocab_table, "merges_table": merges_table, "pack_batches": packed_batches, "sentencepiece_round_trip": pieces_round_trip,
    "ids_llama3": _family_ids(Family.LLAMA3), "ids_qwen25": _family_ids(Family.QWEN25), "ids_deepseek": _family_ids(Family.DEEPSEEK_V3), "ids_sentencepiece": ids_sentencepiece, "ids_with_literals": ids_with_literals,
    "ids_nfc_literals": ids_nfc_literals, "ids_long_pieces": ids_long_pieces, "encode_malformed": encode_malformed, "decode_skipping": decode_skipping, "pretokens_kana_han": _classes(Family.DEEPSEEK_V3, "aeiou", "日アンゟ龥"),
    "pretokens_gaps": _classes(Family.DEEPSEEK_V3, "aeh", "\x01\u00ad\u0e38"), "pretokens_long_s": _classes(Family.LLAMA3, "se", "ſ'"), "nfc_marks": nfc_marks, "chat_templates": chat_templates, "id_files_round_trip": id_files_round_trip,
    "chat_tokens_deepseek": chat_tokens_deepseek,
}


def queries() -> dict:
    return dict(_QUERIES)


def _chat_sql(body: str, head: str, tail: str) -> str:
    return f"""SELECT conv_id, md5({head} || string_agg({body}, '' ORDER BY turn, role, text) || {tail}) AS chat_md5
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id"""


_NO_SYSTEM = f"CASE WHEN bool_or(role = 'system') THEN '' ELSE '<|im_start|>system' || chr(10) || '{chat.DEFAULT_SYSTEM}<|im_end|>' || chr(10) END"


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS v({names})"


def _chat_specials() -> str:
    literals = [(family, template, x, 50257 + i) for family, template, xs in (("llama3", "llama3", chat.LLAMA3), ("qwen25", "qwen25", chat.QWEN25), ("deepseek_v3", "deepseek_v3", chat.DEEPSEEK_V3)) for i, x in enumerate(xs)]
    return _values([("gpt2", None, END, 50256), *literals, *((f, f, END, 50256) for f in ("llama3", "qwen25", "deepseek_v3"))], "family, template, literal, id")


def oracle_sql() -> dict[str, str]:
    w, rows, ids_of = oracle.with_tokens, oracle.pieces_rows, oracle.ids_rows
    count = "SELECT d.doc_id, count(f.token_id)::BIGINT AS n_tokens FROM documents d LEFT JOIN flat f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    listed = "SELECT d.doc_id, coalesce(list(f.token_id ORDER BY f.pos) FILTER (f.token_id IS NOT NULL), []) AS ids FROM documents d LEFT JOIN flat f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    ids = ids_of(rows("documents", "doc_id", "text"), "doc_id", "documents")
    family_ids = lambda family, text="text": ids_of(rows("documents", "doc_id", text, family), "doc_id", "documents")
    ends = "SELECT doc_id, {}::BIGINT, 0::BIGINT, 50256 FROM documents".format
    # U+F00F0, a character of no class, stands for the truncated bytes
    malformed = ids_of(rows("documents", "doc_id", "text || chr(10) || chr(983280)"), "doc_id", "documents", raw="replace(hex(encode(piece)), 'F3B083B0', 'F09F98')")
    jamo = "translate(text, 'ae', chr(4352) || chr(4449))"
    between = f"""SELECT doc_id, pos, piece FROM ({rows('documents', 'doc_id', f"nfc_normalize({jamo} || 'e')", 'qwen25')})
      UNION ALL SELECT doc_id, 100000001 + pos, piece FROM ({rows('documents', 'doc_id', "nfc_normalize(chr(769) || ' e' || chr(769))", 'qwen25')})"""
    swapped = "translate(text, 'aeior', chr(4352) || chr(4449) || chr(4520) || chr(769) || chr(807))"
    # turn k of a conversation has its special ids and pieces at k * 10**7
    turn = "10000000 * row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)"
    own = f"(SELECT conv_id, {turn} AS k, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))"
    cut = lambda texts, family="gpt2": f"SELECT conv_id, (k + pos)::BIGINT AS pos, piece FROM (SELECT conv_id, k, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS piece FROM (SELECT conv_id, k, {oracle.pieces('s', family)} AS ps FROM ({texts})))"
    system = f"SELECT conv_id, 10 AS k, 'system' || chr(10) || '{chat.DEFAULT_SYSTEM}' AS s FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')"
    asked = "SELECT DISTINCT conv_id, 1000000000000 AS k, 'assistant' || chr(10) AS s FROM conversations"
    qwen_texts = f"{system} UNION ALL SELECT conv_id, k + 10, role || chr(10) || text FROM {own} UNION ALL {asked}"
    breaks = f"SELECT conv_id, 9999998, chr(10) FROM ({system}) UNION ALL SELECT conv_id, k + 9999998, chr(10) FROM {own}"
    qwen_rows = cut(f"{qwen_texts} UNION ALL {breaks}")
    qwen_marks = f"SELECT conv_id, k + x.place, 0, x.id FROM (SELECT conv_id, 0 AS k FROM ({system}) UNION ALL SELECT conv_id, k FROM {own}), (VALUES (5, 50257), (9999997, 50258)) x(place, id) UNION ALL SELECT conv_id, k - 1, 0, 50257 FROM ({asked})"
    last_system = "SELECT conv_id, 10 AS k, last(coalesce(text, '') ORDER BY turn, text) AS s FROM conversations WHERE role = 'system' GROUP BY conv_id"
    deep_rows = cut(f"{last_system} UNION ALL SELECT conv_id, k + 10, text FROM {own} WHERE role <> 'system'", "deepseek")
    deep_marks = f"SELECT DISTINCT conv_id, 0, 0, 50257 FROM conversations UNION ALL SELECT conv_id, k + 5, 0, CASE role WHEN 'user' THEN 50258 ELSE 50259 END FROM {own} WHERE role <> 'system' UNION ALL SELECT conv_id, k + 9999997, 0, 50260 FROM {own} WHERE role NOT IN ('system', 'user')"
    toy = toy_pieces()
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *TOY_LETTERS, *(a + b for a, b in TOY_MERGES)]
    return {
        "token_count_per_doc": w(count),
        "token_count_deduplicated": ids,
        "encode_binary": ids,
        "id_files_round_trip": ids,
        "ids_llama3": family_ids("llama3"),
        "ids_qwen25": family_ids("qwen25", "nfc_normalize(text)"),
        "ids_deepseek": family_ids("deepseek"),
        "ids_with_literals": ids_of(rows("documents", "doc_id", "text"), "doc_id", "documents", " UNION ALL ".join(map(ends, (-1, 10**8, 10**8 + 1)))),
        "ids_nfc_literals": ids_of(between, "doc_id", "documents", ends(10**8)),
        "ids_long_pieces": ids_of(rows("benchmark", "item_id", r"regexp_replace(text, '[ \n\t.,]', '', 'g')"), "item_id", "benchmark"),
        "ids_sentencepiece": oracle.toy_ids(names, TOY_MERGES, [(x, i) for x, i in toy.added.items() if i]),
        "encode_malformed": malformed,
        "decode_skipping": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "pretokens_kana_han": rows("documents", "doc_id", "translate(text, 'aeiou', '日アンゟ龥')", "deepseek"),
        "pretokens_gaps": rows("documents", "doc_id", "translate(text, 'aeh', chr(1) || chr(173) || chr(3640))", "deepseek"),
        "pretokens_long_s": rows("documents", "doc_id", "translate(text, 'se', 'ſ''')", "llama3"),
        "nfc_marks": f"SELECT doc_id, md5(nfc_normalize({swapped})) AS nfc_md5, nfc_normalize({swapped}) = {swapped} AS was_nfc FROM documents",
        "chat_templates": _chat_specials(),
        "chat_tokens_deepseek": ids_of(deep_rows, "conv_id", "conversations", deep_marks),
        "pack_batches": oracle.batches(LANE_ROWS, LEAST_LANES, 16, 65_536),
        "tokens_flat": w("SELECT doc_id, pos, token_id FROM flat"),
        "benchmark_tokens": w("SELECT item_id, pos, token_id FROM flat", "benchmark", "item_id"),
        "pretokens_gpt2": rows("documents", "doc_id", "text"),
        "pretokens_llama3": rows("documents", "doc_id", "text", "llama3"),
        "pretokens_qwen25": rows("documents", "doc_id", "text", "qwen25"),
        "pretokens_deepseek": rows("documents", "doc_id", "text", "deepseek"),
        "pretoken_byte_spans": f"SELECT doc_id, pos, (sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n)::BIGINT AS byte_start, n AS byte_len FROM (SELECT doc_id, pos, strlen(piece)::BIGINT AS n FROM ({rows('documents', 'doc_id', 'text')}))",
        "batch_offsets": w(f"SELECT 0::BIGINT AS doc_pos, 0::BIGINT AS offset UNION ALL SELECT row_number() OVER (ORDER BY doc_id), sum(n_tokens) OVER (ORDER BY doc_id)::BIGINT FROM ({count})").replace("AS offset", 'AS "offset"'),
        "decode_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "sentencepiece_round_trip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "decode_bytes": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, md5(text) AS bytes_md5 FROM documents",
        "add_bos_eos": w(f"SELECT doc_id, (len(ids) + 1)::BIGINT AS n, list_append(ids, 50256)[1] AS first_id, 50256 AS last_id, md5(array_to_string(list_append(ids, 50256), ',')) AS ids_md5 FROM ({listed})"),
        "truncate_ids": w(f"SELECT doc_id, len(cut)::BIGINT AS n_mask, len(cut)::BIGINT AS mask_length, md5(array_to_string(cut, ',')) AS ids_md5 FROM (SELECT doc_id, list_slice(list_concat([50256], ids, [50256]), 1, 512) AS cut FROM ({listed}))"),
        "packed_ids": w(f"SELECT doc_id, 4 * len(ids)::BIGINT AS n_bytes, md5(unhex(array_to_string([h[7:8] || h[5:6] || h[3:4] || h[1:2] FOR h IN [printf('%08X', x) FOR x IN ids]], ''))) AS packed_md5 FROM ({listed})"),
        "literal_split": f"SELECT doc_id, unnest([0, 1, 2, 3])::INTEGER AS pos, unnest(['{END}', text, '{END}', '<|end']) AS piece, unnest([true, false, true, false]) AS is_added FROM documents WHERE text <> '' UNION ALL SELECT doc_id, unnest([0, 1, 2])::INTEGER, unnest(['{END}', '{END}', '<|end']), unnest([true, true, false]) FROM documents WHERE text = ''",
        "chat_text_llama3": _chat_sql("'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>'", "'<|begin_of_text|>'", "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)"),
        "chat_text_qwen25": _chat_sql("'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)", _NO_SYSTEM, "'<|im_start|>assistant' || chr(10)"),
        "chat_text_deepseek": _chat_sql("CASE role WHEN 'system' THEN '' WHEN 'user' THEN '<｜User｜>' || text ELSE '<｜Assistant｜>' || text || '<｜end▁of▁sentence｜>' END", "'<｜begin▁of▁sentence｜>' || coalesce(last(text ORDER BY turn, text) FILTER (role = 'system'), '')", "'<｜Assistant｜>'"),
        "chat_tokens": ids_of(qwen_rows, "conv_id", "conversations", qwen_marks),
        "chat_from_json": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS pos, coalesce(role, '') AS role, coalesce(text, '') AS content FROM conversations",
        "is_multilingual": "SELECT doc_id, 64 * len(regexp_extract_all(text, '[^\\x00-\\x7f\\x{2000}-\\x{207f}]')) > strlen(text) AS multilingual FROM documents",
        "size_class": "SELECT doc_id, greatest(4096, (2 ** ceil(log2(strlen(text) + 1024)))::BIGINT)::BIGINT AS size_class FROM documents",
        "nfc_texts": "SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5, nfc_normalize(text) = text AS was_nfc FROM documents",
        "token_stats_by_lang": w("SELECT d.lang, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest, sum(strlen(d.text))::BIGINT AS bytes FROM documents d JOIN (SELECT e.doc_id, count(f.token_id) AS n FROM documents e LEFT JOIN flat f ON f.doc_id = e.doc_id GROUP BY e.doc_id) c ON c.doc_id = d.doc_id GROUP BY d.lang"),
        "dedupe_ratio": f"SELECT count(*)::BIGINT AS pretokens, count(DISTINCT piece)::BIGINT AS distinct_pretokens FROM ({rows('documents', 'doc_id', 'text')})",
        "vocab_table": f"SELECT rank AS id, hex(from_base64(token)) AS token_hex FROM read_csv('{oracle.rank_file()}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'INTEGER'}})",
        "merges_table": f"SELECT (rank - 256)::INTEGER AS rank, rank AS new_id, hex(from_base64(token)) AS joined_hex FROM read_csv('{oracle.rank_file()}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'INTEGER'}}) WHERE rank >= 256",
    }

"""The byte-pair engine against the upstream libraries, which serve as oracles only."""

import json
import random
import unicodedata

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenframe.functions.patterns import Family, cut
from tokenframe.functions.pretokens import split_literals
from tokenframe.functions.routing import is_multilingual, size_class
from tokenframe.operators import chat, specials
from tokenframe.operators.batches import pack_batches
from tokenframe.operators.decode import Decoder, decode, decode_bytes
from tokenframe.operators.encode import batch_offsets, bytes_ids, encode, encode_bytes, encode_deduplicated, explain_pretokens, tokens_flat
from tokenframe.operators.merge import Merger
from tokenframe.plans.queries import toy_pieces, vocabulary
from tokenframe.sources import files
from tokenframe.sources.vocabulary import VocabularyError, literal_pattern, load, variant
from tokenframe.streaming.encode import encode_stream, read_documents, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
with open(BYTE, encoding="utf-8") as f:
    SPEC = json.load(f)
NAMED = {
    Family.GPT2: "endoftext",
    Family.LLAMA3: "eot_id begin_of_text reserved_special_token_5 end_of_text end_header_id start_header_id",
    Family.QWEN25: "endoftext im_end im_start object_ref_start",
}
LITERALS = {family: tuple(f"<|{x}|>" for x in names.split()) for family, names in NAMED.items()}
LITERALS[Family.QWEN25] += ("</tool_call>", "<tool_call>")
LITERALS[Family.DEEPSEEK_V3] = tuple(f"<｜{x}｜>" for x in ("User", "Assistant", "end▁of▁sentence", "begin▁of▁sentence"))
CR, LF, TAB, END = "\r", "\n", "\t", "<|endoftext|>"
DIGITS = ["12", "345", "12345", "1234567", " ".join(map(str, (123456789, 12, 3, 4567, 12345))), "345 it'", "1" * 70]
SPACES = ["hello ", "world", " b", " " * 20 + "y", "x" + " " * 20, "a   ", "   b", " " * 70, " " * 193, LF + "y", "x" + LF, LF, LF * 2 + CR + LF + " " + TAB + LF, "--" + CR, LF + TAB + CR + LF]
QUOTES = ["say", "it'", "'s", "'S", LF + "'towhead", "s ok", " ".join(("'twas", "'Twas", chr(34) + "'s" + chr(34), "('s)", "", "'ll'd're"))]
WIDE = ["long-s ſ whole", " codepoint stays together", "アント", "ニ・ガウディ", "é café ſpecial ſ", "e\u0301 A\u030a \u1100\u1161\u11a8 \u2126 \u212b", "\x85\xa0 x"]
MARKS = ["!!!", "???", "!", "foo.", "bar", "!" * 70, "--" + (CR + LF).join(("", TAB, " foo", "bar"))]
PARTS = ["<|endo", "ftext|>", END + "y", "a" + END + "\u0338b", "<|", "<|not_a_token|>" + END]
RUNS = [c * n for n, c in ((33, "a"), (65, "a"), (257, "b"), (1024, "d"), (1025, "g"))] + [" ".join(("a" * 129, "b" * 257)), "a\x00b", "\x1c\x1d x", "", "abc"]
SEAMS = DIGITS + SPACES + QUOTES + WIDE + MARKS + PARTS + RUNS


def fuzz(literals, n=400, seed=7):
    r = random.Random(seed)
    pool = [*"abcXYZ 0123456789'’\n\r\t.,!?-_<|>éſ日한Ω\x00\xa0アニ・ー🚀", "  ", "'s", "'LL", "\r\n", "́", "̸", *literals]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 47))) for _ in range(n)]


@pytest.mark.parametrize("family", list(LITERALS))
def test_ids_equal_the_upstream_library(spark, family):
    spec = variant(SPEC, family, LITERALS[family])
    vocab, upstream = load(spec), Tokenizer.from_str(json.dumps(spec))
    texts = SEAMS + fuzz(LITERALS[family]) + [x + y for x in LITERALS[family] for y in ("", " b", "̸b", LITERALS[family][0])]
    texts += [("qzxjvkwymfpbghdcrltns" * 4)[:n] for n in (31, 32, 33, 63, 64, 65)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(encode(df, vocab).select("doc_id", "ids").collect())
    want = [upstream.encode(t, add_special_tokens=False).ids for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    own, literal = Merger(vocab), literal_pattern(vocab)
    assert [bytes_ids(own, literal, t.encode()) for t in texts] == want
    assert [r["back"] for r in decode(spark.createDataFrame(list(enumerate(want)), "doc_id long, ids array<int>"), vocab, out="back").orderBy("doc_id").collect()] == [
        t if not vocab.nfc else "".join(unicodedata.normalize("NFC", p) if p not in vocab.added else p for p in __import__("re").split(f"({literal})", t)) for t in texts
    ]


def test_ids_equal_tiktoken():
    import base64

    with open(BYTE.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    upstream = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Merger(vocabulary())
    for t in [t for t in SEAMS if "<|endoftext|>" not in t]:
        assert [i for p in cut(Family.GPT2, t) for i in own.piece(p)] == upstream.encode_ordinary(t)


def test_very_long_runs(spark):
    texts = [c * 200_000 for c in "a \n1\x00日!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for family in LITERALS:
        rows = explain_pretokens(df, vocabulary(family, LITERALS[family])).groupBy("doc_id").agg(F.sum("byte_len").alias("n")).collect()
        assert {r["doc_id"]: r["n"] for r in rows} == {i: len(t.encode()) for i, t in enumerate(texts)}


def test_both_plans_and_any_partitioning_agree(spark):
    texts = SEAMS + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(encode(df.coalesce(1), vocabulary()).select("doc_id", "ids").collect())
    assert dict(encode(df.repartition(7), vocabulary()).select("doc_id", "ids").collect()) == want
    assert dict(encode_deduplicated(df, vocabulary()).collect()) == want
    assert want[len(texts) - 1] is None and want[texts.index("")] == []


def test_heap_equals_scan():
    own, r = Merger(vocabulary()), random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("aabbcde ththe") for _ in range(r.randint(1, 90)))
        assert own.heap(own.first_ids(text)) == own.scan(own.first_ids(text))


def test_ignore_merges():
    toy = json.loads(json.dumps(SPEC))
    toy["model"]["vocab"]["zqzq"] = 60000
    vocab = load(variant(toy, Family.LLAMA3))
    assert Merger(vocab).piece("zqzq") == [60000]
    assert Merger(vocabulary()).piece("zqzq") != [60000]


def test_offsets_and_flat_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "", "c", "", "d e f"])], "doc_id long, text string")
    enc = encode(df, vocabulary()).select("doc_id", "ids")
    for block in (1, 2, 100):
        assert [tuple(r) for r in batch_offsets(enc, per_block=block).orderBy("doc_pos").collect()] == [(0, 0), (1, 2), (2, 2), (3, 3), (4, 3), (5, 6)]
    assert tokens_flat(enc).count() == 6
    assert [tuple(r) for r in batch_offsets(enc.limit(0)).collect()] == [(0, 0)]


def test_malformed_bytes(spark):
    docs = [b"\xf0", b"\x9f\x98\x80 a", b"\xf0\x9f\x98", b"ab\xc5", b"\xbf", b"a\x80\x80 b", b"", b"\xc0\xff x"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(docs)], "doc_id long, bytes binary")
    ids = dict(encode_bytes(df, vocabulary()).select("doc_id", "ids").collect())
    back = Decoder(vocabulary())
    kept = [b"\xf0", b" a", b"\xf0\x9f\x98", b"ab\xc5", b"", b"a\x80\x80 b", b"", b"\xc0\xff x"]
    assert [back.raw(ids[i]) for i in range(len(docs))] == kept


def test_sentence_pieces(spark):
    vocab = toy_pieces()
    own, literal, back = Merger(vocab), literal_pattern(vocab), Decoder(vocab)
    for text in ["", " ", "the and  then", "▁" * 65 + "x", LF * 63 + "x" + TAB * 35, "é日🚀", "a <unk> b"]:
        ids = bytes_ids(own, literal, text.encode())
        df = spark.createDataFrame([(text,)], "text string")
        assert encode(df, vocab).first()["ids"] == ids
        assert back.text(ids) == text.replace("▁", " ")
    runs = bytes_ids(own, literal, ("▁" * 65).encode())
    assert [len(vocab.tokens[i].decode()) for i in runs] == [31, 31, 3]
    byte = vocab.byte_ids
    assert back.text([byte[0xC2], byte[0xA2]]) == "¢"
    assert back.text([byte[b] for b in bytes.fromhex("97c80fe0de00b6")]) == "�" * 7
    assert bytes_ids(own, literal, b"\x80a") == [byte[0x80], vocab.model_ids[b"a"]]


def test_decoding_rules(spark):
    df = spark.createDataFrame([(1, [50256, 64]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = dict(decode(df, vocabulary(), skip_special=True).select("doc_id", "text").collect())
    assert got == {1: "a", 2: "", 3: None}
    assert decode_bytes(df, vocabulary()).first()["bytes"] == b"<|endoftext|>a"
    half = vocabulary().byte_ids[0xC3]
    back = Decoder(vocabulary())
    with pytest.raises(UnicodeDecodeError):
        back.text([half])
    assert back.text([half], "replace") == "�"
    with pytest.raises(ValueError):
        back.text([10**6])


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s["model"].update(type="WordPiece"), lambda s: s["model"].pop("vocab"), lambda s: s["model"].pop("merges"), lambda s: s["model"].update(dropout=0.1), lambda s: s["model"].update(end_of_word_suffix="</w>"),
        lambda s: s["model"].update(byte_fallback=True), lambda s: s["model"].update(ignore_merges=True), lambda s: s["model"].update(unk_token="x"), lambda s: s["model"]["merges"].append(["a", "nosuchthing"]), lambda s: s["model"]["merges"].append(["zq", "zq"]),
        lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["added_tokens"][0].update(single_word=True), lambda s: s["added_tokens"][0].update(id=5), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s.update(normalizer={"type": "NFKC"}),
        lambda s: s["added_tokens"].append(s["added_tokens"][0] | {"id": 50257, "content": "<a<"}), lambda s: s["model"]["vocab"].pop("a"),
    ],
)
def test_near_misses_are_rejected(change):
    spec = json.loads(json.dumps(SPEC))
    change(spec)
    with pytest.raises(VocabularyError):
        load(spec)


def test_foreign_vocabulary_is_rejected():
    with pytest.raises(VocabularyError):
        load(public_tokenizers.path("word_bpe_49k.json"))


def test_template_ids():
    spec = variant(SPEC, Family.LLAMA3, LITERALS[Family.LLAMA3])
    one = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<|begin_of_text|>", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}], "special_tokens": {"<|begin_of_text|>": {"id": "<|begin_of_text|>", "ids": [50257], "tokens": ["<|begin_of_text|>"]}}}
    vocab = load(spec | {"post_processor": {"type": "Sequence", "processors": [{"type": "ByteLevel"}, one]}})
    assert vocab.bos_ids == (50257,) and vocab.eos_ids == () and vocab.eos() == (vocab.added["<|end_of_text|>"],)


def test_special_frames(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>")
    rows = df.select(specials.add_bos_eos(F.col("ids"), vocabulary()).alias("a"), specials.framed(F.col("ids"), (7,), (8,), 3).alias("b"), specials.attention_mask(F.col("ids")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [([1, 2, 3, 50256], [7, 1, 2], [1, 1, 1]), ([50256], [7, 8], [])]


def test_literals_are_cut_first(spark):
    df = spark.createDataFrame([("a<|x|>b<|x|><|xy|>",), ("",), ("none",)], "t string")
    assert [r[0] for r in df.select(split_literals(F.col("t"), ["<|x|>", "<|xy|>"])).collect()] == [["a", "<|x|>", "b", "<|x|>", "<|xy|>"], [], ["none"]]


def chat_by_hand(template, turns, prompt):
    if template == "llama3":
        return "<|begin_of_text|>" + "".join(f"<|start_header_id|>{r}<|end_header_id|>\n\n{c}<|eot_id|>" for r, c in turns) + ("<|start_header_id|>assistant<|end_header_id|>\n\n" if prompt else "")
    if template == "qwen25":
        if all(r != "system" for r, _ in turns):
            turns = [("system", chat.DEFAULT_SYSTEM), *turns]
        return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in turns) + ("<|im_start|>assistant\n" if prompt else "")
    system = [c for r, c in turns if r == "system"]
    body = "".join("<｜User｜>" + c if r == "user" else "<｜Assistant｜>" + c + "<｜end▁of▁sentence｜>" for r, c in turns if r != "system")
    return "<｜begin▁of▁sentence｜>" + (system[-1] if system else "") + body + ("<｜Assistant｜>" if prompt else "")


CHATS = [[], [("user", "hi")], [("system", "s1"), ("user", "a"), ("assistant", "b")], [("user", "a"), ("system", "late")], [("system", "x"), ("system", "y"), ("user", "")], [("user", "<|im_end|> it's"), ("assistant", "")]]


@pytest.mark.parametrize("template,family", [("llama3", Family.LLAMA3), ("qwen25", Family.QWEN25), ("deepseek_v3", Family.DEEPSEEK_V3)])
@pytest.mark.parametrize("prompt", [False, True])
def test_chat_templates(spark, template, family, prompt):
    vocab = vocabulary(family, LITERALS[family])
    assert chat.detect_template(vocab) == template
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in t]) for i, t in enumerate(CHATS)], "i int, turns array<struct<role:string,content:string>>")
    want = [chat_by_hand(template, t, prompt) for t in CHATS]
    assert [r[0] for r in df.orderBy("i").select(chat.render_text(F.col("turns"), template, prompt)).collect()] == want
    pieces = [r[0] for r in df.orderBy("i").select(chat.render(F.col("turns"), template, prompt)).collect()]
    assert all(not (a["special"] is b["special"] is False) for p in pieces for a, b in zip(p, p[1:]))
    upstream = Tokenizer.from_str(json.dumps(variant(SPEC, family, LITERALS[family])))
    ids = [r["ids"] for r in chat.encode_chat(df, vocab, generation_prompt=prompt).orderBy("i").collect()]
    assert ids == [[i for p in own for i in ([vocab.added[p["text"]]] if p["special"] else upstream.encode(p["text"], add_special_tokens=False).ids)] for own in pieces]


def test_unknown_roles(spark):
    df = spark.createDataFrame([([{"role": "tool", "content": "x"}],)], "turns array<struct<role:string,content:string>>")
    assert "tool" in df.select(chat.render_text(F.col("turns"), "llama3")).first()[0]
    for template in ("qwen25", "deepseek_v3"):
        with pytest.raises(Exception, match="unknown role"):
            df.select(chat.render_text(F.col("turns"), template)).collect()
    with pytest.raises(VocabularyError):
        chat.encode_chat(df, vocabulary())


def test_chat_json(spark):
    df = spark.createDataFrame([('[{"role":"user","content":"a"}]',), (' {"messages":[{"role":"user"},{"content":"b"}]}',)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(chat.chat_json(F.col("t"))).collect()] == [[("user", "a")], [("user", ""), ("", "b")]]


def test_routing(spark):
    texts = ["", "plain", "é" + "x" * 61, "é" + "x" * 62, "“quoted” – " * 9, "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    leads = lambda b: sum(x >= 0xC0 for x in b) - sum(x == 0xE2 and y & 0xFE == 0x80 for x, y in zip(b, b[1:]))
    assert [r[0] for r in df.orderBy("i").select(is_multilingual(F.col("t"))).collect()] == [64 * leads(t.encode()) > len(t.encode()) for t in texts]
    sizes = [0, 1, 3071, 3072, 3073, 7168, 7169, 2**20, 2**30]
    want = []
    for n in sizes:
        p = 4096
        while p < n + 1024:
            p *= 2
        want.append(p)
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(size_class(F.col("n"))).collect()] == want


def test_pack_batches(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 6, 30, 4, 1, 1, 1, 9, 0])], "doc_id long, text string")
    rows = sorted(map(tuple, pack_batches(df, 1, 3, 12).select("doc_id", "batch").collect()))
    assert rows == [(0, 0), (1, 0), (2, -1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 2), (8, 2)]


def test_files(spark, tmp_path):
    for i, t in enumerate(["one\ntwo", "", "três"]):
        (tmp_path / f"{i}.txt").write_text(t, encoding="utf-8")
    paths = [str(tmp_path / f"{i}.txt") for i in (2, 0, 1)]
    assert [r["text"] for r in files.text_files(spark, ",".join(paths)).orderBy("doc_pos").collect()] == ["três", "one\ntwo", ""]
    assert files.path_list("a\r\n\n b\n") == ["a", " b"]
    packed = files.with_packed_ids(spark.createDataFrame([([1, 2, 70000],)], "ids array<int>")).first()["packed"]
    (tmp_path / "x.ids").write_bytes(packed)
    assert files.id_files(spark, str(tmp_path / "x.ids")).first()["ids"] == [1, 2, 70000]
    assert files.read_batch(files.batch_bytes([[1, 2], [], [3]])) == [[1, 2], [], [3]]
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    files.write_batches(df, str(tmp_path / "b"))
    assert files.read_batch(bytes(spark.read.parquet(str(tmp_path / "b")).first()["payload"])) == [[1, 2], [], []]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, t, f"2024-01-01 00:0{i % 3}:00") for i, t in enumerate(SEAMS)], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = read_documents(spark, str(tmp_path / "in"))
    encode_stream(stream, vocabulary(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = dict(spark.read.parquet(str(tmp_path / "out")).collect())
    want = dict(encode(df, vocabulary()).select("doc_id", "ids").collect())
    assert got == want
    timed = read_documents(spark, str(tmp_path / "in"), "doc_id long, text string, at timestamp")
    query = token_counts(timed, vocabulary(), "at", "1 minute", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("tokens")).first()[0] == sum(map(len, want.values()))


def test_offsets_of_odd_keys(spark):
    df = spark.createDataFrame([(1, [1, 2]), (None, [3]), (5, [4]), (5, []), (10**15, None), (None, [6, 7])], "doc_id long, ids array<int>")
    for block in (1, 2, 100):
        assert [r[1] for r in batch_offsets(df, per_block=block).orderBy("doc_pos").collect()] == [0, 1, 3, 5, 5, 6, 6]


def test_spans_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "ab cd"), (1, "ef gh"), (None, "é x"), (2, ""), (3, None)], "doc_id long, text string")
    rows = sorted(map(repr, (tuple(r) for r in explain_pretokens(df, vocabulary()).select("doc_id", "pos", "byte_start", "byte_len").collect())))
    assert rows == sorted(map(repr, [(1, 0, 0, 2), (1, 1, 2, 3), (1, 0, 0, 2), (1, 1, 2, 3), (None, 0, 0, 2), (None, 1, 2, 2)]))


def test_hot_and_repeated_keys_are_deduplicated_alike(spark, monkeypatch):
    from tokenframe.functions import skew
    from tokenframe.operators import encode as module

    texts = ["the the the the"] * 9 + [None, "", "a b"]
    df = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(module, "spread_join", lambda *a: skew.spread_join(*a, per=4))
    want = sorted(map(repr, (tuple(r) for r in encode(df, vocabulary()).select("doc_id", "ids").collect())))
    assert sorted(map(repr, (tuple(r) for r in encode_deduplicated(df, vocabulary()).collect()))) == want


def test_the_engine_is_chosen_only_with_proof():
    from tokenframe.operators import library

    assert library.why_not(vocabulary()) is None and library.why_not(vocabulary(Family.QWEN25, LITERALS[Family.QWEN25])) is None
    assert library.why_not(toy_pieces()) and library.why_not(vocabulary(Family.DEEPSEEK_V3))
    unreached = json.loads(json.dumps(SPEC))
    unreached["model"]["vocab"]["zqzq"] = 60000
    assert library.why_not(load(variant(unreached, Family.LLAMA3)))
    swapped = json.loads(json.dumps(SPEC))
    swapped["model"]["merges"][5], swapped["model"]["merges"][6] = swapped["model"]["merges"][6], swapped["model"]["merges"][5]
    assert library.why_not(load(swapped))
    nested = variant(SPEC, Family.LLAMA3, ("<|x", "<|x|>"))
    assert library.why_not(load(nested))
    engine, own = library.Engine(vocabulary()), Merger(vocabulary())
    for text in SEAMS + fuzz([END], 300, 11):
        if all(c <= "ž" for c in text) and END not in text:
            assert engine.ids(text).tolist() == [i for p in cut(Family.GPT2, text) for i in own.piece(p)]


def test_vocabularies_are_described_and_told_apart(spark):
    info = vocabulary().info_df(spark).first()
    assert (info["family"], info["size"], info["engine"], info["engine_note"]) == ("gpt2", 50257, "tiktoken", None)
    assert toy_pieces().describe()["engine"] == "own"
    assert len({vocabulary().digest, vocabulary(Family.LLAMA3).digest, vocabulary(Family.GPT2, ("<x>",)).digest}) == 3 and load(SPEC).digest == vocabulary().digest


def test_barriers_of_normalization():
    from tokenizers.normalizers import NFC
    from tokenframe.functions.normalize import nfc_between

    upstream = NFC()
    for c in map(chr, (0x897, 0x1ACF, 0x1AEB, 0x105D2, 0x10D69, 0x113CE, 0x1611F, 0x1E6F5, 0x301, 0x1161)):
        for text in (f"é{c}́", f"e{c}́", f"ᄀ{c}ᅡᆨ", f"ȩ{c}̧́"):
            assert nfc_between(text, None) == upstream.normalize_str(text)


@pytest.mark.parametrize("merge,literal", [(["\n", "a"], None), (["a", "▁the"], None), (None, "<\n>"), (None, "x▁y")])
def test_piece_vocabularies_keep_runs_apart(merge, literal):
    from tokenframe.sources.vocabulary import _check_runs

    _check_runs({"merges": [["▁", "the"], [">", "▁</"], ["\n", "\n"]]}, ["\n\n", "<x>"])
    with pytest.raises(VocabularyError):
        _check_runs({"merges": [merge] if merge else []}, [literal] if literal else [])


def test_command_line_and_metrics(spark, tmp_path, capsys):
    from tokenframe.__main__ import main

    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "b.txt").write_text("a b c")
    ids = [Tokenizer.from_file(BYTE).encode(t).ids for t in ("hello world", "a b c")]
    paths = f"{tmp_path}/a.txt,{tmp_path}/b.txt"
    assert main(["encode", "--vocab", BYTE, "--inputs", paths, "--add-eos"]) == 0
    assert capsys.readouterr().out.split("\n")[:2] == [" ".join(map(str, [*i, 50256])) for i in ids]
    assert main(["encode", "--vocab", BYTE, "--inputs", paths, "--out", str(tmp_path / "out")]) == 0
    assert [r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("doc_pos").collect()] == ids
    (tmp_path / "x.ids").write_bytes(b"".join(i.to_bytes(4, "little") for i in ids[0]))
    capsys.readouterr()
    main(["decode", "--vocab", BYTE, "--inputs", str(tmp_path / "x.ids")])
    assert capsys.readouterr().out == "hello world\n"
    (tmp_path / "list").write_text(f"{tmp_path}/a.txt\r\n\n{tmp_path}/b.txt\n")
    main(["bench", "--vocab", BYTE, "--input-list", str(tmp_path / "list"), "--runs", "3"])
    lines = capsys.readouterr().out.split("\n")
    assert lines[0].startswith("run,input_index,path,n_bytes,n_tokens,n_pretokens") and [x.split(",")[1] for x in lines[1:4]] == ["1", "0", "1"]
    main(["info", "--vocab", BYTE])
    assert json.loads(capsys.readouterr().out)["engine"] == "tiktoken"
    with pytest.raises(SystemExit):
        main(["encode", "--vocab", BYTE])


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tokenframe import session

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Context:
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared|share"):
        session.shared_dir(Session())
    assert session.shared_dir(spark)
    own = session.written(spark.range(3), "x")
    assert own.count() == 3
    session.drop_written(own)


def test_remembered_pieces_are_bounded_by_their_bytes(monkeypatch):
    import pyarrow as pa
    from tokenframe.operators import merge

    own, r = Merger(toy_pieces()), random.Random(5)
    monkeypatch.setattr(merge, "KEPT", 20_000)
    for _ in range(60):
        own.lists(pa.array([["".join(r.choices("abcde▁", k=1000))]]))
        assert sum(map(len, own.known)) < 40_000


def test_sentence_pieces_are_cut_only_where_no_merge_crosses(spark):
    spec_texts = ["a  the  ", "  ", " x  and\n\n the", "> the >  </a> <", "the" * 900, "é the 日 and"]
    vocab = toy_pieces()
    own, literal = Merger(vocab), literal_pattern(vocab)
    df = spark.createDataFrame(list(enumerate(spec_texts)) + [(9, None)], "doc_id long, text string")
    got = dict(encode(df, vocab).select("doc_id", "ids").collect())
    assert [got[i] for i in range(len(spec_texts))] == [bytes_ids(own, literal, t.encode()) for t in spec_texts] and got[9] is None
    tags = Merger(vocab)
    tags.tags = True
    assert tags.words("a> </b> c >") == ["a>▁</b>▁c", "▁>"] and own.words("a> </b> c >") == ["a>", "▁</b>", "▁c", "▁>"]


def test_batches_for_python_are_bounded_by_bytes(spark):
    from tokenframe.session import BATCH

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), vocabulary())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH


def test_workers_handle_bounded_slices():
    import pyarrow as pa
    from tokenframe.memory import by_slices, weights

    lists = pa.array([[1] * (i % 40) if i % 7 else None for i in range(500)], pa.list_(pa.int32()))
    texts = pa.array([["é" * (i % 9)] * (i % 5) if i % 11 else None for i in range(500)], pa.list_(pa.string()))
    for whole in (lists, texts, lists.slice(3, 300), pa.array(["x" * (i % 30) for i in range(200)] + [None])):
        seen = []
        assert by_slices(lambda own: seen.append(own) or own, whole.type, whole, most=700).equals(whole)
        assert len(seen) > 3 and all(len(x) == 1 or weights(x).sum() <= 700 for x in seen)
    assert by_slices(lambda own: own, lists.type, lists.slice(0, 0)).equals(lists.slice(0, 0))


def test_decoding_tells_byte_runs_from_tokens(spark):
    vocab = toy_pieces()
    back, byte, a = Decoder(vocab), vocab.byte_ids, vocab.model_ids[b"a"]
    rows = [[a, byte[0xC3], byte[0xA9], a], [byte[0xC3], a, byte[0xA9]], [], None, [a] * 5000 + [byte[0x80]]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, ids array<int>")
    assert [r["text"] for r in decode(df, vocab).orderBy("doc_id").collect()] == ["aéa", "�a�", "", None, "a" * 5000 + "�"]
    assert [back.text(x) for x in rows if x is not None] == ["aéa", "�a�", "", "a" * 5000 + "�"] and back.raw(rows[0]) == "aéa".encode()
    with pytest.raises(ValueError):
        back.raw([-1])
    with pytest.raises(Exception, match="isn't in the vocabulary"):
        decode(spark.createDataFrame([([1, None],)], "ids array<int>"), vocab).collect()


def test_malformed_documents_merge_distinct_pieces_once(monkeypatch):
    from tokenframe.operators.encode import _bytes_words

    own, literal = Merger(vocabulary()), literal_pattern(vocabulary())
    raw = b"\x80" + b"the cat's \xc3 dog\xf0\x9f\x98 <|endo\x80ftext|>\x80 " * 50 + b"\xe2\x82"
    words = _bytes_words(own.vocab, literal, raw)
    assert b"".join(END.encode() if w == 50256 else w if isinstance(w, bytes) else w.encode() for w in words) == raw[1:].replace(b"endo\x80ftext|>\x80", b"endoftext|>")
    seen, once = [], Merger.piece
    monkeypatch.setattr(Merger, "piece", lambda self, p: seen.append(p) or once(self, p))
    got = own.rows([words, None, [], words]).to_pylist()
    assert len(seen) == len(set(seen)) and got[1:3] == [None, []] and got[0] == got[3]
    assert got[0] == bytes_ids(own, literal, raw)


def test_the_engine_merges_pieces_of_any_cut():
    from tokenframe.operators import library

    r, deepseek = random.Random(9), vocabulary(Family.DEEPSEEK_V3)
    assert library.merges(deepseek) and library.merges(vocabulary()) and not library.merges(toy_pieces())
    unordered = json.loads(json.dumps(SPEC))
    unordered["model"]["merges"][:2] = unordered["model"]["merges"][1::-1]
    assert not library.merges(load(unordered))
    fast, own = library.single(deepseek), Merger(deepseek)
    pieces = [bytes(r.choice(b"thean \x80\xc3\xa9zq\xff1") for _ in range(r.randint(1, 300))) for _ in range(400)] + [b"a" * 5000, bytes(range(256))]
    assert all(fast(p) == own.heap(own.first_ids(p)) for p in pieces)


def test_the_deduplicating_plan_shuffles_distinct_pieces_only(spark):
    texts = ["the cat sat " * 500, None, "", "é日 the"] * 3
    df = spark.createDataFrame([(f"k{i % 5}" if i else None, t) for i, t in enumerate(texts)], "name string, text string").coalesce(1)
    out = encode_deduplicated(df, vocabulary(), "name")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(words" in plan and "__pieces" not in plan
    want = encode(df, vocabulary()).select("name", "ids").collect()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, want)))
    assert encode_deduplicated(df.limit(0), vocabulary(), "name").collect() == []
    assert [tuple(r) for r in encode_deduplicated(df.where("text IS NULL").limit(1), vocabulary(), "name").collect()] == [("k1", None)]

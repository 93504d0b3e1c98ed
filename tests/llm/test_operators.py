"""The training-data operators against brute force, the tokenizers library, SQL and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenframe.llm import bpe, chat, dom, html_extract, langid, lm, packing, quality, registry, simhash, topk, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, fp string, bucket string, n int"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "one two", "one two three", long, "x" * 300_000, "\n" * 1000, "é Å 日本 <|endoftext|> ſ", "a|b|c " * 30, "The same line here\n" * 40, "1 2 3 !!"] + ["same text for all of them"] * 5
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "x", "x", "x", "x", 1) for i, t in enumerate(texts)]
    return rows + [(None, "no id", None, None, None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None, None), rows[4], rows[4]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


def pairs(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))


# 1


def library(texts):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    out = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_bpe_equals_the_library(spark, odd):
    r = random.Random(5)
    pool = [*"aaabcdeé ſ日한Ω🚀ΣςİIßǅ½²³1234\r\n\t\x85\xa0’.,!?-_<|>", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "</w>", "aaaa", "Å", "!!!!", "ñ", "̀"]
    fuzz = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(800)]
    latin = ["".join(chr(r.randint(0, 0x24F)) for _ in range(30)) for _ in range(400)]
    rows = [(r[0], r[1]) for r in odd_documents()] + [(100 + i, t) for i, t in enumerate(fuzz + latin)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(repr((d, *x)) for (d, _), x in zip(rows, library([t for _, t in rows])))
    assert pairs(bpe.round_trip(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


@needs_tables
def test_bpe_on_the_table(spark):
    rows = table(spark, "documents").select("doc_id", "text").collect()
    want = sorted(repr((d, *x)) for (d, _), x in zip(rows, library([t for _, t in rows])))
    assert pairs(bpe.op1_bpe_round_trip(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_chunks_and_forgetting_change_nothing(monkeypatch):
    texts = ["hello worlds", "", "hello hello tokenization", None, "worlds!"] * 20
    whole = bpe.ChunkEncoder(bpe.default_vocabulary()).encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    parts = bpe.ChunkEncoder(bpe.default_vocabulary())
    each = [parts.encode(texts[i : i + 3]) for i in range(0, len(texts), 3)]
    assert np.concatenate([x[0] for x in each]).tolist() == whole[0].tolist() and np.concatenate([x[1] for x in each]).tolist() == whole[1].tolist()


def test_bpe_one_at_a_time_equals_at_once(monkeypatch):
    own = bpe.encoder(bpe.default_vocabulary())
    words = [w.encode() for w in ("banana", "aaaaaaa", "internationalization", "x", "mississippi", "ааа")]
    want = own.merge(words)
    monkeypatch.setattr(own, "at_once", False)
    got = own.merge(words)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_decoding_is_the_inverse_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    assert dict(bpe.decoded(bpe.encode(df)).collect()) == {1: "hello</w> world</w>", 2: ""}


# 2


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    labels = dict(table(spark, "labels", sf).select("doc_id", "toxic").collect())
    rows = toxicity.op2_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, "documents", sf).count()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([(s >= 0.5) == bool(y) for y, s in held]) > 0.95
    bad, good = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.95


def test_toxicity_finds_unseen_spellings_in_long_texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeiounrstlm") for _ in range(r.randint(2, 8)))
    texts, labels = [], []
    for i in range(600):
        ws = [word() for _ in range(r.randint(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                ws[r.randrange(len(ws))] = "zqwor" + r.choice("abcdefgh") + word()
        texts.append(" ".join(ws))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(pa.array(texts), np.array(labels))
    clean = [" ".join(word() for _ in range(3000)) for _ in range(5)]
    assert (model.scores(pa.array([c + " zqwork" + word() for c in clean])) >= 0.5).mean() >= 0.8
    assert (model.scores(pa.array(clean)) < 0.5).mean() >= 0.8


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(18)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.score(odd, toxicity.train(odd, labels), F.col("doc_id")).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    one = toxicity.train(odd, labels.where("toxic = 1"))
    assert all(r["score"] > 0.99 for r in toxicity.score(odd, one, F.col("doc_id")).collect())
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), labels.limit(0)), F.col("doc_id")).count() == 0


def words_by_hand(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def buckets_by_hand(word, least, most, bits):
    raw, out = f"<{word}>".encode(), []
    for size in range(least, most + 1):
        for i in range(len(raw) - size + 1):
            h = 0
            for b in raw[i : i + size]:
                h = (h * 1_000_003 + b + 1) % 2**64
            out.append(((h ^ h >> 29) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - bits))
    return out


def word_by_hand(weights, word, least, most, bits):
    own = buckets_by_hand(word, least, most, bits)
    return sum(float(weights[b]) for b in own) / max(1, len(own))


def some_texts(spark):
    texts = [r["text"] for r in table(spark, "documents", SMALL).orderBy("doc_id").collect() if len(r["text"]) < 4000][:60]
    return texts + [None, "", "1 2 3", "word", "one two", "Ümläut ÉÑ", "a1b2c3"]


@needs_tables
def test_toxicity_scores_equal_one_text_at_a_time(spark):
    model = toxicity.train(table(spark, "documents"), table(spark, "labels"))
    texts = some_texts(spark)
    for text, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        ws = [word_by_hand(model.gram, w, toxicity.LEAST, toxicity.MOST, toxicity.BITS) for w in words_by_hand(text)]
        size = min(toxicity.WINDOW, len(ws))
        means = [sum(ws[i : i + size]) / size for i in range(len(ws) - size + 1)] if ws else [0.0]
        logits = (0.0, model.slopes[0] * (max(means) + model.bias) + model.slopes[1] * np.log(len(means)) + model.shift)
        assert abs(got - np.exp(logits[1]) / sum(np.exp(logits))) < 1e-6


# 3


def plain_best_fit(counts, capacity):
    bins = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = [i for i, x in enumerate(bins) if x >= size]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= size
            else:
                bins.append(capacity - size)
    return len(bins)


def test_best_fit_equals_the_plain_algorithm():
    r = random.Random(2)
    for _ in range(150):
        capacity = r.choice([8, 31, 64])
        counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(r.randint(1, 10))}
        bins, seen = {}, Counter()
        for size, first, end, sequence, m, offset in packing.best_fit_decreasing(counts, capacity):
            for k in range(end - first):
                bins.setdefault(sequence + k // m, []).append((offset + k % m * size, size))
        for own in bins.values():
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
                seen[size] += 1
            assert at <= capacity
        assert dict(seen) == counts and len(bins) == plain_best_fit(counts, capacity) == max(bins) + 1


def check_packing(rows, docs, length=packing.LENGTH):
    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.piece_bounds(len(ids), length))]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert len(sequences) == plain_best_fit(Counter(r["length"] for r in rows), length)


def test_pieces():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)] and packing.piece_bounds(4, 4) == [(0, 4)] and packing.piece_bounds(8, 4) == [(0, 4), (4, 4)] and packing.piece_bounds(1, 4) == [(0, 1)]


def test_packing_of_odd_rows(spark, odd):
    docs = [(r[0], r[1]) for r in odd_documents()]
    check_packing(packing.pack(odd).collect(), docs)
    assert packing.pack(odd.limit(0)).count() == 0
    pieces = packing.written(packing.cut(odd), "pieces")
    check_packing(packing.place(pieces, bucket_rows=3).collect(), docs)


@needs_tables
def test_packing_of_the_table(spark):
    check_packing(packing.op3_best_fit_packing(spark, SF).collect(), table(spark, "documents").select("doc_id", "text").collect())


# 4


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_of_odd_rows(spark, odd):
    r = random.Random(9)
    texts = [" ".join(r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(0, 60))) + r.choice(["", "\nx\nx\n \n"]) for _ in range(300)]
    df = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(1000 + i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    want = sorted(repr((d, *base(t))) for d, t in [(r[0], r[1]) for r in odd_documents()] + [(1000 + i, t) for i, t in enumerate(texts)])
    assert pairs(quality.judge(quality.statistics(df)), "doc_id", *NAMES) == want
    assert quality.judge(quality.statistics(odd.limit(0))).count() == 0


def quartiles_by_hand(x):
    b = np.sort(np.floor(x * quality._FINE), axis=0)
    at = lambda p: b[int(np.ceil(p * len(b) - 1e-9)) - 1]
    return (at(0.5) + 0.5) / quality._FINE, (at(0.75) - at(0.25)) / quality._FINE / 1.349


def mcd_by_hand(x, prior):
    """The same estimate row by row: mean, covariance, and the log-determinants of every start step by step."""
    noise, n = np.diag(quality.NOISE), len(x)
    median, spread = quartiles_by_hand(x)
    z = x - median
    size = (z**2).sum(axis=1)
    u = z[size > 0] / np.sqrt(size[size > 0])[:, None]
    starts = [(median, np.diag(spread**2)), (median, 5 * u.T @ u / n), (x.mean(axis=0), np.cov(x.T, bias=True))]
    ends = []
    for mean, cov in starts:
        cov, dets = cov + noise, []
        for _ in range(quality.MAX_STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins, left, w = np.floor(np.log2(1 + d) * quality._BIN), quality.HALF * n, np.zeros(n)
            for b in np.unique(bins):
                own = bins == b
                w[own] = min(1.0, left / own.sum())
                left -= own.sum()
                if left <= 0:
                    break
            m = w @ x / w.sum()
            s = quality.CONSISTENCY * ((x * w[:, None]).T @ x / w.sum() - np.outer(m, m)) + noise
            mean, cov = (n * m + quality.PRIOR * prior[0]) / (n + quality.PRIOR), (n * s + quality.PRIOR * prior[1]) / (n + quality.PRIOR)
            dets.append(np.linalg.slogdet(cov)[1])
        ends.append((round(dets[-1], 9), len(ends), mean, cov, dets))
    return min(ends, key=lambda e: e[:2])[2:4], [e[4] for e in ends]


SF_WHOLE = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF


@needs_tables
def test_robust_outliers_equal_numpy(spark):
    got = quality.judge(quality.statistics(table(spark, "documents", SF_WHOLE))).select("doc_id", "g_lang", "g_source", *NAMES, "distance", "kept", *quality.STATS).collect()
    passing = [r for r in got if not r["base_failed"]]
    vectors = lambda rows: np.array([[r[s] for s in quality.STATS] for r in rows])
    median, spread = quartiles_by_hand(vectors(passing))
    every = (median, np.diag(spread**2) + np.diag(quality.NOISE))
    by_lang, by_group = {}, {}
    for r in passing:
        by_lang.setdefault(r["g_lang"], []).append(r)
        by_group.setdefault((r["g_lang"], r["g_source"]), []).append(r)
    langs = {k: mcd_by_hand(vectors(own), every)[0] for k, own in by_lang.items()}
    assert len(by_group) >= 60
    for (lang, _), own in by_group.items():
        x = vectors(own)
        (mean, cov), dets = mcd_by_hand(x, langs[lang])
        want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        assert np.allclose(want, [r["distance"] for r in own], rtol=1e-5, atol=1e-8)
        assert [r["kept"] for r in own] == [w <= quality.CUT for w in want]
        assert all(b <= a + 0.05 for d in dets for a, b in zip(d, d[1:]))  # steps lower the determinant, but for the width of a bin
    labels = dict(table(spark, "labels", SF_WHOLE).select("doc_id", "quality").collect())
    clean = [r for r in passing if labels.get(r["doc_id"]) == 1]
    junk = [r for r in got if labels.get(r["doc_id"]) == 0]
    assert np.mean([r["kept"] for r in clean]) > 0.97 and np.mean([not r["kept"] for r in junk]) > 0.9


def test_small_groups_and_one_row_have_estimates(spark):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, text(r.randint(60, 400)), "en", "big") for i in range(150)] + [(200, text(100), "en", "one"), (201, text(200), None, None), (202, " ".join(["#$%"] * 3 + [text(1)]) + " " + " ".join(f"#{i}%" for i in range(60)), "en", "one")]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert got[200] and got[201] and not got[202] and sum(got[i] for i in range(150)) >= 148


# 5


@pytest.fixture(scope="module")
def forest():
    return html_extract.forest()


def test_the_shipped_trees_are_those_that_the_generator_gives(forest):
    import json

    pages = html_extract.written_pages()
    assert json.loads(html_extract.MODEL.read_text())["pages"] == html_extract.digest(pages)
    few = html_extract.fit(pages[:60])
    assert few.feature.shape == forest.feature.shape


def test_only_what_is_never_shown_is_left_out():
    read = lambda s: [t for t in dom.Page(s).text if t is not None]
    assert read("<p>Let <math>x=5</math> be the value</p>") == ["Let x=5 be the value"]
    assert read("<p>a <svg><title>no</title><path d='M0'/><text>b</text></svg> c<svg/> d</p>") == ["a b c d"]
    assert read("<p>Pick <select><option>a<option>b<p>second</p><p>third</p>") == ["Pick", "a", "b", "second", "third"]
    assert read("<script src=/js/>code</script><p>x</p>") == ["x"] and read("<style/>p{}</style><p>x</p>") == ["x"]
    assert read("<noscript><p>a</p></noscript><object>b</object><xmp><b>&amp;</xmp><textarea>&lt;c</textarea><template>no</template>") == ["a", "b", "<b>&amp;", "<c"]


def test_articles_keep_formulas_and_text_after_unclosed_fields(forest):
    body = lambda x: f"<html><body><nav><a href=/>Home</a><a href=/b>More</a></nav><article><h1>On values</h1><p>Let <math>x=5</math> be the value that we want to look at, for a while.</p>{x}<p>And this is the second paragraph of the text, which is also part of it.</p></article><footer>&copy; us</footer></body></html>"
    first, last = "Let x=5 be the value that we want to look at, for a while.", "And this is the second paragraph of the text, which is also part of it."
    for x in ("", "<script src=/js/>code()</script>", "<select><option>a<option>b"):
        text = html_extract.extract(forest, [body(x)])[0]
        assert first in text and last in text and "code()" not in text and "Home" not in text


def test_extraction_of_generated_pages(forest):
    r = random.Random(77)
    pages = [html_extract.written_page(r) for _ in range(200)]
    want = ["\n\n".join(t for t, y in zip(p.text, p.label) if t is not None and y) for p in map(dom.Page, pages)]
    got = html_extract.extract(forest, [re.sub(r' data-y="[01]"', "", p) for p in pages])
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.93


@needs_tables
def test_extraction_of_the_table(spark, forest):
    import html

    def article(page):
        m = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", m[1]).replace("<br>", " ")) if m else []
        return "\n\n".join(y for b in blocks if (y := " ".join(html.unescape(b).split())))

    pages = {r["page_id"]: r for r in table(spark, "pages").collect()}
    rows = html_extract.main_text(table(spark, "pages"), forest).collect()
    assert len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in rows)
    assert np.mean([r["text"] == article(pages[r["page_id"]]["html"]) for r in rows]) > 0.99


def test_decoding_never_contradicts_itself(forest):
    page = dom.Page("<div><p>a</p><div><p>b</p></div></div>")
    n = len(page.parent)
    r = np.random.default_rng(0)
    for _ in range(200):
        odds = r.normal(0, 1, n)
        best = max((sum(o if k else -o for o, k in zip(odds, keep)), keep) for keep in np.ndindex(*[2] * n) if keep[0] and all(not keep[i] or keep[page.parent[i]] for i in range(1, n)))[1]
        want = "\n\n".join(t for t, k in zip(page.text, best) if t is not None and k)
        assert page.decoded(odds) == want


def test_forgiving_reader():
    read = lambda s: [t for t in dom.Page(s).text if t is not None]
    assert read("<p>a<b>b<p>c&amp;d&nbsp; e<br>f</p>g") == ["ab", "c&d e f", "g"]
    assert read("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- no --> y <!-- open") == ["x y"]
    assert read("<ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5<tr><td>6</table>") == ["1", "2", "3", "4", "5", "6"]
    assert read('<a title="a>b">x</a> 1 < 2 &am') == ["x 1 < 2 &am"]
    assert read("") == [] and read("<div><div>") == [] and read("text <a href='x") == ["text"]
    assert len(read("<b>" * 20_000 + "x" + "<div>" * 20_000 + "y")) == 2


def test_extraction_of_odd_rows(spark, forest):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, "<p>a</p>", "x"), (3, "u", "<nav><a href=x>b</a></nav>", "x"), (3, "u", "<nav><a href=x>b</a></nav>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.main_text(df, forest).collect()
    assert len(got) == 5 and all(r["text"] is not None for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (1, 2)} == {1: "", 2: ""}
    assert html_extract.main_text(df.limit(0), forest).count() == 0


# 6


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(0, 1, 16).round(1).tolist(), "x") for i in range(300)] + [(400, None, "x"), (None, [1.0] * 16, "x"), (402, [1.0, None] * 8, "x"), (403, [float("nan")] * 16, "x"), (404, [float("inf")] * 16, "x"), (405, [], "x"), (406, [0.5] * 3, "x"), (500, [0.5] * 3, "x"), (7, [1.0] * 16, "x")]
    vectors += [(1000 + i, vectors[5][1], "x") for i in range(20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in usable:
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x)))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard, least in ((1024, 1 << 20), (1 << 22, 1 << 20), (1 << 22, 50)):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, shard_components=shard, least_shard=least)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_stops_only_on_proof():
    r = np.random.default_rng(8)
    matrix = (r.normal(0, 1, (3000, 8)) ** 3 * 1000 / 4.0 ** np.arange(8)).astype(np.int64)  # a few dimensions weigh most
    index = topk.ImpactIndex(np.arange(3000), np.arange(3000), matrix)
    few = 0
    for q, (places, scores) in enumerate(index.search(matrix[:40], np.arange(40))):
        order = np.lexsort((np.arange(3000), -(matrix @ matrix[q])))
        want = order[order != q][:10]
        assert places.tolist() == want.tolist() and scores.tolist() == (matrix @ matrix[q])[want].tolist()
        rows = index.possible(matrix[q], q, int((matrix @ matrix[q])[want[-1]]))
        assert rows is None or set(want.tolist()) <= set(rows.tolist())
        few += rows is not None
    assert few > 20  # most searches stop on the proof before half of the vectors are read


def test_top_k_of_repeated_queries_and_large_components(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(0, 1, 2).tolist()) for i in range(60)] + [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [-3.0, 0.5]), (200, [1e5, 1.0]), (201, [1e5, 1.0]), (300, [1e300, -1e300]), (301, [1e305, 1.0]), (302, [-1e300, 1e200]), (0, [4e18, 1e-320])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    exact = [(i, [int(1024 * x // 1) if abs(x) < 1e290 else 1024 * int(x) for x in v]) for i, v in vectors]
    want = []
    for a, (q, x) in enumerate(exact):
        if q % 100 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(exact) if a != b)[:10]
            want += [(q, k + 1, i, max(-(2**63 - 1), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    for shard in (8, 1 << 22):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, shard_components=shard).collect())) == sorted(want)


# 7, 8 and all SQL


@needs_tables
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
@pytest.mark.parametrize("sf", [SMALL, SF])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))


def backoff_by_hand(texts, order, least=2, factor=0.4):
    docs = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split() for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total, out = sum(map(len, docs)), []
    for d in docs:
        score = 0.0
        for i in range(len(d)):
            n, penalty = min(order, i + 1), 0.0
            while n > 1 and counts[tuple(d[i - n + 1 : i + 1])] < least:
                n, penalty = n - 1, penalty + np.log(factor)
            gram = tuple(d[i - n + 1 : i + 1])
            score += penalty + np.log(counts[gram]) - np.log(counts[gram[:-1]] if n > 1 else total)
        out.append((len(d), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_brute_force(spark, odd, order):
    rows = odd_documents()
    want = sorted((r[0] is None, r[0] or 0, n, round(s, 4)) for r, (n, s) in zip(rows, backoff_by_hand([r[1] for r in rows], order)))
    for chunk, bucket in ((1 << 20, 1 << 20), (20_000, 4_000)):
        got = lm.score(odd, order, chunk_bytes=chunk, bucket_bytes=bucket).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["log_score"], 4)) for r in got) == want
        assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm.score(odd.limit(0)).count() == 0


def test_count_tables_equal_brute_force(spark, odd):
    docs = [(r[1] or "").encode().lower().split() for r in odd_documents()]
    for n in (1, 2, 3):
        want = Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1))
        for chunk, bucket in ((1 << 20, 1 << 20), (20_000, 300)):
            got = lm.ngram_counts(odd, 3, chunk_bytes=chunk, bucket_bytes=bucket).where(F.col("n") == n).select("count").collect()
            assert sorted(r[0] for r in got) == sorted(want.values())


def test_a_flood_of_null_ids_is_spread_over_chunks(spark):
    texts = [f"word{i % 9} word{i % 7} word{i % 5} and so on {i}" for i in range(600)] + [None, "", " "] * 200
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    own, _ = lm._exploded(df, 2, 2000, 2000)
    sizes = [len(r["doc_ids"]) for r in own.collect()]
    assert len(sizes) > 5 and max(sizes) < 150
    want = sorted((n, round(s, 4)) for n, s in backoff_by_hand(texts, 3))
    assert sorted((r["n_tokens"], round(r["log_score"], 4)) for r in lm.score(df, 3, chunk_bytes=2000, bucket_bytes=2000).collect()) == want


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "[x] <y> \\l </s>"}]}, {"prompt": "a", "completion": "b"}, {"system": "s", "prompt": "a", "response": "b"}, {"instruction": "do", "input": "this", "output": "ok"}, {"instruction": "do", "input": "", "output": "ok"}, {"instruction": "do", "output": "ok"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, {"id": 3, "messages": [{"role": "tool]<[", "text": "hi"}]}, {"messages": []}, {"question": "q", "answer": None}, {"x": 1},
    ]
    want = [
        [("user", "hi"), ("assistant", "[x] <y> \\l </s>")], [("user", "a"), ("assistant", "b")], [("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "do\n\nthis"), ("assistant", "ok")], [("user", "do"), ("assistant", "ok")], [("user", "do"), ("assistant", "ok")],
        [("user", "q"), ("assistant", "")], [("tool]<[", "hi")], [], [("user", "q"), ("assistant", "")], None,
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(98, "not json", "x"), (99, None, "x")], "id int, record string, formatted_text string")
    out = chat.formatted(chat.canonical(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss"))).orderBy("id").collect()
    for r, turns in zip(out, [*want, None, None]):
        assert (r["turns"] and [tuple(t) for t in r["turns"]]) == turns
        assert (r["back"] and [tuple(t) for t in r["back"]]) == turns
        assert r["learned"] == (None if turns is None else "".join(t for role, t in turns if role == "assistant"))
    assert len({r["formatted"] for r in out[:3]}) == 3


def test_chat_of_odd_rows(spark):
    nasty = ["</s>", "[INST]", "\\", "\\b\\l\\o", "[R:x]", "", None, "a\nb", "日本", "<|x|>" * 1000, "\x00\x01\t\"'"]
    rows = [(c, t, role, text, "x") for c in (1, 2, None) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", "system", "R:a]", None, "OUT") for x in nasty)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    out = chat.formatted(chat.canonical(chat.records_of(df))).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    alone = [r for r in out if r["conv_id"] is None]
    assert len(out) == 2 + len(alone)
    assert sorted(tuple(r["back"][0]) for r in alone) == sorted((role or "", text or "") for c, _, role, text, _ in rows if c is None) and all(len(r["back"]) == 1 for r in alone)
    for r in out:
        if r["conv_id"] is None:
            continue
        own = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv_id"])
        assert [tuple(x) for x in r["back"]] == [(a, b) for _, a, b in own]
    assert chat.records_of(df.limit(0)).count() == 0


def test_very_long_conversations_are_whole_or_an_error(spark):
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("ab<"), 7_000_001).alias("text"))
    out = chat.formatted(chat.canonical(chat.records_of(df))).select(F.length("formatted").alias("n"), F.length(chat.read_back(F.col("formatted"))[0]["text"]).alias("back")).first()
    assert tuple(out) == (6 + 4 * 7_000_001 + 4, 21_000_003)
    json = df.select(F.concat(F.lit('{"messages":[{"role":"user","text":"'), "text", F.lit('"}]}')).alias("record"))
    with pytest.raises(Exception, match="21000"):
        chat.canonical(json).select("turns").collect()


def test_structs_select_layouts_by_their_fields(spark):
    kind = "record struct<system:string,prompt:string,completion:string,messages:array<struct<role:string,content:string>>,output:string,instruction:string>, layout_text string"
    rows = [((None, "a", "b", None, None, None), "x"), (("s", "a", "b", None, None, None), "x"), ((None, None, None, [("user", "hi"), (None, None)], None, None), "x"), ((None, None, None, [], None, None), "x"), ((None, None, None, None, "o", "i"), "x"), ((None, "a", None, None, None, None), "x"), (None, "x")]
    got = [r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [[("user", "a"), ("assistant", "b")], [("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "hi"), ("", "")], [], [("user", "i"), ("assistant", "o")], None, None]


def test_layouts_must_differ(spark):
    two = {"a": chat.Fields((("user", "x"),)), "b": chat.Fields((("assistant", "x"),))}
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([("{}",)], "record string"), layouts=two)


# 9


@needs_tables
def test_languages_on_held_out_rows(spark):
    truth = dict(table(spark, "documents").select("doc_id", "lang").collect())
    rows = langid.op9_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.98


def test_languages_of_odd_rows(spark, odd):
    for docs in (odd, odd.withColumn("lang", F.lit(None).cast("string")), odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "xx").otherwise("fr"))):
        rows = langid.predict(docs, langid.train(docs), F.col("doc_id"), F.col("text")).collect()
        assert len(rows) == odd.count()
        for r in rows:
            if not re.search(r"[^\W\d_]", r["text"] or ""):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.predict(odd.limit(0), langid.train(odd.limit(0)), F.col("doc_id")).count() == 0
    assert langid.family_of("en-GB") == "germanic" and langid.family_of("tlh") == "tlh"


@needs_tables
def test_languages_equal_one_text_at_a_time(spark):
    model, texts = langid.train(table(spark, "documents")), some_texts(spark)
    columns = model.weights.shape[1]
    for text, lang, score in zip(texts, *model.predict(pa.array(texts, pa.string()))):
        ws = words_by_hand(text)
        if not ws:
            assert (lang, score) == ("und", 0.0)
            continue
        margin = [sum(word_by_hand(model.weights[:-1, j], w, langid.LEAST, langid.MOST, langid.BITS) for w in ws) / len(ws) + float(model.weights[-1, j]) for j in range(columns)]
        ranked = sorted(range(len(model.families)), key=lambda f: -margin[f]) if len(model.families) > 1 else [0]
        family, sure = ranked[0], [margin[ranked[0]] - margin[ranked[1]]] if len(model.families) > 1 else []
        names = model.members[family]
        wins = [sum((margin[j] > 0) == (a == k) for a, b, j in model.pairs[family] if k in (a, b)) for k in range(len(names))]
        gains = [sum(margin[j] if a == k else -margin[j] for a, b, j in model.pairs[family] if k in (a, b)) for k in range(len(names))]
        won = max(range(len(names)), key=lambda k: (wins[k], gains[k]))
        sure += [2 * (margin[j] if a == won else -margin[j]) for a, b, j in model.pairs[family] if won in (a, b)]
        at = sum(map(len, model.members[:family])) + won
        mean, between, within = model.likeness[at]
        sure.append((margin[columns - len(model.likeness) + at] - mean) / np.sqrt(between + within / len(ws)) + langid.DEVIATIONS)
        assert lang == names[won] and abs(score - 1 / (1 + np.exp(-2 * np.clip(min(sure), -15, 15)))) < 1e-4


def test_ngrams_are_those_of_single_words_in_little_memory():
    import tracemalloc

    from tokenframe.llm import words

    texts = ["", "a", "日本", "naïve", *(f"{i * 7919:x}" for i in range(40_000))]
    together = pa.array(texts, pa.string())
    tracemalloc.start()
    buckets, grams = words.ngrams(together, 3, 6, 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(buckets)  # of which the result has four bytes each
    ends = np.cumsum(grams)
    for i in [*range(200), len(texts) - 1]:
        own, n = words.ngrams(pa.array([texts[i]]), 3, 6, 18)
        word = f"<{texts[i]}>".encode()
        assert buckets[ends[i] - grams[i] : ends[i]].tolist() == own.tolist() and n.tolist() == [sum(max(0, len(word) - k + 1) for k in range(3, 7))]
        want = []
        for k in range(3, 7):
            for j in range(len(word) - k + 1):
                h = 0
                for b in word[j : j + k]:
                    h = (h * 1_000_003 + b + 1) % (1 << 64)
                want.append(((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) % (1 << 64) >> 46)
        assert own.tolist() == want


def test_three_close_languages():
    r = random.Random(6)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60))
    kinds = {"fr": "abcdeé", "es": "abcdeñ", "it": "abcdeò", "en": "wxyzth", "de": "wxyzßü"}
    langs = [k for k in kinds for _ in range(30)]
    model = langid.fit(pa.array([text(kinds[k]) for k in langs]), langs)
    lang, score = model.predict(pa.array([text(kinds[k]) for k in langs]))
    assert np.mean(lang == np.array(langs, object)) > 0.97 and (score >= 0.5).all()


def test_every_language_is_learned(spark, monkeypatch):
    docs = [(10 * i + k, f"w{i}a w{i}b", f"l{i:02d}") for i in range(70) for k in range(6)] + [(1000 + k, "long " * 5000, "xx") for k in range(6)]
    monkeypatch.setattr(langid, "fit", lambda texts, langs: list(zip(texts.to_pylist(), langs)))
    learned = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert {lang for _, lang in learned} == {d[2] for d in docs}
    assert max(len(text) for text, _ in learned) == langid.TRAIN_CHARS


def test_unlearned_languages_and_gibberish_are_unsure():
    r = random.Random(9)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60))
    kinds = {"fr": "abcdeé", "es": "abcdeñ", "en": "wxyzth"}
    for known in (["fr", "es", "en"], ["fr", "es"], ["fr", "en"], ["fr"]):
        langs = [k for k in known for _ in range(40)]
        model = langid.fit(pa.array([text(kinds[k]) for k in langs]), langs)
        lang, score = model.predict(pa.array([text(kinds[k]) for k in langs]))
        assert np.mean(lang == np.array(langs, object)) > 0.97 and np.mean(score >= langid.LEAST_SCORE) > 0.98
        assert (model.predict(pa.array([text("абвгде"), text("mnopqr"), text("jklm")]))[1] < langid.LEAST_SCORE).all()


# 10


def fingerprint_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, fps):
    f = np.array(fps, np.uint64)
    label = np.arange(len(f))
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    lowest = {}
    for d, c in zip(ids, label.tolist()):
        lowest[c] = min((x for x in (lowest.get(c), d) if x is not None), default=None)
    return [lowest[c] for c in label.tolist()]


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = odd_documents()
    fps = [fingerprint_by_hand(r[1]) for r in rows]
    want = sorted(repr((r[0], f"{f:016x}", c)) for r, f, c in zip(rows, fps, components_by_hand([r[0] for r in rows], fps)))
    assert pairs(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@needs_tables
def test_near_duplicates_of_the_table(spark):
    rows = table(spark, "documents").select("doc_id", "text").collect()
    fps = [fingerprint_by_hand(r["text"]) for r in rows]
    want = sorted(repr((r["doc_id"], f"{f:016x}", c)) for r, f, c in zip(rows, fps, components_by_hand([r["doc_id"] for r in rows], fps)))
    assert pairs(simhash.op10_simhash_vptree(spark, SF), "doc_id", "fingerprint", "component_id") == want


def test_trees_lose_no_link(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [int(c) for c in centres] + [int(x) for x in r.integers(0, 2**63, 2500, dtype=np.uint64)]
    for c in centres.tolist():
        x = c
        for _ in range(25):  # chains whose members drift apart
            for _ in range(int(r.integers(1, 4))):
                x ^= 1 << int(r.integers(0, 64))
            fps.append(x)
    fps = sorted(set(fps))
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in zip(ids, fps)], "doc_id long, fp long")
    want = sorted(zip(ids, components_by_hand(ids, fps)))
    for shard in (64, 1000, 10**6):
        got = simhash.components(simhash.written(df, "fps"), shard_rows=shard)
        assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == want


def test_shared_block_values_are_cut_by_trees(spark):
    r = np.random.default_rng(5)
    near = np.unique(r.integers(0, 2**21, 1500, dtype=np.uint64) << np.uint64(43) | np.uint64(12345))  # two of three blocks alike
    other = r.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate((near, near[:200] ^ np.uint64(1 << 63 | 2), other, other[:50] ^ np.uint64(5))))
    trees = simhash.build_trees(fps, len(fps), 2, 200)
    assert sum(map(len, trees)) >= 2  # the shared values have trees
    place, fp, visits = simhash.routed(fps, trees)
    assert np.unique(place[np.isin(fp, near)]).size > 8 and visits.any()
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in zip(ids, fps.tolist())], "doc_id long, fp long")
    got = simhash.components(simhash.written(df, "fps"), shard_rows=200)
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect())) == sorted(zip(ids, components_by_hand(ids, fps)))


def test_copies_beyond_one_share_are_joined_whole(spark, monkeypatch):
    from tokenframe.functions import skew

    monkeypatch.setattr(simhash, "spread_join", lambda *a: skew.spread_join(*a, per=7))
    df = spark.createDataFrame([(i, "the same words for everyone here") for i in range(50)] + [(100 + i, None) for i in range(20)] + [(200, "alone in all the wide world")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {**{i: 0 for i in range(50)}, **{100 + i: 100 for i in range(20)}, 200: 200}


def test_long_chains_become_stars(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(i + 1, i) for i in range(1000, 1010)], "u long, v long")
    assert sorted(map(tuple, simhash.stars(edges).collect())) == [(i, 0) for i in range(1, n + 1)] + [(i, 1000) for i in range(1001, 1011)]

"""DuckDB SQL for the same results, built from other means: RE2 patterns, rank files and a recursive merge.

RE2 has no lookahead, so a sentinel is put before the last of several spaces that a non-space follows, and
kept out of every negated class.
"""

from __future__ import annotations

import os
from string import punctuation

MARK = "\\x{E000}"
_W = "\\s\\x0b\\x{85}\\p{Z}"
_SUFFIXES = "|".join("'" + x for x in "s t re ve m ll d".split())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rank_file() -> str:
    import public_tokenizers

    return os.path.splitext(public_tokenizers.path("byte_bpe_50k.json"))[0] + ".tiktoken"


def _marked(text: str, line_breaks: bool) -> str:
    last = "[" + _W + "]" if line_breaks else "[ \\t\\x0b\\x0c\\x{85}\\p{Z}]"
    return f"regexp_replace({text}, {_q(f'([{_W}])({last})([^{_W}])')}, '\\1' || chr(57344) || '\\2\\3', 'g')"


def _one_pass(digits: str) -> str:
    return f"(?i:{_SUFFIXES})|[^\\r\\n\\p{{L}}\\p{{N}}{MARK}]?\\p{{L}}+|{digits}| ?[^{_W}\\p{{L}}\\p{{N}}{MARK}]+[\\r\\n]*|[{_W}]*[\\r\\n]+|[{_W}]+"


_GPT2 = f"{_SUFFIXES}| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_W}\\p{{L}}\\p{{N}}{MARK}]+|[{_W}]+"
_MARKS = "".join("\\" + c for c in punctuation)
_LAST = f"[{_MARKS}][A-Za-z]+|[^\\r\\n\\p{{L}}\\p{{P}}\\p{{S}}{MARK}]?[\\p{{L}}\\p{{M}}]+| ?[\\p{{P}}\\p{{S}}]+[\\r\\n]*|[{_W}]*[\\r\\n]+|[{_W}]+"


def _isolated(text: str, pattern: str) -> str:
    """The text cut around every match of a pattern, matches kept."""
    return f"list_filter(string_split(regexp_replace({text}, {_q(f'({pattern})')}, chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '')"


def pieces(text: str, family: str = "gpt2") -> str:
    """An expression for the array of pre-tokens of a text expression."""
    if family == "gpt2":
        return f"regexp_extract_all({_marked(text, True)}, {_q(_GPT2)})"
    if family in ("llama3", "qwen25"):
        return f"regexp_extract_all({_marked(text, False)}, {_q(_one_pass('\\p{N}{1,3}' if family == 'llama3' else '\\p{N}'))})"
    digits = _isolated(text, "\\p{N}{1,3}")
    han = f"flatten(list_transform({digits}, lambda s: {_isolated('s', '[一-龥぀-ゟ゠-ヿ]+')}))"
    return f"flatten(list_transform({han}, lambda t: {_isolated(_marked('t', False), _LAST)}))"


def pieces_rows(source: str, key: str, text: str, family: str = "gpt2") -> str:
    """(key, pos, piece) rows."""
    return f"SELECT {key}, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS piece FROM (SELECT {key}, {pieces(text, family)} AS ps FROM {source})"


def tokens(rows: str, key: str, raw: str = "hex(encode(piece))") -> str:
    """CTEs ending in flat(key, pos, token_id) for a query of (key, pos, piece) rows: a recursive merge of distinct pieces."""
    return f"""ranks AS (
  SELECT from_base64(token) AS tok, rank FROM read_csv('{rank_file()}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'INTEGER'}})
), rows_ AS ({rows}), todo AS (SELECT DISTINCT piece FROM rows_),
bytes_ AS (SELECT piece AS p, i AS pos, unhex(substr(h, 2 * i - 1, 2)) AS sym, 0 AS it FROM (SELECT piece, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT piece, {raw} AS h FROM todo))),
steps AS (
  SELECT p, pos, sym, it FROM bytes_
  UNION ALL
  SELECT p, pos, CASE WHEN pos = mp THEN sym || nsym ELSE sym END, it + 1 FROM (
    SELECT *, lag(pos) OVER (PARTITION BY p ORDER BY pos) AS ppos FROM (
      SELECT *, min(rk) OVER (PARTITION BY p) AS mr, arg_min(pos, rk::BIGINT * 100000 + pos) OVER (PARTITION BY p) AS mp FROM (
        SELECT n.*, r.rank AS rk FROM (SELECT *, lead(sym) OVER (PARTITION BY p ORDER BY pos) AS nsym FROM steps) n LEFT JOIN ranks r ON r.tok = n.sym || n.nsym
      )
    ) WHERE mr IS NOT NULL
  ) WHERE ppos IS DISTINCT FROM mp
), final_ AS (
  SELECT p, pos, rank AS id FROM (SELECT *, max(it) OVER (PARTITION BY p) AS last FROM steps) s JOIN ranks r ON r.tok = s.sym WHERE it = last
), flat AS (
  SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY r.pos, f.pos) - 1)::INTEGER AS pos, f.id AS token_id FROM rows_ r JOIN final_ f ON f.p = r.piece
)"""


def with_tokens(query: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"WITH RECURSIVE {tokens(pieces_rows(source, key, text), key)}\n{query}"


def ids_rows(rows: str, key: str, source: str, fixed: str = "", raw: str = "hex(encode(piece))") -> str:
    """(key, n_tokens, ids_md5) for a query of (key, pos, piece) rows; `fixed` is one of (key, pos, 0, id) rows among them."""
    return f"""WITH RECURSIVE {tokens(rows, key, raw)}, every_ AS (
  SELECT {key}, r.pos::BIGINT AS a, f.pos::BIGINT AS b, f.id::INTEGER AS id FROM rows_ r JOIN final_ f ON f.p = r.piece{' UNION ALL ' + fixed if fixed else ''}
) SELECT d.{key}, count(e.id)::BIGINT AS n_tokens, md5(coalesce(string_agg(e.id::VARCHAR, ',' ORDER BY a, b), '')) AS ids_md5
FROM (SELECT DISTINCT {key} FROM {source}) d LEFT JOIN every_ e ON e.{key} = d.{key} GROUP BY d.{key}"""


def batches(lanes_rows: int, least: int, max_docs: int, max_bytes: int) -> str:
    """Batches filled document by document in each lane."""
    return f"""WITH RECURSIVE sized AS (
  SELECT (doc_id % l.lanes)::INTEGER AS lane, doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents, (SELECT greatest({least}, (count(*) + {lanes_rows - 1}) // {lanes_rows}) AS lanes FROM documents) l
), queue AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS k FROM sized WHERE n <= {max_bytes}), steps AS (
  SELECT lane, k, doc_id, n, 0::BIGINT AS batch, 1 AS docs, n AS held FROM queue WHERE k = 1
  UNION ALL
  SELECT lane, k, doc_id, n, batch + new::BIGINT, CASE WHEN new THEN 1 ELSE docs + 1 END, CASE WHEN new THEN n ELSE held + n END
  FROM (SELECT q.*, s.batch, s.docs, s.held, s.docs = {max_docs} OR s.held + q.n > {max_bytes} AS new FROM steps s JOIN queue q ON q.lane = s.lane AND q.k = s.k + 1)
) SELECT lane, batch, doc_id, n AS n_bytes FROM steps UNION ALL SELECT lane, -1, doc_id, n FROM sized WHERE n > {max_bytes}"""


def toy_ids(names: list[str], merges: list[tuple[str, str]], runs: list[tuple[str, int]]) -> str:
    """Ids of documents under a small sentence-piece vocabulary whose merges only use products of earlier ones.

    Then merging by rank is replacing each pair, one after the other. Products and runs are single private characters.
    """
    text, known, letter = "replace(text, ' ', '▁')", {t: i for i, t in enumerate(names)}, {}
    table = [(t, i) for t, i in known.items() if len(t) == 1]
    for n, (run, i) in enumerate(sorted(runs, key=lambda x: -len(x[0]))):
        if set(run) & {"\n", "\t"}:
            mark = chr(0xE200 + n)
            text = f"replace({text}, {_q(run)}, '{mark}')"
            table.append((mark, i))
    for n, (a, b) in enumerate(merges):
        letter[a + b] = mark = chr(0xE100 + n)
        text = f"replace({text}, '{letter.get(a, a)}{letter.get(b, b)}', '{mark}')"
        table.append((mark, known[a + b]))
    rows = ", ".join(f"({_q(t)}, {i})" for t, i in table)
    first = known["<0x00>"]
    return f"""WITH t(c, id) AS (VALUES {rows}), chars AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS pos FROM (SELECT doc_id, string_split({text}, '') AS cs FROM documents WHERE text <> '')),
spelled AS (SELECT DISTINCT c, hex(encode(c)) AS h FROM chars),
ids AS (SELECT s.c, CASE WHEN t.id IS NOT NULL THEN [t.id] ELSE [{first} + list_position(string_split('0123456789ABCDEF', ''), h[2 * i + 1]) * 16 - 16 + list_position(string_split('0123456789ABCDEF', ''), h[2 * i + 2]) - 1 FOR i IN range(length(h) // 2)] END AS own FROM spelled s LEFT JOIN t ON t.c = s.c),
every_ AS (SELECT doc_id, pos, unnest(own) AS id, unnest(range(len(own))) AS place FROM chars JOIN ids ON ids.c = chars.c)
SELECT d.doc_id, count(e.id)::BIGINT AS n_tokens, md5(coalesce(string_agg(e.id::VARCHAR, ',' ORDER BY pos, place), '')) AS ids_md5 FROM documents d LEFT JOIN every_ e ON e.doc_id = d.doc_id GROUP BY d.doc_id"""

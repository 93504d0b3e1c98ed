"""DuckDB SQL for the quality rules: the base statistics, and the robust estimates step by step."""

from __future__ import annotations

from .quality import CONSISTENCY, CUT, HALF, MAX_STEPS, NOISE, PRIOR, STATS, _BIN, _FINE

_P = range(len(STATS))
_LOW = [(i, j) for i in _P for j in range(i + 1)]
_NAMES = ", ".join([f"m{i}" for i in _P] + [f"c{i}{j}" for i, j in _LOW])
_BASE = r"""
words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents
), windows AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, w) AS times
  FROM (SELECT rid, unnest(range(len(ws) - 2)) AS pos, unnest([ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(len(ws) - 2)]) AS w FROM words WHERE len(ws) > 2)
), covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY rid
), stats AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered c ON c.rid = w.rid
), base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)"""


def _noise(i: int, j: int) -> float:
    return NOISE[i] if i == j else 0.0


def _distance() -> str:
    terms = (" + ".join(f"v{i}{j} * ({STATS[j]} - m{j})" for j in range(i + 1)) for i in _P)
    return " + ".join(f"power({t}, 2)" for t in terms)


def _factored(source: str) -> str:
    """The inverse of the Cholesky factor, and the determinant's logarithm, beside all columns."""
    factor, inverse = [], []
    for j in _P:
        factor.append(f"sqrt(greatest(c{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(j))}, 1e-9)) AS l{j}{j}")
        factor += [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(STATS))]
    for i in _P:
        inverse.append(f"1 / l{i}{i} AS v{i}{i}")
        inverse += [f"-({' + '.join(f'l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} AS v{i}{j}" for j in range(i)]
    return f"SELECT *, {', '.join(inverse)}, {' + '.join(f'2 * ln(l{i}{i})' for i in _P)} AS det FROM (SELECT *, {', '.join(factor)} FROM ({source}))"


def _quartiles(key: str) -> str:
    shares = {"a": 0.25, "b": 0.5, "c": 0.75}
    each = " UNION ALL ".join(f"SELECT {key} AS g, {i} AS i, floor({s} * {_FINE}) AS bin FROM passing" for i, s in enumerate(STATS))
    picks = ", ".join(f"min(bin) FILTER (upto >= {share} * total) AS {name}" for name, share in shares.items())
    at = f"SELECT g, i, max(total) AS n, {picks} FROM (SELECT *, sum(k) OVER (PARTITION BY g, i ORDER BY bin) AS upto, sum(k) OVER (PARTITION BY g, i) AS total FROM (SELECT g, i, bin, count(*) AS k FROM ({each}) GROUP BY g, i, bin)) GROUP BY g, i"
    columns = ", ".join(f"max((b + 0.5) / {_FINE}) FILTER (i = {i}) AS q{i}, max((c - a) / {_FINE} / 1.349) FILTER (i = {i}) AS r{i}" for i in _P)
    return f"SELECT g, max(n)::DOUBLE AS n, {columns} FROM ({at}) GROUP BY g"


def _level(name: str, key: str, prior: str, on: str) -> list[str]:
    """CTEs ending in `name`: the estimate of every group `key`, averaged with the prior's of the group `on`."""
    z = [f"({s} - q{i})" for i, s in enumerate(STATS)]
    size = f"({' + '.join(f'{x} * {x}' for x in z)})"
    means = ", ".join(f"avg({z[i]}) AS a{i}" for i in _P)
    products = ", ".join(f"avg({z[i]} * {z[j]}) AS b{i}{j}, 5 * avg({z[i]} * {z[j]} * CASE WHEN {size} > 0 THEN 1 / {size} ELSE 0 END) AS s{i}{j}" for i, j in _LOW)
    start = lambda k, mean, cov: f"SELECT g, {k} AS start, n, " + ", ".join([f"{mean(i)} AS m{i}" for i in _P] + [f"{cov(i, j)} + {_noise(i, j)} AS c{i}{j}" for i, j in _LOW]) + f" FROM {name}_sums"
    starts = " UNION ALL ".join((start(0, lambda i: f"q{i}", lambda i, j: f"r{i} * r{i}" if i == j else "0.0"), start(1, lambda i: f"q{i}", lambda i, j: f"s{i}{j}"), start(2, lambda i: f"q{i} + a{i}", lambda i, j: f"b{i}{j} - a{i} * a{j}")))
    out = [f"{name}_q AS ({_quartiles(key)})", f"{name}_sums AS MATERIALIZED (SELECT q.*, t.* EXCLUDE (g) FROM {name}_q q JOIN (SELECT g, {means}, {products} FROM (SELECT {key} AS g, {', '.join(STATS)} FROM passing) JOIN {name}_q USING (g) GROUP BY g) t ON t.g = q.g)", f"{name}_0 AS MATERIALIZED ({_factored(starts)})"]
    moments = ", ".join([f"sum({s}) AS x{i}" for i, s in enumerate(STATS)] + [f"sum({STATS[i]} * {STATS[j]}) AS y{i}{j}" for i, j in _LOW])
    near = ", ".join([f"sum(share * x{i}) / sum(share * k) AS x{i}" for i in _P] + [f"sum(share * y{i}{j}) / sum(share * k) AS y{i}{j}" for i, j in _LOW])
    weigh = lambda a, b: f"(e.n * ({a}) + {PRIOR} * {b}) / (e.n + {PRIOR})"
    averaged = ", ".join([f"{weigh(f'x{i}', f'p.m{i}')} AS m{i}" for i in _P] + [f"{weigh(f'{CONSISTENCY} * (y{i}{j} - x{i} * x{j}) + {_noise(i, j)}', f'p.c{i}{j}')} AS c{i}{j}" for i, j in _LOW])
    for k in range(MAX_STEPS):
        bins = f"SELECT g, start, n, floor(log2(1 + {_distance()}) * {_BIN}) AS bin, {', '.join(STATS)} FROM (SELECT {key} AS g, {', '.join(STATS)} FROM passing) JOIN {name}_{k} USING (g)"
        sums = f"SELECT g, start, n, bin, count(*)::DOUBLE AS k, {moments} FROM ({bins}) GROUP BY g, start, n, bin"
        shares = f"SELECT *, least(1.0, ({HALF} * n - (sum(k) OVER (PARTITION BY g, start ORDER BY bin) - k)) / k) AS share FROM ({sums})"
        step = f"SELECT g, start, n, {near} FROM ({shares}) WHERE share > 0 GROUP BY g, start, n"
        out.append(f"{name}_{k + 1} AS MATERIALIZED ({_factored(f'SELECT e.g, e.start, e.n, {averaged} FROM ({step}) e JOIN {prior} p ON {on}')})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{MAX_STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(det, 9), start) = 1)")
    return out


def sql() -> str:
    root = "2 * sqrt({} + 0.375)".format
    values = ("ln(1 + n_words)", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", root("100 * n_symbols / greatest(n_words, 1)"), root("n_dup_lines"), root("100 * n_repeat_words / greatest(n_words, 1)"))
    ctes = [_BASE, f"rows_ AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS {s}' for v, s in zip(values, STATS))} FROM base)", "passing AS (SELECT * FROM rows_ WHERE NOT base_failed)"]
    every = ", ".join([f"q{i} AS m{i}" for i in _P] + [f"{f'r{i} * r{i}' if i == j else '0.0'} + {_noise(i, j)} AS c{i}{j}" for i, j in _LOW])
    ctes.append(f"every_ AS MATERIALIZED (SELECT g, {every} FROM ({_quartiles('[0]')}))")
    ctes += _level("langs", "[lang]", "every_", "true")
    ctes += _level("groups_", "[lang, source]", "langs", "p.g = e.g[1:1]")
    kept = f"NOT base_failed AND coalesce({_distance()}, 0) <= {CUT}"
    return f"WITH {', '.join(ctes)}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {kept} AS kept FROM rows_ r LEFT JOIN groups_ e ON e.g = [r.lang, r.source]"

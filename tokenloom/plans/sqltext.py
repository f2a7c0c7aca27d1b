"""Pieces of SQL text shared by the checks (DuckDB dialect)."""

from __future__ import annotations

from tokenloom.functions import fixed_values as fv
from tokenloom.functions.text import NON_LATIN_CLASS

WS = "'" + fv.PYTHON_WHITESPACE + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def byte_list(expr: str) -> str:
    """UTF-8 bytes of a text as a list of integers."""
    return (
        f"list_transform(regexp_extract_all(hex(encode({expr})), '..'), "
        f"lambda h: ('0x' || h)::INT)"
    )


def md5_list(expr: str) -> str:
    return f"md5(array_to_string({expr}, ','))"


def prompt(instruction: str, context: str) -> str:
    n = "chr(10)"
    return (
        f"('### Instruction:' || {n} || {strip(instruction)} || {n} || {n} || "
        f"CASE WHEN {strip(f'coalesce({context}, {chr(39)*2})')} <> '' THEN '### Input:' || {n} || "
        f"{strip(context)} || {n} || {n} ELSE '' END || '### Response:' || {n})"
    )


def native_ok(expr: str) -> str:
    return (
        f"CASE WHEN {expr} IS NULL OR length({strip(expr)}) < {fv.MIN_TEXT_CHARS} THEN false "
        f"WHEN regexp_matches({expr}, '{NON_LATIN_CLASS}') THEN false "
        f"ELSE length(regexp_replace({expr}, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / "
        f"length({expr}) >= {fv.MIN_ASCII_RATIO}::DOUBLE END"
    )


def placed(size: int) -> str:
    """CTEs ``placed(doc_id, n, s)`` and ``pieces(doc_id, n, s, shard_id, lo, hi)``."""
    return f"""
placed AS (
  SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS s
  FROM (SELECT doc_id, (strlen(text) + 1)::BIGINT AS n FROM documents)),
pieces AS (
  SELECT doc_id, n, s, shard_id, greatest(s, shard_id * {size}) AS lo,
         least(s + n, (shard_id + 1) * {size}) AS hi
  FROM (SELECT *, unnest(range(s // {size}, (s + n - 1) // {size} + 1)) AS shard_id FROM placed))"""


SPLIT = "CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END"


def stream_tokens(size: int) -> str:
    """CTE ``stream(shard_id, p, tok)``: every token with its place in its shard."""
    return f"""
tok AS (
  SELECT doc_id, unnest([256] || {byte_list('text')}) AS tok,
         unnest(range(strlen(text) + 1)) AS i FROM documents),
stream AS (
  SELECT (s + i) // {size} AS shard_id, (s + i) % {size} AS p, tok
  FROM tok JOIN placed USING (doc_id))"""


def windows(size: int, window: int) -> str:
    """CTEs ``lens`` and ``idx(split, shard_id, win, start)`` on top of ``pieces``."""
    return f"""
lens AS (SELECT shard_id, sum(hi - lo)::BIGINT AS len FROM pieces GROUP BY 1),
idx AS (
  SELECT {SPLIT} AS split, shard_id, win, win * {window} AS start
  FROM (SELECT shard_id, unnest(range((len - 1) // {window})) AS win FROM lens))"""


def window_lists(size: int, window: int) -> str:
    """CTE ``wins(shard_id, win, toks)`` with full windows only."""
    return f"""
both_sides AS (
  SELECT shard_id, p // {window} AS win, p, tok FROM stream
  UNION ALL
  SELECT shard_id, p // {window} - 1 AS win, p, tok FROM stream WHERE p % {window} = 0 AND p > 0),
wins AS (
  SELECT shard_id, win, list(tok ORDER BY p) AS toks FROM both_sides
  GROUP BY 1, 2 HAVING count(*) = {window} + 1)"""


CONVERSATION_PAIRS = f"""
u AS (SELECT conv_id, min(turn) AS ut, arg_min({strip('text')}, turn) AS human
      FROM conversations WHERE role = 'user' AND {strip('text')} <> '' GROUP BY 1),
a AS (SELECT c.conv_id, min(turn) AS ait, arg_min({strip('text')}, turn) AS answer
      FROM conversations c JOIN u USING (conv_id)
      WHERE role = 'assistant' AND turn > ut GROUP BY 1),
s AS (SELECT conv_id, min(turn) AS st, arg_min({strip('text')}, turn) AS sys
      FROM conversations WHERE role = 'system' AND {strip('text')} <> '' GROUP BY 1),
ids AS (SELECT DISTINCT conv_id FROM conversations),
pairs AS (
  SELECT conv_id, human, answer, CASE WHEN st < ait THEN sys END AS sys
  FROM ids LEFT JOIN u USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN s USING (conv_id)),
chat AS (
  SELECT conv_id AS ord, 'lmsys-chat' AS source,
         CASE WHEN human <> '' AND answer <> '' THEN human END AS instruction,
         CASE WHEN human <> '' AND answer <> '' THEN '' END AS context,
         CASE WHEN human <> '' AND answer <> '' THEN answer END AS response FROM pairs)"""


def counted(source: str) -> str:
    """CTE ``counted``: token counts and the native language check of unified examples."""
    return f"""
counted AS (
  SELECT *, p + r AS n FROM (
    SELECT *, strlen({prompt('instruction', 'context')}) AS p,
           strlen({strip('response')}) + 1 AS r,
           instruction || ' ' || response AS lt FROM {source}))"""


def kept_examples(source: str) -> str:
    """CTE ``kept``: examples that pass format, native language and length checks."""
    return (
        counted(source)
        + f""",
kept AS (
  SELECT *, [x FOR x IN {byte_list(prompt('instruction', 'context'))}]
         || {byte_list(strip('response'))} || [256] AS toks
  FROM counted WHERE instruction IS NOT NULL AND ({native_ok('lt')})
    AND n <= {fv.SEQUENCE_TOKENS} AND r >= {fv.MIN_RESPONSE_TOKENS})"""
    )


def split_rows(source: str, rows_per_shard: int) -> str:
    """CTE ``rows``: split, shard and row number of each example of ``source``."""
    k = "'-' || source || '-' || ord"
    return f"""
perm AS (
  SELECT *, row_number() OVER (ORDER BY md5('{fv.MIX_SEED}' || {k})) - 1 AS pp,
         count(*) OVER () AS n_all FROM {source}),
halves AS (
  SELECT *, CASE WHEN pp < greatest(1, floor(n_all * {fv.HOLDOUT_FRACTION}::DOUBLE)::BIGINT)
                 THEN 'val' ELSE 'train' END AS split FROM perm),
rows AS (
  SELECT *, rn // {rows_per_shard} AS shard_id, rn % {rows_per_shard} AS row_id FROM (
    SELECT *, row_number() OVER (PARTITION BY split
        ORDER BY md5('{fv.MIX_SEED + 1}' || {k})) - 1 AS rn FROM halves))"""

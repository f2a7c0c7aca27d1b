"""Queries: instruction mix, from raw layouts to stored shards and their description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import fixed_values as fv
from tokenloom.functions import text as tx
from tokenloom.functions.arrays import digest
from tokenloom.operators import analysis, convert, encode, filters, langid, quality, split, turns
from tokenloom.operators import windows
from tokenloom.operators.tokenizers import ByteTokenizer
from tokenloom.plans import sqltext as q
from tokenloom.plans.catalog import documents, query, table
from tokenloom.session import materialise, scratch_path
from tokenloom.sources import prepare, registry, reports
from tokenloom.sources.shards import read_example_shards, write_example_shards

BYTES = ByteTokenizer()
ROWS_PER_SHARD = 16

# ---------------------------------------------------------------------------------------
# Raw layouts made from the test tables, row by row. A document's lines play the turns of a
# nested conversation; who speaks follows from the document and line numbers, so that all
# orders of roles occur, and empty lines give empty turns.

ROLES = ["system", "user", "user", "assistant", "assistant"]
OPENING_ROLES = ["user", "assistant", "user", "assistant", "system"]
CHAT_ROLES = ["system", "human", "human", "gpt", "gpt"]
MARKS = ["### Human: ", "### Assistant: ", ""]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text", "lang", "source")


def _lines() -> Column:
    return F.split(F.col("text"), "\n")


def _speaker(roles: list[str], line: Column) -> Column:
    at = F.pmod(F.col("doc_id") + line, F.lit(len(roles))).cast("int")
    return F.get(F.array(*[F.lit(r) for r in roles]), at)


def _messages(roles: list[str], role: str = "role", content: str = "content") -> Column:
    return F.transform(
        _lines(), lambda x, i: F.struct(_speaker(roles, i).alias(role), x.alias(content))
    )


def _from_document(name: str) -> list[Column]:
    """Columns of one raw layout, made from a document."""
    text, first, second = F.col("text"), F.get(_lines(), F.lit(0)), F.get(_lines(), F.lit(1))
    if name == "dolly":
        return [first.alias("instruction"), F.col("lang").alias("context"), text.alias("response")]
    if name == "smol-smoltalk":
        return [_messages(ROLES).alias("messages")]
    if name == "tulu3":
        return [_messages(OPENING_ROLES).alias("messages")]
    if name == "guanaco":
        marked = F.transform(_lines(), lambda x, i: F.concat(_speaker(MARKS, i), x))
        return [F.array_join(marked, "").alias("text")]
    if name == "openorca":
        return [second.alias("instruction"), first.alias("system"), text.alias("response")]
    if name == "slimorca":
        return [_messages(CHAT_ROLES, "from", "value").alias("conversations")]
    if name == "lmsys-chat":
        language = F.when(F.col("lang") == "en", F.lit("English")).otherwise(F.lit("Other"))
        return [_messages(ROLES).alias("conversation"), language.alias("language")]
    return [first.alias("instruction"), second.alias("input"), text.alias("output")]


def _from_item(name: str) -> list[Column]:
    """Columns of one raw layout, made from a benchmark item."""
    text = F.col("text")
    if name == "gsm8k":
        return [text.alias("question"), text.alias("answer")]
    return [text.alias("instruction"), F.lit(None).cast("string").alias("input"), text.alias("output")]


FROM_ITEMS = ("alpaca", "gsm8k")


def _raw_sources(
    spark: SparkSession, sf_dir: str, names: list[str] | None = None
) -> dict[str, DataFrame]:
    docs = _documents(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark")
    return {
        name: items.select(F.col("item_id").alias("ord"), *_from_item(name))
        if name in FROM_ITEMS
        else docs.select(F.col("doc_id").alias("ord"), *_from_document(name))
        for name in names or registry.source_names()
    }


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_sources(spark, sf_dir)
    raw["lmsys-chat"] = raw["lmsys-chat"].where(F.col("language") == "English")
    return registry.unified_mix(raw)


# The same raw layouts in SQL, one row per line.


def _sql_array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _who(roles: list[str]) -> str:
    return f"({_sql_array(roles)})[((doc_id + i) % {len(roles)})::INT + 1]"


S = q.strip
DOC_LINES = """
dl AS (SELECT doc_id, text, lang, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, lang, unnest(l) AS x, unnest(range(len(l))) AS i FROM dl)"""


def _pair_sql(name: str, roles: list[str], user: str, assistant: str, usable: str, content: str) -> str:
    """CTEs for "first usable user turn, then first assistant turn after it"."""
    return f"""
{name}_t AS (SELECT doc_id, lang, i, {content} AS x, {_who(roles)} AS role FROM ln),
{name}_u AS (SELECT doc_id, min(i) AS ui, arg_min(x, i) AS human FROM {name}_t
             WHERE role = '{user}' AND {usable} GROUP BY 1),
{name}_a AS (SELECT t.doc_id, min(i) AS ai, arg_min(x, i) AS answer FROM {name}_t t
             JOIN {name}_u USING (doc_id) WHERE role = '{assistant}' AND i > ui GROUP BY 1)"""


def _whole(instruction: str, response: str, context: str = "''") -> str:
    ok = f"coalesce({instruction}, '') <> '' AND coalesce({response}, '') <> ''"
    return (
        f"CASE WHEN {ok} THEN {instruction} END AS instruction, "
        f"CASE WHEN {ok} THEN {context} END AS context, "
        f"CASE WHEN {ok} THEN {response} END AS response"
    )


def _system(sys: str, text: str) -> str:
    return f"CASE WHEN length({sys}) > 10 THEN {sys} || chr(10) || chr(10) || {text} ELSE {text} END"


MIX_SQL = f"""{DOC_LINES},
{_pair_sql('st', ROLES, 'user', 'assistant', 'true', 'x')},
{_pair_sql('lm', ROLES, 'user', 'assistant', "x <> ''", S('x'))},
{_pair_sql('so', CHAT_ROLES, 'human', 'gpt', "x <> ''", S('x'))},
so_s AS (SELECT t.doc_id, arg_min(x, i) AS sys FROM so_t t JOIN so_a USING (doc_id)
         WHERE role = 'system' AND x <> '' AND i < ai GROUP BY 1),
gu AS (SELECT doc_id, string_agg({_who(MARKS)} || x, '' ORDER BY i) AS t FROM ln GROUP BY 1),
gu2 AS (SELECT doc_id, CASE WHEN strpos(t, '### Human:') > 0
                            THEN substr(t, strpos(t, '### Human:') + 10) END AS t FROM gu),
gu3 AS (SELECT doc_id, CASE WHEN strpos(t, '### Assistant:') > 0
                            THEN {S("substr(t, 1, strpos(t, '### Assistant:') - 1)")} END AS human,
               substr(t, strpos(t, '### Assistant:') + 14) AS r FROM gu2),
mix AS (
  SELECT doc_id AS ord, 'dolly' AS source, l[1] AS instruction, lang AS context, text AS response FROM dl
  UNION ALL SELECT item_id, 'alpaca', text, '', text FROM benchmark
  UNION ALL SELECT doc_id, 'smol-smoltalk', {_whole('human', 'answer')}
    FROM dl LEFT JOIN st_u USING (doc_id) LEFT JOIN st_a USING (doc_id)
  UNION ALL SELECT doc_id, 'tulu3', {_whole('human', 'answer')} FROM (
    SELECT doc_id,
           CASE WHEN ({_sql_array(OPENING_ROLES)})[(doc_id % 5)::INT + 1] = 'user' THEN l[1] END AS human,
           CASE WHEN ({_sql_array(OPENING_ROLES)})[((doc_id + 1) % 5)::INT + 1] = 'assistant' THEN l[2] END AS answer
    FROM dl)
  UNION ALL SELECT doc_id, 'guanaco', {_whole('human', 'answer')} FROM (
    SELECT doc_id, human, {S("CASE WHEN strpos(r, '### Human:') > 0 THEN substr(r, 1, strpos(r, '### Human:') - 1) ELSE r END")} AS answer
    FROM gu3)
  UNION ALL SELECT doc_id, 'openorca', {_whole('ins', 'res')} FROM (
    SELECT doc_id, {_system(S('l[1]'), S('l[2]'))} AS ins, {S('text')} AS res FROM dl)
  UNION ALL SELECT doc_id, 'slimorca', {_whole('ins', 'answer')} FROM (
    SELECT dl.doc_id, answer, {_system('sys', 'human')} AS ins
    FROM dl LEFT JOIN so_u USING (doc_id) LEFT JOIN so_a USING (doc_id) LEFT JOIN so_s USING (doc_id))
  UNION ALL SELECT item_id, 'gsm8k', {_whole(S('text'), S('text'))} FROM benchmark
  UNION ALL SELECT doc_id, 'lmsys-chat', {_whole('human', 'answer')}
    FROM dl LEFT JOIN lm_u USING (doc_id) LEFT JOIN lm_a USING (doc_id) WHERE lang = 'en'
  UNION ALL SELECT doc_id, 'open-platypus',
    {_whole(S('l[1]'), S('text'), S("coalesce(l[2], '')"))} FROM dl)"""

CONVERTED = "ord, source, md5(instruction) AS instruction_md5, md5(context) AS context_md5, md5(response) AS response_md5"


def _converted(df: DataFrame) -> DataFrame:
    return df.select(
        "ord",
        "source",
        *[F.md5(c).alias(f"{c}_md5") for c in ("instruction", "context", "response")],
    )


def _one_source(name: str, function: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _converted(registry.source(name).converter(_raw_sources(spark, sf_dir, [name])[name]))

    run.__name__ = function
    query(f"WITH {MIX_SQL} SELECT {CONVERTED} FROM mix WHERE source = '{name}'")(run)


for _name in registry.source_names():
    if _name != "lmsys-chat":  # its filter at load is part of the query below
        _one_source(_name, "convert_" + _name.replace("-", "_"))


@query(f"WITH {MIX_SQL} SELECT {CONVERTED} FROM mix WHERE source = 'lmsys-chat'")
def convert_lmsys_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_sources(spark, sf_dir, ["lmsys-chat"])["lmsys-chat"]
    path = scratch_path(spark, "raw-lmsys-chat")
    raw.write.parquet(path)
    return _converted(registry.read_mix(spark, {"lmsys-chat": path}))


@query(
    f"""WITH {MIX_SQL}
SELECT source, count(*) AS n_rows,
       count(*) FILTER (instruction IS NULL) AS n_unusable FROM mix GROUP BY 1"""
)
def source_registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every raw layout, read all of them through the registry, and unite them."""
    paths = {}
    for name, raw in _raw_sources(spark, sf_dir).items():
        paths[name] = scratch_path(spark, f"raw-{name}")
        raw.write.parquet(paths[name])
    return (
        registry.read_mix(spark, paths, registry.source_names())
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("instruction").isNull()).alias("n_unusable"),
        )
    )


# ---------------------------------------------------------------------------------------
# Conversations stored as one row per turn.


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turns.first_pairs(_turns(spark, sf_dir), pass_over_blank=True, strip=True)
    return turns.as_examples(pairs, "lmsys-chat")


@query(
    """WITH u AS (SELECT conv_id, min(turn) AS ut, arg_min(text, turn) AS human FROM conversations
           WHERE role = 'user' GROUP BY 1),
a AS (SELECT c.conv_id, arg_min(text, turn) AS answer FROM conversations c JOIN u USING (conv_id)
      WHERE role = 'assistant' AND turn > ut GROUP BY 1)
SELECT conv_id AS ord, 'smol-smoltalk' AS source,
       CASE WHEN human <> '' AND answer <> '' THEN md5(human) END AS instruction_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5('') END AS context_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5(answer) END AS response_md5
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id) LEFT JOIN a USING (conv_id)"""
)
def chat_first_pair_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turns.first_pairs(_turns(spark, sf_dir), pass_over_blank=False, strip=False)
    return _converted(turns.as_examples(pairs, "smol-smoltalk"))


@query(f"WITH {q.CONVERSATION_PAIRS} SELECT {CONVERTED} FROM chat")
def chat_first_pair_skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_chat(spark, sf_dir))


@query(
    f"""WITH {q.CONVERSATION_PAIRS}
SELECT conv_id AS ord, 'slimorca' AS source,
       CASE WHEN human <> '' AND answer <> '' THEN md5({_system('sys', 'human')}) END AS instruction_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5('') END AS context_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5(answer) END AS response_md5 FROM pairs"""
)
def chat_system_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turns.first_pairs(_turns(spark, sf_dir), pass_over_blank=True, strip=True)
    return _converted(turns.as_examples(pairs, "slimorca", system_prefix=True))


@query(
    """WITH p AS (
  SELECT conv_id, max(CASE WHEN turn = 0 AND role = 'user' THEN text END) AS human,
         max(CASE WHEN turn = 1 AND role = 'assistant' THEN text END) AS answer
  FROM conversations GROUP BY 1)
SELECT conv_id AS ord, 'tulu3' AS source,
       CASE WHEN human <> '' AND answer <> '' THEN md5(human) END AS instruction_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5('') END AS context_md5,
       CASE WHEN human <> '' AND answer <> '' THEN md5(answer) END AS response_md5 FROM p"""
)
def chat_strict_two_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(turns.as_examples(turns.opening_pairs(_turns(spark, sf_dir)), "tulu3"))


# ---------------------------------------------------------------------------------------
# Text predicates, language identification and the filter chain.


@query(
    f"""WITH {MIX_SQL}
SELECT ord, source, md5({q.prompt('instruction', 'context')}) AS prompt_md5,
       strlen({q.prompt('instruction', 'context')}) AS prompt_bytes
FROM mix WHERE instruction IS NOT NULL"""
)
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = tx.render_prompt(F.col("instruction"), F.col("context"))
    return (
        _mix(spark, sf_dir)
        .where(F.col("instruction").isNotNull())
        .select(
            "ord",
            "source",
            F.md5(prompt).alias("prompt_md5"),
            F.octet_length(prompt).cast("bigint").alias("prompt_bytes"),
        )
    )


@query(
    f"""SELECT doc_id, length({S('text')}) AS stripped_chars,
       length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS non_ascii_chars,
       ({q.native_ok('text')}) AS native_ok FROM documents"""
)
def english_filter_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.length(tx.py_strip(text)).cast("bigint").alias("stripped_chars"),
        tx.non_ascii_chars(text).cast("bigint").alias("non_ascii_chars"),
        tx.passes_native_english_checks(text).alias("native_ok"),
    )


# One character from inside each listed block, and a few from blocks that are not listed.
INJECTED = [(lo + hi) // 2 for lo, hi in fv.NON_LATIN_RANGES] + [0x03B1, 0x0561, 0x00E9, 0x20AC]


@query(
    f"""SELECT doc_id, regexp_matches(t, '{tx.NON_LATIN_CLASS}') AS blocked,
       ({q.native_ok('t')}) AS native_ok
FROM (SELECT doc_id, text || chr(({INJECTED})[(doc_id % {len(INJECTED)})::INT + 1]) AS t FROM documents)"""
)
def script_block_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets one foreign character; which one depends on its id."""
    marks = F.array(*[F.lit(chr(c)) for c in INJECTED])
    mark = F.get(marks, F.pmod("doc_id", F.lit(len(INJECTED))).cast("int"))
    return (
        _documents(spark, sf_dir)
        .withColumn("t", F.concat("text", mark))
        .select(
            "doc_id",
            tx.has_non_latin_script(F.col("t")).alias("blocked"),
            tx.passes_native_english_checks(F.col("t")).alias("native_ok"),
        )
    )


def _trigrams_sql(keys: str, text: str, source: str) -> str:
    return f"""
SELECT {keys}, c[i] || c[i + 1] || c[i + 2] AS tri FROM (
  SELECT {keys}, c, unnest(range(1, len(c) - 1)) AS i
  FROM (SELECT {keys}, string_split(lower({text}), '') AS c FROM {source}) WHERE len(c) >= 3)"""


PROFILE_SQL = f"""
train AS ({_trigrams_sql('lang', 'text', 'documents')}),
prof AS (SELECT lang, tri, count(*) AS n FROM train GROUP BY 1, 2),
mass AS (SELECT lang, sum(n) + {langid.SMOOTHING}::DOUBLE * {langid.VOCABULARY} AS m FROM prof GROUP BY 1),
wts AS (
  SELECT tri, lang, ln((coalesce(n, 0) + {langid.SMOOTHING}::DOUBLE) / m) AS w
  FROM (SELECT DISTINCT tri FROM prof) CROSS JOIN mass LEFT JOIN prof USING (tri, lang))"""


def _identify_sql(keys: str, grams: str) -> str:
    """CTE ``found``: best language per key; all weights of a text's own trigrams are known or unseen."""
    on = keys
    return f"""
gr AS ({grams}),
gc AS (SELECT {keys}, tri, count(*) AS c FROM gr GROUP BY ALL),
sc AS (
  SELECT {keys}, mass.lang,
         sum(c * coalesce(w, ln({langid.SMOOTHING}::DOUBLE / m))) AS score
  FROM gc CROSS JOIN mass LEFT JOIN wts ON wts.tri = gc.tri AND wts.lang = mass.lang GROUP BY ALL),
found AS (
  SELECT {on}, lang AS language FROM sc
  QUALIFY row_number() OVER (PARTITION BY {on} ORDER BY score DESC, lang DESC) = 1)"""


@query(f"WITH {PROFILE_SQL} SELECT lang, tri, n FROM prof")
def langid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.trigram_counts(_documents(spark, sf_dir))


HALVES_SQL = f"""
train AS ({_trigrams_sql('half, doc_id, lang', 'text', '(SELECT *, doc_id % 2 AS half FROM documents)')}),
prof AS (SELECT half, lang, tri, count(*) AS n FROM train GROUP BY ALL),
mass AS (SELECT half, lang, sum(n) + {langid.SMOOTHING}::DOUBLE * {langid.VOCABULARY} AS m FROM prof GROUP BY ALL),
gc AS (SELECT half, doc_id, tri, count(*) AS c FROM train GROUP BY ALL),
sc AS (
  SELECT gc.doc_id, mass.lang, sum(c * ln((coalesce(n, 0) + {langid.SMOOTHING}::DOUBLE) / m)) AS score
  FROM gc JOIN mass ON mass.half <> gc.half
  LEFT JOIN prof ON prof.half = mass.half AND prof.tri = gc.tri AND prof.lang = mass.lang GROUP BY ALL),
found AS (
  SELECT doc_id, lang AS language FROM sc
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) = 1)"""


@query(
    f"""WITH {HALVES_SQL}
SELECT d.lang, language, count(*) AS n FROM documents d LEFT JOIN found USING (doc_id) GROUP BY 1, 2"""
)
def langid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half of the documents under the weights of the other half."""
    docs = _documents(spark, sf_dir)
    found = None
    for half in (0, 1):
        profile = langid.train_profile(docs.where(F.col("doc_id") % 2 != half))
        own = langid.identify(docs.where(F.col("doc_id") % 2 == half), profile, keys=["lang"])
        found = own if found is None else found.unionByName(own)
    return found.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with reasons, kept as a table: statistics, cap and split all read it."""
    profile = langid.train_profile(_documents(spark, sf_dir))
    mix = _mix(spark, sf_dir)
    return materialise(
        filters.skip_reasons(mix, BYTES, profile=profile), "reasons"
    )


REASONS_SQL = f"""{MIX_SQL},{PROFILE_SQL},{q.counted('mix')},
ok AS (SELECT ord, source, lt FROM counted WHERE instruction IS NOT NULL AND ({q.native_ok('lt')})),
{_identify_sql('source, ord', _trigrams_sql('source, ord', 'lt', 'ok'))},
reasons AS (
  SELECT source, ord, p, r, n,
         CASE WHEN instruction IS NULL THEN 'fmt'
              WHEN coalesce(language, '') <> 'en' THEN 'lang'
              WHEN n > {fv.SEQUENCE_TOKENS} OR r < {fv.MIN_RESPONSE_TOKENS} THEN 'len' END AS skip_reason
  FROM counted LEFT JOIN found USING (source, ord))"""


@query(
    f"""WITH {REASONS_SQL}
SELECT source, ord, skip_reason, n::BIGINT AS n_tokens FROM reasons"""
)
def sft_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasoned(spark, sf_dir).select(
        "source", "ord", "skip_reason", F.col("n_tokens").cast("bigint").alias("n_tokens")
    )


def _stats_sql(cap: int) -> str:
    return f"""WITH {REASONS_SQL},
k AS (SELECT *, coalesce(sum((skip_reason IS NULL)::INT) OVER (
        PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM reasons)
SELECT source, CASE WHEN grouping(source) = 1 THEN 1 ELSE 0 END AS is_total,
       count(*) FILTER (skip_reason IS NULL) AS kept,
       count(*) FILTER (skip_reason = 'lang') AS skipped_not_english,
       count(*) FILTER (skip_reason = 'len') AS skipped_too_long_or_short,
       count(*) FILTER (skip_reason = 'fmt') AS skipped_format
FROM k WHERE {cap} = 0 OR before < {cap} GROUP BY ROLLUP (source)"""


CAP = 25


@query(_stats_sql(CAP))
def sft_capped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature here: rows after a source's cap-th kept one are not counted."""
    profile = langid.train_profile(_documents(spark, sf_dir))
    mix = materialise(_mix(spark, sf_dir), "mix")
    return filters.skip_stats(filters.capped_reasons(mix, BYTES, cap=CAP, profile=profile))


@query(_stats_sql(0))
def sft_uncapped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.skip_stats(filters.cap_per_source(_reasoned(spark, sf_dir), 0))


# ---------------------------------------------------------------------------------------
# Encoding, split, shards and what is read back from them.

KEPT_SQL = f"{q.CONVERSATION_PAIRS},{q.kept_examples('chat')}"
ROWS_SQL = f"{KEPT_SQL},{q.split_rows('kept', ROWS_PER_SHARD)}"
PADDED_SQL = f"""{ROWS_SQL},
padded AS (
  SELECT *, toks || list_transform(range({fv.SEQUENCE_TOKENS} - n), lambda z: 256) AS t,
         list_transform(range({fv.SEQUENCE_TOKENS}), lambda z: CASE WHEN z >= p AND z < n THEN 1 ELSE 0 END) AS m
  FROM rows)"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.kept_examples(_chat(spark, sf_dir), BYTES)


def _placed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept examples with split, shard and row; ranks are computed on keys alone."""
    kept = materialise(_kept(spark, sf_dir), "kept")
    keys = ["source", "ord"]
    placed = split.row_shards(
        split.holdout_split(kept.select(*keys), keys), keys, rows_per_shard=ROWS_PER_SHARD
    )
    return kept.join(placed, keys)


def _example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tokens, which are made after the join: texts are smaller to move."""
    return encode.encode_examples(_placed_examples(spark, sf_dir), BYTES)


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.pad(_example_rows(spark, sf_dir), BYTES.eot_id)


@query(
    f"""WITH {KEPT_SQL}
SELECT ord, p::BIGINT AS prompt_len, r::BIGINT AS response_len,
       {q.md5_list(f"toks || list_transform(range({fv.SEQUENCE_TOKENS} - n), lambda z: 256)")} AS tokens_md5,
       {q.md5_list(f"list_transform(range({fv.SEQUENCE_TOKENS}), lambda z: CASE WHEN z >= p AND z < n THEN 1 ELSE 0 END)")} AS mask_md5
FROM kept"""
)
def sft_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = encode.pad(encode.encode_examples(_kept(spark, sf_dir), BYTES), BYTES.eot_id)
    return padded.select(
        "ord",
        F.col("prompt_len").cast("bigint").alias("prompt_len"),
        F.col("response_len").cast("bigint").alias("response_len"),
        digest(F.col("tokens")).alias("tokens_md5"),
        digest(F.col("mask")).alias("mask_md5"),
    )


@query(
    f"""WITH {KEPT_SQL},{q.split_rows('kept', ROWS_PER_SHARD)}
SELECT source, ord, split FROM rows"""
)
def sft_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source", "ord"]
    kept = materialise(_kept(spark, sf_dir).select(*keys), "kept-keys")
    divided = materialise(split.holdout_split(kept, keys), "split")
    held_out = divided.where(F.col("split") == "val")
    train = split.kept_outside(kept, held_out, keys).withColumn("split", F.lit("train"))
    val = split.kept_inside(kept, held_out, keys).withColumn("split", F.lit("val"))
    return train.unionByName(val).select("source", "ord", "split")


@query(
    f"""WITH {ROWS_SQL}
SELECT split, shard_id::BIGINT AS shard_id, row_id::BIGINT AS row_id, source, ord,
       {q.md5_list('toks')} AS tokens_md5 FROM rows"""
)
def sft_row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _example_rows(spark, sf_dir).select(
        "split",
        F.col("shard_id").cast("bigint").alias("shard_id"),
        F.col("row_id").cast("bigint").alias("row_id"),
        "source",
        "ord",
        digest(F.col("tokens")).alias("tokens_md5"),
    )


@query(
    f"""WITH {ROWS_SQL}
SELECT split, shard_id::BIGINT AS shard_id, count(*) AS n_rows, max(row_id)::BIGINT AS last_row_id,
       sum(n)::BIGINT AS n_tokens FROM rows GROUP BY 1, 2"""
)
def example_shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "example-shards")
    write_example_shards(_placed_examples(spark, sf_dir), BYTES, path)
    stored = read_example_shards(spark, path)
    return (
        quality.shards_before_gap(stored)
        .groupBy("split", F.col("shard_id").cast("bigint").alias("shard_id"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max("row_id").cast("bigint").alias("last_row_id"),
            F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        )
    )


@query(
    f"""WITH {ROWS_SQL}
SELECT split, shard_id::BIGINT AS shard_id, row_id::BIGINT AS row_id,
       {fv.SEQUENCE_TOKENS}::BIGINT AS n_token,
       (CASE WHEN p < 200 THEN {fv.SEQUENCE_TOKENS - 1} END)::BIGINT AS n_mask
FROM rows WHERE p < 200 OR p > 400"""
)
def shard_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short prompts get a short mask and long prompts none, on purpose; both have to be found."""
    padded = materialise(_padded(spark, sf_dir), "padded")
    keys = ["split", "shard_id", "row_id"]
    short = F.slice("mask", F.lit(1), F.lit(fv.SEQUENCE_TOKENS - 1))
    damaged = (
        F.when(F.col("prompt_len") < 200, short)
        .when(F.col("prompt_len") <= 400, F.col("mask"))
        .alias("mask")
    )
    found = quality.misaligned_rows(
        padded.select(*keys, "tokens"), padded.select(*keys, damaged), fv.SEQUENCE_TOKENS
    )
    return found.select("split", *[F.col(c).cast("bigint").alias(c) for c in found.columns[1:]])


@query(
    f"""WITH {PADDED_SQL},
pos AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY
          CASE WHEN split = 'train' THEN md5('{fv.SFT_SERVE_SEED}-0-' || shard_id || '-' || row_id) END,
          shard_id, row_id) - 1 AS bp, count(*) OVER (PARTITION BY split) AS total FROM padded)
SELECT split, bp % 2 AS rank, (bp // 2) // 4 AS batch_id, (bp // 2) % 4 AS slot, ord,
       {q.md5_list(f't[1:{fv.WINDOW_TOKENS}]')} AS x_md5,
       {q.md5_list(f't[2:{fv.SEQUENCE_TOKENS}]')} AS y_md5,
       {q.md5_list(f'm[2:{fv.SEQUENCE_TOKENS}]')} AS loss_mask_md5
FROM pos WHERE (bp // 2) // 4 < ((total - bp % 2 + 1) // 2) // 4"""
)
def sft_batches_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and batches come from the narrow row index; tokens are joined to them."""
    rows = materialise(_padded(spark, sf_dir), "padded")
    keys = ["split", "shard_id", "row_id"]
    index = rows.select(*keys)

    def served(name: str) -> DataFrame:
        order = windows.served_order(index, ("shard_id", "row_id"), name, seed=fv.SFT_SERVE_SEED)
        order = windows.with_total(order, index.where(F.col("split") == name))
        return windows.batches(order, 4, 2, "n_rows")

    batches = served("train").unionByName(served("val"))
    full = windows.masked_rows(rows.join(batches, keys))
    return full.select(
        "split",
        F.col("rank").cast("bigint").alias("rank"),
        "batch_id",
        F.col("slot").cast("bigint").alias("slot"),
        "ord",
        digest(F.col("x")).alias("x_md5"),
        digest(F.col("y")).alias("y_md5"),
        digest(F.col("loss_mask")).alias("loss_mask_md5"),
    )


LONG_SQL = f"""{ROWS_SQL},
counts AS (SELECT split, source, (n - 1) AS total_tokens, p AS prompt_tokens, r AS response_tokens FROM rows),
melted AS (
  SELECT split, 'total_tokens' AS "column", total_tokens AS value FROM counts
  UNION ALL SELECT split, 'prompt_tokens', prompt_tokens FROM counts
  UNION ALL SELECT split, 'response_tokens', response_tokens FROM counts)"""


@query(
    f"""WITH {LONG_SQL}
SELECT split, "column", round(avg(value), 6) AS mean, median(value)::DOUBLE AS median,
       min(value)::BIGINT AS min, max(value)::BIGINT AS max FROM melted GROUP BY 1, 2"""
)
def sft_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = encode.token_counts(_padded(spark, sf_dir), BYTES.eot_id)
    return analysis.column_stats(counted, ["split"]).select(
        "split",
        "column",
        F.round("mean", 6).alias("mean"),
        "median",
        F.col("min").cast("bigint").alias("min"),
        F.col("max").cast("bigint").alias("max"),
    )


@query(
    f"""WITH {LONG_SQL}
SELECT split, "column", count(*) AS count, round(avg(value), 1) AS mean,
       round(stddev_samp(value), 1) AS std, round(min(value)::DOUBLE, 1) AS min,
       round(quantile_cont(value, 0.25), 1) AS p25, round(quantile_cont(value, 0.5), 1) AS p50,
       round(quantile_cont(value, 0.75), 1) AS p75, round(max(value)::DOUBLE, 1) AS max
FROM melted GROUP BY 1, 2"""
)
def sft_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = encode.token_counts(_padded(spark, sf_dir), BYTES.eot_id)
    return analysis.describe(counted, ["split"])


@query(
    f"""WITH {PADDED_SQL}
SELECT split, (shard_id * {ROWS_PER_SHARD} + row_id)::BIGINT AS index, source,
       md5({S('instruction')}) AS instruction_md5, md5('') AS input_md5,
       md5({S('response')}) AS response_md5, (n - 1)::BIGINT AS total_tokens,
       p::BIGINT AS prompt_tokens, r::BIGINT AS response_tokens FROM padded"""
)
def sft_roundtrip_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode the stored rows and parse the rendered text back into its fields."""
    padded = _padded(spark, sf_dir)

    def part(name: str) -> DataFrame:
        return analysis.analysis_table(
            padded.where(F.col("split") == name), BYTES, ROWS_PER_SHARD
        ).withColumn("split", F.lit(name))

    both = part("train").unionByName(part("val"))
    return both.select(
        "split",
        "index",
        "source",
        *[F.md5(c).alias(f"{c}_md5") for c in ("instruction", "input", "response")],
        *[F.col(c).cast("bigint").alias(c) for c in analysis.TOKEN_COLUMNS],
    )


@query(
    f"""WITH {PADDED_SQL}
SELECT ord, md5({q.prompt('instruction', 'context')}) AS prompt_md5, md5({S('response')}) AS response_md5
FROM padded"""
)
def sft_prompt_response_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode.decoded_text(_padded(spark, sf_dir), BYTES)
    return encode.prompt_and_response(decoded).select(
        "ord", F.md5("prompt_text").alias("prompt_md5"), F.md5("response_text").alias("response_md5")
    )


@query(
    f"""WITH {PADDED_SQL}
SELECT shard_id::BIGINT AS shard_id, row_id::BIGINT AS row_id, ord FROM rows
WHERE split = 'train' ORDER BY shard_id, row_id LIMIT 20"""
)
def sft_shard_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix limit of the analysis is the feature; shards are in numeric order."""
    rows = _example_rows(spark, sf_dir).where(F.col("split") == "train")
    return analysis.shard_prefix(rows, 20).select(
        F.col("shard_id").cast("bigint").alias("shard_id"),
        F.col("row_id").cast("bigint").alias("row_id"),
        "ord",
    )


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def sft_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.source_counts(_documents(spark, sf_dir))


@query("SELECT count(DISTINCT source) AS n_sources FROM documents")
def sft_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.distinct_sources(_documents(spark, sf_dir))


@query(
    f"""SELECT source, doc_id, sample_rank FROM (
  SELECT source, doc_id, row_number() OVER (
    PARTITION BY source ORDER BY md5('{fv.SAMPLE_SEED}-' || doc_id)) AS sample_rank FROM documents)
WHERE sample_rank <= {fv.SAMPLE_PER_SOURCE}"""
)
def sft_sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("source", "doc_id")
    return analysis.sample_per_source(docs, "doc_id").select(
        "source", "doc_id", F.col("sample_rank").cast("bigint").alias("sample_rank")
    )


@query(
    f"""WITH {REASONS_SQL}, kept_rows AS (SELECT source, ord FROM reasons WHERE skip_reason IS NULL),
{q.split_rows('kept_rows', ROWS_PER_SHARD)}
SELECT source, count(*) FILTER (skip_reason IS NULL) AS kept,
       count(*) FILTER (skip_reason = 'lang') AS skipped_not_english,
       count(*) FILTER (skip_reason = 'len') AS skipped_too_long_or_short,
       count(*) FILTER (skip_reason = 'fmt') AS skipped_format,
       (SELECT count(*) FROM rows WHERE split = 'train') AS train_examples,
       (SELECT count(DISTINCT shard_id) FROM rows WHERE split = 'train') AS train_shards,
       (SELECT count(*) FROM rows WHERE split = 'val') AS val_examples,
       (SELECT count(DISTINCT shard_id) FROM rows WHERE split = 'val') AS val_shards
FROM reasons GROUP BY 1"""
)
def mix_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the whole mix, written as JSON and read back."""
    reasoned = _reasoned(spark, sf_dir)
    keys = ["source", "ord"]
    kept = reasoned.where(F.col("skip_reason").isNull()).select(*keys)
    rows = split.row_shards(split.holdout_split(kept, keys), keys, rows_per_shard=ROWS_PER_SHARD)
    path = scratch_path(spark, "metadata")
    reports.write_metadata(reports.mix_metadata(filters.skip_stats(reasoned), rows), path)
    stored = reports.read_metadata(spark, path)
    return stored.select(
        F.explode("per_dataset_stats").alias("source", "stats"), "train", "val"
    ).select(
        "source",
        "stats.*",
        F.col("train.examples").alias("train_examples"),
        F.col("train.shards").alias("train_shards"),
        F.col("val.examples").alias("val_examples"),
        F.col("val.shards").alias("val_shards"),
    )


@query(
    f"""WITH {PADDED_SQL}
SELECT (shard_id * {ROWS_PER_SHARD} + row_id)::BIGINT AS index, source,
       md5({S('instruction')}) AS instruction_md5, md5({S('response')}) AS response_md5,
       (n - 1)::BIGINT AS total_tokens FROM padded WHERE split = 'train'"""
)
def analysis_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis table as CSV with multi-line fields, read back."""
    train = _padded(spark, sf_dir).where(F.col("split") == "train")
    path = scratch_path(spark, "analysis-csv")
    reports.write_analysis_csv(analysis.analysis_table(train, BYTES, ROWS_PER_SHARD), path)
    return reports.read_analysis_csv(spark, path).select(
        "index",
        "source",
        F.md5("instruction").alias("instruction_md5"),
        F.md5("response").alias("response_md5"),
        "total_tokens",
    )


@query(
    f"""WITH {REASONS_SQL},
chosen AS (
  SELECT m.source, m.ord, instruction, context, response, p, r, n,
         row_number() OVER (ORDER BY m.source, m.ord) - 1 AS idx
  FROM mix m JOIN reasons USING (source, ord) WHERE skip_reason IS NULL),
melted AS (
  SELECT 'total_tokens' AS c, (n - 1)::BIGINT AS v FROM chosen
  UNION ALL SELECT 'prompt_tokens', p FROM chosen UNION ALL SELECT 'response_tokens', r FROM chosen),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY source ORDER BY md5('{fv.SAMPLE_SEED}-' || ord || source)) AS k FROM chosen)
  WHERE k <= {fv.SAMPLE_PER_SOURCE})
SELECT 2 AS section, printf('%-20s mean=%6.1f median=%6.1f min=%4d max=%4d', c, avg(v), median(v), min(v), max(v)) AS line
FROM melted GROUP BY c
UNION ALL SELECT 3, rpad(source, 22, ' ') || ' ' || lpad(format('{{:,}}', count(*)), greatest(6, length(format('{{:,}}', count(*))))::INT, ' ') FROM chosen GROUP BY source
UNION ALL SELECT 4, '[' || source || ']  #' || ord || source || '  total=' || (n - 1) || ' tok  (prompt=' || p ||
  ' | response=' || r || ')' || chr(10) || 'INSTRUCTION:' || chr(10) || {S('instruction')} || chr(10) || chr(10) ||
  CASE WHEN {S('context')} <> '' THEN 'INPUT:' || chr(10) || {S('context')} || chr(10) || chr(10) ELSE '' END ||
  'RESPONSE:' || chr(10) || {S('response')} FROM picked"""
)
def preview_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, counts and a sample of the whole kept mix as report lines."""
    kept = _reasoned(spark, sf_dir).where(F.col("skip_reason").isNull())
    counted = filters.kept_examples(_mix(spark, sf_dir), BYTES, kept_keys=kept).select(
        F.concat(F.col("ord").cast("string"), "source").alias("index"),
        "source",
        tx.py_strip(F.col("instruction")).alias("instruction"),
        tx.strip_or_empty(F.col("context")).alias("input"),
        tx.py_strip(F.col("response")).alias("response"),
        (F.col("n_tokens") - 1).alias("total_tokens"),
        F.col("prompt_len").alias("prompt_tokens"),
        F.col("response_len").alias("response_tokens"),
    )
    table_ = materialise(counted, "preview-table")
    return reports.preview_lines(table_).select("section", "line")


# ---------------------------------------------------------------------------------------
# The whole preparation as one job, over all sources: filter with language, cap, split, shards
# written and read back, metadata with the values used, and the report of the stored folder.

MIX_CAP = 40
PREPARED_SQL = f"""{REASONS_SQL},
ranked AS (
  SELECT *, coalesce(sum((skip_reason IS NULL)::INT) OVER (
        PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM reasons),
capped AS (SELECT * FROM ranked WHERE before < {MIX_CAP}),
counters AS (
  SELECT source, count(*) FILTER (skip_reason IS NULL) AS kept,
         count(*) FILTER (skip_reason = 'lang') AS skipped_not_english,
         count(*) FILTER (skip_reason = 'len') AS skipped_too_long_or_short,
         count(*) FILTER (skip_reason = 'fmt') AS skipped_format FROM capped GROUP BY 1),
kept_rows AS (
  SELECT source, ord, instruction, context, response, p, r, n
  FROM mix JOIN capped USING (source, ord) WHERE skip_reason IS NULL),
{q.split_rows('kept_rows', ROWS_PER_SHARD)},
sizes AS (
  SELECT count(*) FILTER (split = 'train') AS train_examples,
         count(DISTINCT shard_id) FILTER (split = 'train') AS train_shards,
         count(*) FILTER (split = 'val') AS val_examples,
         count(DISTINCT shard_id) FILTER (split = 'val') AS val_shards FROM rows)"""


def _prepared(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "prepared-mix")
    prepare.prepare_mix(
        materialise(_mix(spark, sf_dir), "mix"), BYTES, path,
        profile=langid.train_profile(_documents(spark, sf_dir)),
        cap=MIX_CAP, rows_per_shard=ROWS_PER_SHARD,
    )
    return path


@query(
    f"""WITH {PREPARED_SQL}
SELECT split, shard_id::BIGINT AS shard_id, row_id::BIGINT AS row_id, rows.source,
       p::BIGINT AS prompt_len, n::BIGINT AS n_tokens, r::BIGINT AS n_masked,
       {q.md5_list(f"[x FOR x IN {q.byte_list(q.prompt('instruction', 'context'))}] || {q.byte_list(S('response'))} || [256]")} AS tokens_md5,
       kept, skipped_not_english, skipped_too_long_or_short, skipped_format,
       {ROWS_PER_SHARD} AS shard_size, {fv.SEQUENCE_TOKENS} AS sequence_length, sizes.*
FROM rows JOIN counters ON counters.source = rows.source, sizes"""
)
def sft_prepare_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored row with what the stored metadata says of its source and of the whole.

    The cap per source is the feature.
    """
    path = _prepared(spark, sf_dir)
    metadata = prepare.prepared_metadata(spark, path)
    described = metadata.select(
        F.explode("per_dataset_stats").alias("source", "stats"),
        "shard_size", "sequence_length", "train", "val",
    ).select(
        "source", "stats.*", "shard_size", "sequence_length",
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("train", "val") for c in ("examples", "shards")],
    )
    stored = prepare.prepared_examples(spark, path).select(
        "split", "source",
        *[F.col(c).cast("bigint").alias(c) for c in ("shard_id", "row_id", "prompt_len", "n_tokens")],
        F.size(F.filter("mask", lambda m: m == 1)).cast("bigint").alias("n_masked"),
        digest(F.col("tokens")).alias("tokens_md5"),
    )
    # One row for each registered source.
    return stored.join(F.broadcast(described), "source")


@query(
    f"""WITH {PREPARED_SQL},
chosen AS (SELECT *, shard_id * {ROWS_PER_SHARD} + row_id AS idx FROM rows),
melted AS (
  SELECT split, 'total_tokens' AS c, (n - 1)::BIGINT AS v FROM chosen
  UNION ALL SELECT split, 'prompt_tokens', p FROM chosen
  UNION ALL SELECT split, 'response_tokens', r FROM chosen),
by_source AS (SELECT split, source, count(*) AS k, count(*) OVER (PARTITION BY split) AS n_sources
              FROM chosen GROUP BY 1, 2),
picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY split, source ORDER BY md5('{fv.SAMPLE_SEED}-' || idx)) AS k FROM chosen)
  WHERE k <= {fv.SAMPLE_PER_SOURCE})
SELECT 0 AS section, '' AS split, unnest([
    'Block size       : {fv.WINDOW_TOKENS}', 'Sequence length  : {fv.SEQUENCE_TOKENS}',
    'Shard size       : {ROWS_PER_SHARD}', 'Min response tok : {fv.MIN_RESPONSE_TOKENS}',
    'Train examples   : ' || train_examples || '  (' || train_shards || ' shards)',
    'Val examples     : ' || val_examples || '  (' || val_shards || ' shards)']) AS line FROM sizes
UNION ALL SELECT 1, '', rpad(source, 22, ' ') || ' ' || lpad(format('{{:,}}', kept), 7, ' ') || ' ' ||
  lpad(format('{{:,}}', skipped_not_english), 10, ' ') || ' ' || lpad(format('{{:,}}', skipped_too_long_or_short), 10, ' ')
FROM counters
UNION ALL SELECT 2, split, printf('%-20s mean=%6.1f median=%6.1f min=%4d max=%4d', c, avg(v), median(v), min(v), max(v))
FROM melted GROUP BY split, c
UNION ALL SELECT 3, split, rpad(source, 22, ' ') || ' ' || lpad(format('{{:,}}', k), 6, ' ') FROM by_source WHERE n_sources > 1
UNION ALL SELECT 4, split, '[' || source || ']  #' || idx || '  total=' || (n - 1) || ' tok  (prompt=' || p ||
  ' | response=' || r || ')' || chr(10) || 'INSTRUCTION:' || chr(10) || {S('instruction')} || chr(10) || chr(10) ||
  CASE WHEN {S('context')} <> '' THEN 'INPUT:' || chr(10) || {S('context')} || chr(10) || chr(10) ELSE '' END ||
  'RESPONSE:' || chr(10) || {S('response')} FROM picked"""
)
def sft_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a prepared folder, from its stored rows and metadata alone."""
    report = prepare.prepared_report(spark, BYTES, _prepared(spark, sf_dir))
    return report.select("section", "split", "line")

"""The registered queries of this package and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import align, chat, decontaminate, html_blocks, langid, licenses, lm_score, merkle, minhash, packing, spotsigs, token_counts, url_filter
from cohortloom.llm.common import ship, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(run)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]
#: Stands for a published list of hosts, which the tables do not have: those with one of these words between dots and dashes.
LISTED = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), RULES, F.col("host").rlike(LISTED), written)


@query
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, folder, "documents"), TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), TOKENIZER)


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), written)


@query
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), written)


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, folder, "documents"))


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text")
    )
    return chat.digests(chat.formatted_turns(both.unionByName(tricky)))


@query
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score(table(spark, folder, "documents"), wanted, written)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learned_profiles(docs: DataFrame) -> langid.Profiles:
    return langid.learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict(docs, learned_profiles(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_blocks.main_texts(pages, html_blocks.learn(pages))


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.scored(table(spark, folder, "documents"), TOKENIZER, PIECES, written)


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.verified_manifest(table(spark, folder, "documents"), written, broken)


SQL["op1_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') AS listed
  FROM parts
)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def _license_sql(least: float = 0.9) -> str:
    templates = sorted({(name, tuple(sorted(licenses.bigrams(text)))) for name, some in licenses.TEMPLATES.items() for text in some})
    values = ",\n    ".join(f"({k}, '{name}', {len(grams)}, [{', '.join(repr(g) for g in grams)}])" for k, (name, grams) in enumerate(templates))
    return rf"""
WITH templates(t, license, m, grams) AS (VALUES
    {values}
), flat AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS piece FROM flat
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(list_filter(regexp_split_to_array(text, '\n(?: *\n)+'), lambda x: contains(trim(x, chr(10) || ' '), chr(10)))) FROM flat
), words AS (
  SELECT row_number() OVER () AS p, doc_id, kind, string_split(trim(regexp_replace(piece, ' *\n *', ' ', 'g')), ' ') AS words FROM pieces
), grams AS (
  SELECT DISTINCT p, doc_id, kind, words[k] || ' ' || words[k + 1] AS gram
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM words WHERE len(words) > 1)
), sizes AS (
  SELECT p, count(*) AS n FROM grams GROUP BY p
), common AS (
  SELECT p, any_value(doc_id) AS doc_id, any_value(kind) AS kind, t, any_value(license) AS license, any_value(m) AS m, count(*) AS c
  FROM grams JOIN (SELECT t, license, m, unnest(grams) AS gram FROM templates) USING (gram) GROUP BY p, t
)
SELECT doc_id, license, round(max(2.0 * c / (n + m)), 9) AS dice,
       count(*) FILTER (kind = 'line') AS n_lines, count(*) FILTER (kind = 'paragraph') AS n_paragraphs
FROM common JOIN sizes USING (p) WHERE 2.0 * c / (n + m) >= {least} GROUP BY doc_id, license
"""


SQL["op2_licenses"] = _license_sql()

SQL["op6_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s
  FROM words
), grams AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sets x ON x.doc_id = a.doc_id JOIN sets y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, len(x.s), len(y.s) HAVING 100 * count(*) >= 75 * (len(x.s) + len(y.s) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""

SQL["op8_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), formatted AS (
  SELECT *, '### ' || upper(role[1]) || role[2:] || ': ' || regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10) AS formatted
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree over `leaves` (g, p, h, n): `name`0, `name`1, ... have each level's nodes with what stands left and right in their runs."""
    run = "PARTITION BY g, p // 3 ORDER BY p"
    sides = f"coalesce(lag(h, 2) OVER ({run}), '') || coalesce(lag(h) OVER ({run}), '') AS l, coalesce(lead(h) OVER ({run}), '') || coalesce(lead(h, 2) OVER ({run}), '') AS r"
    parts = [f"{name}0 AS MATERIALIZED (SELECT g, p, h, n, {sides} FROM {leaves})"]
    for k in range(levels):
        up = f"SELECT g, p // 3 AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h, (n + 2) // 3 AS n FROM {name}{k} GROUP BY g, p // 3, n"
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, {sides} FROM ({up}))")
    return ",\n".join(parts)


def _walk_sql(name: str, start: str, levels: int, place: str) -> str:
    """CTEs that carry `start` (doc_id, g, p, f, siblings, ...) up the tree `name`: f is folded, siblings are collected."""
    parts = []
    for k in range(levels):
        parts.append(
            f"{place}{k} AS MATERIALIZED (SELECT w.* REPLACE (w.p // 3 AS p, CASE WHEN t.n > 1 THEN sha256(t.l || f || t.r) ELSE f END AS f, siblings || t.l || t.r AS siblings) "
            f"FROM {start if k == 0 else f'{place}{k - 1}'} w JOIN {name}{k} t ON w.g IS NOT DISTINCT FROM t.g AND w.p = t.p)"
        )
    return ",\n".join(parts)


def _merkle_sql(levels: int = 16) -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # CRC-32 bit by bit: each byte of the decimal number, then eight steps
    crc = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    return f"""
WITH crcs AS (
  SELECT *, xor({crc}, 4294967295) AS crc FROM documents
), texts AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM crcs
), leaves AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("changed")} AS changed_leaf FROM texts
), leaf_nodes AS MATERIALIZED (
  SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY source) AS n, changed_leaf FROM leaves
),
{_tree_sql("d", "leaf_nodes", levels)},
group_nodes AS MATERIALIZED (
  SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, h, count(*) OVER () AS n, g AS source FROM d{levels}
),
{_tree_sql("s", "group_nodes", levels)},
walked AS (
  SELECT doc_id, g, p, changed_leaf AS f, '' AS siblings, h AS leaf FROM leaf_nodes
),
{_walk_sql("d", "walked", levels, "w")},
above AS (
  SELECT w.doc_id, 0 AS g, n.p, w.f, w.siblings, w.leaf, n.h AS subroot FROM w{levels - 1} w JOIN group_nodes n ON w.g IS NOT DISTINCT FROM n.source
),
{_walk_sql("s", "above", levels, "v")}
SELECT doc_id, leaf, subroot, (SELECT h FROM s{levels}) AS root, sha256(siblings) AS proof_sha256, f AS folded_root, f = (SELECT h FROM s{levels}) AS verified
FROM v{levels - 1}
"""


SQL["op13_merkle_manifest"] = _merkle_sql()

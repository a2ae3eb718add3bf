"""Queries of the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageledger.llm import chat_format, decontamination, hpylm, licences, merkle, near, packing, passages, quality_rules, role_repair, token_files, tokens, warc
from pageledger.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op3_licence_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_ids(token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"), n=3, percent=85)


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.with_components(passages.repeated_passages(table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
    SELECT *, len(w) AS n, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
), r AS (
    SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM g
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM r) WHERE c > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS c FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), f AS (
    SELECT g.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(c, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS lo
    FROM g LEFT JOIN covered USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words OR 100 * up > 60 * (up + lo)) AS kept
FROM b
"""


@query("op6_quality_cascade", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.judged(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_template_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_length_buckets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
    SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS chosen FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN chosen <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN chosen <> page_id THEN chosen END AS refers_to
FROM r
"""


@query("op1_warc_records", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


@query("op10_pitman_yor_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scores(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {bits}), 4294967295)"


def _edit(top: str, cost: str, letters: str, *turns: str) -> str:
    out = f"{top}.o"
    for t in turns:
        out = f"list_append({out}, {t})"
    return f"{{'c': {top}.c + {cost}, 'a': {top}.a || '{letters}', 'o': {out}}}"


def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


_USER, _ASSISTANT = "'user:'", "'assistant:'"
#: Tops z (nothing yet), s (system), u (user), t (whole pairs) after inserted turns, and after the row as well.
_FILLED = f"""z, s, {_least("u", *(_edit(x, "2", "I", _USER) for x in "zst"))} AS u,
    {_least("t", _edit("u", "2", "I", _ASSISTANT), *(_edit(x, "4", "II", _USER, _ASSISTANT) for x in "zs"))} AS t"""
_NONE = "{'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"


def _kept(initial: str, tops: str) -> list[str]:
    return [f"CASE WHEN initial = '{initial}' AND NOT gone THEN {_edit(x, 'extra', 'K', 'own')} ELSE {_NONE} END" for x in tops]


def _cast(role: str, tops: str) -> list[str]:
    turn = f"'{role}:' || text"
    return [f"CASE WHEN NOT gone THEN {_edit(x, '2 + extra', 'R', turn)} ELSE {_NONE} END" for x in tops]


OP11_SQL = rf"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations
), rows AS (
    SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM k WHERE d <> 0
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows)
), f AS (
    SELECT *, left(role, 1) AS initial, role || ':' || text AS own,
        CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault
    FROM n
), g AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 1 ELSE 0 END AS extra FROM f
), w AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS z, {_NONE} AS s, {_NONE} AS u, {_NONE} AS t FROM conversations
    UNION ALL
    SELECT conv_id, n, {_edit("z", "3", "D")}, {_least(_edit("s", "3", "D"), *_kept("s", "z"))}, {_least(_edit("u", "3", "D"), *_kept("u", "zst"), *_cast("user", "zst"))},
        {_least(_edit("t", "3", "D"), *_kept("a", "u"), *_cast("assistant", "u"))}
    FROM (SELECT g.conv_id, g.n, g.initial, g.own, g.text, g.gone, g.extra, {_FILLED} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.n + 1)
), e AS (
    SELECT conv_id, {_least("z", "t")} AS best FROM (SELECT conv_id, {_FILLED} FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1))
), p AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM g
), c AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM p GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op11_role_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))


def _levels_sql(name: str, first: str) -> str:
    """All nodes of trees whose leaves are (tree, i, h, n)."""
    return f"""{name} AS (
    SELECT tree, 0 AS lvl, i, h, n FROM {first}
    UNION ALL
    SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lvl, i // 3, n
)"""


OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT *, coalesce('1' || source, '0') AS tree, sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '1')")} % 2 = 0 AND doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS told
    FROM documents
), l AS (
    SELECT *, sha256({_FIELDS} || coalesce(strlen(told) || ':' || told, '-')) AS changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
    FROM d
), base AS (SELECT tree, i, leaf AS h, n FROM l
), {_levels_sql("low", "base")}, sub AS (
    SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), tops AS (SELECT 0 AS tree, i, h, n FROM sub
), {_levels_sql("high", "tops")}, mine AS (
    SELECT l.tree, l.i, v.lvl, l.i // (3 ** v.lvl)::BIGINT AS p FROM l JOIN (SELECT DISTINCT tree, lvl FROM low WHERE n > 1) v USING (tree)
), theirs AS (
    SELECT s.tree, v.lvl, s.i // (3 ** v.lvl)::BIGINT AS p FROM sub s, (SELECT DISTINCT lvl FROM high WHERE n > 1) v
), steps AS (
    SELECT m.tree, m.i, m.lvl, string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < m.p) AS bef, string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > m.p) AS aft
    FROM mine m JOIN low x ON x.tree = m.tree AND x.lvl = m.lvl AND x.i // 3 = m.p // 3 GROUP BY ALL
    UNION ALL
    SELECT l.tree, l.i, 1000 + t.lvl, string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < t.p), string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > t.p)
    FROM l JOIN theirs t ON t.tree = l.tree JOIN high x ON x.lvl = t.lvl AND x.i // 3 = t.p // 3 GROUP BY l.tree, l.i, t.lvl
), path AS (SELECT tree, i, coalesce(bef, '') AS bef, coalesce(aft, '') AS aft, row_number() OVER (PARTITION BY tree, i ORDER BY lvl) AS k FROM steps
), proof AS (SELECT tree, i, string_agg(bef || aft, '' ORDER BY k) AS siblings FROM path GROUP BY tree, i
), fold AS (
    SELECT tree, i, changed AS h, 0::BIGINT AS k FROM l
    UNION ALL
    SELECT f.tree, f.i, sha256(p.bef || f.h || p.aft), p.k FROM fold f JOIN path p ON p.tree = f.tree AND p.i = f.i AND p.k = f.k + 1
), ends AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY tree, i ORDER BY k DESC) = 1
), root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM l JOIN ends e ON e.tree = l.tree AND e.i = l.i JOIN sub ON sub.tree = l.tree LEFT JOIN proof p ON p.tree = l.tree AND p.i = l.i, root
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


_MARK = "|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in chat_format.ALL_MARKS)
_ESCAPED = f"length(t) + len(regexp_extract_all(t, '{_MARK}'))"
OP13_SQL = f"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, {_ESCAPED} + CASE role {" ".join(f"WHEN '{r}' THEN {len(a + b)}" for r, (a, b) in chat_format.MARKS.items())}
        ELSE {len(chat_format.NAMED + chat_format.NAMED_TEXT + chat_format.NAMED_END)} + length(role) + len(regexp_extract_all(role, '{_MARK}')) END AS chars
    FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op13_chat_format", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_conversations(spark, table(spark, sf_dir, "conversations"))

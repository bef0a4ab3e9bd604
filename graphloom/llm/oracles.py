"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from graphloom.llm.chat import CONTROL, END, LEARNED_ROLE, TEXT, TURN
from graphloom.llm.lines import MIN_CHARS, MIN_DOCUMENTS
from graphloom.llm.mixing import FILLS, MOST_COPIES, WEIGHTS

WORD = r"[^\x20\x09-\x0D]+"


def line_ctes(docs: str) -> str:
    """CTEs over ``docs`` (doc_id, text) up to ``line_rows``: its rows with n (row number), n_lines, n_dropped and kept."""
    strip = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
    return f"""
line_docs AS (SELECT *, row_number() OVER () AS n, coalesce(doc_id, -9223372036854775808) AS id FROM {docs}),
line_split AS (SELECT n, id, string_split(coalesce(text, ''), chr(10)) AS lines FROM line_docs),
line_each AS (SELECT n, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM line_split),
line_keys AS (
  SELECT n, id, line, pos, translate(regexp_replace(line, {strip}, '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line_each),
line_found AS (
  SELECT key, max(id) AS keeper FROM (SELECT DISTINCT n, id, key FROM line_keys WHERE length(key) >= {MIN_CHARS})
  GROUP BY key HAVING count(*) >= {MIN_DOCUMENTS}),
line_marks AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.id AS gone FROM line_keys k LEFT JOIN line_found f ON f.key = k.key),
line_kept AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM line_marks GROUP BY n),
line_rows AS (SELECT d.*, k.n_lines, k.n_dropped, k.kept FROM line_docs d JOIN line_kept k USING (n))""".lstrip()


LINES_SQL = f"WITH {line_ctes('documents')}\nSELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM line_rows"


def mix_ctes(docs: str) -> str:
    """CTEs over the relation ``docs`` (doc_id, text, source) up to ``mix_rows``: its rows with n (row number), size, source_size, target and copies."""
    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    out = f"""
mix_sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce(doc_id, -9223372036854775808) AS key, row_number() OVER () AS n FROM {docs}),
mix_u AS (
  SELECT *, ((('0x' || substr(md5('mix-' || key::VARCHAR || '-' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM mix_sized),
mix_ranked AS (
  SELECT *, u / (1 - u) / ((size + 1)::DOUBLE / (size + 51)::DOUBLE) AS v FROM mix_u),
mix_per0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_ranked GROUP BY source),
mix_per1 AS (
  SELECT *, {weights}[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, source_size * {MOST_COPIES} AS cap FROM mix_per0),
mix_per2 AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w,
         coalesce(sum(cap) OVER ratio, 0) AS cap_before, coalesce(sum(w) OVER ratio, 0) AS w_before
  FROM mix_per1 WINDOW ratio AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_per3 AS (SELECT *, cap * (total_w - w_before) <= w * (total - cap_before) AS capped FROM mix_per2),
mix_per4 AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE
         / (total_w - coalesce(sum(w) FILTER (capped) OVER (), 0))::DOUBLE END AS target FROM mix_per3),
mix_per5 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM mix_per4),
mix_per AS (SELECT *, floor(target - whole * source_size)::BIGINT AS room FROM mix_per5),
mix_left0 AS (SELECT r.*, p.source_size, p.target, p.whole, p.room FROM mix_ranked r JOIN mix_per p ON r.source IS NOT DISTINCT FROM p.source)"""
    for k in range(FILLS):
        out += f""",
mix_cum{k} AS (
  SELECT *, size > 0 AND size <= room AND sum(CASE WHEN size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, key, size, n) <= room AS yes FROM mix_left{k}),
mix_took{k} AS (SELECT * FROM mix_cum{k} WHERE yes),
mix_words{k} AS (SELECT source, sum(size)::BIGINT AS words FROM mix_took{k} GROUP BY source),
mix_left{k + 1} AS (
  SELECT c.* EXCLUDE (yes, room), c.room - coalesce(m.words, 0) AS room FROM mix_cum{k} c LEFT JOIN mix_words{k} m ON c.source IS NOT DISTINCT FROM m.source WHERE NOT c.yes)"""
    took = " UNION ALL ".join(f"SELECT n, 1 AS more FROM mix_took{k}" for k in range(FILLS))
    return out.lstrip() + f""",
mix_more AS ({took}),
mix_rows AS (SELECT l.* EXCLUDE (room, whole), l.whole + coalesce(m.more, 0) AS copies FROM mix_left0 l LEFT JOIN mix_more m USING (n))"""


MIX_SQL = f"WITH {mix_ctes('documents')}\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM mix_rows"

_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(" + CONTROL + r")', '\1\\\2\3', 'g')"
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
pieces AS (SELECT *, {len(TURN) + len(TEXT) + len(END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id"""

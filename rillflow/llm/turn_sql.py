"""DuckDB SQL of the queries over conversations."""

from __future__ import annotations

BLANK = "[^\\x20\\x09-\\x0D]"

#: crc32 of an ASCII string: the table by its rule, then a fold over the characters.
CRC32 = """
steps AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
          UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS entries FROM steps WHERE k = 8)"""

CRC32_OF_KEY = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
              lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1])), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE {CRC32},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
fated AS (SELECT given.*, {CRC32_OF_KEY} % 20 AS fate FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
-- What each row may do: the states are 0 nothing, 1 system, 2 user, 3 assistant; 99999 stands for what isn't allowed.
moves AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 99999 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay,
         initial = 's' AS s, initial = 'u' AS u, initial = 'a' AS a FROM judged),
back AS (
  SELECT conv_id, n + 1 AS i, 0::BIGINT AS f0, 6::BIGINT AS f1, 3::BIGINT AS f2, 0::BIGINT AS f3 FROM facts
  UNION ALL
  SELECT conv_id, i, least(b0, b2 + 3, b3 + 6), least(b1, b2 + 3, b3 + 6), least(b2, b3 + 3, b2 + 6), least(b3, b2 + 3, b3 + 6)
  FROM (SELECT m.conv_id, m.i,
               least(f0 + 4, f2 + 3 + stay, CASE WHEN s THEN f1 + stay WHEN u THEN f2 + stay ELSE 99999 END) AS b0,
               least(f1 + 4, f2 + 3 + stay, CASE WHEN u THEN f2 + stay ELSE 99999 END) AS b1,
               least(f2 + 4, f3 + 3 + stay, CASE WHEN a THEN f3 + stay ELSE 99999 END) AS b2,
               least(f3 + 4, f2 + 3 + stay, CASE WHEN u THEN f2 + stay ELSE 99999 END) AS b3
        FROM back JOIN moves m ON m.conv_id = back.conv_id AND m.i = back.i - 1)),
costs AS (SELECT conv_id, i, [f0, f1, f2, f3] AS f FROM back),
-- One edit a step: the first in ASCII order of D, I, K and R that stays on a cheapest way.
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS turns, false AS done FROM facts
  UNION ALL
  SELECT conv_id, CASE WHEN edit IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
         CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept WHEN '' THEN q ELSE forced END, audit || edit,
         CASE edit WHEN 'K' THEN list_append(turns, role || ':' || text) WHEN 'R' THEN list_append(turns, forced_role || ':' || text)
                   WHEN 'I' THEN list_append(turns, forced_role || ':') ELSE turns END, edit = ''
  FROM (SELECT w.*, role, text, kept, forced, CASE forced WHEN 2 THEN 'user' ELSE 'assistant' END AS forced_role,
               CASE WHEN stay IS NOT NULL AND here.f[q + 1] = next.f[q + 1] + 4 THEN 'D'
                    WHEN here.f[q + 1] = here.f[forced + 1] + 3 THEN 'I'
                    WHEN kept IS NOT NULL AND here.f[q + 1] = next.f[kept + 1] + stay THEN 'K'
                    WHEN stay IS NOT NULL AND here.f[q + 1] = next.f[forced + 1] + 3 + stay THEN 'R' ELSE '' END AS edit
        FROM (SELECT walk.*, CASE q WHEN 2 THEN 3 ELSE 2 END AS forced, role, text, stay,
                     CASE WHEN s AND q = 0 THEN 1 WHEN u AND q <> 2 THEN 2 WHEN a AND q = 2 THEN 3 END AS kept
              FROM walk LEFT JOIN moves ON walk.conv_id = moves.conv_id AND walk.i = moves.i WHERE NOT done) w
        JOIN costs here ON here.conv_id = w.conv_id AND here.i = w.i
        LEFT JOIN costs next ON next.conv_id = w.conv_id AND next.i = w.i + 1)),
repaired AS (
  SELECT w.conv_id, audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256, f[1] AS cost
  FROM walk w JOIN costs c ON c.conv_id = w.conv_id AND c.i = 1 WHERE done)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN facts USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

#: Fixed values of the chat template: characters of opener and closer of a turn, and its control strings.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]")


def _escapes(column: str) -> str:
    """SQL for the number of escapes that a content needs."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))


OP13_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
turns AS (
  SELECT *, length(text) + {_escapes("text")}
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                        ELSE 19 + length(role) + {_escapes("role")} END AS chars
  FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

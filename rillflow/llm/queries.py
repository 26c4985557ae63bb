"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.llm.ann import nearest
from rillflow.llm.arrow_tokens import token_store
from rillflow.llm.bagminhash import near_duplicates
from rillflow.llm.chat_format import digests, format_chats
from rillflow.llm.collocations import collocations
from rillflow.llm.html_consensus import extract_articles
from rillflow.llm.line_runs import LOWER, UPPER, dedup_lines
from rillflow.llm.packing import pack_documents
from rillflow.llm.storage import written
from rillflow.llm.substring import dedup_substrings
from rillflow.llm.tiling import benchmark_matches
from rillflow.llm.toxicity import toxicity
from rillflow.llm.turn_repair import repair_damaged
from rillflow.llm.turn_sql import OP11_SQL, OP13_SQL
from rillflow.llm.url_cascade import judge_urls


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_multiprobe(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_bagminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op4_tiling(spark, sf_dir):
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), coverage=0.8, min_match=5)


def op5_tokens(spark, sf_dir):
    rows = token_store(table(spark, sf_dir, "documents"), tokenizer_file())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark, sf_dir):
    rows = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), length=2048)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_cascade(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
best AS (
  SELECT page_id, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (page_id)
"""


def op7_substrings(spark, sf_dir):
    rows = dedup_substrings(table(spark, sf_dir, "documents"), width=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS pos FROM split WHERE len(w) >= 13),
windows AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 13], ' ') AS win FROM starts),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win HAVING count(*) > 1),
doomed AS (SELECT doc_id, pos FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id),
removed AS (SELECT DISTINCT doc_id, pos + k AS pos FROM (SELECT doc_id, pos, unnest(range(13)) AS k FROM doomed)),
judged AS (SELECT words.*, removed.pos IS NOT NULL AS gone FROM words LEFT JOIN removed ON words.doc_id = removed.doc_id AND words.pos = removed.pos),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept_text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op8_line_runs(spark, sf_dir):
    rows = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_length=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
judged AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def op9_consensus(spark, sf_dir):
    return extract_articles(table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_turn_repair(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM candidates c, range(1, 4) t(cut)
  JOIN counts l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(w[cut + 1 :], ' ')
  WHERE cut < c.k),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a AS longer, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM candidates, range(2, 4) t(n), range(1, 4) s(i) WHERE n < k AND i + n - 1 <= k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest LEFT JOIN held USING (lang, phrase) JOIN total USING (lang)
WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a
QUALIFY rank <= 2000
"""


def op13_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    return digests(written(format_chats(given.unionByName(more)), "chats"))


QUERIES = {
    "op1_url_cascade": op1_url_cascade,
    "op2_multiprobe": op2_multiprobe,
    "op3_bagminhash": op3_bagminhash,
    "op4_tiling": op4_tiling,
    "op5_tokens": op5_tokens,
    "op6_packing": op6_packing,
    "op7_substrings": op7_substrings,
    "op8_line_runs": op8_line_runs,
    "op9_consensus": op9_consensus,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_collocations": op12_collocations,
    "op13_chat_format": op13_chat_format,
}
SQL = {"op1_url_cascade": OP1_SQL, "op7_substrings": OP7_SQL, "op8_line_runs": OP8_SQL, "op11_turn_repair": OP11_SQL, "op12_collocations": OP12_SQL, "op13_chat_format": OP13_SQL}

"""The queries of the corpus operators, and their SQL where SQL can express them.

The others have none, and are tested against brute force, the public tokenizers, round trips or held-out accuracy
instead: op1 (edit distance of windows), op2 and op10 (tokenizers), op4 (compressed sizes), op5 (random draws; its law
is tested), op7 (places and decoding of matches), op8 (every 400-byte window of the corpus), op9 (patterns with
look-ahead), op11 (all pairs of words, crc32), op12 (hashes of shingles), op13 (all periods of all texts).
"""

from __future__ import annotations

from posewright.llm.bpe import op2_bpe
from posewright.llm.decontaminate import op1_decontaminate
from posewright.llm.jaccard_join import op3_jaccard_join
from posewright.llm.licenses import op9_licenses
from posewright.llm.periodic_runs import op13_periodic_runs
from posewright.llm.quality_classifier import op4_quality_classifier
from posewright.llm.quality_rules import op6_quality_rules
from posewright.llm.secrets import op7_secrets
from posewright.llm.sharding import op5_sharding
from posewright.llm.simhash import op12_simhash
from posewright.llm.spelling import op11_spelling_variants
from posewright.llm.suffix_dedup import op8_suffix_dedup
from posewright.llm.token_counts import op10_token_counts

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sharding": op5_sharding,
    "op6_quality_rules": op6_quality_rules,
    "op7_secrets": op7_secrets,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash": op12_simhash,
    "op13_periodic_runs": op13_periodic_runs,
}
#: All pairs and their closure: for small tables only.
OP3_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
  near(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM near JOIN links ON a = node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(near.c) AS component_id FROM documents d JOIN near ON near.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
OP6_SQL = """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
  c AS (SELECT d.doc_id, d.source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len([s FOR s IN string_split(text, chr(10)) IF regexp_matches(s, '[^\\x20\\x09-\\x0D]')]) - len(list_distinct([s FOR s IN string_split(text, chr(10)) IF regexp_matches(s, '[^\\x20\\x09-\\x0D]')])) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
  h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_words) AS bad FROM f GROUP BY source),
  p AS (SELECT sum(bad) / sum(n) AS m, sum(n * (bad / n) * (bad / n)) AS q, sum(n) AS t, count(*) AS k FROM h),
  s AS (SELECT m, m * (1 - m) AS chance, greatest(q / t - m * m - m * (1 - m) * k / t, 0) AS spread FROM p),
  b AS (SELECT m, CASE WHEN chance <= 0 OR spread <= chance / 1e6::DOUBLE THEN 1e6::DOUBLE ELSE greatest(chance / spread - 1, 1) END AS strength FROM s),
  v AS (SELECT source, (bad + m * strength) / (n + strength) AS rate FROM h, b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, round(rate, 9) AS host_rate FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
ORACLES: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op6_quality_rules": OP6_SQL}

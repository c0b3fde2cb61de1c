"""The registered queries of the training-data operators."""

from __future__ import annotations

from txgraph.llm import bpe, chat_format, conversation_trie, decontaminate, language_id, licenses, near_duplicates, phrases, quality_classifier, quality_rules, secrets, token_counts, warc
from txgraph.llm.common import read_table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op2_license_scans(spark, sf_dir):
    return licenses.license_summary(licenses.license_matches(read_table(spark, sf_dir, "documents")))


def op3_minhash_near_dedup(spark, sf_dir):
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


def op4_bpe_round_trip(spark, sf_dir):
    return bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language_id.predict_language(read_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark, sf_dir):
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.with_digest(found).drop("matches")


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), min_chars=quality_rules.MIN_CHARS, max_longest=quality_rules.MAX_LONGEST_CHARS)


def op9_warc(spark, sf_dir):
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_chat_format(spark, sf_dir):
    """Formatted whole, then read back from the formatted rows (text, offsets and mask)."""
    rows = chat_format.format_conversations(chat_format.with_probe(read_table(spark, sf_dir, "conversations")))
    return chat_format.read_back(rows, in_order=True)


def op12_phrase_collocations(spark, sf_dir):
    return phrases.phrases(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_license_scans, op3_minhash_near_dedup, op4_bpe_round_trip, op5_language_id, op6_secret_scans, op7_benchmark_decontamination,
    op8_quality_rules, op9_warc, op10_quality_classifier, op11_chat_format, op12_phrase_collocations, op13_conversation_trie)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, least(i + 3, len(ws))) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    "op7_benchmark_decontamination": rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(ws, i, least(i + 9, len(ws))) AS g FROM (
    SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
occ AS (
  SELECT doc_id, i, k, item_id FROM (
    SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS g FROM (
      SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, sizes WHERE len(ws) >= k)) JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, d, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM m""",
}

_CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>", "<|endoftext|>")


def _escaped(col: str) -> str:
    out = f"replace({col}, chr(92), chr(92) || chr(92))"
    for c in _CONTROLS:  # none can begin inside another
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


SQL["op11_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) x(i)),
f AS (
  SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + length({_escaped('role')}) END AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(m) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

SQL["op12_phrase_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 5) AS x(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30),
cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(ws, 1, j), ' ') AS head, array_to_string(list_slice(ws, j + 1, k), ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cuts.lang, k, phrase, a, j, l.l, r.r, (2000000 * a) // (l.l + r.r) AS score
  FROM cuts JOIN (SELECT lang, phrase AS head, a AS l FROM f) l USING (lang, head) JOIN (SELECT lang, phrase AS tail, a AS r FROM f) r USING (lang, tail)),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS b FROM (
    SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS y(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE inside.b IS NULL OR 100 * inside.b < 80 * low.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM best JOIN tot USING (lang) WHERE rank <= 2000"""

SQL["op13_conversation_trie"] = """
WITH t AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(s ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
    lambda k: CAST(ascii(substr(CAST(conv_id AS VARCHAR), k, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM own),
built AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
pre AS (SELECT conv_id, d, list_slice(turns, 1, d) AS p, len(turns) AS n FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends,
    (count(*) - 1) * coalesce(octet_length(encode(p[d].text)), 0) AS saved FROM pre GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
flat AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
up AS (SELECT list_slice(p, 1, e) AS p, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM flat)),
sums AS (SELECT p, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY p)
SELECT flat.conv_id, CAST(flat.d AS BIGINT) AS depth, par.conv_id AS parent_conv_id, flat.n_convs, flat.n_children, n_leaves, saved_tokens, sha256(flat.ends) AS ends_sha256
FROM flat JOIN sums USING (p) LEFT JOIN node par ON flat.d > 0 AND par.d = flat.d - 1 AND par.p = list_slice(flat.p, 1, flat.d - 1)"""


def with_pipeline() -> dict:
    """The queries and the corpus pipeline."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}

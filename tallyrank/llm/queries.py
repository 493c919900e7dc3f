"""Registered corpus queries and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import compression_classifier, conversation_repair, decontaminate, filter_audit, line_dedup, minhash, ngram_join, pii, quality_rules, secrets, sentencepiece_sampling, token_store, warc
from .common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the driver, from where it is sent to the executors; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.report(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op7_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
c AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, t, ln, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '![\x20\x09-\x0D]|!\z|!!')) AS bangs,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words
            OR 2 * (len(ln) - len(list_distinct(ln))) > len(ln) OR 2 * bangs > n_words OR 10 * same > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""


def _sql_spans(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """Spans of one kind as rows (doc_id, rank, kind, s, e, v)."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
    SELECT doc_id, hits[i] AS v,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS hits, string_split_regex(t, '{quoted}') AS gaps FROM d)))
  WHERE {keep}"""


_VALUE = "length(regexp_extract(v, '" + secrets.ASSIGN.replace("'", "''") + "', 1)) >= 6"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_sql_spans("assign", 0, secrets.ASSIGN, _VALUE)}
  UNION ALL {_sql_spans("access", 1, r"AKIA[A-Z0-9]+", "length(v) >= 20")}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", "length(v) >= 24")}),
k AS ({_sql_spans("secret", 3, secrets.SECRET, "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')")}
  UNION ALL {_sql_spans("endpoint", 4, secrets.ENDPOINT)}),
a AS (
  SELECT * FROM b UNION ALL
  SELECT * FROM k WHERE EXISTS (
    SELECT 1 FROM b WHERE b.doc_id = k.doc_id AND abs(b.s - k.s) <= {secrets.SCOPE}
      AND (b.kind = 'access' OR k.kind = 'endpoint' AND b.kind = 'assign')))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id
"""


_LUHN = """(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {x}[length({x}) + 1 - i]::INT
  ELSE 2 * {x}[length({x}) + 1 - i]::INT - CASE WHEN {x}[length({x}) + 1 - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)""".replace("{x}", "regexp_replace(v, '[^0-9]', '', 'g')")
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
_MOD97 = """(list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || v[1:4], ''),
  lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1)"""
_TRUST, _GOOD, _BAD = (
    "CASE kind " + " ".join(f"WHEN '{k}' THEN " + (str(v[i]) if i == 0 else f"regexp_matches(around, '{pii.context_pattern(v[i])}')") for k, v in pii.TRUST.items()) + " END"
    for i in range(3)
)
#: The guarded patterns find what the plain ones do; here the plain ones stand.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_sql_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}
  UNION ALL {_sql_spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast('0' || right(ltrim(x, '0'), 3) AS INT), 0) <= 255))")}
  UNION ALL {_sql_spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"{_DIGITS} BETWEEN 16 AND 19 AND {_LUHN}")}
  UNION ALL {_sql_spans("phone", 3, pii.PHONE, f"{_DIGITS} BETWEEN 8 AND 15")}
  UNION ALL {_sql_spans("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97)}
  UNION ALL {_sql_spans("shortcard", 5, r"[0-9](?:[\x20-]?[0-9])+", f"{_DIGITS} BETWEEN 13 AND 15 AND {_LUHN}")}),
c AS (SELECT k.*, t[greatest(1, s + 1 - {pii.CONTEXT}):s] || ' ' || t[e + 1:e + {pii.CONTEXT}] AS around FROM k JOIN d USING (doc_id)),
a AS (SELECT * FROM (SELECT *, greatest(0.0, least(1.0, {_TRUST} + CASE WHEN {_GOOD} THEN {pii.BONUS} ELSE 0 END - CASE WHEN {_BAD} THEN {pii.PENALTY} ELSE 0 END)) AS score FROM c) WHERE rank < 4 OR score >= {pii.THRESHOLD})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY rank, s) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY rank, s), '') AS spans,
       coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY rank, s), '') AS scores
FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id
"""


_BASE32 = " || ".join(
    f"""array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || h[{1 + 5 * i}:{5 + 5 * i}])::INT >> s) & 31) + 1, 1)), '')"""
    for i in range(8)
)
OP8_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""


#: Every order is run over the documents' combinations of failures.
OP11_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS g, coalesce(bool_or(toxic = 1), false) AS x FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
f AS (
  SELECT part, coalesce(g, false) AS g, coalesce(x, false) AS x,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (g) AS ng, count(*) FILTER (x) AS nx FROM f GROUP BY part, m),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS o FROM a p, a q, a r, a s, a t
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
s AS (
  SELECT o, step, 1 << (ascii(o[step]) - 65) AS bit, list_sum(list_transform(range(0, step), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 << (ascii(o[i]) - 65) END))::INT AS before
  FROM (SELECT o, unnest(range(1, 6))::INT AS step FROM o)),
r AS (
  SELECT part, o, step, bit, coalesce(sum(n) FILTER (m & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (m & before > 0 AND m & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
         coalesce(sum(ng) FILTER (m & before = 0 AND m & bit > 0), 0) AS good_lost, coalesce(sum(nx) FILTER (m & before = 0 AND m & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


#: Strings and repaired turns are carried along here; of each state the cheapest, then least, string goes on.
OP12_SQL = r"""
WITH RECURSIVE
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
             lambda p, q: list_reduce(list_prepend(xor(p, q), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS harm
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
j AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM n),
ins(f, t, e, x) AS (VALUES
  (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
  (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']),
  (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])),
op(f, r, op, t, c, name) AS (VALUES
  (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''), (3, 'u', 'K', 2, 0, ''),
  (0, '*', 'R', 2, 2, 'user'), (1, '*', 'R', 2, 2, 'user'), (2, '*', 'R', 3, 2, 'assistant'), (3, '*', 'R', 2, 2, 'user'),
  (0, '*', 'D', 0, 3, ''), (1, '*', 'D', 1, 3, ''), (2, '*', 'D', 2, 3, ''), (3, '*', 'D', 3, 3, '')),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS c, '' AS a, []::VARCHAR[] AS x FROM j
  UNION ALL
  SELECT conv_id, i, s, c, a, x FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY c, a) AS best FROM (
      SELECT w.conv_id, w.i + 1 AS i, op.t AS s, w.c + 2 * length(ins.e) + op.c + (op.op <> 'D' AND j.fault = 'truncated')::INT AS c, w.a || ins.e || op.op AS a,
             list_concat(w.x, ins.x, CASE op.op WHEN 'K' THEN [j.role || ':' || j.text] WHEN 'R' THEN [op.name || ':' || j.text] ELSE [] END) AS x
      FROM w JOIN j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN ins ON ins.f = w.s
      JOIN op ON op.f = ins.t AND (op.r = '*' OR op.r = j.r) AND (op.op = 'D' OR j.fault NOT IN ('blank', 'duplicate')))) WHERE best = 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM j GROUP BY conv_id),
b AS (
  SELECT w.conv_id, min({'c': w.c + 2 * length(e.e), 'a': w.a || e.e, 'x': list_concat(w.x, e.x)}) AS v
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.i JOIN ins e ON e.f = w.s AND (e.t = 3 OR e.t = 0) GROUP BY w.conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(array_to_string(v.x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM q.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op5_quality_rules": OP5_SQL, "op8_warc": OP8_SQL, "op9_secret_scan": OP9_SQL, "op10_pii": OP10_SQL}

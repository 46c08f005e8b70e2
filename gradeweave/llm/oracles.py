"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
placed AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place
  FROM plain WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM placed
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY no_source, src),
sources AS (
  SELECT *, ((row_number() OVER (ORDER BY no_source, encode(src)) - 1) % 3 + 1)::DOUBLE AS weight,
    source_size * 3.0::DOUBLE AS most
  FROM sums),
tight AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, no_source, encode(src)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, no_source, encode(src)
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
    row_number() OVER (ORDER BY most / weight, no_source, encode(src)) AS rn
  FROM sources),
targets AS (
  SELECT *, least(most, weight * coalesce(
    (SELECT share FROM tight WHERE most > weight * share ORDER BY rn LIMIT 1), 0)) AS target
  FROM tight),
numbered AS (
  SELECT doc_id, no_source, src, size, row_number() OVER (PARTITION BY no_source, src ORDER BY
      (size >> greatest(length(bin(size)) - 7, 0)) << greatest(length(bin(size)) - 7, 0),
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3))::INT, doc_id NULLS FIRST, size) - 1 AS place
  FROM sized),
rated AS (
  SELECT doc_id, no_source, src, size, source_size, target, place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM numbered JOIN targets USING (no_source, src)),
shifted AS (
  SELECT *, ('0x' || substr(md5('mix|' || no_source || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM rated),
taken AS (
  SELECT *, least(floor((place + 1) * rate + shift) - floor(place * rate + shift), ceil(rate))::BIGINT AS copies
  FROM shifted)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""

OP6 = r"""
WITH counted AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x00-\x20]'))::BIGINT AS tokens
  FROM documents),
changes AS (
  SELECT 'retokenize' AS batch, 1::BIGINT AS docs, * FROM counted
  UNION ALL
  SELECT 'takedown', -1, doc_id, source, lang, -tokens FROM counted
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source, lang, 'word-pieces-1' AS version, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens,
  count(DISTINCT batch) AS batches
FROM changes GROUP BY source, lang HAVING sum(docs) <> 0 OR sum(tokens) <> 0
"""


def oracle_sql():
    return {"op2_exact_dedup": OP2, "op6_token_rollup": OP6, "op10_source_mix": OP10}

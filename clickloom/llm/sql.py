"""DuckDB SQL that the queries of some operators must agree with."""

from __future__ import annotations

from clickloom.llm.common import LOWER, UPPER

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
r AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS last FROM p)
SELECT page_id, n::bigint AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM r
"""


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, dim: int = 64) -> str:
    """Vector codes of ``embeddings``; vectors have ``dim`` components."""
    width = dim // parts
    distance = " + ".join(f"(p.x[{i}] - b.c[{i}]) * (p.x[{i}] - b.c[{i}])" for i in range(1, width + 1))
    sums = ", ".join(f"sum(x[{i}])::bigint" for i in range(1, width + 1))
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, label, p.part, p.x, min(({distance}) * {entries} + b.entry) AS best "
            f"FROM p JOIN b{k} b USING (part) GROUP BY ALL)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, best % {entries} AS entry, count(*) AS n, [{sums}] AS s FROM a{k} GROUP BY ALL), "
                f"b{k + 1} AS MATERIALIZED (SELECT part, entry, CASE WHEN n IS NULL THEN c ELSE list_transform(s, "
                f"lambda v: (v - ((v % n) + n) % n) // n) END AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"
            )
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(q, part * {width} + 1, part * {width} + {width}) AS x
  FROM v, range({parts}) r(part)),
b0 AS MATERIALIZED (
  SELECT part, n - 1 AS entry, x AS c
  FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= {entries}),
{", ".join(steps)},
found AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code,
         sum(best // {entries})::bigint AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM found
"""


def draw(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> str:
    """Importance resampling of ``documents`` toward ``benchmark``, by single words.

    DuckDB has no CRC-32, so its table is made by rule: the reflected polynomial is a fixed value.
    """
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    h = f"('0x' || substr(sha256(concat('{seed}:', doc_id)), 1, 8))::bigint"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, {words} AS words FROM documents),
w AS MATERIALIZED (SELECT row_id, unnest(words) AS word FROM d),
g AS MATERIALIZED (SELECT unnest({words}) AS word FROM benchmark),
k AS MATERIALIZED (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(strlen(word)),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM g), crc),
s AS (SELECT bucket, count(*)::double AS s FROM w JOIN k USING (word) GROUP BY ALL),
t AS (SELECT bucket, count(*)::double AS t FROM g JOIN k USING (word) GROUP BY ALL),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {buckets}) / ((s + 1) * (t_all + {buckets}))))::bigint AS gain
  FROM s LEFT JOIN t USING (bucket), (SELECT count(*)::double AS s_all FROM w), (SELECT count(*)::double AS t_all FROM g)),
weights AS (SELECT row_id, sum(gain)::bigint AS weight FROM w JOIN k USING (word) JOIN gain USING (bucket) GROUP BY ALL),
scored AS (
  SELECT row_id, doc_id, len(words)::bigint AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(({h} + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM d LEFT JOIN weights USING (row_id)),
ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT {percent} * count(*) // 100 FROM ranked) THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row_id)
"""

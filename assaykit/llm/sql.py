"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .mixing import BLOCK_WORDS, MOST, SEED, SHARD_DOCS

OP4 = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), doc AS (
  SELECT doc_id, CASE WHEN words IS NULL THEN [] ELSE words END AS words FROM split
), pos AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM doc
), win AS (
  SELECT p.doc_id, p.i, array_to_string(d.words[p.i : p.i + 19], ' ') AS w
  FROM pos p JOIN doc d USING (doc_id) WHERE p.i <= p.n - 19
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), edge AS (
  SELECT doc_id, i, sum(d) AS d FROM (SELECT doc_id, i, 1 AS d FROM rep UNION ALL SELECT doc_id, i + 20, -1 FROM rep) GROUP BY ALL
), cov AS (
  SELECT p.doc_id, p.i, coalesce(sum(e.d) OVER (PARTITION BY p.doc_id ORDER BY p.i), 0) AS c
  FROM pos p LEFT JOIN edge e ON e.doc_id = p.doc_id AND e.i = p.i
), kept AS (
  SELECT c.doc_id, string_agg(d.words[c.i], ' ' ORDER BY c.i) AS t, count(*) AS n
  FROM cov c JOIN doc d USING (doc_id) WHERE c.c <= 0 GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (doc_id)
"""

NORMAL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
WITH doc AS (SELECT doc_id, coalesce({NORMAL}, []) AS words FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce({NORMAL}, []) AS words FROM benchmark),
size AS (SELECT DISTINCT least(10, len(words)) AS k FROM item WHERE len(words) > 0),
iwin AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS w
  FROM (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM item WHERE len(words) > 0)
),
dwin AS (
  SELECT doc_id, i, k, array_to_string(words[i : i + k - 1], ' ') AS w
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM doc CROSS JOIN size WHERE len(words) >= k)
),
hit AS (SELECT d.doc_id, d.i, d.k, t.item_id FROM dwin d JOIN iwin t ON d.k = t.k AND d.w = t.w),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word w USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


def _number(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def _apportioned(name: str, parties: str, group: str, order: str, votes: str, seats: str, most: str) -> str:
    """Highest quotients the plain way: every seat a party could hold, ranked."""
    return f"""{name}_seat AS (
  SELECT *, {votes} / (2 * s + 1) AS q FROM (SELECT *, unnest(range(0, CAST({most} AS BIGINT))) AS s FROM {parties})
), {name}_won AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {order}, s) AS r FROM {name}_seat) WHERE r <= {seats}
)"""


OP8 = f"""
WITH doc AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         md5(coalesce(text, '')) AS body FROM documents
), shards AS (SELECT greatest(1, CAST(ceil(count(*) / {SHARD_DOCS}.0) AS BIGINT)) AS k FROM documents),
dealt AS (SELECT d.*, {_number(f"'{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || body")} % k AS shard FROM doc d CROSS JOIN shards),
src AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM dealt GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS weight, {MOST}.0 * source_size AS cap FROM src
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
  FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), target AS (
  SELECT source, source_size, weight, CASE WHEN cap < lv * weight THEN cap
    ELSE least(cap, weight * (SELECT min_by(lv, cap / weight) FROM leveled WHERE NOT cap < lv * weight)) END AS target
  FROM leveled
), party AS (
  SELECT *, CAST(round((SELECT sum(target) FROM target) / {BLOCK_WORDS}) AS BIGINT) AS blocks,
         ceil({MOST} * source_size / {BLOCK_WORDS}) AS most FROM target
), {_apportioned("a", "party", "1", "source NULLS LAST", "target", "blocks", "most")},
quota AS (SELECT p.*, coalesce(w.n, 0) AS source_quota FROM party p LEFT JOIN (SELECT source, count(*) AS n FROM a_won GROUP BY source) w ON p.source IS NOT DISTINCT FROM w.source),
part AS (
  SELECT d.source, d.shard, q.source_size, q.target, q.source_quota, CAST(d.shard_size AS DOUBLE) AS votes, d.shard_size,
         ceil(d.shard_size / {BLOCK_WORDS}.0) * {MOST} AS most
  FROM (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM dealt GROUP BY source, shard) d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
), {_apportioned("b", "part", "source", "shard", "votes", "source_quota", "most")},
shard_quota AS (
  SELECT p.*, coalesce(w.n, 0) AS quota, greatest(1, CAST(ceil(p.shard_size / {BLOCK_WORDS}.0) AS BIGINT)) AS n
  FROM part p LEFT JOIN (SELECT source, shard, count(*) AS n FROM b_won GROUP BY source, shard) w ON p.source IS NOT DISTINCT FROM w.source AND p.shard = w.shard
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY md5('{SEED + 1}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), doc_id, body, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM dealt
), lined AS (
  SELECT p.doc_id, p.size, p.stop, p.stop - p.size AS start, s.*,
         {_number(f"'{SEED + 2}:' || coalesce(s.source, '-') || ':' || CAST(s.shard AS VARCHAR)")} % s.n AS o
  FROM placed p JOIN shard_quota s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard
), block AS (
  SELECT *, unnest(range(start // {BLOCK_WORDS}, (stop - 1) // {BLOCK_WORDS} + 1)) AS j FROM lined WHERE size > 0
), counted AS (
  SELECT doc_id, sum((least(stop, (j + 1) * {BLOCK_WORDS}) - greatest(start, j * {BLOCK_WORDS})) * (((j + 1 + o) * quota) // n - ((j + o) * quota) // n)) AS taken
  FROM block GROUP BY doc_id
)
SELECT l.doc_id, CAST(l.size AS BIGINT) AS size, CAST(l.source_size AS BIGINT) AS source_size, l.target,
       CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM lined l LEFT JOIN counted c ON l.doc_id IS NOT DISTINCT FROM c.doc_id
"""

ORACLES = {"op4_substring_dedup": OP4, "op7_decontamination": OP7, "op8_mixing": OP8}

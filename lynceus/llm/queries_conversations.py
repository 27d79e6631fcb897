"""The query over conversations and its SQL, which lists every prefix as a list of turns."""

from __future__ import annotations

from lynceus.llm import prefix_trie
from lynceus.llm.catalog import query, table

#: crc32 of ASCII text in SQL, byte by byte with the usual table.
CRC_SQL = """bits AS (SELECT i AS k, i AS v, 0 AS step FROM range(256) t(i) UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS tab FROM bits WHERE step = 8)"""


@query("op13_prefix_trie", rf"""
WITH RECURSIVE {CRC_SQL},
turns AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list({{'t': t, 'w': words}} ORDER BY turn NULLS FIRST, t) AS own FROM turns GROUP BY c),
kept AS (SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''),
  lambda x: ord(x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % 4 AS h FROM convs, crc),
built AS (SELECT k.c, list_concat(coalesce(b.own, [])[1:k.h], k.own[k.h + 1:]) AS path FROM kept k LEFT JOIN convs b ON b.c = k.c - k.c % 20),
members AS (SELECT c, unnest(range(len(path) + 1)) AS depth, path, len(path) AS n FROM built),
named AS (SELECT c, depth, n, list_transform(path[1:depth], lambda x: x.t) AS name, CASE WHEN depth > 0 THEN path[depth].w ELSE 0 END AS words FROM members),
nodes AS (SELECT name, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '') AS ends FROM named GROUP BY name, depth),
kids AS (SELECT name[1:depth - 1] AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT m.name[1:d] AS name, m.leaf, m.saved FROM (
  SELECT nodes.name, (kids.n IS NULL)::BIGINT AS leaf, (n_convs - 1) * words AS saved, unnest(range(depth + 1)) AS d
  FROM nodes LEFT JOIN kids ON kids.name = nodes.name) m),
sums AS (SELECT name, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY name)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes LEFT JOIN kids ON kids.name = nodes.name LEFT JOIN nodes up ON up.name = nodes.name[1:nodes.depth - 1] AND up.depth = nodes.depth - 1
JOIN sums ON sums.name = nodes.name""")
def prefix_nodes(spark, d):
    return prefix_trie.trie(table(spark, d, "conversations"))

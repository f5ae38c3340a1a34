"""DuckDB SQL for the queries that SQL can express."""

AUDIT = """
WITH words AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), places AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), sums AS (
  SELECT p.lang, p.source, coalesce(sum(f.n), 0)::HUGEINT AS n
  FROM places p LEFT JOIN found f ON p.lang = f.lang AND p.source = f.source GROUP BY ALL
), rates AS (
  SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 2)) // (s.n + 2 * z.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 2)) // (z.n + 2 * z.v))::BIGINT AS q
  FROM sums s JOIN kept k ON s.lang = k.lang JOIN sizes z ON s.lang = z.lang
  LEFT JOIN found f ON s.lang = f.lang AND s.source = f.source AND k.term = f.term
), compared AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(c.value, 0)::BIGINT AS value
  FROM places a JOIN places b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN compared c ON a.lang = c.lang AND a.source = c.source AND b.source = c.item
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM rates WHERE n > 0 AND p > q
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id,
    list(sha256(strlen(role)::VARCHAR || ':' || role || text) ORDER BY place) AS keys,
    list(strlen(text)::BIGINT ORDER BY place) AS weights
  FROM turns GROUP BY conv_id
), heads AS (
  -- CRC-32 of the decimal id, bit by bit
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT a.conv_id,
    list_concat(coalesce(b.keys[1:a.h], []), a.keys[a.h + 1:]) AS keys,
    list_concat(coalesce(b.weights[1:a.h], []), a.weights[a.h + 1:]) AS weights
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), passed AS (
  SELECT conv_id, d, len(keys) = d AS ends,
    CASE WHEN d = 0 THEN 0 ELSE weights[d] END AS weight,
    sha256(array_to_string(keys[1:d], '/')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(keys[1:d - 1], '/')) END AS up
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(weight) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM passed GROUP BY node, d
), children AS (
  SELECT up, count(*) AS n FROM nodes GROUP BY up
), sized AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.up = n.node
), above AS (
  SELECT DISTINCT p.node AS low, q.node AS high
  FROM sized n JOIN passed p ON p.node = n.node AND p.conv_id = n.conv_id JOIN passed q ON q.conv_id = p.conv_id AND q.d <= p.d
), subtrees AS (
  SELECT a.high AS node, sum(s.saved) AS saved_tokens, sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM above a JOIN sized s ON s.node = a.low GROUP BY a.high
)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children,
  t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN subtrees t ON t.node = s.node LEFT JOIN sized p ON p.node = s.up
"""

ORACLES: dict[str, str] = {"op11_source_audit": AUDIT, "op13_turn_trie": TRIE}

"""Queries of the corpus operators once more, as SQL over words, where SQL can say them."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, key: str, name: str, pattern: str) -> str:
    """Tables ``name`` (key, n) and ``name``_at (key, n, p, word), p from 1."""
    return rf"""
{name}_list AS (SELECT {key}, regexp_extract_all({_LOWER}, '{pattern}') AS w FROM {table}),
{name} AS (SELECT {key}, CAST(len(w) AS BIGINT) AS n FROM {name}_list),
{name}_at AS (
  SELECT {key}, CAST(len(w) AS BIGINT) AS n, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word
  FROM {name}_list)"""


def _windows(name: str, key: str, size: int) -> str:
    frame = f"(PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    return f"""SELECT {key}, p, n, {size} AS k, string_agg(word, ' ') OVER {frame} AS win
  FROM {name}_at"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"
_SIZES = range(1, 14)


def _all_windows(name: str, key: str, wanted: str) -> str:
    parts = [
        f"SELECT * FROM ({_windows(name, key, size)}) WHERE p + {size - 1} <= n AND {wanted}"
        for size in _SIZES
    ]
    return "\n  UNION ALL ".join(parts)


DECONTAMINATION = (
    "WITH "
    + _words("documents", "doc_id", "doc", _ALNUM)
    + ","
    + _words("benchmark", "item_id", "item", _ALNUM)
    + f""",
item_windows AS (
  SELECT DISTINCT item_id, k, win FROM ({_all_windows('item', 'item_id', 'k = least(13, n)')})),
doc_windows AS ({_all_windows('doc', 'doc_id', 'k IN (SELECT k FROM item_windows)')}),
matches AS (SELECT doc_id, p, k, item_id FROM doc_windows JOIN item_windows USING (k, win)),
hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM matches) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""
)

NEAR_DEDUP = (
    "WITH RECURSIVE "
    + _words("documents", "doc_id", "doc", _PLAIN)
    + f""",
shingles AS (
  SELECT DISTINCT doc_id, win FROM ({_windows('doc', 'doc_id', 5)}) WHERE p <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.win = b.win AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * shared >= 75 * (a.size + b.size - shared)),
reached AS (
  SELECT doc_id, doc_id AS other FROM doc
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
     LEFT JOIN sizes USING (doc_id)"""
)

_SIZE, _NUMBER, _ROUNDS = 64, 40, 5


def _assignment(step: int) -> str:
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""
a{step} AS (
  SELECT vec_id, any_value(v) AS v, arg_min(c, d * {_NUMBER} + c) AS c, min(d) AS d
  FROM (SELECT k.vec_id, k.v, c.c, CAST({apart} AS BIGINT) AS d FROM kept k CROSS JOIN c{step} c)
  GROUP BY vec_id)"""


def _moved(step: int) -> str:
    return f"""
s{step} AS (
  SELECT c, p, sum(x) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range({_SIZE})) AS p FROM a{step}) GROUP BY c, p),
m{step} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v
  FROM s{step} GROUP BY c),
c{step + 1} AS (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{step} c LEFT JOIN m{step} m ON m.c = c.c)"""


CLUSTERS = (
    f"""WITH kept AS (
  SELECT vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {_SIZE} AND len(embedding) = {_SIZE}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v
  FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {_NUMBER}),"""
    + ",".join(f"{_assignment(step)},{_moved(step)}" for step in range(_ROUNDS))
    + ","
    + _assignment(_ROUNDS)
    + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{_ROUNDS} a JOIN c{_ROUNDS} c ON c.c = a.c"""
)

TRIE = """WITH step AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
placed AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s
        FROM conversations WHERE conv_id IS NOT NULL) CROSS JOIN step),
turns AS (
  SELECT v.c, 0 AS part, p, k, chars FROM convs v JOIN placed b ON b.c = v.c - v.c % 100 AND p <= h
  UNION ALL SELECT v.c, 1, p, k, chars FROM convs v JOIN placed o ON o.c = v.c AND p > h),
paths AS (
  SELECT c, list(k ORDER BY part, p) AS path, list(chars ORDER BY part, p) AS lens
  FROM turns GROUP BY c
  UNION ALL SELECT c, [], [] FROM convs WHERE c NOT IN (SELECT c FROM turns)),
members AS (
  SELECT c, d, path[:d] AS node, lens[d] AS chars, d = len(path) AS last
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, node, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM members GROUP BY d, node),
children AS (
  SELECT d - 1 AS d, node[:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT k AS d, node[:k] AS node,
    sum((n - 1) * coalesce(chars, 0)) AS saved, count(*) FILTER (leaf) AS n_leaves
  FROM (SELECT n.*, c.node IS NULL AS leaf, unnest(range(n.d + 1)) AS k
        FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.node = n.node) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs,
  coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.node = n.node
  LEFT JOIN children c ON c.d = n.d AND c.node = n.node
  LEFT JOIN nodes u ON u.d = n.d - 1 AND u.node = n.node[:n.d - 1]"""

PASSAGES = rf"""WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM listed)),
first AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p
  FROM windows JOIN first USING (win) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM listed),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM listed LEFT JOIN removed USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

ORACLE = {
    "op9_decontamination": DECONTAMINATION,
    "op10_near_dedup": NEAR_DEDUP,
    "op11_conversation_trie": TRIE,
    "op12_centroid_clusters": CLUSTERS,
    "op13_substring_dedup": PASSAGES,
}

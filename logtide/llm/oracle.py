"""DuckDB statements for the operators that SQL expresses."""

from __future__ import annotations

OP1 = r"""
WITH rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
parts AS (SELECT row_number() OVER () AS id, page_id,
                 translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
          FROM cut),
best AS (SELECT id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
         GROUP BY id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (id)
"""

OP8 = r"""
WITH base AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT id, doc_id, t,
                 list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM base),
starts AS (SELECT id, unnest(range(1, len(words) - 6)) AS i, words FROM split WHERE len(words) >= 8),
windows AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS w FROM starts),
twice AS (SELECT id, w FROM windows GROUP BY id, w HAVING count(*) > 1),
covered AS (SELECT id, count(DISTINCT j) AS n
            FROM (SELECT id, unnest(range(i, i + 8)) AS j FROM windows JOIN twice USING (id, w)) GROUP BY id),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals,
         length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters,
         len(list_filter(range(2, len(words) + 1), lambda k: words[k] = words[k - 1])) AS stutter,
         len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS lettered
  FROM split LEFT JOIN covered USING (id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * capitals > letters OR 2 * n_dup_lines > n_lines
            OR 5 * stutter > n_words OR 10 * lettered < 6 * n_words) AS kept
FROM judged
"""

OP7 = r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents),
split AS (SELECT id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs),
words AS (SELECT id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w, len(words) AS m FROM split),
grams AS (SELECT id, i, m, w AS g1, lag(w) OVER d || ' ' || w AS g2,
                 lag(w, 2) OVER d || ' ' || lag(w) OVER d || ' ' || w AS g3
          FROM words WINDOW d AS (PARTITION BY id ORDER BY i)),
n AS (SELECT count(*) AS n FROM words),
o1 AS (SELECT id, g1, count(*) AS c FROM grams GROUP BY ALL),
o2 AS (SELECT id, g2, count(*) AS c FROM grams WHERE g2 IS NOT NULL GROUP BY ALL),
o3 AS (SELECT id, g3, count(*) AS c FROM grams WHERE g3 IS NOT NULL GROUP BY ALL),
e1 AS (SELECT id, g1, sum(c) OVER (PARTITION BY g1) - c AS c FROM o1),
e2 AS (SELECT id, g2, sum(c) OVER (PARTITION BY g2) - c AS c FROM o2),
e3 AS (SELECT id, g3, sum(c) OVER (PARTITION BY g3) - c AS c FROM o3),
counted AS (SELECT id, i, m, n - m AS rest, e1.c AS c1, coalesce(e2.c, 0) AS c2, coalesce(e3.c, 0) AS c3
            FROM grams CROSS JOIN n JOIN e1 USING (id, g1) LEFT JOIN e2 USING (id, g2) LEFT JOIN e3 USING (id, g3)),
placed AS (SELECT *, lag(c1) OVER d AS p1, lag(c2) OVER d AS p2,
                  CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used
           FROM counted WINDOW d AS (PARTITION BY id ORDER BY i)),
scored AS (SELECT id, used,
                  round(1e6 * ln(CASE used WHEN 3 THEN c3::DOUBLE / p2::DOUBLE WHEN 2 THEN c2::DOUBLE / p1::DOUBLE
                                 WHEN 1 THEN c1::DOUBLE / rest::DOUBLE ELSE 1.0::DOUBLE / (rest + 1)::DOUBLE END
                                 * pow(0.4::DOUBLE, least(i, 3) - greatest(used, 1))))::BIGINT AS micro
           FROM placed)
SELECT doc_id, count(used)::BIGINT AS n_words, coalesce(sum(micro), 0)::BIGINT AS log_micro,
       CASE WHEN count(used) > 0 THEN sum(micro)::DOUBLE / 1e6::DOUBLE / count(used) END AS mean_log,
       count(*) FILTER (used = 0)::BIGINT AS n_unseen, count(*) FILTER (used = 1)::BIGINT AS n_order1,
       count(*) FILTER (used = 2)::BIGINT AS n_order2, count(*) FILTER (used = 3)::BIGINT AS n_order3
FROM docs LEFT JOIN scored USING (id) GROUP BY id, doc_id
"""

OP11 = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                                'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
f1 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM split) GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f
       FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM split) GROUP BY ALL),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f
       FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM split) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT b.lang, x || ' ' || y AS phrase, x AS x1, y AS y1, NULL AS z1, b.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM f2 b JOIN f1 p ON p.lang = b.lang AND p.g = x JOIN f1 q ON q.lang = b.lang AND q.g = y WHERE b.f >= 10
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.x, t.y, t.z, t.f, 1, p.f, q.f
  FROM f3 t JOIN f1 p ON p.lang = t.lang AND p.g = t.x JOIN f2 q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.x, t.y, t.z, t.f, 2, p.f, q.f
  FROM f3 t JOIN f2 p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN f1 q ON q.lang = t.lang AND q.g = t.z
  WHERE t.f >= 10),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, x, y, max(f) AS f
           FROM (SELECT lang, x, y, f FROM f3 WHERE f >= 10 UNION ALL SELECT lang, y, z, f FROM f3 WHERE f >= 10)
           GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON b.z1 IS NULL AND g.lang = b.lang AND g.x = b.x1 AND g.y = b.y1
         WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _merkle_levels(leaves: str, prefix: str, levels: int) -> str:
    """CTEs for that many levels: the nodes of each with their parent's digest;
    a node that is alone in its tree stays as it is."""
    out, below = [], leaves
    for i in range(levels):
        out.append(f"""
{prefix}{i} AS (
  SELECT *, CASE WHEN size = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER
              (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS before,
         CASE WHEN size = 1 THEN '' ELSE coalesce(string_agg(digest, '') OVER
              (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS after
  FROM {below}),
{prefix}{i}up AS (
  SELECT tree, idx // 8 AS idx, (size + 7) // 8 AS size,
         CASE WHEN any_value(size) = 1 THEN any_value(digest)
              ELSE sha256(string_agg(digest, '' ORDER BY {prefix}{i}.idx)) END AS digest
  FROM {prefix}{i} GROUP BY tree, {prefix}{i}.idx // 8, size)""")
        below = f"{prefix}{i}up"
    return ",".join(out)


def _merkle_steps(prefix: str, levels: int, idx: str, tree: str) -> tuple[str, str]:
    """Joins of a leaf's nodes on all levels, and its list of (before, after, whether hashed)."""
    joins = "".join(f"\n  JOIN {prefix}{i} ON {prefix}{i}.tree = {tree} AND {prefix}{i}.idx = {idx} // {8 ** i}"
                    for i in range(levels))
    return joins, ", ".join(f"{{'b': {prefix}{i}.before, 'a': {prefix}{i}.after, 'up': {prefix}{i}.size > 1}}"
                            for i in range(levels))


def _merkle(levels: int = 6, group_levels: int = 3) -> str:
    """Trees of at most 8 ** levels rows a group and 8 ** group_levels groups."""
    joins, steps = _merkle_steps("d", levels, "leaves.idx", "leaves.tree")
    group_joins, group_steps = _merkle_steps("g", group_levels, "tops.idx", "tops.tree")
    field = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    columns = " || ".join(field.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = columns.replace("text", f"{lower}")
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(':' || lang, '') AS tree, sha256({columns}) AS digest, sha256({changed}) AS changed,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
                  count(*) OVER (PARTITION BY tree) AS size FROM hashed),
{_merkle_levels("leaves", "d", levels).strip()},
tops AS (SELECT '' AS tree, tree AS part, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size
         FROM d{levels - 1}up),
{_merkle_levels("tops", "g", group_levels).strip()},
root AS (SELECT digest AS root FROM g{group_levels - 1}up),
top_steps AS (SELECT tops.part, tops.digest AS subroot, [{group_steps}] AS steps FROM tops{group_joins}),
proofs AS (SELECT leaves.doc_id, leaves.digest AS leaf, CASE WHEN leaves.crc % 3 = 0 THEN leaves.changed ELSE leaves.digest END AS start,
                  subroot, list_concat([{steps}], top_steps.steps) AS steps
           FROM leaves{joins} JOIN top_steps ON top_steps.part = leaves.tree),
folded AS (SELECT doc_id, leaf, subroot,
                  sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s.b || s.a), 'string_agg', ''), '')) AS proof_sha256,
                  list_reduce(list_prepend({{'b': start, 'a': '', 'up': false}}, steps),
                              lambda x, s: {{'b': CASE WHEN s.up THEN sha256(s.b || x.b || s.a) ELSE x.b END, 'a': '',
                                            'up': false}}).b AS folded_root
           FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded CROSS JOIN root
"""


OP12 = _merkle()

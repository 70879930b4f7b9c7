"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from carepath.llm import op4_lines, op8_mixing, op11_urls, op12_clusters
from carepath.llm import op5_quality as quality_rules


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _holds(rule: quality_rules.Rule) -> str:
    bounds = []
    if rule.least is not None:
        bounds.append(f"100 * {rule.part} >= {rule.least} * {rule.whole}")
    if rule.most is not None:
        bounds.append(f"100 * {rule.part} <= {rule.most} * {rule.whole}")
    return " AND ".join(bounds)


QUALITY_MEASURES = f"""
numbered AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
split_up AS (
  SELECT rid, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM numbered),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split_up)),
repeated AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
measured AS (
  SELECT s.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS BIGINT) AS n_ellipsis_lines,
         CAST(len(regexp_extract_all(body, '[A-Z]')) AS BIGINT) AS n_capitals,
         CAST(len(list_filter(w, lambda x: x IN ({_quoted(quality_rules.STOP_FORMS)}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split_up s LEFT JOIN covered c ON s.rid = c.rid),
judged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
            OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM measured)
"""
QUALITY_PASSES = "NOT base_failed AND " + " AND ".join(_holds(r) for r in quality_rules.RULES)

OP5 = f"""WITH {QUALITY_MEASURES.format(docs='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {QUALITY_PASSES} AS kept
FROM judged"""

OP3 = """
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS digits
  FROM pages),
parts AS (
  SELECT *, list_transform([1, 11, 21, 31], lambda k: CAST('0x' || substr(digits, k, 10) AS BIGINT)) AS numbers
  FROM sized),
named AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(numbers, lambda v: array_to_string(list_transform(
           [35, 30, 25, 20, 15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '')
         AS payload_digest,
         min(page_id) OVER (PARTITION BY digits) AS first_id
  FROM parts)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named"""



def _mix_level(depth: int, mix: op8_mixing.Mix) -> str:
    """The children of one level: those below the water level are full, the others share the rest."""
    here, parent = ", ".join(mix.levels[:depth]), list(mix.levels[: depth - 1])
    cases = " ".join(
        "WHEN " + " AND ".join(f"{c} = '{n}'" for c, n in zip(mix.levels, path, strict=False) if n != "*") + f" THEN {w}"
        for path, w in reversed(mix.weights.items())
        if len(path) == depth
    )
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    budget = (
        f"JOIN level{depth - 1} USING ({', '.join(parent)})" if parent
        else f"CROSS JOIN (SELECT sum(tokens)::HUGEINT * {mix.budget_percent} // 100 AS budget FROM leaves)"
    )
    return f"""nodes{depth} AS (
  SELECT {here}, sum(capacity)::HUGEINT AS capacity, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {here}),
ranked{depth} AS (
  SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
         (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS after
  FROM nodes{depth} {budget}
  WINDOW w AS ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {mix.levels[depth - 1]})),
judged{depth} AS (SELECT *, capacity * after <= (budget - before) * weight AS is_full FROM ranked{depth}),
level{depth} AS (
  SELECT {here}, CASE WHEN is_full THEN capacity ELSE
    ((budget - coalesce(sum(capacity) FILTER (is_full) OVER ({by}), 0)::HUGEINT) * weight)
    // (sum(weight) FILTER (NOT is_full) OVER ({by}))::HUGEINT END AS budget
  FROM judged{depth}),"""


def mixture(mix: op8_mixing.Mix) -> str:
    levels = ", ".join(mix.levels)
    parts = "\n".join(_mix_level(d, mix) for d in range(1, len(mix.levels) + 1))
    return f"""WITH counted AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '[02468]$') THEN 'books'
         ELSE 'forums' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (
  SELECT {levels}, sum(n_tokens) AS tokens, sum(n_tokens) * {mix.max_epochs} AS capacity
  FROM counted WHERE n_tokens > 0 GROUP BY {levels}),
{parts}
plan AS (
  SELECT {levels}, CAST(budget // tokens AS BIGINT) AS epochs, CAST(budget % tokens AS BIGINT) AS rest
  FROM leaves JOIN level{len(mix.levels)} USING ({levels})),
ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {levels} ORDER BY md5('{mix.seed}:' || epochs || ':' || doc_id), doc_id
                                ROWS UNBOUNDED PRECEDING) AS reached
  FROM counted JOIN plan USING ({levels}) WHERE n_tokens > 0)
SELECT doc_id, {levels}, n_tokens, CAST(epochs + CASE WHEN reached <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered WHERE epochs + CASE WHEN reached <= rest THEN 1 ELSE 0 END > 0"""


# Equal strings instead of hashes: a line with one word left out, and with one word masked.
OP4 = f"""
WITH split_up AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
worded AS (
  SELECT doc_id, line_no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM split_up),
judged AS (SELECT * FROM worded WHERE len(w) >= {op4_lines.LEAST}),
uniq AS (
  SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min({{'d': doc_id, 'n': line_no}}) AS pos
  FROM judged GROUP BY 1),
long_lines AS (SELECT * FROM uniq WHERE len(w) >= {op4_lines.MIN_WORDS}),
places AS (SELECT t, w, pos, unnest(generate_series(1, len(w))) AS i FROM long_lines),
variants AS (
  SELECT t, pos, i, len(w) AS n, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM places),
change AS (
  SELECT t, pos, min(pos) OVER (PARTITION BY n, i, v) AS other FROM variants),
shorter AS (SELECT v.t, v.pos, u.pos AS other FROM variants v JOIN long_lines u ON v.v = u.t),
longer AS (SELECT u.t, u.pos, v.pos AS other FROM variants v JOIN long_lines u ON v.v = u.t),
gone AS (
  SELECT DISTINCT t FROM (SELECT * FROM change UNION ALL SELECT * FROM shorter UNION ALL SELECT * FROM longer)
  WHERE other < pos),
stays AS (SELECT pos.d AS doc_id, count(*) AS n FROM uniq WHERE t NOT IN (SELECT t FROM gone) GROUP BY 1),
totals AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(w) >= {op4_lines.LEAST}) AS n_judged
  FROM worded GROUP BY doc_id)
SELECT doc_id, n_lines, n_judged, n_judged - coalesce(n, 0) AS n_removed FROM totals LEFT JOIN stays USING (doc_id)"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in op11_urls.RULES)
OP11 = f"""
WITH after AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{op11_urls.UPPER}', '{op11_urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM after),
fits AS (
  SELECT rid, r.host || r.path AS rule, verdict
  FROM cut c JOIN (VALUES {_RULES}) AS r(host, path, verdict)
    ON (c.host = r.host OR suffix(c.host, '.' || r.host)) AND starts_with(c.path, r.path)),
best AS (SELECT rid, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (rid)"""


def _clusters_sql(k: int = op12_clusters.CENTROIDS, rounds: int = op12_clusters.ROUNDS) -> str:
    """Every vector against every centroid, and the rounds one after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, list_sum(list_transform(list_zip(v, p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
        FROM kept CROSS JOIN cent{r}) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p
  FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r} JOIN kept USING (rid)) GROUP BY c, i)
  GROUP BY c),
cent{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.p, o.p) AS p FROM cent{r} o LEFT JOIN mean{r} m USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {op12_clusters.DIMS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cent0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS p
  FROM (SELECT sha256('{op12_clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
sums AS (SELECT c, sum(d)::BIGINT AS per FROM near{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, per AS cluster_inertia, (SELECT sum(per)::BIGINT FROM sums) AS inertia,
       sha256(array_to_string(p, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (rid) JOIN sums USING (c) JOIN cent{rounds} USING (c)"""


# A node is the string of its turns; an unsigned CRC-32 bit by bit over the digits of the id.
OP13 = """
WITH turns AS (
  SELECT conv_id, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) - 1 AS k FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)),
joined AS (
  SELECT c.conv_id, 0 AS part, k, t, chars FROM convs c JOIN placed p ON p.conv_id = c.base AND k < h
  UNION ALL SELECT c.conv_id, 1, k, t, chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND k >= h),
rebuilt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS pos FROM joined),
keyed AS (
  SELECT conv_id, pos AS depth, chars,
         string_agg(t, ' ') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS key,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c),
named AS (
  SELECT key, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth),
upward AS (
  SELECT c.key, p.key AS above, p.conv_id AS parent_conv_id
  FROM named c JOIN named p ON p.depth = c.depth - 1 AND p.key = substr(c.key, 1, greatest(65 * p.depth - 1, 0))),
children AS (SELECT above AS key, count(*) AS n_children FROM upward GROUP BY above),
tree AS (SELECT *, coalesce(n_children, 0) AS kids FROM named LEFT JOIN children USING (key)),
under AS (
  SELECT substr(key, 1, greatest(65 * up - 1, 0)) AS key, kids, (n_convs - 1) * chars AS saved
  FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM tree)),
sums AS (SELECT key, count(*) FILTER (kids = 0) AS n_leaves, sum(saved) AS saved_tokens FROM under GROUP BY key)
SELECT conv_id, depth, parent_conv_id, n_convs, kids AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM tree LEFT JOIN upward USING (key) JOIN sums USING (key)"""

ORACLES = {"op4_line_dedup": OP4, "op8_mixture": mixture(op8_mixing.PRODUCTION), "op3_warc_archives": OP3, "op5_quality_rules": OP5,
           "op11_url_filter": OP11, "op12_centroid_clusters": _clusters_sql(), "op13_prefix_trie": OP13}

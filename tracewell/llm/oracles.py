"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import url_filters

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT sha1(body) AS digest, max(page_id) AS first FROM p WHERE strlen(body) >= 1000 GROUP BY 1)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN m ON m.digest = sha1(body)
"""


def _rule() -> str:
    tests = []
    for rule, _ in sorted(url_filters.RULES, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        tests.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'")
    return f"CASE {' '.join(tests)} END"


def _strength(t: str) -> str:
    lo, hi = url_filters.MIN_STRENGTH, url_filters.MAX_STRENGTH
    return f"""(SELECT CASE WHEN m < 2 OR n <= m OR n IS NULL THEN {hi} WHEN top <= 0 OR bottom <= 0 THEN {hi} ELSE least({hi}, greatest({lo}, bottom / top - 1)) END FROM
(SELECT m, n, b - w AS top, b + (n0 - 1) * w AS bottom FROM (SELECT m, n, greatest(0, kk - n * (k / n) * (k / n)) / (m - 1) AS b, within / (n - m) AS w, (n - nn / n) / (m - 1) AS n0 FROM
(SELECT CAST(count(*) AS DOUBLE) AS m, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(n * n) AS DOUBLE) AS nn, sum(k * (CAST(k AS DOUBLE) / n)) AS kk, sum(k * (1 - CAST(k AS DOUBLE) / n)) AS within FROM {t} WHERE n > 0))))"""


_SECOND = ", ".join(f"'{x}'" for x in url_filters.SECOND_LEVEL)
_BY_RULE = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in url_filters.RULES)
OP2 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
  TRY_CAST(nullif(regexp_extract(url, '/(\\d{{1,18}})(?:[^0-9]|$)', 1), '') AS BIGINT) AS key FROM pages),
h AS (SELECT page_id, key, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM u),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM h LEFT JOIN o ON o.doc_id = h.key GROUP BY host),
d AS (SELECT *, string_split(host, '.') AS l FROM c),
s AS (SELECT host, n, k, l, regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') AS num, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS t FROM d),
hosts AS (SELECT host, n, k, CASE WHEN num THEN '' ELSE array_to_string(l[greatest(len(l) - t + 1, 1):], '.') END AS suffix,
  CASE WHEN num THEN host ELSE array_to_string(l[greatest(len(l) - t, 1):], '.') END AS domain FROM s),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
g AS (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(k) AS DOUBLE) / sum(n) ELSE {0.5 * url_filters.THRESHOLD} END AS p, {_strength('hosts')} AS sh, {_strength('domains')} AS sd, {_strength('suffixes')} AS ss FROM suffixes),
ps AS (SELECT suffix, (k + g.p * ss) / (n + ss) AS p FROM suffixes, g),
pd AS (SELECT suffix, domain, (k + ps.p * sd) / (n + sd) AS p FROM domains JOIN ps USING (suffix), g),
ab AS (SELECT host, n, k + sh * pd.p AS a, n - k + sh * (1 - pd.p) AS b FROM hosts JOIN pd USING (suffix, domain), g),
rep AS (SELECT host, n, a / (a + b) AS rate, greatest(a / (a + b) - {url_filters.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS low FROM ab),
r AS (SELECT page_id, host, path, {_rule()} AS rule FROM h)
SELECT page_id, host, path, rule, CASE rule {_BY_RULE} ELSE CASE WHEN low > {url_filters.THRESHOLD} THEN 'block' ELSE 'allow' END END AS verdict,
  CAST(n AS BIGINT) AS labelled, round(CAST(rate AS DOUBLE), 6) AS bad_rate, round(CAST(low AS DOUBLE), 6) AS lower_bound FROM r JOIN rep USING (host)
"""


def _vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Codebooks as rows (p, e, c), moved round by round."""
    nearest = "SELECT v.vec_id, v.label, v.p, v.x, min(CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - b.c[j]) * (v.x[j] - b.c[j]))) AS BIGINT) * {n} + b.e) AS found FROM v JOIN b{k} b USING (p) GROUP BY ALL"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM kept, range(0, {parts}) t(p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS MATERIALIZED ({nearest.format(n=entries, k=k)})",
            f"s{k} AS (SELECT p, found % {entries} AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, 17) r(j) GROUP BY ALL)",
            f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{k} GROUP BY p, e)",
            f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))",
        ]
    return f"""
WITH {", ".join(steps)},
f AS MATERIALIZED ({nearest.format(n=entries, k=rounds)}),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', found % {entries}), '' ORDER BY p) AS code, CAST(sum(found // {entries}) AS BIGINT) AS error FROM f GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, d
"""


OP11 = _vector_codes()

#: CRC-32 of a short ASCII string, bit by bit.
_CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
 lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(0, 8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

OP13 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': role || chr(0) || body, 'b': strlen(body)}} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || body)) AS seq FROM t GROUP BY conv_id),
h AS (SELECT conv_id, seq, xor({_CRC32.format("CAST(conv_id AS VARCHAR)")}, 4294967295) % 9 AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.seq[1:h.h], []), h.seq[h.h + 1:]) AS seq FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS MATERIALIZED (SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(seq[1:depth][-1].b, 0) AS bytes,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
c AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, path)),
s AS (SELECT d AS depth, path[1:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM w, unnest(range(0, depth + 1)) u(d) GROUP BY ALL)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s USING (depth, path) LEFT JOIN n up ON up.depth = w.depth - 1 AND up.path = w.path[1:w.depth - 1]
"""

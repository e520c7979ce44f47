"""SQL for DuckDB that says the same as queries of this subpackage, in its own words."""

from __future__ import annotations

SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either(word: str) -> str:
    """A-Z in either case, nothing else."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
_KINDS = (
    ("assign", rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)


def _found(kind: str, pattern: str, group: int, least: int, place: int) -> str:
    held = f"(?s)(.*?)({pattern})"
    lists = ", ".join(f"regexp_extract_all(text, '{held}', {g}) AS {n}" for g, n in ((1, "g"), (2, "m"), (2 + group, "v")))
    return (
        f"SELECT r, '{kind}' AS kind, {place} AS o, i, e - length(m) AS s, e, length(v) >= {least} AS good FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e"
        f" FROM (SELECT r, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v, generate_subscripts(m, 1) AS i FROM (SELECT r, {lists} FROM d)))"
    )


SQL["op3_blob_ledger"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents), f AS ("
    + " UNION ALL ".join(_found(k, p, g, n, i) for i, (k, p, g, n) in enumerate(_KINDS))
    + "), x AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS t FROM f WHERE good),"
    " a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(t, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(t, ',' ORDER BY s, o) AS spans FROM x GROUP BY 1)"
    " SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"
)

SQL["op5_partenum"] = (
    f"WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),"
    " s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),"
    " n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),"
    " p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),"
    " l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),"
    " reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)"
    " SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id FROM n JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) USING (doc_id)"
)


def _draw(child: str, weight: float) -> str:
    return f"-ln((CAST(('0x' || substr(md5(k || '/{child}'), 1, 13)) AS BIGINT) + 1.0::DOUBLE) / 4503599627370497.0::DOUBLE) / {weight}::DOUBLE"


def _least(children: list[tuple[str, float]]) -> str:
    if len(children) == 1:
        return f"'{children[0][0]}'"
    return "list_sort([" + ", ".join(f"{{'d': {_draw(c, w)}, 'c': '{c}'}}" for c, w in children) + "])[1].c"


def _level(shards: int) -> str:
    """Two shards a rack, two racks a region."""
    regions: dict[str, dict[str, list[int]]] = {}
    for i in range(shards):
        regions.setdefault(f"r{i // 4}", {}).setdefault(f"k{i // 2}", []).append(i)
    top = _least([(r, float(sum(map(len, x.values())))) for r, x in regions.items()])
    racks = "CASE r " + " ".join(f"WHEN '{r}' THEN {_least([(k, float(len(v))) for k, v in x.items()])}" for r, x in regions.items()) + " END"
    leaves = "CASE q " + " ".join(f"WHEN '{k}' THEN {_least([(str(i), 1.0) for i in v])}" for x in regions.values() for k, v in x.items()) + " END"
    return f"SELECT i, CAST({leaves} AS INTEGER) AS shard FROM (SELECT *, {racks} AS q FROM (SELECT *, {top} AS r FROM d))"


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(range(1, CAST(octet_length(encode(text)) AS BIGINT) + 1), lambda j: CAST(('0x' || substr(h, 2 * j - 1, 2)) AS BIGINT))"
SQL["op7_hash_tree"] = (
    "WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),"
    f" t AS (SELECT {_CRC_TABLE} AS t), c AS (SELECT i, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM d, t),"
    f" a AS ({_level(8)}), g AS ({_level(9)}), x AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, a.shard, g.shard AS grown_shard FROM d JOIN c USING (i) JOIN a USING (i) JOIN g USING (i))"
    " SELECT doc_id, size, text_crc32, law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard FROM x"
)


def _unit(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


SQL["op9_poisson_mix"] = (
    "WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY 1), q AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size ELSE 0 END AS rate FROM s),"
    " p AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM q WHERE rate > 0)),"
    f" d AS (SELECT row_number() OVER () AS i, *, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, {_unit("'mix-1/' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS u FROM documents),"
    " c AS (SELECT d.i, count(*) FILTER (p.upto < d.u) AS n FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source GROUP BY 1)"
    f" SELECT doc_id, source, text, round(rate, 6) AS rate, CAST(n AS INTEGER) AS n_copies, CAST(j AS INTEGER) AS copy, round({_unit("'mix-1/order/' || id || '/' || j")}, 9) AS shuffle_key FROM (SELECT d.doc_id, d.source, d.text, d.id, q.rate, c.n, unnest(range(1, c.n + 1)) AS j FROM d JOIN c USING (i) JOIN q ON q.source IS NOT DISTINCT FROM d.source)"
)

SQL["op10_warc"] = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p)"
    " SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to, CAST(1 AS INTEGER) AS n_requests, CAST(1 AS INTEGER) AS n_metadata FROM m"
)

"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from examloom.llm import bcr, fmindex, hardneg, licenses, merkle, quality

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_sql() -> str:
    lengths = sorted({*quality.MAX_NGRAM_SHARE, quality.WINDOW})
    grams = ", ".join(f"CASE WHEN p + {n} - 1 <= n_words THEN md5(array_to_string(w[p:p + {n} - 1], ' ')) END AS g{n}" for n in lengths)
    twice = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 THEN 1 ELSE 0 END AS t{n}" for n in lengths)
    inside = ", ".join(f"max(t{n}) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    sums = ", ".join(f"sum(CASE WHEN c{n} = 1 THEN length(x) ELSE 0 END) AS s{n}" for n in quality.MAX_NGRAM_SHARE)
    shares = ", ".join(f"coalesce(s{n}, 0) / greatest(chars, 1)::DOUBLE AS share_{n}" for n in quality.MAX_NGRAM_SHARE)
    bad = " OR ".join([f"share_{n} > {m}" for n, m in quality.MAX_NGRAM_SHARE.items()] + [f"line_share > {quality.MAX_LINE_SHARE}"])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
b AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, n_words, w FROM b),
g AS (SELECT doc_id, x, p, {grams} FROM e), t AS (SELECT doc_id, x, p, {twice} FROM g), c AS (SELECT doc_id, x, {inside} FROM t),
s AS (SELECT doc_id, sum(c{quality.WINDOW}) AS n_repeat_words, {sums} FROM c GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
m AS (SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS z, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r FROM l),
o AS (SELECT doc_id, count(*) FILTER (r > 1 AND z > 0) AS n_dup_lines, sum(z) FILTER (r > 1) AS dup_chars FROM m GROUP BY 1),
f AS (SELECT b.doc_id, n_words::BIGINT AS n_words, chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(dup_chars, 0) / greatest(chars, 1)::DOUBLE AS line_share, {shares}, n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.MAX_WINDOW_PERCENT} * n_words AS base_failed
  FROM b LEFT JOIN s USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT *, NOT (base_failed OR {bad}) AS kept FROM f"""


def substring_sql(w: int = fmindex.WINDOW) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, w FROM d),
g AS (SELECT doc_id, x, p, CASE WHEN p + {w} - 1 <= len(w) THEN md5(array_to_string(w[p:p + {w} - 1], ' ')) END AS k FROM e),
t AS (SELECT doc_id, x, p, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS t FROM g),
c AS (SELECT doc_id, x, p, max(t) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS c FROM t),
s AS (SELECT doc_id, count(*) AS n, sum(c) AS gone, string_agg(x, ' ' ORDER BY p) FILTER (c = 0) AS kept FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""


def neardup_sql(width: int = 3, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
e AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS k FROM d),
s AS (SELECT DISTINCT doc_id, k FROM e), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {percent} * (a.n + b.n - i)),
z AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, reach) AS (SELECT x, x FROM z UNION SELECT r.node, z.y FROM r JOIN z ON r.reach = z.x),
c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


def passages_sql(w: int = bcr.WINDOW) -> str:
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
l AS (SELECT r, range(octet_length(x)) AS ps, x FROM d),
w AS MATERIALIZED (SELECT r, unnest(ps) AS p, unnest(list_transform(ps, lambda i: CASE WHEN i + {w} <= octet_length(x) THEN md5(x[i + 1:i + {w}]) END)) AS k, unnest(list_transform(ps, lambda i: hex(x[i + 1:i + 1]))) AS c FROM l),
t AS (SELECT r, p, c, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS t FROM w),
g AS (SELECT r, p, c, max(t) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS g FROM t),
e AS (SELECT *, g = 1 AND coalesce(lag(g) OVER (PARTITION BY r ORDER BY p), 0) = 0 AS begins FROM g),
s AS (SELECT r, sum(g) AS gone, count(*) FILTER (begins) AS spans, string_agg(c, '' ORDER BY p) FILTER (g = 0) AS kept FROM e GROUP BY 1)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


def negatives_sql() -> str:
    return f"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor({hardneg.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {hardneg.POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS k FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  WHERE {hardneg.LEAST} * positive_score <= 100 * score AND 100 * score <= {hardneg.MOST} * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= {hardneg.NEGATIVES}"""


def manifest_sql(depth: int = 7) -> str:
    """For groups of up to 16 ** depth nodes."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + "))"
    # CRC-32 of the decimal id: bytes in turn, eight steps for each.
    step = "list_reduce([xor(crc, ascii(c)), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: {step.replace('ascii(c)', 'b')}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, {leaf('text_')} AS shown FROM (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS text_ FROM documents))",
        "l0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]

    def climb(name: str, group: str) -> str:
        """The levels name0, name1, ... of a tree; pre and post of each node, and its parent."""
        for k in range(depth):
            run = f"PARTITION BY {group}, idx // {merkle.FAN} ORDER BY idx"
            sides = ", ".join(f"CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN {a} AND {b}), '') END AS {side}" for side, a, b in (("pre", "UNBOUNDED PRECEDING", "1 PRECEDING"), ("post", "1 FOLLOWING", "UNBOUNDED FOLLOWING")))
            parts.append(f"{name}s{k} AS (SELECT {group}, idx, n, digest, {sides} FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT {group}, idx // {merkle.FAN} AS idx, (max(n) + {merkle.FAN - 1}) // {merkle.FAN} AS n, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}{k} GROUP BY 1, 2)")
        return f"{name}{depth}"

    subroots = climb("l", "g")
    parts.append(f"t0 AS (SELECT 0 AS one, g, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM {subroots})")
    root = climb("t", "one")
    parts.append("j AS (SELECT l0.*, t0.idx AS top, t0.digest AS subroot FROM l0 JOIN t0 USING (g))")
    joins, siblings = "", []
    for name, at, on in (("l", "j.idx", "{0}.g = j.g AND "), ("t", "j.top", "")):
        for k in range(depth):
            x = f"{name}s{k}"
            joins += f" JOIN {x} ON {on.format(x)}{x}.idx = {at} // {merkle.FAN**k}"
            siblings += [f"{x}.pre", f"{x}.post"]
    columns = ", ".join(f"{x}.pre AS p{i}, {x}.post AS q{i}" for i, x in enumerate(s[:-4] for s in siblings[::2]))
    parts.append(f"w AS (SELECT doc_id, leaf, shown, subroot, {root}.digest AS root, {columns} FROM j{joins} JOIN {root} ON true)")
    last = "w"
    for i in range(2 * depth):
        parts.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN p{i} IS NULL THEN shown ELSE sha256(concat(p{i}, shown, q{i})) END AS shown) FROM {last})")
        last = f"f{i}"
    all_siblings = ", ".join(f"p{i}, q{i}" for i in range(2 * depth))
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(concat({all_siblings})) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM {last}"


ORACLE_SQL = {
    "op3_suffix_dedup": passages_sql(),
    "op4_license_scan": licenses.ORACLE_SQL,
    "op6_minhash_neardup": neardup_sql(),
    "op7_substring_dedup": substring_sql(),
    "op8_quality_rules": quality_sql(),
    "op12_hard_negatives": negatives_sql(),
    "op13_merkle_manifest": manifest_sql(),
}

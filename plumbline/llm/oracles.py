"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Table of CRC-32 and a scalar for a text; DuckDB has no crc32.
CRC_TABLE = """crc_steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text, where crc_table is in scope."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def merkle(levels: int = 6) -> str:
    """op13: trees of 16 ** levels rows a source at most, level by level with window functions."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hashed = lambda text: "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
    steps = [
        CRC_TABLE,
        f"raw AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {hashed(lowered)} ELSE {hashed('text')} END AS claim FROM documents, crc_steps)",
        "sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM raw))",
        "leaves AS (SELECT raw.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM raw JOIN sources ON raw.source IS NOT DISTINCT FROM sources.source)",
        "t0 AS (SELECT tree, idx, leaf AS node FROM leaves)",
    ]

    def climb(name: str, depth: int) -> None:
        for k in range(depth):
            steps.append(
                f"{name}s{k} AS (SELECT tree, idx, count(*) OVER (PARTITION BY tree) AS n, node, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            steps.append(f"{name}{k + 1} AS (SELECT DISTINCT tree, idx // 16 AS idx, CASE WHEN n = 1 THEN node ELSE sha256(l || node || r) END AS node FROM {name}s{k})")

    climb("t", levels)
    steps.append(f"u0 AS (SELECT 0 AS tree, tree AS idx, node FROM t{levels})")
    climb("u", 3)
    steps.append("f0 AS (SELECT doc_id, source, leaf, tree, idx, claim AS fold, '' AS proof FROM leaves)")
    for k in range(levels + 3):
        name, tree, idx = (f"ts{k}", "f.tree", f"f.idx // {16**k}") if k < levels else (f"us{k - levels}", "0", f"f.tree // {16 ** (k - levels)}")
        fold = "CASE WHEN s.n = 1 THEN fold ELSE sha256(l || fold || r) END"
        steps.append(f"f{k + 1} AS (SELECT doc_id, source, leaf, f.tree, f.idx, {fold} AS fold, proof || l || r AS proof FROM f{k} f JOIN {name} s ON s.tree = {tree} AND s.idx = {idx})")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, source, leaf, t{levels}.node AS subroot, u3.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u3.node AS verified
FROM f{levels + 3} f JOIN t{levels} ON t{levels}.tree = f.tree, u3"""
    )


#: op12: words that share a form with one code point left out, at the same place (replaced) or where one of them is that form (inserted).
SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n, length(run) AS m FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, m, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per_doc, crc_steps),
slipped AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % m)::INT) || substr(run, (h % m)::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS m FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(m)) AS k FROM words)),
pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.rest
  UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.rest),
best AS (SELECT word, count(*) AS n_near, min(CASE WHEN near_n >= 10 * n THEN (-near_n, near) END) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, b[2] AS form, -b[1] AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS place, form_n AS place_n FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form, forms.form_n FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(place, place_n) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""

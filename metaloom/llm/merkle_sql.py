"""SQL of the Merkle manifest: levels are written out, enough for sixteen million leaves a source."""

from __future__ import annotations

#: CRC-32 (reflected polynomial 0xEDB88320) of an ASCII string.
CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda b: ascii(b)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""
LEVELS = 6


def crc32(text: str) -> str:
    return CRC32.format(text)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _climb(name: str, start: str) -> tuple[str, str, str]:
    """CTEs that grow trees from ``start`` (tree, r, digest) and, of each leaf, its siblings and both folds; the last level's name; the path's columns."""
    parts = [f"{name}0 AS (SELECT tree, r, digest, count(*) OVER (PARTITION BY tree) AS n FROM {start})"]
    for k in range(1, LEVELS + 1):
        below = f"{name}{k - 1}"
        parts.append(
            f"{name}{k} AS (SELECT tree, r // 16 AS r, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY {below}.r)) END AS digest, "
            f"(any_value(n) + 15) // 16 AS n FROM {below} GROUP BY tree, {below}.r // 16)"
        )
        # Of each node its siblings, before and after.
        parts.append(
            f"{name}s{k - 1} AS (SELECT a.tree, a.r, any_value(a.n) AS n, coalesce(string_agg(b.digest, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS rgt "
            f"FROM {below} a JOIN {below} b ON a.tree = b.tree AND a.r // 16 = b.r // 16 GROUP BY a.tree, a.r)"
        )
    joins = " ".join(f"JOIN {name}s{k} ON {name}s{k}.tree = x.tree AND {name}s{k}.r = x.rank // {16**k}" for k in range(LEVELS))
    proof = " || ".join(f"{name}s{k}.lft || {name}s{k}.rgt" for k in range(LEVELS))
    return ",\n".join(parts), joins, proof


def manifest_sql() -> str:
    own, joins, proof = _climb("l", "ranked")
    top, top_joins, top_proof = _climb("t", "subs")
    steps = []
    for k in range(LEVELS):
        steps.append(f"f{k + 1} AS (SELECT x.* EXCLUDE (h), CASE WHEN s.n = 1 THEN x.h ELSE sha256(s.lft || x.h || s.rgt) END AS h FROM f{k} x JOIN ls{k} s ON s.tree = x.tree AND s.r = x.rank // {16**k})")
    for k in range(LEVELS):
        steps.append(f"g{k + 1} AS (SELECT x.* EXCLUDE (h), CASE WHEN s.n = 1 THEN x.h ELSE sha256(s.lft || x.h || s.rgt) END AS h FROM {f'g{k}' if k else f'f{LEVELS}'} x JOIN ts{k} s ON s.r = x.sub // {16**k})")
    crc = crc32("doc_id::VARCHAR")
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, sha256({" || ".join([*fields, _field("text")])}) AS leaf,
         sha256({" || ".join([*fields, f"CASE WHEN {crc} % 5 = 0 THEN {_field(lowered)} ELSE {_field('text')} END"])}) AS given FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
ranked AS (SELECT tree, rank AS r, leaf AS digest FROM x),
{own},
subs AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS r, tree AS sub, digest FROM l{LEVELS}),
{top},
lp AS (SELECT x.tree, x.rank, {proof} AS p FROM x {joins}),
tp AS (SELECT x.sub AS tree, x.r AS sub, x.digest AS subroot, {top_proof} AS p FROM (SELECT *, r AS rank FROM subs) x {top_joins}),
f0 AS (SELECT x.tree, x.rank, x.doc_id, x.leaf, tp.sub, tp.subroot, lp.p || tp.p AS p, x.given AS h FROM x JOIN lp ON lp.tree = x.tree AND lp.rank = x.rank JOIN tp ON tp.tree = x.tree),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, h AS folded_root, h = root AS verified FROM g{LEVELS}, (SELECT digest AS root FROM t{LEVELS})"""

"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

#: levels of the Merkle SQL: groups of up to 8 ** 7 rows, up to 8 ** 3 groups
_ROW_LEVELS, _GROUP_LEVELS = 7, 3


def _crc32(text: str) -> str:
    """crc32 of a text's bytes (ASCII), bit by bit."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: cast(ord(ch) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda a, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    items = [f"coalesce(cast(strlen({c}) as varchar) || ':' || {c}, '-')" for c in
             ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)]
    return f"sha256({' || '.join(items)})"


def merkle_manifest() -> str:
    """Trees hashed up level by level; each row's way is folded from the siblings of its runs."""
    parts = [f"""d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("cast(doc_id as varchar)")} % 3 = 0
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf("text")} END AS shown
  FROM documents)""",
             """p AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)""",
             "a0 AS (SELECT lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p)",
             "f0 AS (SELECT id, lang, pos, shown AS cur, '' AS proof FROM p)"]

    def level(a: str, f: str, k: int, group: str, fold_group: str) -> list[str]:
        return [f"""{a}r{k} AS (
  SELECT {group}, pos // 8 AS run, list(h ORDER BY pos) AS hs, max(n) AS n FROM {a}{k} GROUP BY ALL)""",
                f"""{a}{k + 1} AS (
  SELECT {group}, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h,
         (n + 7) // 8 AS n FROM {a}r{k})""",
                f"""{f}{k + 1} AS (
  SELECT w.id, w.lang, w.pos // 8 AS pos,
         CASE WHEN r.n = 1 THEN cur ELSE sha256(array_to_string(hs[1:w.pos % 8], '') || cur
              || array_to_string(hs[w.pos % 8 + 2:], '')) END AS cur,
         proof || array_to_string(hs[1:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:], '') AS proof
  FROM {f}{k} w JOIN {a}r{k} r ON {fold_group} AND w.pos // 8 = r.run)"""]

    for k in range(_ROW_LEVELS):
        parts += level("a", "f", k, "lang", "w.lang IS NOT DISTINCT FROM r.lang")
    parts += [f"""b0 AS (
  SELECT 0 AS top, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM a{_ROW_LEVELS})""",
              f"""g0 AS (
  SELECT w.id, w.lang, b.pos, w.cur, w.proof FROM f{_ROW_LEVELS} w JOIN b0 b ON w.lang IS NOT DISTINCT FROM b.lang)"""]
    for k in range(_GROUP_LEVELS):
        parts += level("b", "g", k, "top", "true")
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root,
       g.cur = t.h AS verified
FROM p JOIN g{_GROUP_LEVELS} g ON p.id = g.id JOIN b0 s ON p.lang IS NOT DISTINCT FROM s.lang
     CROSS JOIN b{_GROUP_LEVELS} t"""


#: smallest id reachable by links, from relations ids(id) and links(x, y)
_REACH = """reach(x, y) AS (
  SELECT id, id FROM ids UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)"""


def ngram_jaccard() -> str:
    """All pairs of documents that share a shingle, compared by exact counts; components by recursion."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                        ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
ids AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.x = d.doc_id""".replace("\\\\", "\\")


def embedding_links() -> str:
    """Cosines of all pairs of one label in double precision; components by recursion."""
    return f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.x = vec_id"""


ORACLE_SQL = {
    "op8_ngram_jaccard": ngram_jaccard(),
    "op9_grid_order_join": embedding_links(),
    "op12_merkle_butterfly": merkle_manifest(),
}

"""The manifest of documents in SQL: trees as lists, one column for each level."""

from __future__ import annotations

#: Levels told apart: up to 3 ** 12 rows of a source and 3 ** 8 sources.
ROWS, SOURCES = 12, 8
CRC32_POLYNOMIAL = 0xEDB88320


def crc32(text: str) -> str:
    """CRC-32 of text without characters beyond ASCII, half a byte at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (CRC32_POLYNOMIAL if c & 1 else 0)
        table.append(c)
    halves = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(ord(ch) & 15 AS BIGINT), CAST(ord(ch) >> 4 AS BIGINT)]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, h: xor(c >> 4, list_extract(CAST({table} AS BIGINT[]), 1 + (xor(c, h) & 15)))), 4294967295)"


def row_digest(fields: list[str]) -> str:
    return f"sha256({' || '.join(f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)})"


def tree(name: str, of: str, keys: str, depth: int) -> str:
    """CTEs that add to ``of``, which has the leaves as l0, the levels above; the last one, ``name``, has ``top`` too."""
    out, last = [], of
    for k in range(depth):
        up = f"CASE WHEN len(l{k}) < 2 THEN l{k} ELSE list_transform(range(0, (len(l{k}) + 2) // 3), lambda i: sha256(array_to_string(l{k}[3 * i + 1:3 * i + 3], ''))) END"
        last, before = f"{name}{k + 1}", last
        out.append(f"{last} AS (SELECT *, {up} AS l{k + 1} FROM {before})")
    lists = ", ".join(f"l{k} AS {name}_l{k}" for k in range(depth))
    return ",\n".join([*out, f"{name} AS (SELECT {keys}, {lists}, l{depth}[1] AS {name}_top FROM {last})"])


def steps(name: str, at: str, depth: int) -> list[tuple[str, str, str]]:
    """(whether the level has siblings, those before, those after) for each level."""
    out = []
    for k in range(depth):
        row, own, run = f"{name}_l{k}", f"({at} // {3**k})", f"({at} // {3 ** (k + 1)})"
        out.append((f"len({row}) > 1", f"array_to_string({row}[3 * {run} + 1:{own}], '')", f"array_to_string({row}[{own} + 2:3 * {run} + 3], '')"))
    return out


def sql() -> str:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    forged = [f if f != "text" else "replace(text, chr(10), '')" for f in fields]
    path = [*steps("t", "i", ROWS), *steps("s", "g", SOURCES)]
    folds, last = [], "placed"
    for k, (some, before, after) in enumerate(path):
        last, of = f"fold{k}", last
        folds.append(f"{last} AS (SELECT * EXCLUDE (now), CASE WHEN {some} THEN sha256({before} || now || {after}) ELSE now END AS now FROM {of})")
    return f"""WITH leaves AS (
  SELECT doc_id, source, {row_digest(fields)} AS leaf, {row_digest(forged)} AS other, {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i
  FROM documents
), sources AS (SELECT source, list(leaf ORDER BY doc_id) AS l0 FROM leaves GROUP BY source),
{tree("t", "sources", "source", ROWS)},
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM t),
tops AS (SELECT list(t_top ORDER BY g) AS l0 FROM ranked),
{tree("s", "tops", "1 AS one", SOURCES)},
placed AS (
  SELECT leaves.*, ranked.* EXCLUDE (source), s.*, CASE WHEN tampered THEN other ELSE leaf END AS now
  FROM leaves JOIN ranked ON leaves.source IS NOT DISTINCT FROM ranked.source, s
),
{", ".join(folds)}
SELECT doc_id, source, leaf, t_top AS subroot, s_top AS root, sha256({" || ".join(f"{b} || {a}" for _, b, a in path)}) AS proof_sha256, now AS folded_root, now = s_top AS verified
FROM {last}"""

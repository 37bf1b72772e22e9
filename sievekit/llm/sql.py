"""DuckDB SQL of corpus queries whose rows SQL can say."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """CRC-32 of a string of digits: eight rounds of the polynomial for each byte."""
    rounds = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {rounds}), 4294967295)"


def merkle_sql(levels: int = 8, source_levels: int = 4) -> str:
    """The manifest, with one step of the trees for each level; levels above a single node change nothing."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(concat(" + ", ".join(field.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
    low = LOWERED.format("text")
    meant = f"({crc32_sql('doc_id::VARCHAR')}) % 5 = 0"
    parts = [
        f"""WITH docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
    {leaf.format(field.format("text"))} AS leaf,
    CASE WHEN {meant} THEN {leaf.format(field.format(low))} END AS tampered
  FROM documents)""",
        """a0 AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS m FROM docs)""",
    ]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            run = "(PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN "
            parts.append(
                f"""{name}s{k} AS (
  SELECT tree, i, m, coalesce(string_agg(h, '') OVER {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"""
            )
            parts.append(
                f"""{name}{k + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h,
    (m + 15) // 16 AS m FROM {name}{k} GROUP BY tree, i // 16, m)"""
            )

    climb("a", levels)
    parts.append(
        f"b0 AS (SELECT '' AS tree, tree AS below, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM a{levels})"
    )
    climb("b", source_levels)
    parts.append(
        f"""f0 AS (
  SELECT a0.tree, a0.i, b0.i AS j, a0.doc_id, a0.leaf, b0.h AS subroot, (SELECT h FROM b{source_levels}) AS root,
    coalesce(a0.tampered, a0.leaf) AS node, '' AS proof
  FROM a0 JOIN b0 ON a0.tree = b0.below)"""
    )
    at = 0
    for name, n, tree, place in (("a", levels, "f.tree", "f.i"), ("b", source_levels, "''", "f.j")):
        for k in range(n):
            moved = "f.i // 16 AS i, f.j" if name == "a" else "f.i, f.j // 16 AS j"
            parts.append(
                f"""f{at + 1} AS (
  SELECT f.tree, {moved}, doc_id, leaf, subroot, root,
    CASE WHEN s.m > 1 THEN sha256(concat(s.l, node, s.r)) ELSE node END AS node, concat(proof, s.l, s.r) AS proof
  FROM f{at} f JOIN {name}s{k} s ON s.tree = {tree} AND s.i = {place})"""
            )
            at += 1
    return ",\n".join(parts) + (
        f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{at}"
    )

COLLOCATIONS_SQL = rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {LOWERED.format("coalesce(text, '')")} AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS longer WHERE longer.lang = c.lang AND longer.k > c.k AND longer.f >= c.f
      AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest
  FROM kept, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, j, l.f AS l, r.f AS r, n.n AS n,
    (1000::HUGEINT * cuts.f * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN n USING (lang) JOIN f AS l ON l.lang = cuts.lang AND l.phrase = head
    JOIN f AS r ON r.lang = cuts.lang AND r.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

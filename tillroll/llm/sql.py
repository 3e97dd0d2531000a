"""SQL with the same rows as the operators it can express."""

from __future__ import annotations

from tillroll.llm.sharding import SHARDS

_DRAW = "((('0x' || substr(md5(concat(doc_id, ':{s}')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _least(shards: int) -> str:
    scores = ", ".join(f"-ln({_DRAW.format(s=s)})" for s in range(shards))
    return f"list_position([{scores}], list_min([{scores}])) - 1"


# The checksum byte by byte, with the usual table of its reflected polynomial.
_CRC_TABLE = """steps AS (
    SELECT i AS byte, i AS value, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT byte,
           CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END,
           k + 1
    FROM steps WHERE k < 8
), crc_table AS (SELECT list(value ORDER BY byte) AS crc FROM steps WHERE k = 8)"""
_CRC = """xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(
                   regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                   lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"""

SHARDING = f"""
WITH RECURSIVE {_CRC_TABLE}, placed AS (
    SELECT doc_id,
           strlen(coalesce(text, '')) + 1 AS size,
           {_CRC} AS text_crc32,
           {_least(SHARDS)} AS shard,
           {_least(SHARDS + 1)} AS grown_shard,
           md5(concat(doc_id)) AS digest
    FROM documents, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (
           PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST, text_crc32, size
       ) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""

# With sources in the order in which they reach their ceiling, stopping the first
# k leaves a level for the others; the largest level is the true one.
MIXING = """
WITH sized AS (
    SELECT doc_id, source, md5(concat(doc_id)) AS digest,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT)
               AS size
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
               WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS third
    FROM sized GROUP BY source
), ordered AS (
    SELECT *,
           (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0)) / 2.0
               / sum(weight) OVER after AS level
    FROM sources
    WINDOW before AS (
               ORDER BY source_size::DOUBLE / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (
               ORDER BY source_size::DOUBLE / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
    SELECT source, source_size,
           CASE third WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS first,
           CASE third WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS last,
           least(2.0 * source_size,
                 weight * max(level) OVER ()) AS target
    FROM ordered
), placed AS (
    SELECT *, coalesce(sum(size) OVER (
               PARTITION BY source ORDER BY digest, doc_id NULLS FIRST, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized JOIN targets USING (source)
), readings AS (
    SELECT *, CAST(round(target) AS BIGINT) AS due,
           greatest(0, least(size, round(target) - ahead)) AS read_first,
           greatest(0, least(size, round(target) - source_size - ahead)) AS read_second,
           least(1.0::DOUBLE, ahead::DOUBLE / greatest(due, 1)) * (first + last) / 2 AS met,
           least(1.0::DOUBLE, (ahead + source_size)::DOUBLE / greatest(due, 1))
               * (first + last) / 2 AS met_again
    FROM placed
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(read_first + read_second AS BIGINT) AS taken,
       CASE WHEN read_first <= 0 THEN NULL WHEN met <= 0 THEN 0
            ELSE 2 * met / (first + sqrt(greatest(
                0, first * first + 2 * (last - first) * met))) END AS position,
       CASE WHEN read_second <= 0 THEN NULL WHEN met_again <= 0 THEN 0
            ELSE 2 * met_again / (first + sqrt(greatest(
                0, first * first + 2 * (last - first) * met_again))) END AS second_position
FROM readings
"""


# A list of field digests, then one step for each level: enough for 16^5 records of a
# source and 16^4 sources.
_DOC_LEVELS, _SOURCE_LEVELS = 5, 4


def _field(expression: str) -> str:
    text = f"CAST({expression} AS VARCHAR)"
    return f"coalesce(concat(strlen({text}), ':', {text}), '-')"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256(concat({', '.join(_field(f) for f in fields)}))"


def _tree_steps(name: str, levels: int) -> list[str]:
    """Levels ``name0`` to ``nameL`` with the runs of siblings of each."""
    steps = []
    for k in range(levels):
        steps.append(
            f"{name}_runs{k} AS (SELECT grp, place // 16 AS run, n, list(h ORDER BY place) AS hs "
            f"FROM {name}{k} GROUP BY grp, place // 16, n)"
        )
        steps.append(
            f"{name}{k + 1} AS (SELECT grp, run AS place, (n + 15) // 16 AS n, CASE WHEN n = 1 "
            f"THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_runs{k})"
        )
    return steps


def _fold_steps(tree: str, name: str, levels: int) -> list[str]:
    """Folding along the runs of ``tree``, from ``name0`` to ``nameL``."""
    steps = []
    for k in range(levels):
        before = "array_to_string(hs[1:place % 16], '')"
        after = "array_to_string(hs[place % 16 + 2:], '')"
        steps.append(
            f"{name}{k + 1} AS (SELECT f.* EXCLUDE (place, acc, proof), f.place // 16 AS place, "
            f"CASE WHEN r.n = 1 THEN acc ELSE sha256({before} || acc || {after}) END AS acc, "
            f"proof || {before} || {after} AS proof "
            f"FROM {name}{k} f JOIN {tree}_runs{k} r ON f.grp = r.grp AND f.place // 16 = r.run)"
        )
    return steps


_LOWERED = (
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_ID_CRC = _CRC.replace("text", "CAST(doc_id AS VARCHAR)")
_MANIFEST_STEPS = [
    f"""digests AS MATERIALIZED (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {_ID_CRC} % 5 = 0
                THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS seen
    FROM documents, crc_table
)""",
    """leaves AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
           row_number() OVER (
               PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n
    FROM digests
)""",
    "node0 AS (SELECT grp, place, n, leaf AS h FROM leaves)",
    *_tree_steps("node", _DOC_LEVELS),
    f"""top0 AS (
    SELECT 0 AS grp, grp AS place, count(*) OVER () AS n, h FROM node{_DOC_LEVELS}
)""",
    *_tree_steps("top", _SOURCE_LEVELS),
    """path0 AS (
    SELECT doc_id, leaf, grp, place, seen AS acc, '' AS proof FROM leaves
)""",
    *_fold_steps("node", "path", _DOC_LEVELS),
    f"""climb0 AS (
    SELECT p.doc_id, p.leaf, s.h AS subroot, 0 AS grp, p.grp AS place, p.acc, p.proof
    FROM path{_DOC_LEVELS} p JOIN node{_DOC_LEVELS} s USING (grp)
)""",
    *_fold_steps("top", "climb", _SOURCE_LEVELS),
]

MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE}, {", ".join(_MANIFEST_STEPS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256,
       acc AS folded_root, acc = h AS verified
FROM climb{_SOURCE_LEVELS} JOIN top{_SOURCE_LEVELS} USING (grp)
"""


_PARTS, _ENTRIES, _ROUNDS, _WIDTH = 8, 16, 6, 8
_SQUARED = " + ".join(f"(p.v[{i}] - b.v[{i}]) * (p.v[{i}] - b.v[{i}])" for i in range(1, _WIDTH + 1))
_MEANS = ", ".join(
    f"CAST(floor(sum(v[{i}]) / CAST(count(*) AS DOUBLE)) AS BIGINT)" for i in range(1, _WIDTH + 1)
)


def _nearest(round_: int) -> str:
    """Each part with its nearest entry: the least of (distance, index)."""
    return f"""near{round_} AS MATERIALIZED (
    SELECT p.vec_id, p.part, any_value(p.v) AS v,
           min({{'apart': {_SQUARED}, 'entry': b.entry}}) AS best
    FROM parts p JOIN book{round_} b USING (part) GROUP BY p.vec_id, p.part
)"""


def _refined(round_: int) -> str:
    """Entries of the next round; one without points stays."""
    return f"""book{round_ + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
    FROM book{round_} b LEFT JOIN (
        SELECT part, best.entry AS entry, [{_MEANS}] AS v
        FROM near{round_} GROUP BY part, best.entry
    ) m USING (part, entry)
)"""


_CODE_STEPS = [
    """kept AS MATERIALIZED (
    SELECT vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
    f"""parts AS MATERIALIZED (
    SELECT vec_id, part, v[part * {_WIDTH} + 1:part * {_WIDTH} + {_WIDTH}] AS v
    FROM kept, range({_PARTS}) t(part)
)""",
    f"""book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
    FROM parts QUALIFY entry < {_ENTRIES}
)""",
    *[step(k) for k in range(_ROUNDS) for step in (_nearest, _refined)],
    _nearest(_ROUNDS),
    f"""coded AS (
    SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
           CAST(sum(best.apart) AS BIGINT) AS error
    FROM near{_ROUNDS} GROUP BY vec_id
)""",
    f"""digest AS (
    SELECT sha256(string_agg(CAST(v[at_] AS VARCHAR), ',' ORDER BY part, entry, at_)) AS sha
    FROM book{_ROUNDS}, range(1, {_WIDTH + 1}) t(at_)
)""",
]

# Means are below 2^53 in these tables, so their floors in doubles are exact.
CODES = f"""
WITH {", ".join(_CODE_STEPS)}
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""

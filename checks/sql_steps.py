"""SQL for the sequence steps over long rows ``keys, date, day, token, pos``."""

from checks.standins import sql_uniform

AGE = "'AGE:' || CAST(floor(date_diff('day', birth, fe) / 365) AS BIGINT)"


def age(src: str, keys: str = "person_id", cond: str = "TRUE") -> str:
    return f"""SELECT {keys}, date, day, pos, CASE WHEN token LIKE 'AGE%' AND fe IS NOT NULL AND birth IS NOT NULL AND {cond} THEN {AGE} ELSE token END AS token
FROM (SELECT *, min(date) FILTER (WHERE day <> 0) OVER w AS fe, min(date) FILTER (WHERE day = 0) OVER w AS birth
      FROM ({src}) WINDOW w AS (PARTITION BY {keys}))"""


def rebase(src: str, keys: str, cond: str) -> str:
    return f"""SELECT * EXCLUDE (day), CASE WHEN day <> 0 AND {cond} THEN day - d0 + 1 ELSE day END AS day
FROM (SELECT *, min(day) FILTER (WHERE day <> 0) OVER (PARTITION BY {keys}) AS d0 FROM ({src}))"""


def trim_length(src: str, length: int, keys: str = "person_id") -> str:
    kept = f"""SELECT *, n >= {length - 1} AS cut FROM (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, count(*) FILTER (WHERE day = 0) OVER (PARTITION BY {keys}) AS b,
    row_number() OVER (PARTITION BY {keys}, day <> 0 ORDER BY pos DESC) AS back FROM ({src}))
WHERE n < {length - 1} OR day = 0 OR back <= greatest({length - 1} - b, 0)"""
    return age(rebase(kept, keys, "cut"), keys, "cut")


def trim_position(src: str, position: int, keys: str = "person_id", cond: str = "TRUE") -> str:
    shifted = f"""SELECT * EXCLUDE (day), CASE WHEN day <> 0 AND cut THEN day - top + {position - 1} ELSE day END AS day, day AS was
FROM (SELECT *, max(day) OVER (PARTITION BY {keys}) AS top, max(day) OVER (PARTITION BY {keys}) >= {position} AND {cond} AS cut FROM ({src}))"""
    kept = f"SELECT * FROM ({shifted}) WHERE NOT cut OR was = 0 OR day > 0"
    return age(rebase(kept, keys, "cut"), keys, "cut")


def random_window(src: str, length: int, position: int, seed: str, keys: str = "person_id") -> str:
    ranked = f"""SELECT *, n > {length} AS long, least(greatest({length} - b, 0), n - b) AS w,
  row_number() OVER (PARTITION BY {keys}, day <> 0 ORDER BY pos) - 1 AS e
FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, count(*) FILTER (WHERE day = 0) OVER (PARTITION BY {keys}) AS b FROM ({src}))"""
    placed = f"SELECT *, floor({sql_uniform(seed, *keys.split(', '))} * (n - b - w + 1)) AS off FROM ({ranked})"
    kept = f"SELECT {keys}, date, day, token, pos, long FROM ({placed}) WHERE NOT long OR day = 0 OR (e >= off AND e < off + w)"
    based = f"SELECT {keys}, date, day, token, pos, long FROM ({rebase(kept, keys, 'long')})"
    flag = f"SELECT DISTINCT {keys}, long FROM ({based})"
    cut = trim_position(based, position, keys, "long")
    joined = f"SELECT c.*, f.long FROM ({cut}) c JOIN ({flag}) f USING ({keys})"
    return age(joined, keys, "long")


def samples(src: str) -> str:
    return f"""SELECT m.person_id, m.label_count, m.label, r.date, r.day, r.token, r.pos
FROM (SELECT person_id, pos, row_number() OVER (PARTITION BY person_id ORDER BY pos) - 1 AS label_count, split_part(token, ':', 2)::BIGINT AS label
      FROM ({src}) WHERE token LIKE 'LABEL%') m
JOIN ({src}) r ON r.person_id = m.person_id AND r.pos < m.pos AND r.token NOT LIKE 'LABEL%'"""


def no_repeats(src: str, keys: str) -> str:
    return f"""SELECT * EXCLUDE (nt, nd) FROM (SELECT *, lead(token) OVER w AS nt, lead(day) OVER w AS nd FROM ({src})
WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) WHERE NOT coalesce(nt = token AND nd = day, FALSE)"""


def text(src: str, keys: str = "person_id") -> str:
    return f"SELECT {keys}, string_agg(day || '@' || token, '|' ORDER BY day <> 0, pos) AS seq FROM ({src}) GROUP BY ALL"


def encoded(src: str, voc: str, length: int, keys: str = "person_id", step: int | None = None, single_age: bool = False) -> str:
    """Rows ``keys, i, id, day, type`` of the encoded sequence, ``[CLS]`` first."""
    token = "CASE WHEN token LIKE 'AGE:%' THEN 'AGE' ELSE token END" if single_age else "token"
    kind = "0"
    if step is not None:
        kind = f"CASE WHEN len(string_split(token, ':')) > 2 THEN split_part(string_split(token, ':')[-1], '-', 2)::INT // {step} ELSE 0 END"
        token = "array_to_string(string_split(token, ':')[1:2], ':')"
    return f"""SELECT {keys}, i, coalesce(v.id, (SELECT max(id) FROM {voc} WHERE token = '[UNK]')) AS id, day, type FROM (
  SELECT {keys}, i, day, type, t FROM (
    SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY day <> 0, pos) AS i, day, {kind} AS type, {token} AS t FROM ({src})
    UNION ALL SELECT DISTINCT {keys}, 0, 0, 0, '[CLS]' FROM ({src})) WHERE i < {length}) e
LEFT JOIN {voc} v ON v.token = e.t"""


def encoded_text(rows: str, keys: str = "person_id", types: bool = False) -> str:
    extra = ", string_agg(type, ',' ORDER BY i) AS token_type_ids" if types else ""
    return f"""SELECT {keys}, string_agg(id, ',' ORDER BY i) AS input_ids, string_agg(day, ',' ORDER BY i) AS position_ids,
  string_agg('1', ',') AS attention_mask{extra} FROM ({rows}) GROUP BY ALL"""

"""Query registration: a Spark callable and, where SQL can say the same, its oracle text."""
import re

QUERIES, ORACLES = {}, {}

# Views over the given tables, for the oracle side only. Order matters: later ones may use earlier ones.
VIEWS = {
    "regions": r"""SELECT doc_id AS item, unnest(range(1, len(w) + 1)) AS zone, unnest(w) AS word FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w
        FROM documents)""",
    "part_regions": """SELECT p_partkey // 100 + 1 AS item, p_partkey % 100 + 1 AS zone, p_name AS word FROM part""",
    "obs": """SELECT l_suppkey AS participant, l_partkey // 100 + 1 AS item, l_partkey % 100 + 1 AS zone,
        p_name AS word, l_extendedprice AS rt, l_quantity AS rt2, l_returnflag = 'R' AS skip
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sheet": """SELECT l_suppkey::VARCHAR AS pp_nr, l_partkey::VARCHAR AS word_id, l_partkey // 1000 + 1 AS part,
        l_partkey // 100 % 10 + 1 AS trial, (l_partkey % 100) * 7 // 6 + 1 AS position,
        CASE WHEN p_size % 10 = 0 THEN 'n' WHEN p_size % 17 = 0 THEN 'b' ELSE 's' END AS cell_type,
        CASE WHEN p_size % 10 = 0 THEN (p_size / 4.0)::DOUBLE::VARCHAR
             WHEN p_size % 17 = 0 THEN CASE WHEN p_size = 17 THEN 'true' ELSE 'false' END ELSE p_name END AS cell,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS word_skip,
        CASE WHEN l_returnflag = 'R' THEN '.' WHEN l_discount = 0 THEN '' WHEN l_tax = 0 THEN '0'
             ELSE l_extendedprice::VARCHAR END AS gaze_cell,
        CASE WHEN l_returnflag = 'R' THEN '.' ELSE l_quantity::VARCHAR END AS total_cell
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "seq": """SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS zone,
        event_type AS word, value AS y FROM events""",
    "states": """SELECT vec_id, label::BIGINT AS item,
        list_transform(range(0, 8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE)) AS h
        FROM embeddings""",
    "logits": """SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l, label AS target FROM embeddings""",
    "freq": """SELECT word AS form, count(*) AS count FROM regions GROUP BY word""",
    "layer_states": """SELECT l_partkey // 100 + 1 AS item, l_partkey % 100 + 1 AS zone, l_linenumber AS layer,
        [l_quantity / 10, l_discount * 50, l_tax * 50, dayofyear(l_shipdate)::DOUBLE / 50] AS vec FROM lineitem""",
    "means": """SELECT item, zone, count(*) AS n, avg(rt) AS mean_rt FROM obs GROUP BY item, zone""",
}


def q(expression: str, digits: int = 4) -> str:
    """Oracle twin of ``snap``."""
    scale = f"1e{digits}"
    return f"(round(({expression})::DOUBLE * {scale} + 1e-5, 0) / {scale} + 0.0)"


def with_views(body: str) -> str:
    needed, text = [], body
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            needed.append(name)
            text += " " + VIEWS[name]
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function
    return register

"""Vector functions and pooling (X*, A7)."""
from pyspark.sql import functions as F

from wordframe.catalog.registry import VIEWS, q, query
from wordframe.functions import vectors
from wordframe.functions.numeric import snap
from wordframe.operators import states as state_ops
from wordframe.plans import reading
from wordframe.sources import tables


def _norm(v):
    return f"sqrt(list_dot_product({v}, {v}))"


def _minus(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def _cos(a, b, guard="1e-12"):
    return (f"(1 - greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / "
            f"greatest({_norm(a)} * {_norm(b)}, {guard}))))")


def _rel(a, b):
    return f"({_norm(_minus(a, b))} / greatest({_norm(b)}, 1e-12))"


def _avg(a):
    return f"(list_sum({a}) / len({a}))"


def _third(a, i):
    n = f"len({a})"
    start = f"({i} * ({n} // 3) + least({i}, {n} % 3))"
    return f"{a}[{start} + 1 : {start} + {n} // 3 + ({n} % 3 > {i})::INT]"


def _pairs(stack, body):
    return f"list_transform(range(1, len({stack})), lambda i: {body})"


VIEWS["profiles"] = f"""SELECT vec_id, item, h, {_pairs('h', _cos('h[i]', 'h[i + 1]'))} AS cosine,
    {_pairs('h', f"{_norm(_minus('h[i + 1]', 'h[i]'))} / ({_norm('h[i]')} + 1e-12)")} AS relative_l2 FROM states"""


def profiles(spark, sf_dir):
    return tables.states(spark, sf_dir).select("vec_id", "h", vectors.cosine_profile(F.col("h")).alias("cosine"),
                                               vectors.relative_profile(F.col("h")).alias("relative_l2"))


def rounded(columns):
    return [snap(c.cast("double")).alias(n) for n, c in columns.items()]


@query("x01_profiles", f"""SELECT vec_id, unnest(range(1, len(cosine) + 1))::INT AS layer, {q('unnest(cosine)')} AS cosine,
    {q('unnest(relative_l2)')} AS relative_l2 FROM profiles""")
def x01(spark, sf_dir):
    rows = profiles(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("cosine", "relative_l2")).alias("i", "z"))
    return rows.select("vec_id", (F.col("i") + 1).alias("layer"), snap(F.col("z.cosine")).alias("cosine"),
                       snap(F.col("z.relative_l2")).alias("relative_l2"))


def _summaries(m):
    e, mid, late = (_avg(_third(m, i)) for i in range(3))
    return {f"total_{m}": f"list_sum({m})", f"mean_{m}": _avg(m), f"maximum_{m}": f"list_max({m})",
            f"peak_layer_{m}": f"list_position({m}, list_max({m}))", f"early_mean_{m}": e, f"middle_mean_{m}": mid,
            f"late_mean_{m}": late, f"late_minus_early_{m}": f"{late} - {e}"}


@query("x02_profile_summaries", "SELECT vec_id, " + ", ".join(
    f"{q(e)} AS {n}" for m in ("cosine", "relative_l2") for n, e in _summaries(m).items()) + " FROM profiles")
def x02(spark, sf_dir):
    columns = {}
    for m in ("cosine", "relative_l2"):
        columns.update(vectors.profile_summaries(F.col(m), m))
    return profiles(spark, sf_dir).select("vec_id", *rounded(columns))


def _shape(m):
    return {"roughness": f"list_sum(list_transform(range(1, len({m})), lambda i: abs({m}[i + 1] - {m}[i]))) / list_sum({m})",
            "centre": f"list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i] * (i - 1) / (len({m}) - 1))) / list_sum({m})",
            "peak_share": f"list_max({m}) / list_sum({m})"}


@query("x03_profile_shape", "SELECT vec_id, " + ", ".join(
    f"{q(e)} AS {m}_{n}" for m in ("cosine", "relative_l2") for n, e in _shape(m).items()) + " FROM profiles")
def x03(spark, sf_dir):
    columns = {f"{m}_{n}": c for m in ("cosine", "relative_l2") for n, c in vectors.profile_shape(F.col(m)).items()}
    return profiles(spark, sf_dir).select("vec_id", *rounded(columns))


@query("x04_pair_distance", f"""SELECT vec_id, {q(_cos('h[1]', 'h[8]'))} AS cosine, {q(_rel('h[1]', 'h[8]'))} AS relative FROM states""")
def x04(spark, sf_dir):
    a, b = F.col("h")[0], F.col("h")[7]
    return tables.states(spark, sf_dir).select("vec_id", *rounded(
        {"cosine": vectors.cosine_distance(a, b), "relative": vectors.relative_distance(a, b)}))


@query("x05_displacement", "SELECT vec_id, " + ", ".join(
    f"{q(f('h[8]', s))} AS {n}_{k}" for n, s in (("input", "h[1]"), ("early", "h[3]"), ("middle", "h[5]"))
    for k, f in (("cosine", _cos), ("relative", _rel))) + " FROM states")
def x05(spark, sf_dir):
    return tables.states(spark, sf_dir).select("vec_id", *rounded(vectors.displacement(F.col("h"))))


VIEWS["moves"] = f"SELECT vec_id, {_pairs('h', _minus('h[i + 1]', 'h[i]'))} AS d FROM states"
VIEWS["turns"] = f"SELECT vec_id, d, {_pairs('d', _cos('d[i + 1]', 'd[i]'))} AS t FROM moves"


@query("x06_curvature", f"SELECT vec_id, {q(_avg('t'))} AS turn_mean, {q('list_max(t)')} AS turn_max, " + ", ".join(
    f"{q(_avg(_third('t', i)))} AS turn_{n}" for i, n in enumerate(("early", "middle", "late"))) +
    f", {q('len(list_filter(range(1, len(d)), lambda i: ' + _norm('d[i]') + ' <= 1e-12)) / len(t)')} AS still_share FROM turns")
def x06(spark, sf_dir):
    return tables.states(spark, sf_dir).select("vec_id", *rounded(vectors.curvature(F.col("h"))))


VIEWS["lognorms"] = f"SELECT vec_id, list_transform(h, lambda v: ln({_norm('v')})) AS g FROM states"


@query("x07_norm_dynamics", f"""SELECT vec_id, {q('g[1]')} AS log_norm_first, {q('g[8]')} AS log_norm_last, {q('g[8] - g[1]')} AS log_norm_net,
    {q('list_max(list_transform(range(1, len(g)), lambda i: abs(g[i + 1] - g[i])))')} AS log_norm_step,
    {q('(g[2] + g[3] + g[4]) / 3')} AS log_norm_early, {q('(g[5] + g[6]) / 2')} AS log_norm_middle,
    {q('(g[7] + g[8]) / 2')} AS log_norm_late FROM lognorms""")
def x07(spark, sf_dir):
    return tables.states(spark, sf_dir).select("vec_id", *rounded(vectors.norm_dynamics(F.col("h"))))


VIEWS["stack_dims"] = """SELECT item, zone, layer, unnest(range(1, 5)) AS d, unnest(vec) AS x FROM layer_states"""
VIEWS["stack_means"] = "SELECT item, zone, layer, d, avg(x) AS x, count(*) AS pieces FROM stack_dims GROUP BY ALL"
VIEWS["stack_layers"] = "SELECT item, zone, layer, list(x ORDER BY d) AS v, max(pieces) AS pieces FROM stack_means GROUP BY ALL"
VIEWS["stacks"] = """SELECT item, zone, list(v ORDER BY layer) AS h, sum(pieces)::BIGINT AS pieces FROM stack_layers
    GROUP BY item, zone HAVING count(*) = 7"""


VIEWS["all_stacks"] = "SELECT item, zone, list(v ORDER BY layer) AS h, count(*) AS layers, sum(pieces)::BIGINT AS pieces FROM stack_layers GROUP BY item, zone"


@query("a07_pooled_states", f"""SELECT item, zone, pieces, layers, unnest(range(1, len(h) + 1))::INT AS layer,
    {q('unnest(list_transform(h, lambda v: list_sum(v)))')} AS total FROM all_stacks""")
def a07(spark, sf_dir):
    """Every region with the layers it has."""
    pooled = state_ops.pool(tables.layer_states(spark, sf_dir))
    rows = pooled.select("item", "zone", "pieces", "layers", F.posexplode("h").alias("i", "v"))
    return rows.select("item", "zone", "pieces", "layers", (F.col("i") + 1).alias("layer"), snap(vectors.total(F.col("v"))).alias("total"))


@query("a07_excluded_stacks", """SELECT item, zone, layers, concat_ws(';', CASE WHEN layers < 7 THEN 'missing_layer' END,
    CASE WHEN len(list_filter(h[1:layers], lambda v: list_dot_product(v, v) = 0)) > 0 OR layers < 4 THEN 'undefined_profile' END) AS reasons
    FROM all_stacks WHERE reasons <> ''""")
def a07_excluded(spark, sf_dir):
    """The regions that later steps leave out, counted with their reasons."""
    return state_ops.excluded(state_ops.pool(tables.layer_states(spark, sf_dir)), 7)


def _context_views(name: str, pieces: str) -> None:
    """Views of pieces in order, their scoring windows as a loop makes them, and the truncated contexts of regions."""
    order = ", ".join(tables.PIECE_ORDER)
    VIEWS[f"{name}_rows"] = f"""SELECT l_partkey // 100 + 1 AS item, l_partkey % 100 + 1 AS zone,
        row_number() OVER (PARTITION BY l_partkey // 100 ORDER BY l_partkey % 100, {order}) - 1 AS idx,
        [l_quantity / 10, l_discount * 50, l_tax * 50, dayofyear(l_shipdate)::DOUBLE / 50] AS vec FROM lineitem {pieces}"""
    VIEWS[f"{name}_first"] = f"""SELECT item, zone, min(idx) AS first, max(idx) + 1 AS stop, (sum(count(*)) OVER (PARTITION BY item))::BIGINT AS n
        FROM {name}_rows GROUP BY item, zone"""
    VIEWS[f"{name}_windows"] = f"""SELECT item, n, greatest(0, least(n, e) - 1024) AS w_begin, least(n, e) AS w_end, t AS target_start FROM (
        SELECT item, n, 1 AS t, 1024 AS e FROM (SELECT DISTINCT item, n FROM {name}_first) UNION ALL
        SELECT item, n, 1024 + 256 * unnest(range(0, (greatest(n - 1024, 0) + 255) // 256)), 1280 + 256 * unnest(range(0, (greatest(n - 1024, 0) + 255) // 256))
        FROM (SELECT DISTINCT item, n FROM {name}_first))"""
    VIEWS[f"{name}_ranges"] = f"""SELECT f.item, f.zone, k AS "limit", CASE WHEN k < 0 THEN w_begin ELSE greatest(w_begin, first - k) END::BIGINT AS "start", stop::BIGINT AS stop
        FROM {name}_first f JOIN {name}_windows s ON f.item = s.item AND greatest(f.first, 1) >= s.target_start AND greatest(f.first, 1) < greatest(s.w_end, 2),
        (SELECT unnest([-1, 0, 16, 64])::INT AS k)"""
    VIEWS[f"{name}_means"] = f"""SELECT r.item, r.zone, r."limit", r."start", r.stop, [avg(vec[1]), avg(vec[2]), avg(vec[3]), avg(vec[4])] AS v
        FROM {name}_ranges r JOIN {name}_rows p ON p.item = r.item AND p.idx >= r."start" AND p.idx < r.stop GROUP BY ALL"""


_context_views("pieces_all", "")
_context_views("pieces_final", "WHERE l_linenumber = 7")
_LIMITS = (0, 16, 64)


@query("w09_context_means", f"""SELECT item, zone, "limit", "start", stop, {", ".join(f"{q(f'v[{d}]')} AS v{d}" for d in range(1, 5))} FROM pieces_all_means""")
def w09_means(spark, sf_dir):
    """Mean vector of each region's pieces with the last 0, 16 and 64 pieces before it and with its whole scoring window (-1)."""
    means = state_ops.context_means(tables.piece_states(spark, sf_dir), _LIMITS)
    return means.select("item", "zone", "limit", "start", "stop", *[snap(F.col("mean")[d - 1]).alias(f"v{d}") for d in range(1, 5)])


@query("x08_context_contrast", "SELECT f.item, f.zone, " + ", ".join(
    f"{q(e(f'f.v', f'm{k}.v'))} AS context{k}_{n}" for k in _LIMITS for n, e in (("cosine", _cos), ("relative", _rel))) + " FROM pieces_final_means f " + " ".join(
    f"""JOIN pieces_final_means m{k} ON m{k}.item = f.item AND m{k}.zone = f.zone AND m{k}."limit" = {k}""" for k in _LIMITS) + ' WHERE f."limit" = -1')
def x08(spark, sf_dir):
    """The final state in the whole window against the states in shorter contexts."""
    out = state_ops.context_contrast(tables.piece_states(spark, sf_dir, 7), _LIMITS)
    return out.select("item", "zone", *rounded({c: F.col(c) for c in out.columns if c.startswith("context")}))


_DEPTH = {0: 3, 1: 5, 2: 7}
VIEWS["neighbours"] = """SELECT a.item, a.zone, a.h AS h, b.h AS p1, c.h AS p2, d.h AS p3 FROM stacks a
    JOIN stacks b ON a.item = b.item AND a.zone = b.zone + 1 JOIN stacks c ON a.item = c.item AND a.zone = c.zone + 2
    LEFT JOIN stacks d ON a.item = d.item AND a.zone = d.zone + 3"""


def _relation(kind, depth):
    if kind == "previous":
        return _cos(f"h[{depth}]", f"p1[{depth}]")
    if kind == "two_back":
        return _cos(f"h[{depth}]", f"p2[{depth}]")
    two = f"list_transform(range(1, 5), lambda i: (p1[{depth}][i] + p2[{depth}][i]) / 2)"
    three = f"list_transform(range(1, 5), lambda i: (p1[{depth}][i] + p2[{depth}][i] + p3[{depth}][i]) / 3)"
    return f"CASE WHEN p3 IS NULL THEN {_cos(f'h[{depth}]', two)} ELSE {_cos(f'h[{depth}]', three)} END"


@query("x09_previous_relations", "SELECT item, zone, " + ", ".join(
    f"{q(_relation(k, d))} AS {k}_{i}" for k in ("previous", "two_back", "recent") for i, d in _DEPTH.items()) + ", " + ", ".join(
    f"{q(f'({_relation(k, 7)}) - ({_relation(k, 3)})')} AS {k}_change" for k in ("previous", "two_back", "recent")) + " FROM neighbours")
def x09(spark, sf_dir):
    out = state_ops.previous_relations(reading.stacks(spark, sf_dir), [2, 4, 6])
    return out.select("item", "zone", *rounded({c: F.col(c) for c in out.columns if c not in ("item", "zone")}))


VIEWS["soft"] = """SELECT vec_id, l, target, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS z FROM logits"""


@query("x10_entropy_bits", f"SELECT vec_id, {q('-list_sum(list_transform(l, lambda x: exp(x - z) * (x - z))) / ln(2)')} AS entropy_bits FROM soft")
def x10(spark, sf_dir):
    return tables.logits(spark, sf_dir).select("vec_id", snap(vectors.entropy_bits(F.col("l"))).alias("entropy_bits"))


@query("x11_surprisal_bits", f"SELECT vec_id, {q('(z - l[target + 1]) / ln(2)')} AS surprisal FROM soft")
def x11(spark, sf_dir):
    return tables.logits(spark, sf_dir).select("vec_id", snap(vectors.surprisal_bits(F.col("l"), F.col("target"))).alias("surprisal"))


VIEWS["soft_p"] = "SELECT vec_id, l, target, list_reverse_sort(list_transform(l, lambda x: exp(x - z))) AS p FROM soft"


@query("x12_distribution_shape", f"""SELECT vec_id, {q('ln(2 + len(list_filter(l, lambda x: x > l[target + 1])))')} AS target_log_rank,
    {q('list_sum(p[1:10])')} AS top10_mass, {q('p[1] - p[2]')} AS top_margin, {q('list_dot_product(p, p)')} AS collision FROM soft_p""")
def x12(spark, sf_dir):
    return tables.logits(spark, sf_dir).select("vec_id", *rounded(vectors.distribution_shape(F.col("l"), F.col("target"))))


@query("r03_state_ingest", "SELECT item, zone, pieces, " + ", ".join(
    f"{q(e)} AS {n}" for m in ("cosine", "relative_l2") for n, e in _summaries(m).items()) + f""" FROM (SELECT item, zone, pieces,
    {_pairs('h', _cos('h[i]', 'h[i + 1]'))} AS cosine,
    {_pairs('h', f"{_norm(_minus('h[i + 1]', 'h[i]'))} / ({_norm('h[i]')} + 1e-12)")} AS relative_l2 FROM stacks)""")
def r03(spark, sf_dir):
    t = reading.trajectory_table(spark, sf_dir)
    names = [n for m in ("cosine", "relative_l2") for n in vectors.profile_summaries(F.col(m), m)]
    return t.select("item", "zone", "pieces", *rounded({n: F.col(n) for n in names}))

"""Column functions over vectors (array<double>) and stacks of layer vectors (array<array<double>>)."""
from pyspark.sql import Column, functions as F

EPSILON = 1e-12     # fixed value: guard below which a norm counts as zero


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, although the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clip_unit(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - clip_unit(dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON)))


def relative_distance(a: Column, b: Column) -> Column:
    """L2 distance in units of the second vector's norm."""
    return norm(minus(a, b)) / F.greatest(norm(b), F.lit(EPSILON))


def steps(h: Column) -> Column:
    """1..size-1, empty for a stack of one."""
    return F.when(F.size(h) > 1, F.sequence(F.lit(1), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))


def at(h: Column, i: Column) -> Column:
    """0-based element."""
    return F.element_at(h, (i + 1).cast("int"))


def undefined_stack(h: Column) -> Column:
    """True for a stack whose distances are undefined: too short, or a near-zero or non-finite state."""
    bad = F.exists(h, lambda v: ~F.coalesce(norm(v) > EPSILON, F.lit(False)) | F.isnan(norm(v))
                   | (norm(v) == float("inf")))
    return (F.size(h) < 4) | bad


def cosine_profile(h: Column) -> Column:
    def body(n):
        return F.transform(steps(h), lambda i: 1 - clip_unit(dot(at(h, i - 1), at(h, i)) / (at(n, i - 1) * at(n, i))))
    return let(F.transform(h, norm), body)


def relative_profile(h: Column) -> Column:
    return F.transform(steps(h), lambda i: norm(minus(at(h, i), at(h, i - 1))) / (norm(at(h, i - 1)) + EPSILON))


def third(a: Column, which: int) -> Column:
    """Early (0), middle (1) or late (2) part of an array; earlier parts take the remainder."""
    size, extra = F.floor(F.size(a) / 3), F.size(a) % 3
    start = F.lit(which) * size + F.least(F.lit(which), extra)
    length = size + F.when(extra > which, 1).otherwise(0)
    return F.slice(a, (start + 1).cast("int"), length.cast("int"))


def profile_summaries(profile: Column, measure: str) -> dict[str, Column]:
    early, middle, late = (mean(third(profile, i)) for i in range(3))
    return {f"total_{measure}": total(profile), f"mean_{measure}": mean(profile),
            f"maximum_{measure}": F.array_max(profile),
            f"peak_layer_{measure}": F.array_position(profile, F.array_max(profile)),
            f"early_mean_{measure}": early, f"middle_mean_{measure}": middle, f"late_mean_{measure}": late,
            f"late_minus_early_{measure}": late - early}


def profile_shape(profile: Column) -> dict[str, Column]:
    """Roughness, distance-weighted centre in 0..1, and peak share, all relative to the total."""
    whole = F.greatest(total(profile), F.lit(EPSILON))
    last = F.greatest(F.size(profile) - 1, F.lit(1))
    rough = total(F.transform(steps(profile), lambda i: F.abs(at(profile, i) - at(profile, i - 1))))
    centre = total(F.transform(profile, lambda x, i: x * i / last))
    return {"roughness": rough / whole, "centre": centre / whole, "peak_share": F.array_max(profile) / whole}


def contrasts(h: Column, against: dict[str, Column]) -> dict[str, Column]:
    """Cosine and relative distance of the final state to the states at the given 0-based layers."""
    final = at(h, F.size(h) - 1)
    pairs = F.transform(F.array(*[i.cast("int") for i in against.values()]), lambda i: F.struct(
        cosine_distance(final, at(h, i)).alias("cosine"), relative_distance(final, at(h, i)).alias("relative")))
    return {f"{name}_{k}": pairs[j][k] for j, name in enumerate(against) for k in ("cosine", "relative")}


def displacement(h: Column) -> dict[str, Column]:
    """Final state against the input, L/3 and 2L/3 states."""
    blocks = F.size(h) - 1
    return contrasts(h, {"input": F.lit(0), "early": F.floor(blocks / 3), "middle": F.floor(blocks * 2 / 3)})


def curvature(h: Column) -> dict[str, Column]:
    """Turning between successive displacement vectors; zero where either displacement vanishes."""
    def turning(moves):
        def body(n):
            return F.transform(steps(moves), lambda i: F.struct(
                ((at(n, i - 1) > EPSILON) & (at(n, i) > EPSILON)).alias("moving"),
                cosine_distance(at(moves, i), at(moves, i - 1)).alias("turn")))
        return let(F.transform(moves, norm), body)
    pairs = let(F.transform(steps(h), lambda i: minus(at(h, i), at(h, i - 1))), turning)

    def summary(z):
        turns = F.transform(z, lambda s: F.when(s["moving"], s["turn"]).otherwise(0.0))
        return let(turns, lambda t: F.struct(
            mean(t).alias("turn_mean"), F.array_max(t).alias("turn_max"),
            *[mean(third(t, i)).alias(f"turn_{n}") for i, n in enumerate(("early", "middle", "late"))],
            (F.size(F.filter(z, lambda s: ~s["moving"])) / F.size(z)).alias("still_share")))
    out = let(pairs, summary)
    return {n: out[n] for n in ("turn_mean", "turn_max", "turn_early", "turn_middle", "turn_late", "still_share")}


def norm_dynamics(h: Column) -> dict[str, Column]:
    def summary(logs):
        last = F.size(logs) - 1
        change = F.transform(steps(logs), lambda i: F.abs(at(logs, i) - at(logs, i - 1)))
        blocks = F.slice(logs, F.lit(2), last)
        return F.struct(
            at(logs, F.lit(0)).alias("log_norm_first"), at(logs, last).alias("log_norm_last"),
            (at(logs, last) - at(logs, F.lit(0))).alias("log_norm_net"), F.array_max(change).alias("log_norm_step"),
            *[mean(third(blocks, i)).alias(f"log_norm_{n}") for i, n in enumerate(("early", "middle", "late"))])
    out = let(F.transform(h, lambda v: F.log(F.greatest(norm(v), F.lit(EPSILON)))), summary)
    return {f"log_norm_{n}": out[f"log_norm_{n}"] for n in ("first", "last", "net", "step", "early", "middle", "late")}


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(
        F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def entropy_bits(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda z: -F.aggregate(
        logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * (x - z))) / F.log(F.lit(2.0))


def surprisal_bits(logits: Column, target: Column) -> Column:
    return (log_sum_exp(logits) - at(logits, target)) / F.log(F.lit(2.0))


def distribution_shape(logits: Column, target: Column) -> dict[str, Column]:
    """Log competition rank of the target, top-10 mass, top margin, collision probability."""
    above = let(at(logits, target), lambda t: F.size(F.filter(logits, lambda x: x > t)))
    p = let(log_sum_exp(logits), lambda z: F.sort_array(F.transform(logits, lambda x: F.exp(x - z)), asc=False))
    out = let(p, lambda v: F.struct(total(F.slice(v, 1, 10)).alias("top10_mass"),
                                    (at(v, F.lit(0)) - at(v, F.lit(1))).alias("top_margin"),
                                    dot(v, v).alias("collision")))
    return {"target_log_rank": F.log1p((above + 1).cast("double")),
            **{n: out[n] for n in ("top10_mass", "top_margin", "collision")}}

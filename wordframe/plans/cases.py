"""The modelling table: outcome, controls, history, trajectory and representation families per region."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.cluster import cut, shared
from wordframe.functions import text, vectors
from wordframe.functions.layers import layer_names, third_names
from wordframe.functions.numeric import zero_with_flag
from wordframe.operators import ngram, spans
from wordframe.operators.ordered import lag_by_key
from wordframe.operators.ranking import assign_folds, assign_inner_folds
from wordframe.operators.states import context_contrast, previous_relations, window_origins
from wordframe.plans import reading
from wordframe.sources import tables

KEYS = ["item", "zone"]
OUTER = list(range(10))
LEXICAL = ["surprisal", "prev_surprisal", "word_length", "prev_word_length", "log_frequency", "prev_log_frequency"]
BASE = [*LEXICAL, "n_bpe", "prev_n_bpe"]
CORE = [*BASE, "entropy_bits", "prev_entropy_bits"]
LAG2_LEXICAL = ["lag2_word_length", "lag2_log_frequency", "lag2_n_bpe", "lag2_frequency_available"]
LAG2_SCORES = ["lag2_surprisal", "lag2_entropy_bits", "lag2_available"]
HISTORY = [*LAG2_LEXICAL, *LAG2_SCORES]
BLOCKS, DEPTHS, WIDTH, COUNT = 6, [2, 4, 6], 4, 2
CONTEXTS = (0, 16, 64)      # pieces before a region that a shortened context keeps
LAYERS = [[f"hidden_{l}_{d}" for d in range(WIDTH)] for l in range(len(DEPTHS))]
THIRDS = [*third_names("cosine"), *third_names("relative_l2")]
SHAPES = ["roughness", "centre", "peak_share"]
FAMILIES = {
    "distribution_shape": [*ngram.SHAPE, *[f"prev_{c}" for c in ngram.SHAPE]],
    "extended_spillover": LAG2_SCORES,
    "nonlinear_uncertainty": [f"{p}{c}" for p in ("", "prev_") for c in ("s2", "h2", "sh", "p")],
    "trajectory_shape": [f"{m}_{s}" for m in ("cosine", "relative_l2") for s in SHAPES],
}
REPRESENTATION = {
    "displacement": [f"{n}_{k}" for n in ("input", "early", "middle") for k in ("cosine", "relative")],
    "curvature": ["turn_mean", "turn_max", "turn_early", "turn_middle", "turn_late", "still_share"],
    "norm_dynamics": [f"log_norm_{n}" for n in ("first", "last", "net", "step", "early", "middle", "late")],
    "contextualization": ["context0_cosine", "context0_relative"],
    "context_dependence": [f"context{k}_{m}" for k in (16, 64) for m in ("cosine", "relative")],
    "previous_relations": [*[f"{r}_{i}" for r in ("previous", "two_back", "recent") for i in range(3)],
                           *[f"{r}_change" for r in ("previous", "two_back", "recent")]],
}
FLAGS = [f"{p}{n}" for p in ("", "prev_") for n in ("stop", "comma", "colon", "quote", "digit", "capital")]
NUISANCE = [*FLAGS, "log_zone", "log_before", "local", "local_squared"]


def nonlinear(prefix: str) -> dict:
    s, h = F.col(f"{prefix}surprisal"), F.col(f"{prefix}entropy_bits")
    return {f"{prefix}s2": s * s, f"{prefix}h2": h * h, f"{prefix}sh": s * h, f"{prefix}p": F.pow(F.lit(2.0), -s)}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions with scores, lags one and two back, and the zero-plus-flag history columns."""
    rows = shared(spark, ("analysis", sf_dir), lambda: reading.analysis_rows(spark, sf_dir))
    full = rows.select(*KEYS, "mean_rt", "word_length", "log_frequency").join(reading.scores(spark, sf_dir), KEYS)
    lagged = lag_by_key(full, ["word", "surprisal", "entropy_bits", "n_bpe", "word_length", "log_frequency", *ngram.SHAPE],
                        lags=(1, 2), prefix={1: "prev_", 2: "lag2_"})
    frequency, available = zero_with_flag(F.col("lag2_log_frequency"))
    surprisal, _ = zero_with_flag(F.col("lag2_surprisal"))
    entropy, both = zero_with_flag(F.col("lag2_entropy_bits"))
    return lagged.withColumns({"lag2_log_frequency": frequency, "lag2_frequency_available": available,
                               "lag2_surprisal": surprisal, "lag2_entropy_bits": entropy, "lag2_available": both})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory and representation columns of every region with a complete stack."""
    h = F.col("h")
    t = reading.trajectory_table(spark, sf_dir)
    columns = {**vectors.displacement(h), **vectors.curvature(h), **vectors.norm_dynamics(h)}
    for m in ("cosine", "relative_l2"):
        columns.update({f"{m}_{n}": c for n, c in vectors.profile_shape(F.col(m)).items()})
    for l, depth in enumerate(DEPTHS):
        for d in range(WIDTH):
            columns[f"hidden_{l}_{d}"] = h[depth][d]
    rows = t.select(*KEYS, *layer_names(BLOCKS), *THIRDS, *[c.alias(n) for n, c in columns.items()])
    pieces = cut(tables.piece_states(spark, sf_dir, BLOCKS + 1))
    near = reading.stacks(spark, sf_dir).join(window_origins(pieces), KEYS)
    return rows.join(previous_relations(near, DEPTHS, "origin"), KEYS).join(context_contrast(pieces, CONTEXTS), KEYS)


def case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases with saved outer folds and, per outer fold, saved inner folds."""
    def build():
        past = history(spark, sf_dir).withColumns({**nonlinear(""), **nonlinear("prev_")})
        flags = {**text.surface_flags(F.col("word")), **text.surface_flags(F.col("prev_word"), "prev_")}
        position = spans.position_controls(reading.scores(spark, sf_dir))
        side = shared(spark, ("features", sf_dir), lambda: features(spark, sf_dir))
        rows = past.withColumns(flags).join(position, KEYS).join(side, KEYS)
        needed = list(dict.fromkeys([*CORE, *HISTORY, *layer_names(BLOCKS), *THIRDS, *NUISANCE,
                                     *[c for cs in (*FAMILIES.values(), *REPRESENTATION.values(), *LAYERS) for c in cs]]))
        eligible = reading.complete(rows.select(*KEYS, "word", F.col("mean_rt").alias("y"), *[
            F.col(c).cast("double").alias(c) for c in needed]), [*needed, "y"])
        # Folds scan the keys several times: write the features once first.
        return assign_inner_folds(assign_folds(cut(eligible), KEYS), KEYS, OUTER)
    return shared(spark, ("case", sf_dir), build)

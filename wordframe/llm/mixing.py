"""Mixing sources to target weights by Pfair scheduling of source blocks."""
import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordframe.llm.ranks import ranked, row_hash

BLOCK_DOCS = 8          # documents in a source block
MAX_SOURCES = 100_000   # sources whose weights fit on the driver; more are an error, none is dropped
SHORTFALL = 0.05        # target weight of sources that may run out before the mixture ends


def period_shares(weights: dict, period: int) -> dict:
    """Slots of each source in one period: largest remainders, one slot at least, ``period`` in all."""
    total = sum(weights.values())
    exact = {s: Fraction(w).limit_denominator(10**12) * period / Fraction(total).limit_denominator(10**12)
             for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    at = 0
    while sum(slots.values()) < period:
        slots[order[at % len(order)]] += 1
        at += 1
    excess = sum(slots.values()) - period
    for s in sorted(slots, key=lambda s: (-slots[s], str(s))):
        taken = min(excess, slots[s] - 1)
        slots[s] -= taken
        excess -= taken
    return slots


def pfair_period(slots: dict) -> dict:
    """For each source the slot of its 1st, 2nd, ... block in one period, by earliest deadline first.

    Block j of a source with ``c`` of ``D`` slots is released at floor(jD/c) and due by ceil((j+1)D/c). The weights
    sum to one, so every block meets its deadline and each source stays less than one block from its share at any time.
    """
    period = sum(slots.values())
    placed = {s: [] for s in slots}
    waiting, ready = [(0, i, s, 0) for i, s in enumerate(slots)], []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), i, s, j))
        due, i, s, j = heapq.heappop(ready)
        assert slot < due, "a block missed its deadline"
        placed[s].append(slot)
        if j + 1 < slots[s]:
            heapq.heappush(waiting, ((j + 1) * period // slots[s], i, s, j + 1))
    return placed


def mix(df: DataFrame, source: str = "source", weights: dict | None = None, power: float = 0.5,
        block_docs: int = BLOCK_DOCS, shortfall: float = SHORTFALL) -> DataFrame:
    """Add ``block`` (of its source), ``release``, ``deadline``, ``slot`` (of the schedule) and ``in_mix``.

    ``weights`` maps every source to its target weight; without it a source weighs its row count to ``power``.
    Blocks hold ``block_docs`` rows of one source in an order drawn from a hash of the row; the last may hold fewer.
    The schedule repeats with a period in which every source has its whole number of slots, so only one period is
    simulated and a row's slot follows from its rank in its source. ``in_mix`` ends where sources with more than
    ``shortfall`` of the target weight have run out; later rows keep their slots and are marked false. Nothing is
    repeated. A missing source is a source of its own. Input columns with one of the five names are replaced. An empty table gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("block", "release", "deadline", "slot", "in_mix")
    placed = ranked(df.withColumn("_tie", row_hash(df)), [F.col(f"`{source}`"), F.col("_tie")], "_rank").drop("_tie")
    sizes = placed.groupBy(F.col(f"`{source}`").alias("s")).agg(F.count("*").alias("n"), F.min("_rank").alias("low"))
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["s"]: r["n"] for r in rows}
    shares = {s: float(weights[s]) if weights else n ** power for s, n in counts.items()}
    slots = period_shares(shares, max(1000, 20 * len(shares))) if shares else {}
    table, period = pfair_period(slots) if slots else {}, max(1, sum(slots.values()))
    ends = sorted(((-(-n // block_docs)) // slots[s] * period + table[s][-(-n // block_docs) % slots[s]], slots[s])
                  for s, n in counts.items())
    end, gone = 0, 0
    for at, share in ends:                          # the slot at which each source has no block left
        end, gone = at, gone + share
        if gone > shortfall * period:
            break
    plan = spark.createDataFrame([(r["s"], r["low"], slots[r["s"]], table[r["s"]]) for r in rows],
                                 "_s string, _low long, _share long, _table array<long>")
    block, share = F.col("block"), F.col("_share")
    return (placed.join(F.broadcast(plan), F.col(f"`{source}`").cast("string").eqNullSafe(F.col("_s")))
            .withColumn("block", F.floor((F.col("_rank") - F.col("_low")) / block_docs))
            .withColumn("release", F.floor(block * period / share))
            .withColumn("deadline", F.ceil((block + 1) * period / share))
            .withColumn("slot", F.floor(block / share) * period + F.element_at("_table", (block % share + 1).cast("int")))
            .withColumn("in_mix", F.col("slot") < end)
            .drop("_rank", "_s", "_low", "_share", "_table"))


def op4_pfair_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    return mix(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "in_mix")

"""Character spans, pieces, piece ownership and scoring windows."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wordframe.operators.ordered import SLICE, exclusive_prefix, exploded, running_total

SPACES = np.frombuffer(b" \t\n\x0b\f\r", np.uint8)      # what a regular expression takes for white space


def text_bytes(texts: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of a string column, one text behind the other."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else [0, 0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)

def region_spans(regions: DataFrame) -> DataFrame:
    """[start, end) of each region in its context's text joined by single blanks."""
    sized = regions.withColumn("_w", F.length("word") + 1)
    return exclusive_prefix(sized, {"start": "_w"}).select(
        *regions.columns, F.col("start").cast("bigint").alias("start"),
        (F.col("start") + F.length("word")).cast("bigint").alias("end"))


def piece_pattern(max_letters: int | None = None) -> str:
    """Runs of one kind of character, each with the blank before it, so pieces tile the whole text."""
    run = f"{{1,{max_letters}}}" if max_letters else "+"
    return rf"\s?[\p{{L}}\p{{M}}]{run}|\s?\p{{Nd}}+|\s?[^\p{{L}}\p{{M}}\p{{Nd}}\s]+|\s+"


PIECE_BLOCK = SLICE         # pieces that leave a task at once
OWNER_CHARS = 1 << 20       # characters whose owners are found at once; a longer context stands alone


def pieces(spans: DataFrame, pattern: str | None = None) -> DataFrame:
    """Split every region, with the separator before it, into pieces with offsets in the context text.

    Output: item, zone, piece (1-based in the region), text, start, end.
    """
    found = found_pieces(F.col("word"), F.col("zone"), pattern)
    rows = spans.select("item", "zone", (F.col("start") - (F.col("zone") > 1).cast("int")).alias("_at"), found.alias("text"))
    rows = rows.withColumn("_n", F.transform("text", lambda t: F.length(t)))
    out = exploded(rows, ["item", "zone", "_at"], ["text"], {"off": "_n"}, position="piece", rows=PIECE_BLOCK)
    begin = F.col("_at") + F.col("off")
    return out.select("item", "zone", F.col("piece").cast("bigint").alias("piece"), "text",
                      begin.cast("bigint").alias("start"),
                      (begin + F.length("text")).cast("bigint").alias("end"))


def found_pieces(word: Column, zone: Column, pattern: str | None = None) -> Column:
    """The pieces of a region with the separator before it, as an array."""
    return F.regexp_extract_all(F.concat(F.when(zone > 1, F.lit(" ")).otherwise(F.lit("")), word), F.lit(pattern or piece_pattern()), F.lit(0))


def piece_counts(regions: DataFrame, pattern: str | None = None) -> Column:
    """Number of pieces of a region, without placing them."""
    return F.size(found_pieces(F.col("word"), F.col("zone"), pattern))


def context_counts(contexts: DataFrame, pattern: str | None = None) -> DataFrame:
    """``item, zone, n_bpe, first, n``: pieces of each region, of the regions before it and of its whole context.

    ``contexts`` has ``item`` and the array ``word`` of all its regions, so both sums are taken inside a row.
    """
    sizes = F.transform("word", lambda w, i: F.size(found_pieces(w, i + 1, pattern)).cast("bigint"))
    return exploded(contexts.select("item", sizes.alias("n_bpe")), ["item"], ["n_bpe"], {"first": "n_bpe"}, {"n": "n_bpe"})


def context_owners(contexts: DataFrame, pattern: str | None = None) -> DataFrame:
    """``owners`` of all pieces of contexts that stand in one row each (``item``, array ``word``): item, start, end, owner, ambiguous.

    Both tilings lie on one line, so the overlaps of a piece follow from counts of characters up to its two ends: the
    first and the last visible character in it name the regions it covers. The rule is that of ``owners``; no pair of
    intervals is formed and nothing is shuffled. Work is linear in the text; memory is that of ``OWNER_CHARS`` characters or
    of the longest context, whatever a batch holds.
    """
    lengths = F.flatten(F.transform("word", lambda w, i: F.transform(found_pieces(w, i + 1, pattern), lambda p: F.length(p))))
    schema = T.StructType([contexts.schema["item"], *[T.StructField(n, T.LongType()) for n in ("start", "end", "owner")], T.StructField("ambiguous", T.BooleanType())])

    def runs(batches):
        """Rows of a batch whose pieces cover ``OWNER_CHARS`` characters together, or a single row."""
        for batch in batches:
            parts = batch.column(2)
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
            upto = np.r_[0, np.cumsum(parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64))][ends]
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + OWNER_CHARS, "right")) - 1)
                yield batch.slice(a, b - a)
                a = b

    def own(batches):
        for batch in runs(batches):
            item, words, pieces = batch.columns
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (words, pieces)]
            flat = words.flatten()
            letters = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            # One line for the whole batch: every region, then one place for the separator behind it.
            stops = np.cumsum(letters + 1) - 1
            starts = stops - letters
            firsts = np.cumsum(sizes[0]) - sizes[0]                     # number of the first region of each context
            base = np.r_[starts, stops[-1:] + 1, 0][np.minimum(firsts, len(starts))]
            cuts = np.cumsum(np.r_[0, pieces.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])
            row = np.repeat(np.arange(len(batch)), sizes[1])
            shift = (base - cuts[np.cumsum(sizes[1]) - sizes[1]])[row]
            low, high = cuts[:-1] + shift, cuts[1:] + shift
            data = text_bytes(flat)
            letter = data[(data & 0xC0) != 0x80]                        # first byte of each character
            region = np.repeat(np.arange(len(letters)), letters)
            line = np.arange(len(letter)) + region                      # place of each character
            shown = ~np.isin(letter, SPACES)
            found = []
            for chosen in (shown, np.ones(len(letter), bool)):
                upto = np.zeros(int(stops[-1]) + 3 if len(stops) else 1, np.int64)
                upto[line[chosen] + 1] = 1
                upto = np.cumsum(upto)
                a, b, mine = upto[low], upto[high], np.r_[region[chosen], 0]
                found.append((b > a, mine[np.minimum(a, len(mine) - 1)], mine[np.maximum(b - 1, 0)]))
            (visible, one, last), (inside, _, within) = found
            after = np.searchsorted(starts, high)
            follows = np.r_[starts, -1][after] == high
            owner = np.where(visible, one, np.where(inside, within, after)) - firsts[row] + 1
            known = np.where(visible, one == last, inside | follows)
            for a in range(0, len(row), SLICE):
                at = slice(a, a + SLICE)
                yield pa.RecordBatch.from_arrays([item.take(pa.array(row[at])), pa.array((low - base[row])[at]), pa.array((high - base[row])[at]),
                                                  pa.array(owner[at], mask=~known[at]), pa.array((one < last)[at], mask=~visible[at])], names=schema.names)

    return contexts.select("item", "word", lengths.alias("_p")).mapInArrow(own, schema)


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int = 64, reach: int = 0) -> DataFrame:
    """Pairs of intervals [start, end) of the same ``key`` that overlap, each pair once.

    Both sides are placed in buckets of ``width`` positions, so the join key is (key, bucket) and a long
    context never meets itself as a whole. ``reach`` widens the left interval on its right side.
    """
    def place(df, side, extra):
        renamed = df.select(*[F.col(c) if c == key else F.col(c).alias(f"{side}_{c}") for c in df.columns])
        stop = F.col(f"{side}_end") + extra - 1
        return renamed.withColumn("_b", F.explode(F.sequence(
            F.floor(F.col(f"{side}_start") / width), F.floor(stop / width))))
    pairs = place(left, "l", reach).join(place(right, "r", 0), [key, "_b"])
    begin = F.greatest("l_start", "r_start")
    return pairs.filter((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end") + reach)
                        & (F.col("_b") == F.floor(begin / width))).drop("_b")


def owners(piece_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Owner of each piece by visible overlap, with whitespace-only pieces resolved, and a reason when unclear.

    A piece belongs to the one region whose visible characters it covers; a blank inside a region belongs to
    that region; a separator belongs to the region after it.
    """
    pairs = overlap_join(piece_rows.select("item", "start", "end"), spans.select("item", "zone", "word", "start", "end"),
                         "item", reach=1)
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    shown = F.substring(F.col("r_word"), (lo - F.col("r_start") + 1).cast("int"), (hi - lo).cast("int"))
    inside = hi > lo
    visible = inside & shown.rlike(r"\S")
    grouped = pairs.groupBy("item", F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(
        F.min(F.when(visible, F.col("r_zone"))).alias("_first"), F.max(F.when(visible, F.col("r_zone"))).alias("_last"),
        F.max(F.when(inside, F.col("r_zone"))).alias("_within"), F.min(F.when(~inside, F.col("r_zone"))).alias("_next"))
    return grouped.select(
        "item", "start", "end",
        F.when(F.col("_first") == F.col("_last"), F.col("_first"))
         .when(F.col("_first").isNull(), F.coalesce("_within", "_next")).alias("owner"),
        (F.col("_first") < F.col("_last")).alias("ambiguous"))


def unowned(owned: DataFrame, spans: DataFrame) -> DataFrame:
    """Regions without any piece."""
    return spans.select("item", "zone").join(
        owned.select("item", F.col("owner").alias("zone")).distinct(), ["item", "zone"], "left_anti")


def window_of(idx: Column, n: Column, window: int, stride: int) -> dict[str, Column]:
    """Scoring window of a token, in closed form: each token has one window of bounded context.

    Token 0 is never a target; it is represented in the first window.
    """
    if not 1 <= stride < window:
        raise ValueError("stride must be between 1 and window - 1")
    late = idx >= window
    k = F.floor((idx - window) / stride) + 1
    target = F.when(late, F.lit(window) + (k - 1) * stride).otherwise(F.lit(1))
    end = F.least(n, F.when(late, target + stride).otherwise(F.lit(window)))
    begin = F.greatest(F.lit(0), end - window)
    return {"begin": begin.cast("bigint"), "end": end.cast("bigint"), "target_start": target.cast("bigint"),
            "local": (idx - begin).cast("bigint")}


def position_controls(counts: DataFrame, window: int = 1024, stride: int = 256) -> DataFrame:
    """Position of a region in words, in pieces, and in its scoring window: item, zone and four columns."""
    placed = exclusive_prefix(counts.select("item", "zone", "n_bpe"), {"before": "n_bpe"})
    return placed_controls(placed.join(counts.groupBy("item").agg(F.sum("n_bpe").alias("n")), "item"), window, stride)


def placed_controls(sized: DataFrame, window: int = 1024, stride: int = 256) -> DataFrame:
    """``position_controls`` of regions whose pieces are counted already: item, zone, n_bpe, before, n."""
    own = F.sequence(F.col("before"), F.col("before") + F.col("n_bpe") - 1)
    local = F.transform(own, lambda i: window_of(i, F.col("n"), window, stride)["local"].cast("double"))
    mean = F.aggregate(local, F.lit(0.0), lambda s, v: s + v) / F.col("n_bpe") / F.lit(float(window))
    return sized.select("item", "zone", F.log1p(F.col("zone").cast("double")).alias("log_zone"),
                        F.log1p(F.col("before").cast("double")).alias("log_before"), mean.alias("local")).withColumn(
        "local_squared", F.col("local") * F.col("local"))


def window_coverage(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """How often the tokens of each item are targets of a window: ``item, tokens, once, repeated, missing``.

    ``windows`` has item, first and stop of each target range, ``sizes`` item and its number of tokens ``n``; every item
    of ``windows`` must be in it. Only the ends of ranges are ordered, never the tokens: the number of open windows changes there
    alone, and tokens under exactly k windows are the sum of positions where that number leaves k less those where it
    reaches k. Parts of ranges outside 0 to n are not counted.
    """
    inside = windows.join(sizes, "item").select("item", F.greatest(F.col("first"), F.lit(0)).alias("first"), F.least("stop", "n").alias("stop")).where("first < stop")
    ends = inside.select("item", F.inline(F.array(F.struct(F.col("first").cast("bigint").alias("at"), F.lit(1).alias("d")),
                                                  F.struct(F.col("stop").cast("bigint").alias("at"), F.lit(-1).alias("d")))))
    steps = ends.groupBy("item", "at").agg(F.sum("d").alias("d"))           # sums to nothing in every item, so items need no start of their own
    open_ = running_total(steps, ["item", "at"], "d", "after").withColumn("before", F.col("after") - F.col("d"))
    covered = open_.groupBy("item").agg(
        F.sum(F.col("at") * ((F.col("before") == 1).cast("int") - (F.col("after") == 1).cast("int"))).alias("once"),
        F.sum(F.col("at") * ((F.col("before") > 1).cast("int") - (F.col("after") > 1).cast("int"))).alias("repeated"))
    return sizes.join(covered, "item", "left").select(
        "item", F.col("n").cast("bigint").alias("tokens"), F.coalesce("once", F.lit(0)).alias("once"), F.coalesce("repeated", F.lit(0)).alias("repeated"),
        (F.col("n") - F.coalesce("once", F.lit(0)) - F.coalesce("repeated", F.lit(0))).cast("bigint").alias("missing"))

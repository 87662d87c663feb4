"""Near-duplicates by Order MinHash, verified by banded alignment of words."""
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordframe.cluster import cut
from wordframe.llm.components import components
from wordframe.llm.ranks import row_hash
from wordframe.llm.words import CHUNK_BYTES, mix, runs, text_buffer, words_of

SHINGLE = 5         # words in a k-mer
SKETCHES = 32       # bands: each holds the two smallest labelled k-mers in the sequence of the text
SHORT_SHINGLE = 2   # words in a k-mer of the bands for texts with many edits
SHORT_SKETCHES = 16
SHORT_TEXT = 14     # texts of so many words at most meet by what is left after deletions: no pair of them is missed
RANGES = 128        # ranges of hashes; a text's signature holds four bits of its smallest 2-word k-mer in each
SIGNS = RANGES // 16    # longs of a signature
SIGMAS = 5          # deviations granted to texts with more k-mers than ranges; shorter ones are never refused wrongly
TURNS = 3           # pivots of each bucket before the pairs that are still apart are listed
FEW_EDITS = 40      # texts of a hundred times as many words are first tried for a hundredth of edits
SIMILARITY = 0.8    # 1 - word edits / words of the longer text

_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _labelled(hashes: np.ndarray, first: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of each text, and where each text's begin.

    A text of fewer than ``shingle`` words is one k-mer.
    """
    counts = np.diff(first)
    grams = np.where(counts == 0, 0, np.maximum(1, counts - shingle + 1))
    start = np.concatenate([[0], np.cumsum(grams)])
    text = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(start[-1]) - start[text] + first[text]
    end = first[1:][text]
    out = np.zeros(len(at), np.uint64)
    for j in range(shingle):
        there = at + j < end
        word = np.where(there, hashes[np.minimum(at + j, len(hashes) - 1)], _U(0))
        out = out * _U(0xD6E8FEB86659FD93) + word
    out = mix(out)
    keyed = mix(out ^ mix(text.astype(np.uint64)))      # equal k-mers of one text meet, those of two texts do not
    order = np.argsort(keyed, kind="stable")
    ordered = keyed[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), np.int64)
    occurrence[order] = np.arange(len(order)) - group
    return mix(out + occurrence.astype(np.uint64) * _U(0xA0761D6478BD642F)), start


def order_sketches(hashes: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, shingle: int = SHINGLE) -> np.ndarray:
    """One row per text, one 64-bit value per sketch: two smallest k-mers under the sketch's order, in text order."""
    return _sketches(*_labelled(hashes, first, shingle), sketches)


def _sketches(labelled: np.ndarray, start: np.ndarray, sketches: int) -> np.ndarray:
    full = np.flatnonzero(np.diff(start))
    out = np.zeros((len(start) - 1, sketches), np.uint64)
    if not len(full):
        return out
    begin = start[full]
    longest = int(np.diff(start).max())
    low = _U((1 << max(1, longest.bit_length())) - 1)
    within = (np.arange(len(labelled)) - np.repeat(begin, np.diff(start)[full])).astype(np.uint64)
    for j in range(sketches):
        drawn = (labelled ^ _MULTIPLIERS[j]) * _MULTIPLIERS[(j + 32) % 64]
        drawn = (drawn ^ (drawn >> _U(29))) & ~low | within
        one = begin + (np.minimum.reduceat(drawn, begin) & low).astype(np.int64)
        drawn[one] = _U(0xFFFFFFFFFFFFFFFF)
        least = np.minimum.reduceat(drawn, begin)
        two = np.where(least == _U(0xFFFFFFFFFFFFFFFF), one, begin + (least & low).astype(np.int64))
        a, b = np.minimum(one, two), np.maximum(one, two)
        out[full, j] = mix(labelled[a] * _U(3) + mix(labelled[b]) + _U(j))
    return out


def signatures(labelled: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One row of ``SIGNS`` longs per text: four bits of the smallest labelled k-mer in each of ``RANGES`` ranges, 0 for none."""
    full = np.flatnonzero(np.diff(start))
    four = np.zeros((len(start) - 1, RANGES), np.uint8)
    text = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(start)[full])
    low = 64 - (CHUNK_BYTES - 1).bit_length()       # the same bits of a hash whatever the number of texts, a byte each at least
    ordered = np.sort(text << _U(low) | labelled >> _U(64 - low))
    place = (ordered >> _U(low - RANGES.bit_length() + 1)).astype(np.int64)
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    at = place[least]
    four[full[at // RANGES], at % RANGES] = 1 + mix(ordered[least] & _U((1 << low) - 1)) % _U(15)
    return (four[:, 0::2] | four[:, 1::2] << 4).copy().view(np.int64)


def _agreeing(x: str, y: str, n: Column, least: float) -> Column:
    """Whether the signatures ``x`` and ``y`` may be those of a pair alike, ``n`` the words of the longer text.

    An edit touches two k-mers of each text, and an unlike k-mer changes no range but its own: so many ranges may differ.
    In texts that fill all ranges a range differs with the unlike share of all k-mers, and ``SIGMAS`` deviations more are granted.
    """
    share = min(1.0, 4 * (1 - least) / (1 + 2 * (1 - least)))
    most = RANGES * share + SIGMAS * (RANGES * share * (1 - share)) ** 0.5
    def ranges(i):
        other = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        half = other.bitwiseOR(F.shiftrightunsigned(other, 2))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return reduce(Column.__add__, [ranges(i) for i in range(SIGNS)]) <= F.least(4 * (1 - least) * n + 1e-9, F.lit(most))


def _allowed(n: int, least: float) -> int:
    """Most words to delete from a text of ``n`` so that it meets every text of ``SHORT_TEXT`` words at most with ``least``."""
    longer = min(SHORT_TEXT, int(n / least + 1e-9)) if least > 0 else SHORT_TEXT
    return min(n, int((1 - least) * max(n, longer) + 1e-9))


def deletions(words: np.ndarray, most: int) -> list[int]:
    """Hashes of the sequences left after up to ``most`` deletions.

    Two texts within ``most`` edits share one: a replaced word is deleted from both, any other only from one.
    """
    found, layer = set(), {tuple(words.tolist())}
    for k in range(most + 1):
        found |= layer
        layer = {t[:i] + t[i + 1:] for t in layer for i in range(len(t))} if k < most else ()
    rest = np.array([len(t) for t in found], np.uint64)
    wide = np.zeros((len(found), len(words)), np.uint64)
    for row, t in zip(wide, found):
        row[:len(t)] = t
    for column in wide.T:
        rest = rest * _U(0xD6E8FEB86659FD93) + column
    return mix(mix(rest) + _U(0x8CB92BA72F3D8DD7)).view(np.int64).tolist()


def _sketcher(least: float):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, owner, text → key, owner, n_words, buckets (sketch values, and what deletions leave of a short text), sign."""
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            counts, values, sizes, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, SIGNS), np.int64)]
            for lo, hi in runs(offsets):
                words = words_of(data, offsets[lo:hi + 1])
                two = _labelled(words.hashes, words.first, SHORT_SHINGLE)
                long, short = order_sketches(words.hashes, words.first), _sketches(*two, SHORT_SKETCHES) ^ _U(0x5851F42D4C957F2D)
                both = np.hstack([long, short]).view(np.int64)
                size = np.where(words.counts > 0, both.shape[1], 0)
                extra = []
                for i in np.flatnonzero((words.counts > 0) & (words.counts <= SHORT_TEXT)):
                    some = deletions(words.hashes[words.first[i]:words.first[i + 1]], _allowed(int(words.counts[i]), least))
                    extra.append((int(i), some))
                at = np.concatenate([np.repeat(np.flatnonzero(size), both.shape[1]), *[np.full(len(x), i) for i, x in extra]])
                flat = np.concatenate([both[size > 0].reshape(-1), *[np.array(x, np.int64) for _, x in extra]])
                values.append(flat[np.argsort(at, kind="stable")])
                counts.append(words.counts)
                signs.append(signatures(*two))
                sizes.append(np.bincount(at.astype(np.int64), minlength=hi - lo))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            sign = np.concatenate(signs)
            sign = pa.ListArray.from_arrays(pa.array(np.arange(len(sign) + 1, dtype=np.int32) * SIGNS), pa.array(sign.reshape(-1)))
            yield pa.record_batch([batch.column("key"), batch.column("owner"), pa.array(np.concatenate(counts)), buckets, sign],
                                  names=["key", "owner", "n_words", "buckets", "sign"])
    return sketch


def _reach(ha: np.ndarray, hb: np.ndarray, i: np.ndarray, j: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """How many words agree from (i, j) on, for many pairs at once: binary search over hashes of stretches."""
    room = np.minimum(len(ha) - 1 - i, len(hb) - 1 - j)
    good, step = np.zeros(len(i), np.int64), 1 << max(0, int(room.max(initial=0)).bit_length())
    while step:
        longer = good + step
        fits = longer <= room
        to = np.where(fits, longer, 0)
        same = (ha[i + to] - ha[i] * powers[to]) == (hb[j + to] - hb[j] * powers[to])
        good = np.where(fits & same, longer, good)
        step >>= 1
    return good


def _prefix_hashes(words: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """h[i + 1] = h[i] * base + word, for all prefixes."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * inverse[1:len(words) + 1], out=out[1:])
    return out * powers[:len(words) + 1]


_BASE = _U(0x2545F4914F6CDD1D)


def word_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits (insert, delete, replace) that turn ``a`` into ``b``; ``most + 1`` if more than ``most``.

    Equal words at both ends are taken off. Long texts with few edits are aligned along diagonals, all others column by column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    begin = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + begin:][::-1] != b[m - short + begin:][::-1])
    end = int(differ[0]) if len(differ) else short - begin
    a, b = a[begin:n - end], b[begin:m - end]
    few = max(len(a), len(b)) // 100
    if few >= FEW_EDITS:
        edits = diagonal_edits(a, b, min(most, few))
        if edits <= few or most <= few:
            return edits
    return column_edits(a, b, most)


def column_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """``word_edits`` by Myers' bit vectors (Hyyrö's form): a whole number holds the differences down a column, a bit for each word of the shorter text.

    It ends as soon as the words left cannot bring the edits down to ``most``.
    """
    down, along = sorted((a.tolist(), b.tolist()), key=len)
    if not down:
        return min(len(along), most + 1)
    places = {}
    for i, word in enumerate(down):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(down)) - 1, 1 << (len(down) - 1)
    more, less, edits, left = full, 0, len(down), len(along)
    for word in along:
        same = places.get(word, 0) | less
        straight = (((same & more) + more) ^ more) | same
        up, right = more & straight, (less | ~(more | straight)) & full
        edits += bool(right & last) - bool(up & last)
        left -= 1
        if edits - left > most:
            return most + 1
        right = right << 1 | 1
        less = right & straight
        more = (up << 1 | ~(right | straight)) & full
    return edits


def diagonal_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """``word_edits`` along diagonals: its work grows with the edits rather than the words.

    Only diagonals within ``most`` of the main one are aligned. For each number of edits the furthest reach on every
    diagonal of the band is kept; agreeing stretches are jumped over.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    length = max(n, m) + 2
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(length, _BASE)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[_U(1)], np.full(length, _U(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
    ha, hb = _prefix_hashes(a, powers, inverse), _prefix_hashes(b, powers, inverse)
    none = -(1 << 60)
    reach = _reach(ha, hb, np.zeros(1, np.int64), np.zeros(1, np.int64), powers)    # rows of a, by diagonal j - i
    low = 0
    if n == m and reach[0] == n:
        return 0
    for edits in range(1, most + 1):
        wide = np.full(len(reach) + 4, none)
        wide[2:-2] = reach
        far = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])
        low -= 1
        diagonal = np.arange(low, low + len(far))
        keep = (np.abs(diagonal) <= most) & (diagonal >= -n) & (diagonal <= m)
        far, diagonal = far[keep], diagonal[keep]
        low = int(diagonal[0])
        far = np.minimum(far, np.minimum(n, m - diagonal))
        live = (far >= 0) & (far + diagonal >= 0)
        i = np.where(live, far, 0)
        j = np.where(live, far + diagonal, 0)
        far = np.where(live, far + _reach(ha, hb, i, j, powers), none)
        if diagonal[0] <= m - n <= diagonal[-1] and far[m - n - low] >= n:
            return edits
        reach = far
    return most + 1


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - edits / longer length where that is at least ``least``, else 0. Unequal bags of words are refused first."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(nx[at], ny[to]).sum()) > most:
        return 0.0
    edits = word_edits(a, b, most)
    return 1 - edits / longer if edits <= most else 0.0


def _verifier(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, at = [], {}
            for name in ("text_a", "text_b"):
                data, offsets = text_buffer(batch.column(name))
                out = []
                for lo, hi in runs(offsets):
                    words = words_of(data, offsets[lo:hi + 1])
                    out += [words.hashes[words.first[i]:words.first[i + 1]] for i in range(hi - lo)]
                sides.append(out)
            score = np.array([similarity(a, b, least) for a, b in zip(*sides)], np.float64)
            at = pa.array(np.flatnonzero(score >= least))
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at), pa.array(score).take(at)],
                                  names=["a", "b", "similarity"])
    return verify


def _verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    with_a = pairs.join(bodies.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(bodies.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b")
               .mapInArrow(_verifier(least), "a binary, b binary, similarity double"))


def near_links(docs: DataFrame, text: str, least: float = SIMILARITY) -> DataFrame:
    """``a, b, similarity``: verified links between different texts, named by their 128-bit digests.

    Each bucket and half-octave of lengths has a pivot, first its smallest digest, then others drawn by a hash. In each of
    up to ``TURNS`` rounds every text that is not in its pivot's group is compared with it, n - 1 comparisons at most for n
    texts, and groups that are linked become one. Rounds end early when one finds no link or no bucket holds
    several groups. Then every pair that shares a bucket, whose lengths allow a link and that is still in different groups
    is compared, so no chain or group depends on the pivots: the connected groups are those of all pairs that share a
    bucket. Pairs inside a group are not compared again, so the links hold the groups together and are not all pairs
    alike. Signatures refuse pairs far from alike before their texts are fetched, and inside the join that lists the last ones.
    """
    body = docs.select(F.unhex(F.md5(text)).alias("key"), row_hash(docs).alias("owner"),
                       F.col(f"`{text}`").alias("text")).where("text is not null")
    sketches = cut(body.mapInArrow(_sketcher(least), "key binary, owner long, n_words long, buckets array<long>, sign array<long>"))
    texts = sketches.groupBy("key").agg(F.min("owner").alias("owner"))
    rows = sketches.select("key", "n_words", F.explode("buckets").alias("bucket"))
    # Only buckets of several texts: most hold one. Numbers instead of digests keep the aggregate in hash tables.
    full = (sketches.select(F.xxhash64("key").alias("id"), F.explode("buckets").alias("bucket")).groupBy("bucket")
            .agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("bucket"))
    rows = cut(rows.join(full, "bucket").distinct().withColumn("kind", F.floor(2 * F.log2(F.col("n_words"))).cast("int")))
    ends = rows.select("key").distinct()
    bodies = cut(body.join(texts.join(ends, "key", "left_semi"), ["key", "owner"], "left_semi")
                 .dropDuplicates(["key", "owner"]).select("key", "text"))
    signs = cut(sketches.select("key", "n_words", "sign").join(ends, "key", "left_semi").groupBy("key")
                .agg(F.first("n_words").alias("n"), F.first("sign").alias("sign")))
    fits = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9     # noqa: E731
    left, links, tried, roots = rows.withColumn("root", F.col("key")), None, None, None
    for turn in range(TURNS):
        place = F.struct(F.xxhash64(F.lit(turn), "key") if turn else F.lit(0).alias("h"), "key", "root", "n_words")
        pivots = left.groupBy("bucket", "kind").agg(F.min(place).alias("to"))
        pairs = (left.join(pivots, ["bucket", "kind"]).where((F.col("root") != F.col("to.root")) & fits("n_words", "to.n_words"))
                 .select(F.greatest("key", "to.key").alias("a"), F.least("key", "to.key").alias("b")).distinct())
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        signed = (pairs.join(signs.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a")), "a")
                  .join(signs.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b")), "b"))
        found = _verified(signed.where(_agreeing("sign_a", "sign_b", F.greatest("n_a", "n_b"), least)).select("a", "b"), bodies, least)
        links = found if links is None else links.unionByName(found)
        if turn and not found.head(1):
            break
        roots = components(links, "a", "b").select(F.col("node").alias("key"), "root")
        grouped = left.drop("root").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        several = grouped.groupBy("bucket").agg(F.min(F.xxhash64("root")).alias("low"), F.max(F.xxhash64("root")).alias("high"))
        left = cut(grouped.join(several.where("low <> high").select("bucket"), "bucket"))
        if not left.head(1):
            return cut(links)
    wide = cut(left.select("bucket", "key", "n_words", "root").join(signs.select("key", "sign"), "key"))
    x, y = wide.alias("x"), wide.alias("y")
    others = (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root"))
                     & fits(F.col("x.n_words"), F.col("y.n_words"))
                     & _agreeing("x.sign", "y.sign", F.greatest("x.n_words", "y.n_words"), least))
              .select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")).distinct())
    return cut(links.unionByName(_verified(cut(others.join(tried, ["a", "b"], "left_anti")), bodies, least)))


def near_classes(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links, and ``key, class``: the digest of each text that has a near copy, with its group's smallest digest."""
    links = near_links(docs, text, least)
    return links, components(links, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("class"))


def classified(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with binary ``_class``, and the verified links.

    Equal texts, empty ones too, share a class, and so do texts joined by a chain of links. A missing text has no
    class (null) and never a copy. Texts of fewer than five words allow no edit, so only those of equal words are near copies.
    """
    links, classes = near_classes(docs, text, least)
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.col(f"`{text}`"))))
    return (keyed.join(classes.withColumnRenamed("key", "_key").withColumnRenamed("class", "_class"), "_key", "left")
            .withColumn("_class", F.coalesce("_class", "_key")), links)


def deduplicated(docs: DataFrame, order: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near copies: the one with the smallest ``order``, then the smallest row hash.

    Rows without text stay, all of them. Rows alike in every column count once. Columns are those of ``docs``.
    """
    _, classes = near_classes(docs, text, least)
    keyed = (docs.withColumn("_key", F.unhex(F.md5(F.col(f"`{text}`")))).withColumn("_row", row_hash(docs))
             .withColumn("_order", F.coalesce(F.col(f"`{order}`").cast("long"), F.lit((1 << 63) - 1))))
    light = keyed.where("_key is not null").select("_key", "_order", "_row")
    best = (light.groupBy("_key").agg(F.min(F.struct("_order", "_row")).alias("best"))
            .join(classes.withColumnRenamed("key", "_key"), "_key", "left")
            .groupBy(F.coalesce("class", "_key").alias("class"))
            .agg(F.min(F.struct(F.col("best._order").alias("_order"), F.col("best._row").alias("_row"), F.col("_key"))).alias("w"))
            .select("w._key", "w._order", "w._row"))
    kept = keyed.join(best, ["_key", "_order", "_row"], "left_semi").dropDuplicates(["_key", "_order", "_row"])
    return kept.unionByName(keyed.where("_key is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_order_minhash(spark, sf_dir):
    """Per document its class (smallest document of the class), the class's size and ``n_links``.

    ``n_links`` counts the verified links of its text that hold the class together, not all texts alike.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, links = classified(docs)
    rows = cut(found.select("doc_id", "_key", "_class"))
    ends = links.select(F.col("a").alias("_key")).unionByName(links.select(F.col("b").alias("_key")))
    degree = ends.groupBy("_key").agg(F.count("*").alias("n_links"))
    # Written, so that a class that many rows share can be split between tasks of the join.
    names = cut(rows.where("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("class_id"),
                                                                         F.count("*").alias("class_size")))
    return (rows.join(names, "_class", "left").join(degree, "_key", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))

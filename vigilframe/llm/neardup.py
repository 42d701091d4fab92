"""Near-duplicate texts by weighted minwise signatures made of hashed darts, and banded joining.

A text is the set of its distinct words.  Texts with equal sets form a class; everything below works on
one representative a class.

Darts: every word owns a region as wide as its weight, and a fixed random stream of darts (rank,
coordinate) into it, so many per rank as the region is wide.  A text throws the darts of its words up to a
rank at which it expects k ln k + 2k of them, and keeps the first dart of each of k coordinates; a text that
misses a coordinate goes on to higher ranks.  Two texts have the same first dart with a probability
equal to their weighted similarity.

A word's weight falls with the share of texts that have it, and the words are taken in two parts: if a
pair reaches a similarity, then the rare words or the common words of the two reach it by themselves
(the similarity of the whole lies between those of the parts).  So a text is signed twice:

* by all its words, the rare ones weighing most, in bands of two darts;
* by its common words alone, in bands of as many darts as it takes until hardly any text would have them
  all by chance.  That finds texts whose rare words were inserted or replaced.  Texts with next to no rare
  words have further, shorter bands.

Each banded row carries a small bitmap of its words from which a lower bound of the difference follows, so
that a pair goes on only if it may reach the threshold; the exact similarity of the word sets decides at the end.

A band value that a sample shows to be hot isn't shuffled.  Its texts are keyed by their rarest words
and sizes instead, so many that two texts that reach the threshold have one in common (prefix filter), so
nothing is lost and no task holds a hot value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.durable import cut, spread
from vigilframe.llm.splits import connected_components
from vigilframe.llm.words import words

BANDS, ROWS = 13, 2
#: Bands of the common words, and the darts at hand for one.
COMMON_BANDS, COMMON_ROWS = 11, 6
#: Further bands, of so many darts, for texts with fewer than FEW_RARE rare words to a common one.
FEW_BANDS, FEW_ROWS, FEW_RARE = 28, 4, 0.2
#: A word of at least this weight counts as rare.
RARE_WEIGHT = 0.25
#: A band of common words ends when so many texts would be expected to have its darts' words.
BY_CHANCE = 4
#: Banded rows to a partition, and the most partitions.
BANDED_ROWS, BANDED_PARTS = 600_000, 100_000
#: Texts from which hot band values are told, and how often one must occur among them.
HOT_SAMPLE, HOT_LEAST = 50_000, 10
#: A word in a smaller share of the texts has full weight.  Only more common ones are sent to the workers: at most words per text / RARE.
RARE = 1e-5
LEAST_WEIGHT = 1 / 512
#: Rows of one band value that are compared in one task; more are split into blocks.
BLOCK = 20_000
_BITS = 96


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _exponential() -> np.ndarray:
    """Exponential variates at 2^16 even steps of probability."""
    return -np.log1p(-(np.arange(1 << 16) + 0.5) / (1 << 16))


def signatures(offsets: np.ndarray, tokens: np.ndarray, weights: np.ndarray, k: int, marks: np.ndarray | None = None) -> np.ndarray:
    """First darts (rank and name in one number) of k coordinates for texts given as runs of words.

    offsets: where each text's words begin and the last end; every text has at least one word.
    marks: a number below 64 for each word, which its darts then carry in their lowest six bits.
    """
    n = len(offsets) - 1
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.add.reduceat(weights, offsets[:-1]) if n else np.zeros(0)
    wanted = (k * math.log(k) + 2 * k) / total
    todo = np.arange(n)
    reach = np.maximum(wanted, 1.0)
    while len(todo):
        # texts of like reach together, so that few needless darts are thrown
        level = np.ceil(np.log2(reach[todo])).astype(int)
        left = []
        for lv in np.unique(level):
            group = todo[level == lv]
            upto = float(2.0**lv)
            for part in np.array_split(group, max(1, int(len(group) * upto / 300_000))):
                _throw(best, part, reach, upto, offsets, tokens, weights, k, marks)
                got = (best.reshape(n, k)[part] != np.iinfo(np.uint64).max).all(1)
                left.append(part[~got])
        todo = np.concatenate(left) if left else np.zeros(0, int)
        reach[todo] *= 2.0
    return best.reshape(n, k)


def _throw(best: np.ndarray, texts: np.ndarray, reach: np.ndarray, upto: float, offsets: np.ndarray, tokens: np.ndarray, weights: np.ndarray, k: int, marks: np.ndarray | None) -> None:
    length = offsets[texts + 1] - offsets[texts]
    at = np.repeat(offsets[texts] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    word, place = np.unique(tokens[at], return_inverse=True)
    weight = np.zeros(len(word))
    weight[place] = weights[at]
    owner = np.repeat(texts, length)
    # occurrences sorted by word, to spread a word's darts over its texts
    order = np.argsort(place, kind="stable")
    owner = owner[order]
    first = np.searchsorted(place[order], np.arange(len(word) + 1))
    alive = np.arange(len(word))
    rank = np.zeros(len(word))
    step = 0
    exponential = _exponential()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base = _mix(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    while len(alive):
        h = _mix(base[alive] + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        rank = rank + exponential[(h & np.uint64(0xFFFF)).astype(np.int64)] / weight[alive]
        on = rank <= upto
        alive, rank = alive[on], rank[on]
        found.append((alive, rank, _mix(h[on])))
        step += 1
    if not found:
        return
    w = np.concatenate([f[0] for f in found])
    r = np.concatenate([f[1] for f in found])
    h = np.concatenate([f[2] for f in found])
    many = first[w + 1] - first[w]
    spread = np.repeat(first[w] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    text = owner[spread]
    # the rank to 2^-16 in the upper half, the dart's name in the lower
    name = h >> np.uint64(32)
    if marks is not None:
        mark = np.zeros(len(word), np.uint64)
        mark[place] = marks[at]
        name = (name & np.uint64(0xFFFFFFC0)) | mark[w]
    dart = (np.minimum(r * 65536.0, 4.29e9).astype(np.uint64) << np.uint64(32)) | name
    coordinate = (h & np.uint64(0xFFFFFF)) % np.uint64(k)
    slot = text * k + np.repeat(coordinate.astype(np.int64), many)
    dart, r = np.repeat(dart, many), np.repeat(r, many)
    within = r <= reach[text]
    np.minimum.at(best, slot[within], dart[within])


def word_sets(text: Column) -> Column:
    """The distinct words as sorted 32-bit hashes."""
    return F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.shiftright(F.xxhash64(w), 32).cast("int"))))


def word_weights(sets: DataFrame, rare: float = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Words in at least the share ``rare`` of all different texts, sorted, their weights - 1 for a word of one text, falling with its share -, their shares, and the number of texts."""
    n = sets.count()
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    common = counts.filter((F.col("df") >= max(2.0, n * rare))).toArrow()
    word = common.column("w").to_numpy()
    share = common.column("df").to_numpy() / max(n, 1)
    weight = np.clip((np.log(1 / share) / math.log(max(min(1 / rare, n), 2))) ** 3, LEAST_WEIGHT, 1.0) if len(word) else np.zeros(0)
    order = np.argsort(word)
    return word[order], weight[order], share[order], n


def _bitmap(offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits set by the words of each text, and its number of words (up to 255) in the next byte; the three left over stay zero, as zeros compress."""
    n = len(offsets) - 1
    bit = (_mix(tokens.astype(np.uint64) + np.uint64(77)) % np.uint64(_BITS)).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    grid = np.zeros((n, 128), bool)
    grid[text, bit] = True
    packed = np.packbits(grid, axis=1, bitorder="little").view("<u8")
    size = np.minimum(np.diff(offsets), 255).astype(np.uint64)
    return packed[:, 0].copy(), packed[:, 1] | (size << np.uint64(32))


def _may_reach(m0a, m1a, m0b, m1b, threshold: float) -> np.ndarray:
    """Whether two word sets can have the similarity, by their bitmaps: never false where they have."""
    low = np.uint64((1 << 32) - 1)
    na, nb = (m1a >> np.uint64(32)).astype(np.int64), (m1b >> np.uint64(32)).astype(np.int64)
    apart = np.bitwise_count(m0a ^ m0b).astype(np.int64) + np.bitwise_count((m1a ^ m1b) & low)
    most = (1 - threshold) / (1 + threshold) * (na + nb) + 1e-9
    return (apart <= most) | (na == 255) | (nb == 255)


def _pairs_of_runs(key: np.ndarray, rows: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    ids, m0, m1 = rows
    a, b = [], []
    here = np.nonzero(key[1:] == key[:-1])[0]
    d = 1
    while len(here):
        i, j = here, here + d
        ok = _may_reach(m0[i], m1[i], m0[j], m1[j], threshold) & (ids[i] != ids[j])
        a.append(np.minimum(ids[i], ids[j])[ok])
        b.append(np.maximum(ids[i], ids[j])[ok])
        d += 1
        here = here[here + d < len(key)]
        here = here[key[here + d] == key[here]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _starts(length: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(length))).astype(np.int64)


def _seeded(n: int, bands: int, kind: int) -> np.ndarray:
    return np.full((n, bands), kind, np.uint64) + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)


def fixed_bands(first: np.ndarray, bands: int, kind: int) -> np.ndarray:
    """Band values (texts x bands) of ``bands`` equal runs of darts."""
    key = _mix(_seeded(len(first), bands, kind))
    for r in range(first.shape[1] // bands):
        key = _mix(key + first[:, r :: first.shape[1] // bands])
    return key


def grown_bands(first: np.ndarray, bands: int, need: float, kind: int) -> np.ndarray:
    """Band values of runs of darts that end, after two at least, when the marks of their words (thirds of a bit) come to ``need`` bits."""
    per = first.shape[1] // bands
    key = _mix(_seeded(len(first), bands, kind))
    bits = np.zeros(key.shape)
    for r in range(per):
        dart = first[:, r::per]
        on = (bits < need) | (r < 2)
        key = np.where(on, _mix(key + dart), key)
        bits += (dart & np.uint64(63)).astype(float) / 3
    return key


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sizes to 16 by themselves, greater ones by quarters."""
    return np.where(n <= 16, n, 16 + np.floor(np.log(np.maximum(n, 16) / 16) / math.log(1.25))).astype(np.int64)


def prefix_keys(offsets: np.ndarray, tokens: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) so that two texts that reach the threshold have a key in common: their rarest words with both sizes.

    Of two texts of n and m words that share at least o, each has one of the shared words among its
    rarest n - o + 1 or m - o + 1, the order being the same for both.  o follows from the sizes.
    """
    length = np.diff(offsets)
    order = np.lexsort((tokens, -weights, np.repeat(np.arange(len(length)), length)))
    ranked = tokens[order].astype(np.uint64)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(length):
        own = np.nonzero(length == n)[0]
        m = np.arange(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1)
        mine = int(_size_class(np.array([n]))[0])
        for c, least in zip(*(x.tolist() for x in np.unique(_size_class(m), return_index=True))):
            shared = math.ceil(threshold / (1 + threshold) * (n + int(m[least])) - 1e-9)
            upto = int(n) - shared + 1
            if upto < 1:
                continue
            at = offsets[own][:, None] + np.arange(upto)[None, :]
            pair = np.uint64(min(c, mine) << 20 | max(c, mine))
            keys.append(_mix(_mix(ranked[at.ravel()] + np.uint64(0x5851F42D4C957F2D)) + pair))
            texts.append(np.repeat(own, upto))
    return np.concatenate(texts), np.concatenate(keys)


class _Signer:
    """Band values of texts given as runs of words.  known, weight, share: the words that aren't rare, of n texts."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, share: np.ndarray, n: int, bands: int) -> None:
        self.known, self.bands = known, bands
        self.weight = weight
        self.milder = np.clip(np.log(1 / np.maximum(share, 1e-12)) / math.log(max(n, 3)), 0.02, 1.0)
        self.mark = np.minimum(np.floor(3 * np.log2(1 / np.maximum(share, 1e-12))), 63).astype(np.uint64)
        self.need = math.log2(max(n / BY_CHANCE, 2))

    def look(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, places among the known words, -1 for others)"""
        place = np.full(len(tokens), -1)
        w = np.ones(len(tokens))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
            same = self.known[at] == tokens
            place[same] = at[same]
            w[same] = self.weight[at[same]]
        return w, place

    def keys(self, offsets: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, weights of the words)"""
        w, place = self.look(tokens)
        rare = (w >= RARE_WEIGHT) | (place < 0)
        n_rare = np.add.reduceat(rare, offsets[:-1], dtype=np.int64)
        n_common = np.diff(offsets) - n_rare
        texts, keys = [], []

        def add(chosen: np.ndarray, of: np.ndarray) -> None:
            texts.append(np.repeat(chosen, of.shape[1]))
            keys.append(of.ravel())

        def part(chosen: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            inside = np.zeros(len(n_rare), bool)
            inside[chosen] = True
            at = np.nonzero(words & np.repeat(inside, np.diff(offsets)))[0]
            return _starts(np.add.reduceat(words, offsets[:-1], dtype=np.int64)[chosen]), at

        some = np.nonzero(n_rare > 0)[0]
        if len(some):
            own, at = part(some, np.ones(len(tokens), bool))
            add(some, fixed_bands(signatures(own, tokens[at], w[at], self.bands * ROWS), self.bands, 0))
        usual = np.nonzero(n_common > 0)[0]
        if len(usual):
            own, at = part(usual, ~rare)
            add(usual, grown_bands(signatures(own, tokens[at], self.milder[place[at]], COMMON_BANDS * COMMON_ROWS, self.mark[place[at]]), COMMON_BANDS, self.need, 1))
        few = np.nonzero(n_rare < FEW_RARE * n_common)[0]
        if len(few):
            own, at = part(few, ~rare)
            add(few, fixed_bands(signatures(own, tokens[at], np.ones(len(at)), FEW_BANDS * FEW_ROWS), FEW_BANDS, 2))
        return np.concatenate(texts), np.concatenate(keys), w


def near_duplicates(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8, bands: int = BANDS, rare: float = RARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts whose sets of distinct words reach the similarity ``threshold``.

    members: id, class - the least id with the same set of words.  Texts without words (null, empty, only
    marks) are in no class and have no row.  links: class_a < class_b, similarity - pairs of classes, each
    once, with the exact similarity.  A hot class of copies is one row from the first aggregation on; the texts
    of a hot band value are keyed by their rarest words before the shuffle, and a value that still has more than
    ``block`` rows is compared block against block in tasks of their own, so no pair is left out.  Ids must be unique integers.  An empty table gives two empty frames.
    """
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")))
    sets = texts.select("id", word_sets(F.col("text")).alias("words")).filter(F.size("words") > 0)
    keyed = sets.withColumn("set", F.xxhash64("words"))
    heads = cut(keyed.groupBy("set").agg(F.min(F.struct("id", "words")).alias("h")).select("set", "h.id", "h.words"))
    members = cut(keyed.select("id", "set").join(heads.select("set", F.col("id").alias("class")), "set").select(F.col("id").alias(id_col), "class"))
    spark = df.sparkSession
    known, weight, share, n = word_weights(heads, rare)
    common = spark.sparkContext.broadcast((known, weight, share, n, bands))
    cores = heads.select("id", "words")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                lists = part.column(1)
                yield part.column(0).to_numpy(), _starts(lists.value_lengths().to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(*common.value)
        for _, offsets, tokens in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(signer.keys(offsets, tokens)[1].view(np.int64))], names=["key"])

    hot = np.zeros(0, np.int64)
    if n > block:  # else no value can have more rows than that
        taken = min(1.0, HOT_SAMPLE / n)
        sample = cores.filter(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(1 << 30)) < F.lit(int(taken * (1 << 30))))
        often = F.count("*") >= F.lit(max(HOT_LEAST, int(block * taken)))
        # at most the sample's bands / HOT_LEAST values
        hot = np.sort(sample.mapInArrow(values, "key long").groupBy("key").agg(often.alias("hot")).filter("hot").select("key").toArrow().column("key").to_numpy())
    hot_values = spark.sparkContext.broadcast(hot.view(np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hot = _Signer(*common.value), hot_values.value
        for ids, offsets, tokens in runs(batches):
            m0, m1 = _bitmap(offsets, tokens)
            text, key, w = signer.keys(offsets, tokens)
            if len(hot):
                burnt = np.isin(key, hot)
                mine = np.unique(text[burnt])
                text, key = text[~burnt], key[~burnt]
                if len(mine):
                    at = np.concatenate([np.arange(offsets[x], offsets[x + 1]) for x in mine])
                    which, more = prefix_keys(_starts(np.diff(offsets)[mine]), tokens[at], w[at], threshold)
                    text, key = np.concatenate((text, mine[which])), np.concatenate((key, more))
            for part in np.array_split(np.arange(len(text)), max(1, len(text) // 200_000)):
                x = text[part]
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(ids[x]), pa.array(m0[x].view(np.int64)), pa.array(m1[x].view(np.int64))], names=["key", "id", "m0", "m1"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n * (bands + COMMON_BANDS) // BANDED_ROWS, BANDED_PARTS))
    banded = cores.mapInArrow(sign, "key long, id long, m0 long, m1 long").repartition(parts, "key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pairs: key null; rows of a band value beyond ``block``: with their key and block
        def out(a, b, key=None, blocks=None, m0=None, m1=None) -> pa.RecordBatch:
            n = len(a)
            given = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), given(b, pa.int64()), given(key, pa.int64()), given(blocks, pa.int64()), given(m0, pa.int64()), given(m1, pa.int64())], names=["a", "b", "key", "block", "m0", "m1"])

        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        hot, seen = None, 0

        def finish(rows: list[np.ndarray], more: bool) -> Iterator[pa.RecordBatch]:
            """Emits what is complete; keeps the last run if more may follow."""
            nonlocal kept, hot, seen
            key = rows[0]
            if hot is not None:
                n = int(np.searchsorted(key, hot, "right")) if len(key) else 0
                if n:
                    yield out(rows[1][:n], None, key[:n], (seen + np.arange(n)) // block, rows[2][:n], rows[3][:n])
                    seen += n
                    rows = [x[n:] for x in rows]
                    key = rows[0]
                if len(key) or not more:
                    hot, seen = None, 0
            end = len(key)
            if more and end:
                end = int(np.searchsorted(key, key[-1], "left"))
                if len(key) - end > block:
                    hot = key[-1]
                    yield out(rows[1][end:], None, key[end:], np.arange(len(key) - end) // block, rows[2][end:], rows[3][end:])
                    seen = len(key) - end
                    rows = [x[:end] for x in rows]
                    key = rows[0]
            kept = [x[end:] for x in rows]
            a, b = _pairs_of_runs(key[:end], [rows[1][:end], rows[2][:end].view(np.uint64), rows[3][:end].view(np.uint64)], threshold)
            if len(a):
                yield out(a, b)

        for batch in batches:
            yield from finish([np.concatenate((x, batch.column(c).to_numpy())) for c, x in enumerate(kept)], True)
        yield from finish(kept, False)

    met = cut(banded.mapInArrow(meet, "a long, b long, key long, block long, m0 long, m1 long"))
    pairs = met.filter("key is null").select("a", "b").union(_block_pairs(met.filter("key is not null"), threshold)).distinct()
    pairs = cut(pairs)
    # the words of all texts are shuffled once; what meets twice is the words of candidates
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    cores = cut(cores.join(ends, "id", "left_semi"))
    linked = pairs.join(cores.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(cores.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    scored = linked.select("a", "b", shared.alias("i"), (F.size("wa") + F.size("wb") - shared).alias("u")).filter(F.col("i") >= F.lit(threshold) * F.col("u") - F.lit(1e-9))
    return members, scored.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (F.col("i") / F.col("u")).alias("similarity"))


def _block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs within hot band values: every block meets every block of its value in a group of its own."""
    counts = rows.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    lent = rows.join(counts, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = lent.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), F.col("a").alias("id"), "m0", "m1")

    def compare(key, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        m0, m1 = group.column("m0").to_numpy().view(np.uint64), group.column("m1").to_numpy().view(np.uint64)
        second = group.column("second").to_numpy()
        left, right = (np.nonzero(~second)[0], np.nonzero(second)[0]) if key[1].as_py() != key[2].as_py() else (np.arange(len(ids)),) * 2
        found = [np.zeros((0, 2), np.int64)]
        for x in left:
            ok = _may_reach(m0[x], m1[x], m0[right], m1[right], threshold) & (ids[right] != ids[x])
            other = ids[right][ok]
            found.append(np.stack([np.minimum(other, ids[x]), np.maximum(other, ids[x])], 1))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return tasks.groupBy("key", "i", "j").applyInArrow(lambda key, group: compare(key, group), "a long, b long")


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per document with words: id, class, group (the least class connected by links) and links, the number of links of its class."""
    id_col = members.columns[0]
    parts = connected_components(links.select(F.col("class_a").alias("src"), F.col("class_b").alias("dst")))
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(parts.withColumnRenamed("node", "class"), "class", "left").join(ends, "class", "left").select(id_col, "class", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def document_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of documents, those within a class and those of linked classes."""
    id_col = members.columns[0]
    m = members.select("class", F.col(id_col).alias("id"))
    # Most classes have one member: only those with more are joined with themselves.
    many = m.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
    within = m.join(many, "class", "left_semi")
    same = within.select("class", F.col("id").alias("x")).join(within.select("class", F.col("id").alias("y")), "class").filter("x < y").select("x", "y")
    across = links.select("class_a", "class_b").join(m.select(F.col("class").alias("class_a"), F.col("id").alias("x")), "class_a").join(m.select(F.col("class").alias("class_b"), F.col("id").alias("y")), "class_b").select("x", "y")
    return same.union(across).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))

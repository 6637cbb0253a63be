"""N-gram Jaccard join (11): adaptive multi-match prefixes.

A document is the set of its five-word shingles; two sets link when they are at four fifths of Jaccard or more. Equal
sets are one class from the start, so copies never meet in pairs. All sets are put in one order, rare shingles first.
A set of n members shares at least t = ceil(0.8 n) of them with any partner, so two partners share at least l members
among the first n - t + l of each. Every set chooses its own l: each step makes its prefix one member longer, which
costs more matches, and lets it ask for one more shared member, which leaves fewer pairs to verify; the counts of
common shingles over all documents tell which l is cheapest. How many shared prefix members a pair of sizes n and m
needs before it is verified follows from both (:func:`needed`): never fewer than the smaller l, and more where the
sizes are near each other.

Large groups of near copies are not compared all with all. Each set in lists of over ``TRY`` sets is tried against one
member of these lists (the one it shares most with), in rounds, as long as the tries move at least a share ``LIVE`` of
a list's open sets. Links found so join sets into components. Only pairs
that are still in different components go through the multi-match join. A list of over ``HOT`` sets that lie in
different components is opened by a second shared member, out of prefixes one longer: that is exact too.

Every set has ``BITS`` parities: one for each part of the hashes, odd where an odd number of its members falls. Each
member that only one of two sets has turns one of them, so two sets differ in at least as many members as parities.
Pairs that differ in too many are left out before any set is read (:func:`_parted`), in crowded lists within the join
itself, where near copies would else meet under each of their common keys. That is exact; it tells most pairs of up
to some 1,500 members and lets longer ones through.

Verification reads the documents again, makes the sets of those in some pair, and compares whole sets (48-bit hashes
of shingles; classes are told apart by 64 bits).

Defined results: a null or empty text has an empty set, is linked with nothing and is its own component; fewer words
than five are one shingle; repeated rows and equal texts fall together; a null id joins a component but never names
one unless all its members are null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, drop, fair_batches, settled, slim, table
from maskwright.llm.components import components
from maskwright.llm.registry import query

SHINGLE, PART = 5, (4, 5)
#: Lists of more open sets than HOT are opened by a second member; sets in lists of more than TRY are tried first, in so many rounds.
HOT, TRY, ROUNDS = 256, 8, 4
#: A list is tried again where the last round moved this share of its open sets to another root, and rounds go on while each
#: finds this share of all links found so far. What is left goes through the join.
LIVE = 1 / 8
#: Parities of a set, held as 64 to a number.
BITS = 1024
#: The longest multi-match; what posting a member costs next to one match of it, and verifying a pair, for each member;
#: and how often a member is shared that is not known to be common.
MOST_NEED, POST, VERIFY, SHARED = 8, 4.0, 0.5, 0.05
#: Shingles are counted in so many buckets over all documents; so many of the fullest ones are known to every task.
BUCKETS, KNOWN = 1 << 22, 1 << 18
#: Large tables are shuffled in so many turns, one for this many prefix members, so the disk holds a part of them at a time.
TURNS, TURN = 4, 1 << 23
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
NUMBERS = ("n", "rest")

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sets of shingle hashes, many texts at a time: words are cut and hashed as whole byte arrays."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.up, self.down = size, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BACK, np.uint64)]))
        return self.up, self.down

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word and where it begins; ``cuts``: where texts begin."""
        gap = _GAP[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        inner = cuts[cuts < len(data)]
        begins[inner] |= ~gap[inner]
        ends = ~gap
        ends[:-1] &= gap[1:] | begins[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return _mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)), starts

    def _text(self, data: np.ndarray) -> np.ndarray:
        """Word hashes of one text of any length, cut at white space."""
        out, at = [], 0
        while at < len(data):
            to = at + CHUNK
            while to < len(data) and not _GAP[data[to]]:
                to += 1
            out.append(self._words(data[at:to], np.zeros(1, np.int64))[0])
            at = to
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _joined(self, words: np.ndarray, size: int) -> np.ndarray:
        n = len(words) - size + 1
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _BASE + words[k : k + n]
        return _mixed(out + np.uint64(size))

    def _set(self, words: np.ndarray, shingles: np.ndarray | None = None) -> np.ndarray:
        if len(words) < self.size:
            return self._joined(words, len(words)) if len(words) else np.empty(0, np.uint64)
        return np.unique(self._joined(words, self.size) if shingles is None else shingles)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted set of each text, in order; empty for null."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            part, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            if to == at + 1:
                yield self._set(self._text(part))
            else:
                words, starts = self._words(part, cuts[:-1])
                shingles = self._joined(words, self.size) if len(words) >= self.size else np.empty(0, np.uint64)
                first = np.searchsorted(starts, cuts)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    yield self._set(words[a:b], shingles[a : max(a, b - self.size + 1)])
            at = to


def _tokens(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.uint32)


def _class(shingles: np.ndarray) -> int:
    digest = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, same (hash of the text), place (hash of id and text), text as bytes."""
    return slim(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "doc_id", "text").alias("place"), F.col("text").cast("binary").alias("text")
    )


def heat(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the ``KNOWN`` buckets that most shingles of all documents fall in.

    Each task counts all its documents and passes on the buckets well above its average. Only the order of prefixes and
    the choice of l hang on these counts: any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, total = Shingler(size), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            held = []
            for s in shingler.sets(batch.column("text")):
                held.append(_tokens(s) % BUCKETS)
            tokens = np.concatenate(held) if held else np.empty(0, np.uint32)
            np.add.at(counts, tokens, 1)
            total += len(tokens)
        usual = total / BUCKETS
        hot = np.flatnonzero(counts > usual + 4 * max(1.0, usual**0.5))
        hot = hot[np.argsort(-counts[hot], kind="stable")[:KNOWN]]
        for at in range(0, len(hot), 1 << 16):
            some = hot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    counted = _rows(docs).select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "bucket").limit(KNOWN).toArrow()
    return found.column("bucket").to_numpy(), found.column("n").to_numpy()


def least_shared(n: int) -> int:
    """Members that a set of n shares with any partner, at least."""
    return -(-n * PART[0] // PART[1])


def choose_need(rates: np.ndarray, base: int, most: int) -> int:
    """The cheapest l for a set whose members, in order, stand in about ``rates`` sets; ``base``: the length of the prefix at l = 1."""
    length = np.arange(base, base + most)
    matches = np.cumsum(np.maximum(rates[: base + most - 1] - 1, SHARED))[length - 1]
    return int(np.argmin(POST * length + matches + VERIFY * len(rates) * matches / np.arange(1, most + 1))) + 1


def needed(n: Column, rest: Column, m: Column, more: Column) -> Column:
    """Shared prefix members without which sets of sizes n and m, with ``rest`` and ``more`` members behind their prefixes, cannot be at ``PART``.

    They must share 4/9 of n + m. Of the two prefixes, one ends first in the common order; what its set shares, it
    shares within both prefixes or behind its own.
    """
    part, whole = PART
    return F.ceil((n + m) * part / F.lit(part + whole)) - F.greatest(rest, more)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` ranges of the hashes, whether an odd number of members falls in it, as 64-bit numbers."""
    places = (shingles >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, same, place, class, n, rest, base, prefix, bits) per document. No shuffle.

    ``class`` names the set, ``n`` is its size, ``prefix`` holds its first n - rest members in order and the one after
    them, ``base`` is the length of the prefix at l = 1, ``bits`` holds the ``BITS`` parities of the set.
    """
    fair_batches(docs.sparkSession)
    rows = _rows(docs)
    sent = docs.sparkSession.sparkContext.broadcast(heat(docs, size))  # at most KNOWN pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rate = Shingler(size), np.zeros(BUCKETS, np.int64)
        rate[sent.value[0]] = sent.value[1]
        for batch in batches:
            names, sizes, rests, bases, prefixes, bits = [], [], [], [], [], []
            for shingles in shingler.sets(batch.column("text")):
                n, tokens = len(shingles), _tokens(shingles)
                rates = rate[tokens % BUCKETS]
                order = np.lexsort((shingles, rates))
                shared = least_shared(n)
                base = n - shared + 1 if n else 0
                length = base + choose_need(rates[order], base, min(MOST_NEED, shared)) - 1 if n else 0
                names.append(_class(shingles) if n else None)
                sizes.append(n)
                rests.append(n - length)
                bases.append(base)
                prefixes.append(tokens[order[: length + 1]].view(np.int32))
                bits.append(parities(shingles))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "same", "place")], pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rests, pa.int64()), pa.array(bases, pa.int32()), pa.array(prefixes, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "same", "place", "class", "n", "rest", "base", "prefix", "bits"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same bigint, place bigint, class bigint, n bigint, rest bigint, base int, prefix array<int>, bits array<bigint>")


def _packed(shingles: np.ndarray) -> bytes:
    """The first 48 bits of each hash, in order."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int = SHINGLE) -> DataFrame | None:
    """Those of the pairs (a, b) of classes whose whole sets are at ``PART`` or more; None where there are no pairs.

    The texts do not move: every task reads its documents again and makes the sets of those in a bitmap of the asked
    places. Where the bitmap has grown to its bound, more sets than asked are made, and drop out of the joins.
    """
    spark = docs.sparkSession
    pairs = cut_lineage(pairs.distinct())
    asked = classes.join(pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct(), "class", "left_semi").select("place")
    asked = cut_lineage(asked)
    n = asked.count()
    if not n:
        return None
    bits = 1 << min(27, max(20, (n * 32).bit_length()))
    words = asked.select((F.pmod("place", F.lit(bits)) / 64).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    chosen = np.zeros(bits // 64, np.int64)
    chosen[words.column("at").to_numpy()] = words.column("word").to_numpy()
    sent = spark.sparkContext.broadcast(chosen)  # 16 MB at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, done, field = Shingler(size), set(), sent.value
        for batch in batches:
            at = batch.column("place").to_numpy() & (bits - 1)
            mine = np.flatnonzero((field[at >> 6] >> (at & 63)) & 1)
            found: dict[int, bytes] = {}
            for shingles in shingler.sets(batch.column("text").take(pa.array(mine))):
                name = _class(shingles)
                if name not in done:  # repeated rows in one task
                    done.add(name)
                    found[name] = _packed(shingles)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["class", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = PART
        for batch in batches:
            good, b, right = [], None, None
            for a_set, b_name, b_set in zip(batch.column("left"), batch.column("b").to_pylist(), batch.column("right"), strict=True):
                if b_name != b:
                    b, right = b_name, _unpacked(b_set.as_py())
                left = _unpacked(a_set.as_py())
                place = np.searchsorted(right, left)
                both = int(np.count_nonzero(right[np.minimum(place, len(right) - 1)] == left))
                good.append(both * whole >= (len(left) + len(right) - both) * part)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = _rows(docs).select("place", "text").mapInArrow(make, "class bigint, set binary")
    left, right = held.select(F.col("class").alias("a"), F.col("set").alias("left")), held.select(F.col("class").alias("b"), F.col("set").alias("right"))
    met = pairs.join(left, "a").join(right, "b")
    return cut_lineage(met.select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint").distinct())


_POSTED = "slice(prefix, 1, CAST(n - rest AS INT))"


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that share enough prefix members to be verified."""
    sides = [classes.select(F.col("class").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in NUMBERS], F.expr(_POSTED).alias(f"{s}_prefix")) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    shared = F.size(F.array_intersect("a_prefix", "b_prefix")) + 1  # one to spare: two members may have one 32-bit token
    return met.where(shared >= needed(*[F.col(f"{s}_{c}") for s in "ab" for c in NUMBERS])).select("a", "b")


def _parted(left: Column, n: Column, right: Column, m: Column) -> Column:
    """Whether the parities of sets of n and m members alone tell that they are not at ``PART``."""
    part, whole = PART
    differ = reduce(Column.__add__, [F.bit_count(left[k].bitwiseXOR(right[k])) for k in range(BITS // 64)])
    return differ * (whole + part) > (n + m) * (whole - part)


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that their parities leave open."""
    sides = [classes.select(F.col("class").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    return met.where(~_parted(F.col("a_bits"), F.col("a_n"), F.col("b_bits"), F.col("b_n"))).select("a", "b")


def _opened(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """(first, second, class, root, numbers, bits): the lists of crowded members, parted by each second member after the first in a prefix one longer."""
    prefixed = crowded.join(classes.select("class", "base", "bits", F.expr("slice(prefix, 1, base + 1)").alias("prefix")), "class")
    after = F.expr("slice(prefix, array_position(prefix, token) + 1, size(prefix))")
    first = prefixed.where(F.expr("array_position(prefix, token) BETWEEN 1 AND base"))
    return first.select(F.col("token").alias("first"), F.explode(after).alias("second"), "class", "root", "bits", *NUMBERS)


def _apart(lists: DataFrame, keys: list[str], *more: Column, but: Column | None = None) -> DataFrame:
    """(a, b, ...) of the rows with equal keys that are in different components and near in size, without those that ``but`` tells; one row per key they share."""
    part, whole = PART
    x, y = lists.alias("x"), lists.alias("y")
    same = reduce(Column.__and__, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    near = F.least("x.n", "y.n") * whole >= F.greatest("x.n", "y.n") * part
    met = x.join(y, same & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & near & (F.lit(True) if but is None else ~but))
    return met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), *more)


def _open(lists: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The rows of those lists whose sets are in more than one component, and what ``more`` aggregates of each list."""
    mixed = lists.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *more).where("lo < hi").drop("lo", "hi")
    return lists.join(mixed, keys)


def _rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``classes`` with their root: themselves where nothing links them."""
    if roots is None:
        return classes.withColumn("root", F.col("class"))
    named = roots.select(F.col("node").alias("class"), F.col("root"))
    return classes.join(named, "class", "left").withColumn("root", F.coalesce("root", "class"))


def _in_turns(make: Callable[[int], DataFrame], turns: int) -> DataFrame:
    """What ``make`` gives for each turn, together; each turn's shuffle files go before the next."""
    return reduce(DataFrame.unionAll, [cut_lineage(make(k)) for k in range(turns)])


def _turn(column: str, turn: int, turns: int) -> Column:
    return F.pmod(F.hash(column), F.lit(turns)) == turn


def class_roots(
    docs: DataFrame, classes: DataFrame, turns: int = 1, size: int = SHINGLE, hot: int = HOT, rounds: int = ROUNDS, most: int = TRY, likely: DataFrame | None = None
) -> DataFrame | None:
    """(node, root): the component of every class that has a link; None without any.

    ``likely``: pairs (a, b) of classes that another method found; they are verified first, and only what their links leave apart is joined.
    """
    posted = classes.select("class", F.explode(F.expr(_POSTED)).alias("token"))

    def shared_members(turn: int) -> DataFrame:
        some = posted.where(_turn("token", turn, turns))
        twice = some.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("members")).where("members > 1")
        return some.join(twice, "token").select("token", "class", "members")

    lists, before = _in_turns(shared_members, turns), []
    edges, roots, tried, known = None, None, None, 0
    if likely is not None:
        tried = cut_lineage(_close(likely, classes))
        edges = verified(docs, classes, tried, size)
        roots = None if edges is None else components(edges)
    lists = _rooted(lists, roots).withColumn("live", F.lit(True))
    if roots is not None:
        lists = cut_lineage(_open(lists, ["token"]))
        before = [lists]
    for turn in range(rounds):
        large = lists.where((F.col("members") > most) & F.col("live"))
        # One member of each list is tried: a few orders, so that sets with many lists in common meet the same one.
        order = F.xxhash64("class", F.pmod("token", F.lit(4)), F.lit(turn))
        hub = large.groupBy("token").agg(F.min(F.struct(order.alias("order"), F.col("class").alias("b"), F.col("root").alias("other"))).alias("hub")).select("token", "hub.b", "hub.other")
        shared = large.join(hub, "token").where("root <> other").groupBy(F.col("class").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))
        best = shared.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b")
        pairs = _close(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes)
        pairs = cut_lineage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = verified(docs, classes, pairs, size)
        if found is None:
            break
        tried = pairs if tried is None else tried.unionAll(pairs)
        edges = found if edges is None else edges.unionAll(found)
        roots = components(edges)
        moved = _rooted(lists.drop("live").withColumnRenamed("root", "was"), roots)
        live = F.avg((F.col("root") != F.col("was")).cast("int")) >= LIVE
        lists = cut_lineage(_open(moved, ["token"], live.alias("live")).drop("was"))  # what lies in one component is done
        drop(*before)
        before = [lists]
        new = found.count()
        known += new
        if new < LIVE * known:
            break
    placed = cut_lineage(lists.drop("live").join(classes.select("class", *NUMBERS), "class"))
    drop(*before)
    large, calm = placed.where(F.col("members") > hot), placed.where(F.col("members") <= hot)
    # Members of crowded lists may be shared too: they count as if they were.
    crowds = large.groupBy("class").agg(F.count(F.lit(1)).alias("crowds"))
    calm = calm.join(crowds, "class", "left").withColumn("crowds", F.coalesce("crowds", F.lit(0)))
    need = needed(*[F.col(f"{s}.{c}") for s in "xy" for c in NUMBERS]) - F.least("x.crowds", "y.crowds")

    def promising(turn: int) -> DataFrame:
        met = _apart(calm, ["token"], need.alias("need"), but=None if turns == 1 else ~_turn("x.class", turn, turns))
        shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
        return shared.where("shared >= need").select("a", "b")

    pairs = _close(promising(0) if turns == 1 else _in_turns(promising, turns), classes)
    if not large.isEmpty():
        opened = _open(_opened(large.drop("members"), classes), ["first", "second"])
        parted = _parted(F.col("x.bits"), F.col("x.n"), F.col("y.bits"), F.col("y.n"))
        pairs = pairs.unionAll(_promising(_apart(opened, ["first", "second"], but=parted).distinct(), classes))
    found = verified(docs, classes, pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), size)
    if found is None:
        return roots
    return components(found if edges is None else edges.unionAll(found))


def near_copies(
    docs: DataFrame, size: int = SHINGLE, hot: int = HOT, rounds: int = ROUNDS, most: int = TRY, likely: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Per document: doc_id, same (hash of the text), n (members of its set), root (equal for linked sets; null for empty ones).

    ``likely`` makes the pairs that :func:`class_roots` verifies first, out of (same, class).
    """
    ready = cut_lineage(prints(docs, size))
    narrow = cut_lineage(ready.select("doc_id", "same", "n", "class"))
    turns = min(TURNS, 1 + (ready.agg(F.sum(F.col("n") - F.col("rest"))).first()[0] or 0) // TURN)
    firsts = [F.first(c).alias(c) for c in ("place", "base", "prefix", "bits", *NUMBERS)]
    classes = _in_turns(lambda turn: ready.where((F.col("n") > 0) & _turn("class", turn, turns)).groupBy("class").agg(*firsts), turns)
    drop(ready)
    found = None if likely is None else likely(narrow.where("n > 0").select("same", "class").distinct())
    roots = class_roots(docs, classes, turns, size, hot, rounds, most, found)
    if roots is None:
        return narrow.withColumnRenamed("class", "root")
    return narrow.join(roots, narrow["class"] == roots["node"], "left").select("doc_id", "same", "n", F.coalesce("root", "class").alias("root"))


def linked(docs: DataFrame, size: int = SHINGLE, hot: int = HOT, rounds: int = ROUNDS, most: int = TRY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included)."""
    found = settled(docs.sparkSession, lambda: near_copies(docs, size, hot, rounds, most))
    named = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(named, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0) t
), z AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS c FROM s GROUP BY doc_id
), r AS (
  SELECT c, min(doc_id) AS doc_id, any_value(n) AS n FROM z GROUP BY c
), q AS (
  SELECT g, count(*) AS often FROM s GROUP BY g
), f AS (
  SELECT s.doc_id, s.g, r.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY q.often, s.g) AS place
  FROM s JOIN r ON s.doc_id = r.doc_id JOIN q ON q.g = s.g
), p AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m
  FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE a.place <= a.n - (4 * a.n + 4) // 5 + 1 AND b.place <= b.n - (4 * b.n + 4) // 5 + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND x.g = y.g
  GROUP BY p.a, p.b, p.n, p.m HAVING 100 * count(*) >= 80 * (p.n + p.m - count(*))
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), t(a, b) AS (
  SELECT doc_id, doc_id FROM r UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a
), c AS (
  SELECT r.c, min(t.b) AS least FROM t JOIN r ON r.doc_id = t.a GROUP BY r.c
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN c ON c.c = z.c
"""


@query("op11_jaccard_join", ORACLE)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))

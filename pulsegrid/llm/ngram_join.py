"""N-gram Jaccard join by vertical partitioning.

Each text is its set of word shingles, and shingles have one global order: rare ones by hash, then the most frequent by
count. The order is cut into fragments; a pair's overlap is counted in each fragment by itself and the counts are summed.

Which pairs get counted comes from the order's beginning: two sets that are similar enough share a shingle among the
first of each. Every such shingle has a bucket of sets. Small buckets pair all their sets. In a large one each set is
first paired with one leader; what is linked is a class then, and only sets of different classes are paired after that.
So a group of near copies of any size costs pairs in proportion to it, and no link between classes is lost.

Before any shingle of a pair is sent, sketches of the two sets (parities, some bits a shingle) bound how many shingles
they don't share from below; a pair that this bound rules out is no link, and what is left is nearly all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, NOT_SPACE, Shared, Tables, Words, pick, pick_rows, shingles, sparing, table, text_slices
from .exact_dedup import SPACE

SIZE = 5
#: Similarity of `NEEDED` percent or more links.
NEEDED = 80
#: Shingles in more sets than this come last in the order, by count; at most MAX_FREQUENT of them, the most frequent.
#: Any other shingle has less than 1 / MAX_FREQUENT of all entries, so that its bucket is no task's undoing.
FREQUENT, MAX_FREQUENT = 64, 100_000
#: Sets that a bucket may have for all its pairs to be made at once, and the sets of a large bucket that one task holds.
SMALL, SALT_ROWS = 16, 5_000
#: Pairs of a set that share one copy of its segments, and rows (of two numbers) up to which a table goes to every task.
PAIRS_EACH, SENT_ROWS = 256, 1_000_000
#: Most bits of a sketch, as a power of two: 8 KB for the largest sets.
SKETCH_POWER = 16
FRAGMENTS = 8
#: Longs of the bit map that tells which sets are in a pair: 8 MB at most, whatever the number of pairs.
MAP_WORDS = 1 << 20
#: Set ids that a task remembers so as to send copies once, and shingles that it gathers before it sends them.
SEEN, SEND = 200_000, 250_000


def least_overlap(n: int) -> int:
    """The least overlap with any set that a set of n shingles can be linked with."""
    return -(-NEEDED * n // 100)


class Sets:
    """The shingle sets of an Arrow array of texts: (row, id, sorted shingles). The id is a hash of the whole set."""

    def __init__(self, size: int):
        self.size = size

    def of(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for a, _, data, offsets in text_slices(texts):
            for i, s in enumerate(shingles(Words(data, offsets, NOT_SPACE), self.size)):
                yield a + i, int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True), s


class Order:
    """The global order of shingles, given the frequent ones by rising count."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent)
        self.frequent = frequent[self.rank]

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set's rare shingles in order, and its frequent ones in order."""
        if not len(self.frequent):
            return s, s[:0]
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        hit = self.frequent[at] == s
        return s[~hit], s[hit][np.argsort(self.rank[at[hit]])]


def _once(sets: Iterator[tuple[int, int, np.ndarray]], seen: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    for row, node, s in sets:
        if len(s) and node not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            yield row, node, s


def _emit(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names)


def _to_count(size: int, shared):
    """Shingles to count: without known frequent ones those of the set's prefix, else what those push into the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(size), set()
        order = Order(shared.value) if shared is not None else None
        for batch in batches:
            out, held = [np.empty(0, dtype=np.uint64)], 0
            for _, _, s in _once(sets.of(batch.column(0)), seen):
                held += len(out[-1])
                if held > SEND:
                    yield _emit([np.concatenate(out).astype(np.int64)], ["shingle"])
                    out, held = [out[-1][:0]], 0
                prefix = len(s) - least_overlap(len(s)) + 1
                if order is None:
                    out.append(s[:prefix])
                    continue
                rare, frequent = order.split(s)
                moved = int((frequent <= s[prefix - 1]).sum())
                if 4 * moved >= prefix:
                    out.append(rare)  # mostly common text: its other shingles are likely to be frequent too
                elif moved:
                    out.append(rare[prefix - moved : prefix])
            yield _emit([np.concatenate(out).astype(np.int64)], ["shingle"])

    return run


def _frequent(texts: DataFrame, size: int, known: np.ndarray | None, limit: int) -> np.ndarray:
    """Shingles in more than FREQUENT sets, by rising count; the most frequent `limit` of them."""
    shared = Shared(texts.sparkSession, known) if known is not None else None
    with sparing(texts.sparkSession):
        counts = texts.mapInArrow(_to_count(size, shared), "shingle long").groupBy("shingle").count().where(F.col("count") > FREQUENT)
        rows = counts.orderBy(F.col("count").desc(), "shingle").limit(limit).toArrow()
    return rows.column("shingle").to_numpy().astype(np.uint64)[::-1], rows.column("count").to_numpy()[::-1]


def frequent_shingles(texts: DataFrame, size: int = SIZE, limit: int = MAX_FREQUENT) -> np.ndarray:
    """Frequent shingles by rising count.

    The first pass counts the prefixes under the order by hash alone. Taking the frequent ones out of a prefix brings
    others in, which the second pass counts. The order is free to choose: it decides the cost and not the result.
    """
    first, n_first = _frequent(texts, size, None, limit)
    if not len(first):
        return first
    more, n_more = _frequent(texts, size, first, limit)
    both, counts = np.concatenate([first, more]), np.concatenate([n_first, n_more])
    return both[np.lexsort((both, counts))][-limit:]


def _prefixes(size: int, shared):
    names = ["shingle", "node", "n", "place", "rare", "frequent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, order = Sets(size), set(), Order(shared.value)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for _, node, s in _once(sets.of(batch.column(0)), seen):
                if held > SEND:
                    yield _emit([np.concatenate(x) for x in out], names)
                    out, held = [[] for _ in names], 0
                rare, frequent = order.split(s)
                prefix = len(s) - least_overlap(len(s)) + 1
                first = np.concatenate([rare[:prefix], frequent[: max(0, prefix - len(rare))]])
                place = np.arange(prefix, dtype=np.int32)
                held += prefix
                fill = lambda x, kind=np.int32, n=prefix: np.full(n, x, dtype=kind)
                for column, x in zip(out, (first.astype(np.int64), fill(node, np.int64), fill(len(s)), place, fill(len(rare)), place >= len(rare)), strict=True):
                    column.append(x)
            if out[0]:
                yield _emit([np.concatenate(x) for x in out], names)

    return run


def _segments(nodes: list[int], places: list[int], segments: list[np.ndarray]) -> pa.RecordBatch:
    flat, ends = np.concatenate(segments), np.cumsum([0, *map(len, segments)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.int32()), lists], ["node", "fragment", "segment"])


def _fragments(size: int, shared_order, shared_map, fragments: int):
    """The segments of sets that may be in a pair: fragments cut the rare shingles by hash; the frequent ones are the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, order, bits = Sets(size), set(), Order(shared_order.value), shared_map.value
        cuts = np.array([(i << 64) // (fragments - 1) for i in range(1, fragments - 1)], dtype=np.uint64)
        for batch in batches:
            nodes, places, segments, held = [], [], [], 0
            for _, node, s in _once(sets.of(batch.column(0)), seen):
                at = node & (64 * MAP_WORDS - 1)
                if not (int(bits[at >> 6]) >> (at & 63)) & 1:
                    continue
                if held > SEND:
                    yield _segments(nodes, places, segments)
                    nodes, places, segments, held = [], [], [], 0
                held += len(s)
                rare, frequent = order.split(s)
                for i, part in enumerate([*np.split(rare, np.searchsorted(rare, cuts)), frequent]):
                    if len(part):
                        nodes.append(node)
                        places.append(i)
                        segments.append(part.astype(np.int64))
            if nodes:
                yield _segments(nodes, places, segments)

    return run


def _pair_map(pairs: DataFrame) -> np.ndarray:
    """A bit for each set that is in a pair. It has MAP_WORDS longs; several sets may share a bit."""
    node = F.explode(F.array("a", "b"))
    at = F.col("node").bitwiseAND(F.lit(64 * MAP_WORDS - 1))
    words = pairs.select(node.alias("node")).select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit"))
    with sparing(pairs.sparkSession):
        rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # MAP_WORDS rows at most
    out = np.zeros(MAP_WORDS, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint64)
    return out


def similar(na: Column, nb: Column, overlap: Column) -> Column:
    return 100 * overlap >= NEEDED * (na + nb - overlap)


def possible(na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    """Whether sets of these sizes that first meet at these places can be similar."""
    overlap = F.least(na - pa_, nb - pb)
    return similar(na, nb, overlap)


def verify(texts: DataFrame, pairs: DataFrame, order, tables: Tables, size: int = SIZE, fragments: int = FRAGMENTS) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps counted fragment by fragment, summed by pair.

    A set that is in many pairs has its segments dealt over salts, one for each PAIRS_EACH pairs.
    """
    shared_map = Shared(texts.sparkSession, _pair_map(pairs))
    segments = texts.mapInArrow(_fragments(size, order, shared_map, fragments), "node long, fragment int, segment array<long>").dropDuplicates(["node", "fragment"])
    often = pairs.select(F.explode(F.array("a", "b")).alias("often")).groupBy("often").agg(F.ceil(F.count(F.lit(1)) / PAIRS_EACH).cast("int").alias("salts"))
    often = tables.write(often.where("salts > 1"))
    many = F.broadcast(often) if often.count() <= SENT_ROWS else often
    cut = pairs
    for side, other in (("a", "b"), ("b", "a")):
        cut = cut.join(many.withColumnRenamed("often", f"often_{side}").withColumnRenamed("salts", f"salts_{side}"), F.col(side) == F.col(f"often_{side}"), "left")
        cut = cut.withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), F.coalesce(f"salts_{side}", F.lit(1))).cast("int"))
    cut = cut.select("a", "b", "na", "nb", "salt_a", "salt_b", F.explode(F.array(*(F.lit(i) for i in range(fragments)))).alias("fragment"))
    salted = segments.join(many, F.col("node") == F.col("often"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    left = salted.select(F.col("node").alias("a"), "fragment", F.col("salt").alias("salt_a"), F.col("segment").alias("sa"))
    right = salted.select(F.col("node").alias("b"), "fragment", F.col("salt").alias("salt_b"), F.col("segment").alias("sb"))
    met = cut.join(left, ["a", "fragment", "salt_a"]).join(right, ["b", "fragment", "salt_b"])
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))
    return total.where(similar(F.col("na"), F.col("nb"), F.col("overlap"))).select("a", "b")


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls on each of some places, a power of two and twice the set's size or more (if not above 2 ** SKETCH_POWER)."""
    places = 1 << max(6, min(SKETCH_POWER, (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _xor(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))


def apart(x: Column, y: Column) -> Column:
    """A lower bound of the number of shingles that only one of two sets has, by their sketches: each place where they differ needs one.

    Sets that can be similar have sketches of the same size or of twice the size; the larger one is folded then.
    """
    half = F.shiftright(F.greatest(F.size(x), F.size(y)), 1)
    fold = lambda v: F.when(F.size(v) > F.least(F.size(x), F.size(y)), _xor(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half))).otherwise(v)
    return F.aggregate(_xor(fold(x), fold(y)), F.lit(0), lambda n, w: n + F.bit_count(w))


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out. 100 * common >= NEEDED * union is (100 + NEEDED) * apart <= (100 - NEEDED) * (na + nb)."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    fits = (100 + NEEDED) * apart(F.col("sketch_a"), F.col("sketch_b")) <= (100 - NEEDED) * (F.col("na") + F.col("nb"))
    return both.where(fits).select("a", "b", "na", "nb")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node and comp (the smallest node reachable) of the edges (a, b), by smallest neighbours and jumps along them."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = tables.write(both.union(both.select("dst", "src")).dropDuplicates())
    new = tables.write(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.col("src").alias("old"), F.least("src", "m").alias("comp")))
    while not new.where("comp != old").isEmpty():
        labels, old = new.select("node", "comp"), new
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["src"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        to = step.select(F.col("node").alias("to"), F.col("comp").alias("jump"))
        new = tables.write(step.join(to, step["comp"] == to["to"]).select("node", "old", F.least("comp", "jump").alias("comp")))
        tables.drop(old)
    tables.drop(both)
    return new.select("node", "comp")


def _buckets(texts: DataFrame, order, size: int, tables: Tables) -> DataFrame:
    """Prefix entries of buckets with two sets or more: shingle, node, n, place, total (rows of the bucket), and the bucket's leader (node, n, place).

    Entries of frequent shingles are salted, so that no task holds a whole bucket of them. The leader has the fewest rare
    shingles: of a text and its edited copies, that is the text.
    """
    entries = texts.mapInArrow(_prefixes(size, order), "shingle long, node long, n int, place int, rare int, frequent boolean")
    # a frequent shingle's bucket is dealt over as many salts as keep each small, by the number of sets
    salted = entries.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("node"), F.lit(_salts(texts)))).otherwise(F.lit(0)).cast("int"))
    here = Window.partitionBy("shingle", "salt")
    leader = F.min(F.struct("rare", "node", "n", "place")).over(here)
    rows = salted.repartition("shingle", "salt").withColumn("leader", leader)
    rows = rows.withColumn("rows", F.count(F.lit(1)).over(here)).withColumn("last", F.max("node").over(here)).withColumn("first", F.min("node").over(here))
    rows = rows.where(F.col("frequent") | (F.col("first") != F.col("last")))
    rows = tables.write(rows.select("shingle", "node", "n", "place", "frequent", "rows", "leader"))
    # leaders of frequent shingles: one for each of them, of which there is a bounded number
    tops = tables.write(rows.where("frequent").groupBy(F.col("shingle").alias("of")).agg(F.min("leader").alias("top"), F.count(F.lit(1)).alias("top_rows")))
    rows = rows.join(F.broadcast(tops), F.col("frequent") & (F.col("shingle") == F.col("of")), "left")
    lead = F.coalesce("top", "leader")
    return rows.select("shingle", "node", "n", "place", F.coalesce("top_rows", "rows").alias("total"), lead["node"].alias("lead"), lead["n"].alias("lead_n"), lead["place"].alias("lead_place"))


def _salts(texts: DataFrame) -> int:
    return max(1, -(-texts.count() // SALT_ROWS))


def _ordered(a: str, na: str, b: str, nb: str) -> list[Column]:
    first = F.col(a) < F.col(b)
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(first, F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(first, F.col(nb)).otherwise(F.col(na)).alias("nb")]


#: Where the smaller set of a similar pair can meet the other first: it shares this much of itself. Entries further on are for larger sets alone.
_EARLY = f"{100 + NEEDED} * (n - place) >= {2 * NEEDED} * n"


def _bucket_pairs(left: DataFrame, right: DataFrame, keys: list[str], different: Column) -> DataFrame:
    """Pairs of a smaller set, from the left, and a larger one with the same keys, from the right, that may be similar."""
    smaller = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.node") < F.col("r.node")))
    fits = possible(F.col("l.n"), F.col("r.n"), F.col("l.place"), F.col("r.place"))
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    met = left.where(_EARLY).alias("l").join(right.alias("r"), [*same, smaller & different & fits])
    pairs = met.select(F.col("l.node").alias("x"), F.col("l.n").alias("nx"), F.col("r.node").alias("y"), F.col("r.n").alias("ny"))
    return pairs.select(*_ordered("x", "nx", "y", "ny")).dropDuplicates(["a", "b"])


def _class_pairs(large: DataFrame) -> DataFrame:
    """Pairs of sets of different classes in large buckets: shingle, node, n, place, total, comp and minor (not of the bucket's largest class).

    Within the largest class of a bucket nothing is left to link, so one side of each pair is from outside it. Sizes meet
    by their powers of two: a similar set has the same or the next one. The other side of a bucket is dealt over salts.
    """
    salts = F.ceil(F.col("total") / SALT_ROWS).cast("int")
    large = large.withColumn("power", F.length(F.bin("n")))
    dealt = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    minor = large.where("minor").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    next_ = lambda df: df.withColumn("power", F.explode(F.array(F.col("power"), F.col("power") + 1)))
    keys, other = ["shingle", "power", "salt"], F.col("l.comp") != F.col("r.comp")
    return _bucket_pairs(next_(minor), dealt, keys, other).union(_bucket_pairs(next_(dealt.where("not minor")), minor, keys, other)).dropDuplicates(["a", "b"])


def links(texts: DataFrame, sketches: DataFrame, tables: Tables, size: int = SIZE, fragments: int = FRAGMENTS) -> DataFrame:
    """The components (node, comp) of the sets by their links. sketches: node and sketch of each set."""
    order = Shared(texts.sparkSession, frequent_shingles(texts, size))
    buckets = _buckets(texts, order, size, tables)
    small = buckets.where(F.col("total") <= SMALL)
    all_small = _bucket_pairs(small, small, ["shingle"], F.lit(True))
    fits = possible(F.col("n"), F.col("lead_n"), F.col("place"), F.col("lead_place"))
    led = buckets.where(F.col("total") > SMALL).where((F.col("node") != F.col("lead")) & fits).select(*_ordered("node", "n", "lead", "lead_n")).dropDuplicates(["a", "b"])
    tried = tables.write(_likely(all_small.union(led).dropDuplicates(["a", "b"]), sketches))
    found = tables.write(verify(texts, tried, order, tables, size, fragments))
    comps = components(found, tables)

    # large buckets again: sets of different classes there, which no leader has brought together
    large = buckets.where(F.col("total") > SMALL).select("shingle", "node", "n", "place", "total")
    known = comps.select(F.col("node").alias("of"), "comp")
    large = large.join(known, large["node"] == known["of"], "left").select("shingle", "node", "n", "place", "total", F.coalesce("comp", "node").alias("comp"))
    sides = large.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("total").alias("total"))
    sides = sides.groupBy("shingle").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("classes"), F.max("total").alias("total")).where("classes > 1")
    salts = F.ceil(F.col("total") / SALT_ROWS).cast("int")
    sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("shingle", "salt", "main")
    large = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).join(sides, ["shingle", "salt"])
    large = tables.write(large.select("shingle", "node", "n", "place", "total", "comp", (F.col("comp") != F.col("main")).alias("minor")).dropDuplicates(["shingle", "node"]))
    rest = tables.write(_likely(_class_pairs(large), sketches).join(tried, ["a", "b"], "left_anti"))
    tables.drop(large)
    more = tables.write(verify(texts, rest, order, tables, size, fragments))
    if more.isEmpty():
        return comps
    return components(found.union(more), tables)


def _members(size: int):
    """doc_id, node and n_shingles of each text, and the set's sketch where this task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(size), set()
        for batch in batches:
            nodes, sizes, sketches = [], [], []
            for _, node, s in sets.of(batch.column(1)):
                new = next(_once(iter([(0, node, s)]), seen), None)
                nodes.append(node)
                sizes.append(len(s))
                sketches.append(sketch(s) if new else None)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n_shingles", "sketch"])

    return run


def _classes(rows: DataFrame, size: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """Of rows of (doc_id, text): doc_id, node and n_shingles of each, and node, first (its smallest doc_id) and comp (its component) of each set with words."""
    tables = Tables(rows.sparkSession, "ngram-join")
    members = tables.write(rows.mapInArrow(_members(size), "doc_id long, node long, n_shingles long, sketch array<long>"))
    sketches = tables.write(members.where("sketch is not null").dropDuplicates(["node"]).select("node", "sketch"))
    comps = links(rows.select("text"), sketches, tables, size, fragments).select(F.col("node").alias("of"), "comp")
    tables.drop(sketches)
    nodes = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(comps, nodes["node"] == comps["of"], "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    return members.select("doc_id", "node", "n_shingles"), tables.write(nodes)


def near_duplicates(docs: DataFrame, size: int = SIZE, fragments: int = FRAGMENTS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 80 % or more: doc_id, n_shingles, component_id.

    Words are separated by white space (ASCII) with A-Z lower-cased; a text of fewer than `size` words has one shingle.
    A text without words (null, empty or white space) has none and is linked with nothing. component_id is the smallest
    doc_id that links reach, the document itself included. One row for each input row; rows that repeat an id each get
    one, by their own text; other columns are ignored; an empty table gives no rows.
    """
    members, nodes = _classes(pick(docs, "doc_id", "text"), size, fragments)
    first = nodes.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = nodes.join(first, "comp").select(F.col("node").alias("of"), "component_id")
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = members.where("n_shingles > 0").join(of, F.col("node") == F.col("of")).select("doc_id", "n_shingles", "component_id")
    return linked.union(alone)


def _with_nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            nodes = pa.array([node for _, node, _ in sets.of(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "node"])

    return run


def keep_one_each(docs: DataFrame, size: int = SIZE, fragments: int = FRAGMENTS) -> DataFrame:
    """One document of each component, with the columns doc_id, text, lang, source, n_chars.

    It has the smallest id (null last), then the most shingles. Rows stay by id and set of shingles, so others of that id
    follow their own component; of rows that repeat both, one stays. Texts without words are linked with nothing and all stay.
    """
    docs = pick(docs, *DOCUMENT_COLUMNS)
    members, nodes = _classes(docs.select("doc_id", "text"), size, fragments)
    # of each set the row that would stay, and of each component the best of those
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (-F.col("n_shingles")).alias("less"), "node")).alias("best")
    first = members.where("n_shingles > 0").groupBy("node").agg(best)
    kept = first.join(nodes.select("node", "comp"), "node").groupBy("comp").agg(F.min("best").alias("best")).select("best.doc_id", "best.node")
    empty = F.translate(F.coalesce("text", F.lit("")), SPACE, "") == ""
    tagged = docs.where(~empty).mapInArrow(_with_nodes(size), T.StructType([*docs.schema.fields, T.StructField("node", T.LongType())]))
    return pick_rows(tagged, tagged["node"], kept).drop("node").union(docs.where(empty))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

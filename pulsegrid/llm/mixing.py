"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each document gets a rate between 0 and 3. Among all rates whose tokens meet the sources' targets, entropy balancing
takes those nearest to 1 (least bounded relative entropy). They have the form 3 e^t / (2 + e^t) with a tilt
t = lambda * size, one lambda for each source's token constraint, and the lambdas minimise a convex dual, which Newton
iterations solve. The rates are then rounded into whole copies.

The dual sees documents only through (source, size) counts, so the iterations run over that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, checkpoint, pick, table

MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a rounding group has on average; there are as many groups as the rows need.
GROUP_ROWS = 8_000
MOST_STEPS, EXACT = 60, 1e-9
#: Documents of each power of two in size that are at hand to correct a source's remainder.
SPARE = 4
#: A table of up to so many rows (a few numbers each) is sent to every task; rows meet a larger one over SALTS salts.
SENT_ROWS, SALTS = 100_000, 32


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null. Counts the places where a word starts, without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def meet(rows: DataFrame, small: DataFrame, column: str, small_column: str) -> DataFrame:
    """All rows, with what `small` (one row for each value, null included) has for their value. A value may hold any share of the rows.

    `small` is counted: up to SENT_ROWS rows it goes to every task and the rows stay where they are; else the rows of each
    value are dealt over SALTS salts.
    """
    if small.count() <= SENT_ROWS:
        return rows.join(F.broadcast(small), rows[column].eqNullSafe(small[small_column]), "left")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    every = small.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, salted[column].eqNullSafe(every[small_column]) & (salted["_salt"] == every["_of"]), "left").drop("_salt", "_of")


def numbered(sizes: DataFrame) -> DataFrame:
    """Sources with their place (from 0) by code point, null last. They are sorted by ranges, each of which counts on from those before."""
    order = F.col("source").asc_nulls_last()
    parts = checkpoint(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part, inner = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return parts.join(F.broadcast(starts), part == F.col("part")).select("source", "source_size", (F.col("start") + inner).alias("place"))


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources (source, source_size): weights 1, 2, 3, repeating, by the sources' code points, null last.

    The targets share the total of all sizes. None is above `most` times its source's size; what is over goes to the
    others by weight until none is above: each round finds the common level of the sources below their limits, and ends
    when no more of them reach theirs.
    """
    s = checkpoint(numbered(sizes).withColumn("weight", (1 + F.col("place") % 3).cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size")))
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        got = s.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("over"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weights"), F.count(F.when(capped, 1)).alias("full")).first()
        if not got["weights"] or got["full"] == full:
            break
        level, full = (got["total"] - got["over"]) / got["weights"], got["full"]
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * F.lit(level))
    return s.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, z: Column) -> Column:
    """3 e^t / (2 + e^t), written so that no exponential overflows."""
    t = lam * z
    small = F.exp(-F.abs(t))
    return F.when(t >= 0, MOST_COPIES / (1 + 2 * small)).otherwise(MOST_COPIES * small / (2 + small))


def balance(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Solve the dual: source, lambda, scale. counts: source, size, n (documents of that size).

    Newton steps, kept inside a bracket that halves whenever a step would leave it, so that every source converges. A
    source whose target is its limit has lambda null and the rate 3.
    """
    targets = targets.where("source_size > 0")
    means = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("mean"))
    joined = targets.join(means, targets["source"].eqNullSafe(means["source"])).select(targets["source"], "target", "source_size", F.col("mean").alias("scale"))
    open_ = F.col("target") < MOST_COPIES * F.col("source_size") * (1 - 1e-9)
    state = checkpoint(joined.select("source", "target", "scale", F.when(open_, F.lit(0.0)).alias("lam"), F.lit(-4096.0).alias("lo"), F.lit(4096.0).alias("hi"), (~open_).alias("done")))
    for _ in range(MOST_STEPS):
        live = state.where("not done")
        z = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), z)
        mass = F.col("size") * F.col("n")
        sums = (
            live.join(counts, live["source"].eqNullSafe(counts["source"]))
            .groupBy(live["source"])
            .agg(F.sum(mass * rate).alias("tokens"), F.sum(mass * z * rate * (1 - rate / MOST_COPIES)).alias("slope"))
            .withColumnRenamed("source", "of")
        )
        off = F.col("tokens") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        now_done = F.col("done") | (F.abs(off) <= EXACT * F.col("target"))
        state = checkpoint(
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left").select(
                "source", "target", "scale", F.when(now_done, F.col("lam")).otherwise(step).alias("lam"), lo.alias("lo"), hi.alias("hi"), now_done.alias("done")
            )
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.col("lam").alias("lambda"), "scale")


def mix_sources(docs: DataFrame) -> DataFrame:
    """Copies of each document so that sources meet their targets: doc_id, size, source_size, target, taken, copies, rate, tie.

    One row for each input row; taken = copies * size, with 0 to 3 copies; tie is a hash of id and text. A null or empty text has size 0 and is never
    taken; a null source is a source of its own, after all others. Repeated rows count each by itself. Reruns agree: order
    comes from (size, doc_id, text hash) alone. Other columns are ignored; an empty table gives no rows.

    Plan: sizes are counted once and kept without the texts; pre-aggregated (source, size) counts feed the Newton
    iterations; rounding runs in groups of some thousand rows (a hot source has many), whose remainders a few spare
    documents of each size class make up for.
    """
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    rows = checkpoint(rows)
    counts = checkpoint(rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    every = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = checkpoint(source_targets(every.drop("source_rows")))
    solved = balance(counts, targets)
    plan = checkpoint(
        targets.join(solved, targets["source"].eqNullSafe(solved["source"]), "left").select(targets["source"].alias("plan_source"), "source_size", "target", "lambda", "scale")
    )
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    rated = meet(rows, plan, "source", "plan_source")
    z = F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lambda").isNull(), float(MOST_COPIES)).otherwise(_rate(F.col("lambda"), z))
    rated = rated.select("doc_id", "source", "size", "tie", "source_size", "target", rate.alias("rate"), F.floor(F.log2(F.greatest("size", F.lit(1)))).alias("octave"), F.pmod("tie", F.lit(groups)).alias("salt"))
    # systematic rounding: a document's copies are the whole numbers that the running sum of rates passes
    steps = Window.partitionBy("source", "octave", "salt").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.pmod(F.xxhash64("source", "octave", "salt"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    running = F.sum("rate").over(steps) + shift
    whole = lambda x: F.floor(x + 1e-9)
    copies = F.least(F.lit(MOST_COPIES), F.greatest(F.lit(0), whole(running) - whole(running - F.col("rate")))).cast("int")
    copies = F.when(F.col("size") == 0, 0).when(F.col("rate") >= MOST_COPIES, MOST_COPIES).otherwise(copies)
    rounded = checkpoint(rated.withColumn("copies", copies).withColumn("row", F.monotonically_increasing_id()))
    fixed = _correct(rounded, plan)
    return fixed.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "tie")


def _correct(rounded: DataFrame, plan: DataFrame) -> DataFrame:
    """Give or take one copy of a few documents of each source, largest first, while they fit into what is missing or over."""
    got = rounded.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).withColumnRenamed("source", "got_source")
    rest = plan.join(got, plan["plan_source"].eqNullSafe(got["got_source"])).select("plan_source", F.round(F.col("target") - F.col("got")).cast("long").alias("rest")).where("rest != 0")
    fits = meet(rounded, checkpoint(rest), "source", "plan_source")
    fits = fits.where("size > 0 and size <= abs(rest) and ((rest > 0 and copies < 3) or (rest < 0 and copies > 0))")
    rank = F.row_number().over(Window.partitionBy("source", "octave").orderBy("tie", F.col("doc_id").asc_nulls_last(), "copies", "row"))
    spare = fits.withColumn("spare", rank).where(F.col("spare") <= SPARE).select("source", "tie", "doc_id", "row", "size", "rest")
    # at most SPARE documents of each power of two: a list of bounded length for each source
    by_source = spare.groupBy("source").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct("size", "tie", "doc_id", "row")), asc=False).alias("all"))
    start = F.struct(F.abs("rest").alias("left"), F.expr("cast(array() as array<bigint>)").alias("used"))
    use = lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["used"], F.array(x["row"])).alias("used"))).otherwise(acc)
    used = checkpoint(by_source.select(F.signum("rest").cast("int").alias("sign"), F.explode(F.aggregate("all", start, use)["used"]).alias("used_row")))
    # few rows change; a row has one number, so that those that repeat are told apart
    changed = F.broadcast(used) if used.count() <= SENT_ROWS else used
    return rounded.join(changed, rounded["row"] == used["used_row"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0)))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with doc_id, text, lang, source, n_chars, their size, their source's target and their copies.

    A document that is to be read several times is one row with that many copies, 1 to 3. Rows that repeat id and text are
    one row with the copies of all of them. Of repeats in several sources, the first source by code point is named.
    """
    docs = pick(docs, *DOCUMENT_COLUMNS)
    taken = mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie"))
    mixed = taken.agg(F.first("size").alias("size"), F.min("target").alias("target"), F.sum("copies").cast("int").alias("copies"))
    tied = docs.withColumn("tie", F.xxhash64("doc_id", "text")).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("none", F.col("doc_id").isNull())
    first = F.row_number().over(Window.partitionBy("id", "none", "tie").orderBy(F.col("source").asc_nulls_last(), "lang", "n_chars"))
    once = tied.withColumn("first", first).where("first = 1")
    same = (F.coalesce("mix_id", F.lit(0)) == once["id"]) & (F.col("mix_id").isNull() == once["none"]) & (once["tie"] == F.col("mix_tie"))
    return once.join(mixed, same).select(*DOCUMENT_COLUMNS, "size", "target", "copies")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Sizes are words. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` times all words; a target stops at ``most`` times its source's size and the excess is
shared again by weight among the others, until none is above.

Seats go to the highest quotients weight / 1, / 3, / 5 ... (``apportion``). First single words go to
sources. A source's words are dealt in equal blocks, a thousandth of the source at most, so a small
source beside huge ones gets its target too. Blocks go in the same way to the groups of shards of a source and to the shards of a
group, so each shard has an integer quota. A shard is about ``SHARD_WORDS`` words of one
source, by hash of doc_id: a source that holds a third of all rows is many shards. Windows are over
one shard, one group of ``GROUP`` shards or the groups of a source; over all sources there are only
aggregates and numbers by range partitions. In a shard the documents lie end to end in seeded order;
a seeded permutation of its blocks picks which are taken once more than the others. A document is
taken by the words of its blocks.

Defined results: null texts have size 0 and are taken 0 times; a text of any length is taken whole; an
empty table gives an empty table; repeated rows are documents of their own (equal rows may share their
words either way); a corpus without words has targets 0. Equal quotients go to the smaller source or
shard. Input columns other than doc_id, source, text and those of ``keep`` are not returned, and those of
``keep`` must not have the names of output columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import save

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SHARD_WORDS = 1 << 17
GROUP = 1024
BLOCK_WORDS, BLOCKS = 256, 1 << 16  # blocks have BLOCK_WORDS words, fewer where the corpus would not have BLOCKS of them
SOURCE_BLOCKS = 1000  # or the source not SOURCE_BLOCKS of them
SEED = "mix-1"
FEW_SOURCES = 10_000  # so many rows of the source table are broadcast; more are joined
STEPS = 16  # divisors tried in one pass
OPEN = 4  # seats a unit, as an average, that are left to ranking


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*cols: Column) -> Column:
    """A seeded integer of 60 bits."""
    text = F.concat_ws("/", F.lit(SEED), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with a running number from 0 over all rows: range partitions, their sizes, and a number within each."""
    placed = save(spark, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def source_targets(spark: SparkSession, docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, sidx, weight, source_size, target. ``docs``: source, size."""
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = numbered(spark, s, [F.col("source").asc_nulls_last()], "sidx")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sidx") % len(weights) + 1).cast("int")))
    s = save(spark, s.withColumn("cap", F.lit(float(most)) * F.col("source_size")), "sources")
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # sources above their cap at this level stop there; the excess raises the level of the others
        over = (F.col("cap") < level * F.col("weight")) if stopped >= 0 else F.lit(False)
        r = s.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("left")).first()
        if r.n == stopped or not r.left:
            break
        stopped, level = r.n, (budget - (r.cap or 0)) / r.left
    target = F.col("cap") if not r.left and stopped >= 0 else F.least("cap", F.lit(float(level)) * F.col("weight"))
    return s.select("source", "sidx", "weight", "source_size", target.alias("target"))


def apportion(spark: SparkSession, units: DataFrame, by: list[str], unit: str, weight: Column, quota: Column, most: Column, out: str, ranked: bool = False) -> DataFrame:
    """Sainte-Laguë within each ``by`` group: adds ``out``, the seats of each unit, ``most`` at most. Exactly the
    ``quota`` highest quotients weight / (2 k - 1) win a seat; equal ones by ``unit``.

    At a multiplier t a unit has min(most, floor(weight * t + 1/2)) quotients of 1 / (2 t) or more. Passes
    of ``STEPS`` multipliers a group, summed over its units, narrow t until few seats lie between the two
    bounds; those are listed and ranked. ``ranked``: by range partitions, for one group of any size.
    """
    u = units.withColumns({"_w": weight.cast("double"), "_m": F.greatest(most, F.lit(0)).cast("long"), "_q": F.greatest(quota, F.lit(0)).cast("long")})
    u = save(spark, u.withColumn("_m", F.when(F.col("_w") > 0, F.col("_m")).otherwise(0)), "units")
    seats = lambda t: F.least(F.col("_m"), F.floor(F.col("_w") * t + 0.5))
    total = lambda t: F.coalesce(F.sum(F.when(F.col("_w") > 0, seats(t))), F.lit(0)).cast("long")
    g = u.groupBy(*by).agg(F.max("_q").alias("q"), F.sum("_m").alias("m"), F.count("*").alias("n"), F.sum("_w").alias("w"), F.max(F.when(F.col("_w") > 0, (F.col("_m") + 1) / F.col("_w"))).alias("top"))
    g = g.withColumn("q", F.least("q", "m"))
    near = lambda by_half: F.when(F.col("w") > 0, F.greatest(F.lit(0.0), (F.col("q") + by_half * F.col("n") / 2) / F.col("w"))).otherwise(0.0)
    # at lo at most q seats are won, at top all; at hi q, unless units stop at their most
    g = save(spark, g.select(*by, F.col("q").alias("_gq"), F.col("n").alias("_n"), near(-1).alias("_lo"), near(1).alias("_hi"), F.coalesce("top", F.lit(0.0)).alias("_top")), "bounds")
    while True:
        at = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (k / STEPS) for k in range(STEPS + 1)] + [F.col("_top")]
        s = [F.col(f"_s{k}") for k in range(len(at))]
        sums = u.join(F.broadcast(g) if ranked else g, by).groupBy(*by, "_gq", "_n", "_lo", "_hi", "_top").agg(*[total(t).alias(f"_s{k}") for k, t in enumerate(at)])
        lo, low, hi, high = at[0], s[0], at[-1], s[-1]
        for k in range(1, STEPS + 1):
            below = s[k] <= F.col("_gq")
            lo, low = F.when(below, at[k]).otherwise(lo), F.when(below, s[k]).otherwise(low)
        for k in range(STEPS, 0, -1):
            above = s[k] >= F.col("_gq")
            hi, high = F.when(above, at[k]).otherwise(hi), F.when(above, s[k]).otherwise(high)
        g = save(spark, sums.select(*by, "_gq", "_n", lo.alias("_lo"), hi.alias("_hi"), hi.alias("_top"), low.alias("_sl"), high.alias("_sh")), "bounds")
        # done where few seats are open, or only equal quotients are
        wide = (F.col("_sh") - F.col("_sl") > OPEN * F.col("_n") + 64) & (F.col("_hi") - F.col("_lo") > F.col("_hi") * 1e-15)
        if not g.agg(F.bool_or(wide)).first()[0]:
            break
        g = g.drop("_sl", "_sh")
    d = u.join(F.broadcast(g) if ranked else g, by)
    bound = lambda t: F.when(F.col("_w") > 0, seats(F.col(t))).otherwise(0).cast("long")
    d = d.withColumn("_low", bound("_lo")).withColumn("_high", bound("_hi")).withColumn("_left", F.col("_gq") - F.col("_sl")).drop("_gq", "_n", "_lo", "_hi", "_top", "_sl", "_sh")
    d = save(spark, d, "seats")
    seat = d.where("_high > _low and _left > 0").select(*by, unit, "_left", "_w", F.explode(F.expr("sequence(_low + 1, _high)")).alias("_k"))
    order = [(F.col("_w") / (2 * F.col("_k") - 1)).desc(), F.col(unit), F.col("_k")]
    seat = numbered(spark, seat, order, "_rank") if ranked else seat.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    won = seat.where("_rank < _left").groupBy(*by, unit).agg(F.count("*").alias("_won"))
    return d.join(won, [*by, unit], "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_w", "_m", "_q", "_low", "_high", "_left", "_won")


def mix(spark: SparkSession, docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, and its ``keep`` columns; also what ``cuts`` needs."""
    sized = save(spark, docs.select("doc_id", "source", words("text").alias("size"), *keep), "sizes")
    targets = save(spark, source_targets(spark, sized, share, most, weights), "targets")
    total, n_sources, wanted = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = max(1, min(BLOCK_WORDS, total // BLOCKS))

    seats = apportion(spark, targets.withColumn("one", F.lit(1)), ["one"], "sidx", F.col("target"), F.lit(round(wanted)), F.col("source_size") * most, "words", ranked=True)
    seats = seats.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / SOURCE_BLOCKS))).cast("long"))
    seats = seats.select("source", "sidx", "source_size", "target", "block", F.round(F.col("words") / F.col("block")).cast("long").alias("seats"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards"))
    seats = save(spark, seats, "seats").withColumnRenamed("source", "_source")
    if n_sources <= FEW_SOURCES:
        seats = F.broadcast(seats)
    d = sized.join(seats, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", *keep, "sidx", "source_size", "target", "block", "seats", "shards", _hash(F.col("doc_id")).alias("turn_in_shard"))
    d = d.withColumn("unit", F.col("turn_in_shard") % F.col("shards"))

    units = d.groupBy("sidx", "unit", "seats", "block").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("unit") / GROUP)).withColumn("blocks", F.ceil(F.col("words") / F.col("block")))
    units = save(spark, units, "shards")
    groups = units.groupBy("sidx", "group", "seats").agg(F.sum("words").alias("gwords"), F.sum("blocks").alias("gblocks"))
    groups = apportion(spark, groups, ["sidx"], "group", F.col("gwords"), F.col("seats"), F.col("gblocks") * most, "gseats").select("sidx", "group", "gseats")
    units = apportion(spark, units.join(groups, ["sidx", "group"]), ["sidx", "group"], "unit", F.col("words"), F.col("gseats"), F.col("blocks") * most, "quota")
    h = _hash(F.col("sidx"), F.col("unit"), F.lit("blocks"))
    plan = units.where("blocks > 0").select(
        "sidx",
        "unit",
        "blocks",
        F.floor(F.col("quota") / F.col("blocks")).alias("base"),
        (F.col("quota") % F.col("blocks")).alias("extra"),
        F.element_at(F.array(*[F.lit(p).cast("long") for p in (2654435761, 2246822519, 3266489917)]), (h % 3 + 1).cast("int")).alias("step"),
        (h % F.col("blocks")).alias("turn"),
    )
    lie = Window.partitionBy("sidx", "unit").orderBy("turn_in_shard", "doc_id", "size", *keep)
    d = d.withColumn("at", F.sum("size").over(lie.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d = d.join(plan, ["sidx", "unit"], "left")
    again = F.expr(f"aggregate({_BLOCKS}, 0L, (n, b) -> n + if({_PICKED}, {_OVERLAP}, 0L))")
    return d.withColumn("taken", F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), F.col("base") * F.col("size") + F.when(F.col("extra") > 0, again).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long"))


# of a document: the blocks it has words in; whether a block is taken once more; its words in a block
_BLOCKS = "sequence(at div block, (at + size - 1) div block)"
_PICKED = "pmod(pmod(step, blocks) * b + turn, blocks) < extra"
_OVERLAP = "least(at + size, (b + 1) * block) - greatest(at, b * block)"


def cuts() -> Column:
    """What the mix takes of a document with words: base (times the whole text) and parts (first word, from 1, and
    number of words of the blocks that are taken once more)."""
    picked = f"if(extra > 0, filter({_BLOCKS}, b -> {_PICKED}), array())"
    return F.expr(f"struct(int(base) AS base, transform({picked}, b -> struct(int(greatest(at, b * block) - at + 1) AS first, int({_OVERLAP}) AS n)) AS parts)")


def taken_text(text: str = "text", cuts: str = "cuts") -> Column:
    """The text that the mix takes of a document, by its ``cuts``. Null if nothing is taken."""
    # in an array of one, so that words are found once and not for every part
    found = f"transform(array(regexp_extract_all({text}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> array_join(flatten(transform({cuts}.parts, p -> slice(w, p.first, p.n))), ' '))"
    more = F.expr(f"if(size({cuts}.parts) > 0, {found}, array())")
    copies = F.when(F.col(f"{cuts}.base") >= 1, F.array_repeat(F.col(text), F.col(f"{cuts}.base"))).otherwise(F.array().cast("array<string>"))
    out = F.concat(copies, more)
    return F.when(F.size(out) > 0, F.array_join(out, "\n"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def highest_quotients(weights: list[float], quota: int, most: list[int]) -> list[int]:
    """The same by a heap, for tests."""
    import heapq

    seats = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(quota):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        seats[i] += 1
        if seats[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * seats[i] + 1), i))
    return seats

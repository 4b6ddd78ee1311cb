"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every row gets a fixed pseudo-random place in its source (a hash of its id); a source's blocks are equal ranges of
places, so any run of blocks is a random draw without replacement. A source's target is met by whole passes and a last
pass that ends at one place. The blocks drawn are dealt to output shards by a splitting tree: at each node the exact
quotas of all sources are halved by a random permutation of the node's tokens, which is a multivariate hypergeometric
draw, and the shards then take disjoint runs of each source's permuted blocks. A row is taken once by every draw of its
block (of the block in which a pass ends, only up to that place). Rows go to their shard and are ordered there by a hash.

Only sizes per (source, block) are aggregated; rows are never shuffled by source, so a source may hold any share of
them, and a shard is dealt to tasks by ranges of its order. The tables that meet the rows have at most a fixed number of
rows per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import positional

#: Blocks of a source that are dealt as wholes; bins of the block in which a pass ends.
BLOCKS, BINS = 64, 1024
#: Depth of the splitting tree: 2 ** LEVELS output shards.
LEVELS = 4
WEIGHTS = (3, 1, 2)
SEED = 20_240_229


def words(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(*ids: Column) -> Column:
    """A place from 0 to 2 ** 62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *ids), 2)


def _block(place: Column) -> Column:
    return F.shiftright(place, 62 - BLOCKS.bit_length() + 1).cast("int")


def _bin(place: Column, step: int) -> Column:
    shift = 62 - (BLOCKS.bit_length() - 1) - step * (BINS.bit_length() - 1)
    return F.shiftright(place, shift)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, source, source_size -> also target: water filling of ``share`` of all sizes by weight, up to ``most`` times
    a source's size. Weights repeat over the sources by code point, null last. One row per source.

    Passing a capped source's excess on to the others by weight ends where all free sources stand at one level per
    weight. With sources sorted by the level at which they are full, that is the highest of the levels that result if
    the sources before a place are full and the others share the rest.
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") - 1) % len(weights) + 1).cast("double")
    ranked = ranked.withColumn("__weight", weight).withColumn("__full", F.col("source_size") * F.lit(most) / F.col("__weight"))
    before = Window.orderBy("__full", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__full", "__rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("__full", "__rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(before), F.lit(0.0))
    ranked = ranked.withColumn("__level", rest / F.sum("__weight").over(after))
    level = F.max("__level").over(everything)
    filled = F.least(F.col("source_size") * F.lit(most), level * F.col("__weight"))
    return ranked.withColumn("target", filled).drop("__rank", "__weight", "__full", "__level")


def plan(cells: DataFrame, most: float = 2.0) -> DataFrame:
    """One row per source: key, source_size, target, full (whole passes), cut (last place of the last pass, or
    -1) and extra (the place of one more row, or -1).

    ``cells`` has key, source, size and place of every row. The cut is the last place whose running size stays within
    what the whole passes leave, found in three steps, each over sums of a fixed number of bins per source.
    """
    bins = cells.groupBy("key", _bin(F.col("place"), 0).alias("bin")).agg(F.sum("size").alias("size"), F.min("source").alias("source"))
    bins = materialize(bins, "mix-bins")
    sources = bins.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    sources = targets(sources, most=most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    sources = materialize(sources, "mix-sources")

    def boundary(sums: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """The bin at which each source's running size first exceeds its rest, and what is left before it."""
        run = F.sum("size").over(Window.partitionBy("key").orderBy("bin"))
        over = sums.withColumn("run", run).join(edges, "key").where(F.col("run") > F.col("rest"))
        first = over.groupBy("key").agg(F.min(F.struct("bin", (F.col("rest") - F.col("run") + F.col("size")).alias("left"))).alias("x"))
        return materialize(first.select("key", F.col("x.bin").alias("edge"), F.col("x.left").alias("rest")), name)

    edges = boundary(bins, sources.select("key", "rest"), "mix-edge1")
    inside = cells.join(edges.select("key", "edge"), "key").where(_bin(F.col("place"), 0) == F.col("edge"))
    finer = inside.groupBy("key", _bin(F.col("place"), 1).alias("bin")).agg(F.sum("size").alias("size"))
    edges2 = boundary(finer, edges.select("key", "rest"), "mix-edge2")
    last = cells.join(edges2, "key").where(_bin(F.col("place"), 1) == F.col("edge"))
    run = F.sum("size").over(Window.partitionBy("key").orderBy("place"))
    ends = last.withColumn("run", run).where(F.col("run") <= F.col("rest")).groupBy("key").agg(F.max("place").alias("end"), F.max("run").alias("run"))
    shift = 62 - (BLOCKS.bit_length() - 1) - (BINS.bit_length() - 1)
    found = edges2.join(ends, "key", "left").select("key", F.coalesce("end", F.shiftleft("edge", shift) - 1).alias("cut"), (F.col("rest") - F.coalesce("run", F.lit(0))).alias("gap"))
    # Every source with something left over has an edge: its sizes exceed the rest. The largest row after the cut that
    # still fits closes most of the gap before it.
    found = materialize(found, "mix-cut")
    fits = cells.join(found, "key").where((F.col("place") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    extra = fits.groupBy("key").agg(F.max(F.struct("size", "place")).alias("x")).select("key", F.col("x.place").alias("extra"))
    none = F.lit(-1).cast("long")
    out = sources.join(found, "key", "left").join(extra, "key", "left")
    return out.select("key", "source_size", "target", "full", F.coalesce("cut", none).alias("cut"), F.coalesce("extra", none).alias("extra"))


def _taken(draws: Column, place: Column) -> Column:
    """The draws of a row's block that take the row."""
    return F.filter(F.coalesce(draws, F.array().cast("array<struct<pass:int,shard:int,cut:bigint,extra:bigint>>")), lambda d: (place <= d["cut"]) | (place == d["extra"]))


def shards(plans: DataFrame) -> DataFrame:
    """key, block, draws: of each pass over each drawn block the output shard, by the splitting tree, the last place taken
    and the place of one more row.

    A source's tokens number its drawn blocks. At every node of the tree the tokens are permuted and the first half go
    left, so the left quotas are a multivariate hypergeometric draw from the node's; the leaves' quotas then take
    consecutive runs of the source's blocks, which are a permutation of its rows already.
    """
    end = F.greatest("cut", "extra")
    passes = F.col("full") + F.when(end >= 0, 1).otherwise(0)
    drawn = plans.withColumn("pass", F.explode(F.when(passes > 0, F.sequence(F.lit(1), passes))))
    last = F.when(F.col("pass") > F.col("full"), _block(end)).otherwise(BLOCKS - 1)
    units = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy("key").orderBy("pass", F.xxhash64(F.lit(SEED + 1), "key", "pass", "block"), "block")
    units = units.select("key", "pass", "block", F.row_number().over(order).alias("token"))
    node = units.select("key", "token").withColumn("node", F.lit(0))
    for level in range(LEVELS):
        here = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(SEED + 2 + level), "key", "token"), "key", "token")
        half = F.count("*").over(Window.partitionBy("node")) / 2
        node = node.withColumn("node", F.col("node") * 2 + F.when(F.row_number().over(here) <= half, 0).otherwise(1))
    quotas = node.withColumn("token", F.row_number().over(Window.partitionBy("key").orderBy("node", "token")))
    dealt = units.join(quotas, ["key", "token"])
    whole = F.col("pass") <= F.col("full")
    end = F.when(whole, F.lit((1 << 62) - 1)).otherwise(F.col("cut")).alias("cut")
    draw = F.struct(F.col("pass").cast("int").alias("pass"), F.col("node").cast("int").alias("shard"), end, F.when(whole, -1).otherwise(F.col("extra")).cast("long").alias("extra"))
    return dealt.join(plans.select("key", "full", "cut", "extra"), "key").groupBy("key", "block").agg(F.array_sort(F.collect_list(draw)).alias("draws"))


def _cells(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows with a source key that is never null, the size and the place."""
    cells = positional(df)
    at, text, source = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col, source_col))
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    return cells.select(at.alias("id"), key.alias("key"), source.alias("source"), words(text).alias("size"), _place(at).alias("place"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken, copies and shards (one per copy) of every row.

    Sources weigh 3, 1, 2, repeating by code point with null last, and share 150 % of all words, none more than twice
    its own; a row is taken 0, 1 or 2 times whole. Defined cases: a null text has size 0; a null source is a source; a
    null id has its place like any other; rows that repeat an id share its place and are taken alike; sources without
    words have target 0; an empty table gives no rows; other columns are ignored. Runs agree: places are hashes.
    """
    cells = materialize(_cells(df, id_col, text_col, source_col), "mix-cells")
    plans = materialize(plan(cells), "mix-plan")
    dealt = materialize(shards(plans), "mix-shards")
    # One row per source, and BLOCKS rows per source: as files of known size these are broadcast while they are small.
    out = cells.join(plans, "key").withColumn("block", _block(F.col("place")))
    out = out.join(dealt, ["key", "block"], "left")
    chosen = F.transform(_taken(F.col("draws"), F.col("place")), lambda d: d["shard"])
    copies = F.size(chosen)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), chosen.alias("shards"))


def deal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of each row of df as c0, c1 and so on, its shard and its order there, as often as it is drawn: in the order
    of the shards, and in each by a hash of the id, the pass and the text. Partitions are ranges of that order."""
    cells = materialize(_cells(df, id_col, text_col, source_col), "mix-cells")
    plans = materialize(plan(cells), "mix-plan")
    dealt = materialize(shards(plans), "mix-shards")
    # By position: df may have columns of any names.
    own = [f"c{k}" for k in range(len(df.columns))]
    at, text, source = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col, source_col))
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    out = positional(df).withColumn("key", key).withColumn("block", _block(_place(at))).join(dealt, ["key", "block"])
    out = out.withColumn("draw", F.explode(_taken(F.col("draws"), _place(at))))
    order = F.xxhash64(F.lit(SEED + 100), at, F.col("draw.pass"), text)
    out = out.select(*own, F.col("draw.shard").alias("shard"), order.alias("order"))
    return out.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of df as often as it is drawn, with its columns, in its shards and their order.

    The cases are those of mix(); columns of any names stay as they are.
    """
    return deal(df, id_col, text_col, source_col).drop("shard", "order").toDF(*df.columns)

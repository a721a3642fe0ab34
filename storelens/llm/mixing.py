"""Mixing sources to target weights by entropy balancing (operator 3, DataFrame operations only).

Each source gets a target of words. Among all document rates between 0 and
``MAX_RATE`` that meet a source's target, the ones closest in entropy to "take
every document once" are min(MAX_RATE, exp(a * size)): exponentially tilted. The
multiplier ``a`` of every source solves the convex dual; safeguarded Newton
steps find all of them at once, each step one aggregate over the histogram of
(source, size). Sums are exact decimals, so reruns agree bit for bit.

Rates become copies per cell of equal source and size, from large to small
sizes: the running sum of a source's copies is rounded, so the copies down to any
size are within half a copy of the rates and their words within half of the
source's largest document. What is left of the target is then made up by copies of
ever smaller documents, until the difference is below the smallest that has room.
Inside a cell the documents of lowest hash get the odd copies.

Bounds: the tables of sources and cells are aggregates. Running sums go over blocks of
``BLOCK_SIZES`` sizes first and then inside each block: a text under 2^31 bytes
has at most 2^30 words, so a window orders at most 2^15 rows. A cell that holds a large part of all rows is ranked in
1,024 hash buckets. Documents' texts never enter a shuffle.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take 0; an empty table gives no rows; a
repeated row counts as often as it occurs. Extra columns are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.common import checkpointed, table
from storelens.llm.ranks import positions

WEIGHTS = (5, 2, 1)     #: repeating over the sources in code point order
MAX_RATE = 3
BLOCK_SIZES = 1 << 15
NEWTON_STEPS = 60
TOLERANCE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus target: shares by weight, none above MAX_RATE times its size.

    With sources sorted by size per weight, those that hit the cap are a prefix,
    so the level that the others share follows from running sums. One row per
    source passes through the window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_ratio = Window.orderBy("ratio", "pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    return (sources.withColumn("pos", F.row_number().over(by_name)).withColumn("w", w)
            .withColumn("cap", F.col("source_size") * MAX_RATE).withColumn("ratio", F.col("cap") / F.col("w"))
            .withColumn("level", level)
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(every)))
            .select("source", "source_size", "target"))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(28,9)")).cast("double")


def solve_rates(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """Multiplier ``a`` per source such that sum(n * size * min(MAX_RATE, exp(a * size / mean))) = target.

    cells: (source, size, n), sizes above 0; goal: (source, source_size, target).
    """
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    shape = cells.groupBy("source").agg(F.min("size").alias("least"), F.sum("n").alias("docs"))
    goal = checkpointed(
        goal.alias("g").join(shape.alias("c"), same)
        .select("g.source", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"), "least")
        .withColumn("ratio", F.col("target") / F.col("source_size"))
        .withColumn("x0", F.col("least") / F.col("mean"))
        .withColumn("full", F.col("ratio") >= MAX_RATE * (1 - 1e-12))
        # rates at the ends of the bracket are all above, or all below, what is needed
        .withColumn("lo", F.when(F.col("ratio") >= 1, 0.0).otherwise(F.log(F.greatest("ratio", F.lit(1e-300))) / F.col("x0")))
        .withColumn("hi", F.when(F.col("ratio") >= 1, F.log(F.lit(float(MAX_RATE))) / F.col("x0")).otherwise(0.0))
        .withColumn("a", F.greatest("lo", F.least("hi", F.log(F.greatest("ratio", F.lit(1e-300))))))
        .withColumn("error", F.lit(1.0)))
    hist = cells.alias("c").join(goal.select("source", "mean").alias("g"), same).select(
        "c.source", "n", "size", (F.col("size") / F.col("mean")).alias("x"))
    hist = checkpointed(hist)
    for _ in range(NEWTON_STEPS):
        raw = F.exp(F.least(F.col("a") * F.col("x"), F.lit(60.0)))
        words = F.col("n") * F.col("size")
        sums = (hist.alias("c").join(goal.alias("g"), same)
                .groupBy("c.source")
                .agg(_exact(words * F.least(raw, F.lit(float(MAX_RATE)))).alias("got"),
                     _exact(F.when(raw < MAX_RATE, words * F.col("x") * raw).otherwise(0.0)).alias("slope")))
        s = sums.alias("c").join(goal.alias("g"), same).select("g.*", "got", "slope")
        low = F.col("got") < F.col("target")
        s = (s.withColumn("error", F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("got") / F.col("target") - 1)))
             .withColumn("lo", F.when(low, F.col("a")).otherwise(F.col("lo")))
             .withColumn("hi", F.when(low, F.col("hi")).otherwise(F.col("a")))
             # a Newton step on the logarithm of the words taken, halving the bracket where it leaves it
             .withColumn("step", F.col("a") + F.log(F.col("target") / F.col("got")) * F.try_divide("got", "slope")))
        goal = checkpointed(
            s.withColumn("a", F.when(F.col("error") <= TOLERANCE, F.col("a"))
                         .when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step"))
                         .otherwise((F.col("lo") + F.col("hi")) / 2)).select(*goal.columns))
        if (goal.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    return goal


def _round_running(rated: DataFrame) -> DataFrame:
    """(source, size, n, rate) plus copies: rounded running sums of n * rate, from large to small sizes of each source."""
    want = F.least(F.col("n") * F.col("rate"), (F.col("n") * MAX_RATE).cast("double"))
    parts = (rated.withColumn("whole", F.floor(want)).withColumn("block", F.floor(F.col("size") / BLOCK_SIZES))
             .withColumn("part", (want - F.col("whole")).cast("decimal(18,9)")))
    by_block = Window.partitionBy("source").orderBy(F.col("block").desc())
    blocks = parts.groupBy("source", "block").agg(F.sum("part").alias("part"))
    blocks = blocks.select("source", "block", (F.sum("part").over(by_block) - F.col("part")).alias("before"))
    same = F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.block") == F.col("g.block"))
    inside = Window.partitionBy("source", "block").orderBy(F.col("size").desc())
    # copies up to the cell, less those up to the cell before: the cell's whole copies and one more or not
    return (parts.alias("c").join(blocks.alias("g"), same).select("c.*", "before")
            .withColumn("upto", F.col("before") + F.sum("part").over(inside))
            .withColumn("copies", (F.col("whole") + F.floor(F.col("upto") + F.lit(0.5).cast("decimal(2,1)"))
                                   - F.floor(F.col("upto") - F.col("part") + F.lit(0.5).cast("decimal(2,1)"))).cast("long"))
            .select("source", "size", "n", "rate", "copies"))


def copies_per_cell(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, size, n, rate) -> copies: whole numbers whose words come near each source's target.

    Rounded running sums of the copies come within half of the largest document.
    What a source is then short of, or over, is made up by rounds: each takes the
    largest size that still fits into the difference and has copies to add or to
    drop, as many of them as fit, and goes on with smaller sizes. A round leaves less
    than the size it used, so the differences shrink at least by half.
    """
    same = F.col("c.source").eqNullSafe(F.col("g.source"))
    rate = F.when(F.col("full"), float(MAX_RATE)).otherwise(
        F.least(F.exp(F.least(F.col("a") * F.col("size") / F.col("mean"), F.lit(60.0))), F.lit(float(MAX_RATE))))
    rated = cells.alias("c").join(goal.alias("g"), same).select("c.source", "size", "n", rate.alias("rate"))
    now = checkpointed(_round_running(rated).select("source", "size", "n", "copies"))
    sums = now.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    left = checkpointed(sums.alias("c").join(goal.alias("g"), same).select(
        "c.source", F.round(F.col("target") - F.col("got")).cast("long").alias("left"), F.lit((1 << 63) - 1).alias("last")))
    while True:
        room = F.when(F.col("left") > 0, F.col("n") * MAX_RATE - F.col("copies")).otherwise(F.col("copies"))
        fits = (now.alias("c").join(left.alias("g"), same).where((F.col("size") <= F.abs("left")) & (F.col("size") < F.col("last")))
                .select("c.source", "size", "left", room.alias("room")).where("room > 0"))
        best = fits.groupBy("source").agg(F.max(F.struct("size", "room", "left")).alias("b")).select(
            "source", "b.size", (F.signum("b.left").cast("long") * F.least("b.room", F.expr("abs(b.left) div b.size"))).alias("more"))
        best = checkpointed(best)
        if best.isEmpty():
            return now.select("source", "size", "copies")
        cell = same & (F.col("c.size") == F.col("g.size"))
        now = checkpointed(now.alias("c").join(best.alias("g"), cell, "left").select(
            "c.source", "c.size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies")))
        left = checkpointed(left.alias("c").join(best.alias("g"), same).select(
            "c.source", (F.col("left") - F.col("more") * F.col("size")).alias("left"), F.col("size").alias("last")))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), source_col: str = "source",
        text_col: str = "text", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``keep`` columns plus source, size, source_size, target, copies and taken per row of docs.

    Rows with equal ``keep`` values, source and size are alike to the operator.
    """
    inner = [f"_k{i}" for i in range(len(keep))]
    sized = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner)], F.col(source_col).alias("source"),
                        n_words(F.col(text_col)).alias("size"))
    sized = checkpointed(sized.withColumn("h", F.xxhash64(*inner))
                         .withColumn("bucket", F.shiftrightunsigned("h", 54)))
    cells = checkpointed(sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    whole = checkpointed(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sources = whole.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = checkpointed(targets(sources, weights))
    some = whole.where("size > 0")
    solved = solve_rates(some, goal.where("source_size > 0"))
    same_cell = F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.size") == F.col("g.size"))
    copies = whole.alias("c").join(copies_per_cell(some, solved).alias("g"), same_cell, "left").select(
        "c.source", "c.size", F.col("n").alias("cell_n"), F.coalesce("copies", F.lit(0)).alias("copies"))
    # how many documents of the cell come before each of its buckets: at most 1,024 rows per cell
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    ranked = (cells.withColumn("before", before).alias("c").join(copies.alias("g"), same_cell)
              .select("c.source", "c.size", "bucket", "before",
                      F.expr("copies div cell_n").alias("each"), (F.col("copies") % F.col("cell_n")).alias("odd")))
    in_bucket = Window.partitionBy("d.source", "d.size", "d.bucket").orderBy("h", *[f"d.{k}" for k in inner])
    placed = (sized.alias("d").join(ranked.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))
                                    & (F.col("d.size") == F.col("r.size")) & (F.col("d.bucket") == F.col("r.bucket")))
              .withColumn("copies", F.col("each") + F.when(
                  F.col("before") + F.row_number().over(in_bucket) <= F.col("odd"), 1).otherwise(0))
              .select(*[f"d.{k}" for k in inner], "d.source", "d.size", "copies"))
    return (placed.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
            .select(*[F.col(k).alias(c) for c, k in zip(keep, inner)], F.col("c.source").alias("source"), "size",
                    "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; documents with no copy go.

    Copies are looked up by (doc_id, source, size). Rows that agree in these share
    the copies of all of them evenly, by their place in one sort (a group of any size
    spreads over tasks), so a source takes what the mix planned.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    keys = ["doc_id", "source", "size"]
    plan = checkpointed(mix(docs).groupBy(*keys).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
                        .where("_all > 0"))
    sized = docs.select(*cols, n_words(F.col("text")).alias("_size"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source"))
            & (F.col("_size") == F.col("p.size")))
    met = sized.alias("d").join(plan.alias("p"), same).select(*[f"d.{c}" for c in cols], "_size", "_all", "_rows")
    alike = positions(met.where("_rows > 1").withColumn("_g", F.struct("doc_id", "source", "_size")), ["text"], "_g")
    # the place-th of _rows rows takes the whole numbers between two multiples of _all / _rows
    part = F.expr("(pos + 1) * _all div _rows - pos * _all div _rows")
    taken = (met.where("_rows = 1").select(*cols, F.col("_all").alias("_copies"))
             .unionByName(alike.select(*cols, part.alias("_copies"))))
    return (taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select(*cols))

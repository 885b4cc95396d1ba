"""Mix sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ordered import number_rows, running_total
from ledgerloom.llm.tables import aside
from ledgerloom.session import stage

#: A word is a run of anything but blanks; the digits name code points.
WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of the hash that each histogram of a source tells apart.
_LEVELS = (10, 20)
_RESULTS = ["size", "source_size", "target", "repeats", "taken"]
_INNER = ["_source", "_s", "_hash", "_cuts", "_limits", "_close", "_whole", "_copy"]
#: Runs of documents that the partial repetition of a source is made of, at most.
_RUNS = 4
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(docs: DataFrame, source: str, cycle: tuple[int, ...]) -> DataFrame:
    """Weights in a repeating cycle over the sources by code point, null last."""
    known = docs.groupBy(F.col(source).alias("source")).agg(F.lit(1).alias("_one"))
    known = known.select("source", F.col("source").isNull().alias("_last"))
    ranked = number_rows(known, ["_last", "source"], "_rank")
    at = F.pmod(F.col("_rank") - 1, F.lit(len(cycle))).cast("int") + 1
    return ranked.select(
        "source", F.element_at(F.array(*map(F.lit, cycle)), at).cast("double").alias("weight")
    )


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``.

    All sizes are shared out by weight.  A source whose share passes
    ``max_epochs`` times its size is clamped there and its excess goes to the
    others by weight, until no share is above.

    What each gets is the lesser of its cap and its weight times one level.  With
    the sources in order of cap by weight, clamping the first k of them gives the
    level (total - their caps) / (weight of the others); the level wanted is the
    highest of these, as clamping too few or too many only lowers it.  So two running
    totals find it, however many sources there are.  Sources without words or
    without positive weight get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    shared = sources.where("weight > 0 AND source_size > 0").select(
        cap.alias("cap"), "weight", (cap / F.col("weight")).alias("_full")
    )
    order = ["_full", "weight"]
    filled = running_total(running_total(shared, order, "cap", "_caps"), order, "weight", "_weights")
    row = filled.agg(F.sum("weight").alias("w"), F.max("_full").alias("top")).first()
    level = 0.0
    if row.w:
        left = F.lit(row.w) - F.col("_weights")
        best = filled.agg(F.max(F.when(left > 0, (F.lit(float(total)) - F.col("_caps")) / left))).first()[0]
        level = max(total / row.w, best if best is not None else 0.0)
        if filled.agg(F.sum("cap")).first()[0] <= total:
            level = row.top
    share = F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(F.lit(0.0))
    return sources.select("*", share.alias("target"))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: float = 3.0,
    seed: int = 20,
) -> DataFrame:
    """Say how often each document enters the mix.

    ``weights(source, weight)`` names what each source is worth; a source it does
    not name weighs 0.  Adds ``size`` (words; null text: 0), ``source_size``,
    ``target`` (its source's), ``repeats`` and ``taken`` (size times repeats).

    Every document of a source is taken as many whole times as the target holds
    the source.  For the fraction left, documents are ordered by a seeded hash of
    id and text, and the longest run from the front that fits is taken once more.
    The run ends at a document too long for the gap, so the documents behind it that
    are no longer than the gap are tried the same way, a few times over; then the one
    document that best closes what is left.  The end of a run comes from two
    histograms of 1,024 hash buckets a source, the second within the one bucket in
    which the first says it falls, and from the rows of one bucket of that; so no
    task sorts a whole source and the texts are never shuffled.  Rows alike in id and
    text share a hash and hence a fate.
    An empty table gives no rows; null sources are a source.  Input columns
    with the names of results are replaced.
    """
    docs, back = aside(docs, _RESULTS, _INNER, [id_col, text_col, source_col])
    hashed = F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    sized = docs.withColumns({
        "_source": F.col(source_col), "_hash": hashed, "size": word_count(text_col),
    })
    keyed = stage(sized.select("_source", "_hash", "size"), "sizes")
    sources = stage(
        keyed.groupBy("_source").agg(F.sum("size").alias("source_size"))
        .join(weights.select(F.col("source").alias("_w"), "weight"),
              F.col("_source").eqNullSafe(F.col("_w")), "left")
        .select("_source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")),
        "sources",
    )
    plan = _cuts(keyed, stage(water_fill(sources, max_epochs), "targets"))
    plan = stage(plan, "cuts").withColumnRenamed("_source", "_s")
    size, at = F.col("size"), F.col("_hash")
    once = at == F.col("_close")
    for i in range(_RUNS):
        since = F.lit(True) if i == 0 else at > F.element_at("_cuts", i)
        once = once | (since & (at <= F.element_at("_cuts", i + 1)) & (size <= F.element_at("_limits", i + 1)))
    repeats = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce(once, F.lit(False)).cast("int"))
    return (
        sized.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("repeats", F.coalesce(repeats, F.lit(0)).cast("int"))
        .select(*back, "size", "source_size", "target", "repeats",
                (F.col("size") * F.col("repeats")).alias("taken"))
    )


def _bucket(bits: int) -> Column:
    return F.shiftright("_hash", 64 - bits)


def _run_end(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Where the longest run of ``rows`` that fits each source's gap ends.

    ``goals(_g, _gap, _since, _limit)``: only rows behind ``_since`` and no larger than
    ``_limit`` count.  Returns ``_t``, ``_end`` (null: no row fits) and ``_sum``;
    sources whose rows all fit have ``_end`` behind all.
    """
    before = (
        Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("_source").eqNullSafe(F.col("_g"))
    counts = (F.col("_hash") > F.col("_since")) & (F.col("size") <= F.col("_limit"))
    goals = goals.withColumns({"_up": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
    crossed, within, totals = goals, F.lit(True), None
    for bits in _LEVELS:
        histogram = (
            rows.join(crossed, same & counts & within)
            .groupBy(*crossed.columns, _bucket(bits).alias("_bucket"))
            .agg(F.sum("size").alias("_words"))
            .withColumn(
                "_below", F.col("_base") + F.coalesce(F.sum("_words").over(before), F.lit(0))
            )
        )
        if totals is None:
            histogram = stage(histogram, "histogram")
            totals = histogram.groupBy(F.col("_g").alias("_t")).agg(F.sum("_words").alias("_all"))
        crossed = stage(
            histogram.where(F.col("_below") + F.col("_words") > F.col("_gap"))
            .groupBy("_g", "_gap", "_since", "_limit")
            .agg(F.min(F.struct("_bucket", "_below")).alias("_c"))
            .select("_g", "_gap", "_since", "_limit", F.col("_c._bucket").alias("_up"), F.col("_c._below").alias("_base")),
            "crossings",
        )
        within = _bucket(bits) == F.col("_up")
    upto = Window.partitionBy("_g").orderBy("_hash").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = (
        rows.join(crossed, same & counts & within)
        .withColumn("_through", F.col("_base") + F.sum("size").over(upto))
        .where(F.col("_through") <= F.col("_gap"))
        .groupBy("_g").agg(F.max(F.struct("_hash", "_through")).alias("_i"))
        .select(F.col("_g").alias("_s"), "_i")
    )
    # A run that ends where the bucket begins ends before its first row.
    ends = crossed.join(inside, F.col("_g").eqNullSafe(F.col("_s")), "left").select(
        F.col("_g").alias("_t"),
        F.coalesce("_i._hash", F.shiftleft("_up", 64 - _LEVELS[-1]) - 1).alias("_end"),
        F.coalesce("_i._through", "_base").alias("_sum"),
    )
    whole = goals.select("_g").join(totals, F.col("_g").eqNullSafe(F.col("_t")), "left").join(
        ends.select(F.col("_t").alias("_e")), F.col("_g").eqNullSafe(F.col("_e")), "left_anti"
    )
    return ends.unionByName(whole.select(
        F.col("_g").alias("_t"), F.lit(_LAST).alias("_end"), F.coalesce("_all", F.lit(0)).alias("_sum")
    ))


def _cuts(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """What the last, partial repetition of each source takes: runs, and one document."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    goals = targets.withColumn("_whole", F.coalesce(whole, F.lit(0)).cast("int")).withColumn(
        "_quota", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    sized = keyed.where("size > 0")
    state = goals.select(
        F.col("_source").alias("_g"), F.col("_quota").alias("_gap"), F.lit(_FIRST).alias("_since"),
        F.lit(_LAST).alias("_limit"), F.array().cast("array<long>").alias("_cuts"),
        F.array().cast("array<long>").alias("_limits"),
    )
    for _ in range(_RUNS):
        ends = _run_end(sized, state.select("_g", "_gap", "_since", "_limit"))
        joined = state.join(ends, F.col("_g").eqNullSafe(F.col("_t")))
        gap = F.col("_gap") - F.col("_sum")
        state = stage(joined.select(
            "_g", gap.alias("_gap"), F.col("_end").alias("_since"), F.floor(gap).alias("_limit"),
            F.array_append("_cuts", F.col("_end")).alias("_cuts"),
            F.array_append("_limits", F.col("_limit")).alias("_limits"),
        ), "runs")
    same = F.col("_source").eqNullSafe(F.col("_g"))
    off = F.abs(F.col("size") - F.col("_gap"))
    closing = (
        sized.join(state.select("_g", "_gap", "_since"), same & (F.col("_hash") > F.col("_since")))
        .where(off < F.col("_gap"))
        .groupBy("_source")
        .agg(F.min(F.struct(off.alias("_off"), "_hash")).alias("_n"))
        .select(F.col("_source").alias("_t"), F.col("_n._hash").alias("_close"))
    )
    return (
        goals.join(state.select("_g", "_cuts", "_limits"), same, "left")
        .join(closing, F.col("_source").eqNullSafe(F.col("_t")), "left")
        .select("_source", "source_size", "target", "_whole", "_cuts", "_limits", "_close")
    )


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats")))
    return mixed.where("repeats > 0").select(*columns, copies.alias("_copy")).select(*columns)

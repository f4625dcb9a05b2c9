"""Statistics over batches and strata: profiles, shifts, lifts, outliers, agreement, drift (A, N)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, group: str, column: str) -> DataFrame:
    """A1: counts, zeros, extremes, mean, median, 90 % per group."""
    c = F.col(column)
    own = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count(c).alias("present"), F.count_distinct(c).alias("distinct_values"), F.count_if(c == 0).alias("zeros"),
        F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"),
    )
    return own.join(quantiles(df, [group], column, {"median": 0.5, "p90": 0.9}), group, "left")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """A2: bin start and count; the highest value is in the last bin."""
    ends = df.agg(F.min(column), F.max(column)).first()
    lo, hi = float(ends[0] or 0.0), float(ends[1] or 0.0)
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width + lo).alias("start"), "n")


def spread(df: DataFrame, column: str, top: int = 8) -> DataFrame:
    """Most frequent values (ties to the smallest text) with their share and rank."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.filter(F.col(column).isNotNull()).agg(F.count("*").alias("total"))
    first = counts.orderBy(F.desc("n"), "value").limit(top)  # a top-k report
    order = Window.orderBy(F.desc("n"), "value")
    return first.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"), F.row_number().over(order).cast("long").alias("rank"))


def variance_explained(df: DataFrame, group: str, stratum: str, value: str) -> DataFrame:
    """Between-group over total variance of values centred by stratum."""
    centred = df.withColumn("v", F.col(value) - F.avg(value).over(Window.partitionBy(stratum)))
    with_mean = centred.withColumn("m", F.avg("v").over(Window.partitionBy(group)))
    return with_mean.agg((F.var_pop("m") / F.var_pop("v")).alias("explained"))


def shifts(df: DataFrame, batch: str, stratum: str, columns: list[str], min_batch: int = 30) -> DataFrame:
    """Standardised mean difference of each batch to the other batches of its stratum, per column.

    Sums and squares per batch are taken once; the baseline is the stratum's total less the batch's own.
    """
    long = df.select(batch, stratum, F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast(`{c}` AS DOUBLE)" for c in columns) + ") AS (column, x)")).filter("x IS NOT NULL")
    own = long.groupBy(stratum, batch, "column").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    part = Window.partitionBy(stratum, "column")
    n_all = F.sum("n").over(part)
    mean_all = F.sum(F.col("n") * F.col("mean")).over(part) / n_all
    square_all = F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))).over(part)
    both = own.withColumn("nb", n_all - F.col("n")).withColumn("mb", (mean_all * n_all - F.col("n") * F.col("mean")) / F.nullif(F.col("nb"), F.lit(0)))
    both = both.withColumn("vb", (square_all - F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))) / F.nullif(F.col("nb"), F.lit(0)) - F.col("mb") * F.col("mb"))
    pooled = F.sqrt((F.col("var") + F.col("vb")) / 2)
    found = both.filter((F.col("n") >= min_batch) & (F.col("nb") >= min_batch)).withColumn("effect", F.round((F.col("mean") - F.col("mb")) / F.nullif(pooled, F.lit(0.0)), 4)).filter("effect IS NOT NULL")
    return found.select(batch, stratum, "column", "effect", "n", F.col("nb").alias("n_baseline"), F.when(F.col("effect") > 0, "up").otherwise("down").alias("direction"))


def ranked_shifts(found: DataFrame, batch: str, stratum: str) -> DataFrame:
    """By size of the effect; the table has one row per batch, stratum and column, so one order is small."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("effect")), stratum, batch, "column")).cast("long"))


def running(counts: DataFrame, by: list[str], order: str, values: list[str], parts: int = 1024, part_rows: int = 50_000) -> DataFrame:
    """``counts`` with the running sum ``<value>_upto`` of each value in ascending ``order`` within ``by``.

    A prefix sum in two levels: rows are cut into ranges of ``order`` at approximate quantiles; the sums of the
    ranges are accumulated over at most ``parts`` rows a group, and each range adds its own, so no task orders a
    whole group.  ``order`` is distinct within a group.
    """
    k = max(1, min(parts, counts.count() // part_rows))
    bounds = sorted(set(counts.agg(F.percentile_approx(order, F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(100_000))).first()[0] or [])) if k > 1 else []
    listed = "array(" + ", ".join(f"{float(b)!r}D" for b in bounds) + ")"
    dealt = counts.withColumn("__part", F.expr(f"size(filter({listed}, b -> b <= `{order}`))") if bounds else F.lit(0))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "__part").agg(*[F.sum(v).alias(v) for v in values])
    base = sums.select(*by, "__part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__{v}") for v in values])
    own = Window.partitionBy(*by, "__part").orderBy(order)
    joined = dealt.join(base, [*by, "__part"])
    return joined.select(*counts.columns, *[(F.sum(v).over(own) + F.col(f"__{v}")).alias(f"{v}_upto") for v in values])


def quantiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Per group the exact, interpolated quantiles of a column by name.

    Values are counted map-side and looked up by their running counts, so no task holds all values of a group.
    """
    x = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    upto = running(x, by, "__x", ["__n"]).join(x.groupBy(*by).agg(F.sum("__n").alias("__all")), by) if by else running(x, by, "__x", ["__n"]).join(F.broadcast(x.agg(F.sum("__n").alias("__all"))))
    ends = []
    for name, q in wanted.items():
        place = q * (F.col("__all") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.min(F.when(F.col("__n_upto") > rank, F.col("__x"))).alias(f"__{name}_{side}"))
        ends.append(F.first(place - F.floor(place)).alias(f"__{name}_rest"))
    found = upto.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_rest")).alias(n) for n in wanted])


def edges_of(df: DataFrame, column: str, cuts: int) -> list[float]:
    """The distinct edges between equal shares of a column, lowest and highest among them."""
    row = quantiles(df, [], column, {f"e{i}": i / cuts for i in range(cuts + 1)}).first()
    return sorted({v for v in row if v is not None}) if row else []


def ks_statistic(df: DataFrame, group: str, side: Column, value: str) -> DataFrame:
    """Per group, the largest gap between the distributions of the two sides, by running counts over distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("x")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    totals = counts.groupBy(group).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    return running(counts, [group], "x", ["a", "b"]).join(totals, group).groupBy(group).agg(F.max(gap).alias("ks"))


def consequences(turns: DataFrame, bad_at: DataFrame) -> DataFrame:
    """Per turn, whether the next turn starts with a marked step or is interrupted; unknown for the last.

    ``bad_at`` has key and step.
    """
    own = Window.partitionBy("key").orderBy("index")
    nxt = turns.withColumn("next_start", F.lead("start").over(own)).withColumn("next_cut", F.col("ended_by") == "interrupt")
    marks = bad_at.select("key", F.col("step").alias("next_start"), F.lit(True).alias("marked")).distinct()
    joined = nxt.join(marks, ["key", "next_start"], "left")
    return joined.select("key", "index", "start", "end", "calls", F.when(F.col("next_start").isNotNull(), F.coalesce("marked", F.lit(False)) | F.col("next_cut")).alias("followed"))


def lifts(located: DataFrame, turns: DataFrame, strata: DataFrame) -> DataFrame:
    """Per rule, hits, followed share, baseline of the strata the hits fall in, and their ratio.

    ``located`` has key, rule, index; ``turns`` key, index, calls, followed; ``strata`` key, stratum.
    """
    known = turns.filter("followed IS NOT NULL").join(strata, "key")
    base = known.filter("calls > 0").groupBy("stratum").agg(F.avg(F.col("followed").cast("double")).alias("base"))
    hits = located.filter("index IS NOT NULL").join(known.select("key", "index", "followed", "stratum"), ["key", "index"]).join(base, "stratum")
    per_rule = hits.groupBy("rule").agg(F.count("*").alias("hits"), F.avg(F.col("followed").cast("double")).alias("followed"), F.avg("base").alias("baseline"))
    return per_rule.withColumn("lift", F.col("followed") / F.nullif(F.col("baseline"), F.lit(0.0)))


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once: in the checkpoint folder, or, in a local session without one, in the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    return df.localCheckpoint() if context.master.startswith("local") else df


#: Blocks of those asked in one task, for a block of those that ask.
ASKED = 4


def nearest(vectors: DataFrame, stratum: str, k: int = 10, block: int = 2048) -> DataFrame:
    """Key, neighbour, distance, rank: the k nearest of each vector among all of its stratum.

    ``vectors`` has key, stratum and ``vector``.  A stratum is cut into blocks; each block meets all others, some at a
    time, as matrix products, so a task holds few blocks whatever the size of the stratum.  The products find which
    vectors may be among the k nearest, the distances of these are taken from the vectors.  Ties go to the smaller key.
    """
    import numpy as np
    import pandas as pd

    sizes = vectors.groupBy(stratum).agg(F.count("*").alias("m"))
    dealt = vectors.join(sizes, stratum).withColumn("blocks", F.ceil(F.col("m") / block)).withColumn("block", F.expr("pmod(xxhash64(key), blocks)")).withColumn("of", F.expr(f"block DIV {ASKED}"))
    left = dealt.withColumn("other", F.explode(F.expr(f"sequence(0L, (blocks - 1) DIV {ASKED})"))).select(stratum, F.col("block").alias("mine"), "other", F.lit(True).alias("asks"), "key", "vector")
    right = dealt.withColumn("mine", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(stratum, "mine", F.col("of").alias("other"), F.lit(False).alias("asks"), "key", "vector")
    kind = dict(vectors.dtypes)["key"]
    kinds = f"key {kind}, neighbour {kind}, distance double"
    most = np.finfo(float).max

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, held = pdf[pdf.asks], pdf[~pdf.asks].sort_values("key")
        nothing = pd.DataFrame({"key": pdf.key.to_numpy()[:0], "neighbour": pdf.key.to_numpy()[:0], "distance": np.zeros(0)})
        if not len(asks) or not len(held):
            return nothing
        a, b = np.stack(asks.vector).astype(float), np.stack(held.vector).astype(float)
        mine, theirs = asks.key.to_numpy(), held.key.to_numpy()
        shared = int(asks.mine.iloc[0]) // ASKED == int(asks.other.iloc[0])  # else nobody meets itself
        squares = (b**2).sum(1)
        heaps = min(len(b), 8 * k)
        deep = len(b) // heaps
        out = [nothing]
        for at in range(0, len(a), 256):
            part, keys = a[at : at + 256], mine[at : at + 256]
            own = (part**2).sum(1)
            with np.errstate(all="ignore"):
                d = part @ b.T
                d *= -2
                d += own[:, None]
                d += squares[None, :]
            if shared:
                d[keys[:, None] == theirs[None, :]] = np.inf
            d[:, ~np.isfinite(squares)] = np.inf
            # The k-th smallest of the least of heaps is no less than the k-th smallest of all.
            lows = d[:, : heaps * deep].reshape(len(part), deep, heaps).min(1)
            upto = np.partition(lows, k - 1, axis=1)[:, k - 1] if heaps > k else np.full(len(part), most)
            upto = np.maximum(upto, 0)
            reach = own + squares[np.isfinite(squares)].max(initial=0)
            with np.errstate(all="ignore"):  # what rounding to nine digits and the products' errors may hide is kept too
                upto = np.minimum(upto + 4e-9 * np.sqrt(upto) + 1e-17 + 1e-15 * (8 + part.shape[1]) * reach, most)
            rows, columns = np.nonzero(d <= upto[:, None])
            exact = np.empty(len(rows))
            slice_ = max(1, 2_000_000 // max(1, part.shape[1]))
            for lo in range(0, len(rows), slice_):
                r, c = rows[lo : lo + slice_], columns[lo : lo + slice_]
                exact[lo : lo + slice_] = np.sqrt(((part[r] - b[c]) ** 2).sum(1))
            order = np.lexsort((columns, np.round(exact, 9), rows))
            first = np.searchsorted(rows, np.arange(len(part)))
            order = order[np.arange(len(rows)) - first[rows] < k]
            out.append(pd.DataFrame({"key": keys[rows[order]], "neighbour": theirs[columns[order]], "distance": exact[order]}))
        return pd.concat(out)

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(tasks, stratum, "mine", "other")  # counted, so that small rows aren't put together
    found = met.groupBy(stratum, "mine", "other").applyInPandas(search, kinds)
    order = Window.partitionBy("key").orderBy(F.round("distance", 9), "neighbour")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def outliers(vectors: DataFrame, stratum: str, k: int = 10) -> DataFrame:
    """Mean distance to the k nearest over the stratum's median of it (its mean, then 1, where that is 0); null below three."""
    means = nearest(vectors, stratum, k).groupBy("key").agg(F.avg("distance").alias("mean_distance"))
    own = kept(vectors.select("key", stratum).join(means, "key", "left"))  # quantiles read it more than once
    sizes = own.groupBy(stratum).agg(F.count("*").alias("__rows"), F.avg("mean_distance").alias("__mean"))
    scales = sizes.join(quantiles(own, [stratum], "mean_distance", {"__middle": 0.5}), stratum, "left")
    scale = F.coalesce(F.nullif("__middle", F.lit(0.0)), F.nullif("__mean", F.lit(0.0)), F.lit(1.0))
    return own.join(scales, stratum).withColumn("outlier", F.when(F.col("__rows") >= 3, F.col("mean_distance") / scale)).select("key", stratum, "outlier")


def anomaly_scores(outlier: DataFrame, events: DataFrame, lift: DataFrame) -> DataFrame:
    """log1p of the summed weights of a trajectory's open events added to its outlier score.

    A rule weighs 1 where its lift is unknown, else what its lift is above 1.
    """
    weights = events.filter("NOT recovered").join(lift.select("rule", "lift"), "rule", "left").groupBy("key").agg(F.log1p(F.sum(F.greatest(F.coalesce(F.col("lift") - 1, F.lit(1.0)), F.lit(0.0)))).alias("events_score"))
    both = outlier.join(weights, "key", "left").withColumn("events_score", F.coalesce("events_score", F.lit(0.0)))
    return both.withColumn("anomaly_score", F.coalesce("outlier", F.lit(0.0)) + F.col("events_score"))


def ranked(df: DataFrame, score: str, key: str, parts: int = 1024) -> DataFrame:
    """W19 over any number of rows: rank by score descending, ties by key.

    Rows are cut into ranges of the score at approximate quantiles; a rank is the rows of the ranges above and the
    place within one's own, so no task sorts everything.
    """
    n = df.count()
    parts = max(1, min(parts, n // 10_000))
    bounds = sorted(set(df.agg(F.percentile_approx(score, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100_000))).first()[0] or [])) if parts > 1 else []
    part = F.expr("size(filter(array(" + ", ".join(f"{b!r}D" for b in bounds) + f"), b -> b <= `{score}`))") if bounds else F.lit(0)
    dealt = df.withColumn("__part", part)
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    above, seen = {}, 0
    for p in sorted(counts, reverse=True):
        above[p], seen = seen, seen + counts[p]
    offset = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p in above]), F.array(*[F.lit(x) for x in above.values()])), F.col("__part")) if above else F.lit(0)
    own = Window.partitionBy("__part").orderBy(F.desc_nulls_last(score), key)
    return dealt.withColumn("rank", (F.row_number().over(own) + offset).cast("long")).drop("__part")


def quartile_labels(df: DataFrame, column: str, none: str = "none") -> Column:
    """Right-closed intervals between distinct quartile edges, the lowest closed on both sides."""
    edges = edges_of(df, column, 4)
    if len(edges) < 2:
        return F.coalesce(F.col(column).cast("string"), F.lit(none))
    label = F.when(F.col(column).isNull(), none)
    for i in range(1, len(edges)):
        label = label.when(F.col(column) <= edges[i], f"q{i}")
    return label


def disagreement(kind: str, x: str, y: str) -> Column:
    """0/1 for a category, one less Jaccard for sets."""
    if kind == "set":
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(x, y)) / union)
    return (~F.col(x).eqNullSafe(F.col(y))).cast("double")


def jensen_shannon(df: DataFrame, bin_: str, side: Column) -> DataFrame:
    """between the two sides' distributions over bins, in bits."""
    counts = df.groupBy(bin_).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = counts.crossJoin(F.broadcast(total)).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return p.agg(((F.sum(term("p")) + F.sum(term("q"))) / 2).alias("divergence"))


def decile_bins(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Bins by the reference's deciles; a value equal to an edge has a bin of its own (two searches, added)."""
    edges = edges_of(reference, column, 10)
    listed = "array(" + ", ".join(f"{e!r}D" for e in edges) + ")"
    return df.withColumn("bin", F.expr(f"size(filter({listed}, e -> e < `{column}`)) + size(filter({listed}, e -> e <= `{column}`))").cast("long"))


def surprisal(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Key, surprisal of a category: -ln((c + 1) / (n + k)), k values in the reference and one unknown."""
    counts = reference.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
    own = df.join(counts, column, "left").crossJoin(F.broadcast(total))
    return own.select("key", (-F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("kinds") + 1))).alias("surprisal"))


def spearman(df: DataFrame, stratum: str, x: str, y: str, least: int = 20) -> DataFrame:
    """Per stratum of enough rows, the correlation of average ranks."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(stratum, x, y)
    for c, name in ((x, "rx"), (y, "ry")):
        counts = both.groupBy(stratum, c).agg(F.count("*").alias("n"))
        ranks = running(counts, [stratum], c, ["n"]).select(stratum, c, (F.col("n_upto") - (F.col("n") - 1) / 2).alias(name))
        both = both.join(ranks, [stratum, c])
    return both.groupBy(stratum).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).filter(F.col("n") >= least)


def confusion(df: DataFrame, x: str, y: str) -> DataFrame:
    """A23."""
    return df.groupBy(x, y).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cohen's, from the contingency table."""
    table = confusion(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y)
    rows = table.groupBy(F.col(x).alias("label")).agg(F.sum("n").alias("r"))
    columns = table.groupBy(F.col(y).alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, "label").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    seen = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(x) == F.col(y), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select(F.col("n").cast("long").alias("n"), po.alias("agreement"), ((po - pe) / (1 - pe)).alias("kappa"))


def latest_precision(verdicts: DataFrame) -> DataFrame:
    """Per feature, the share of worth verdicts, the last line of each (feature, key) only."""
    last = verdicts.groupBy("feature", "key").agg(F.max_by("worth", "line").alias("worth"))
    return last.groupBy("feature").agg(F.count("*").alias("verdicts"), F.avg(F.col("worth").cast("double")).alias("precision"))


def probe_ledger(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """Per probe, hits, read, found, precision, and hits no other probe has."""
    distinct = hits.select("probe", "key").distinct()
    alone = F.count("*").over(Window.partitionBy("key")) == 1
    joined = distinct.withColumn("alone", alone).join(reads, "key", "left")
    return joined.groupBy("probe").agg(F.count("*").alias("hits"), F.count("found").alias("read"), F.count_if("found").alias("found"), F.avg(F.col("found").cast("double")).alias("precision"), F.count_if("alone").alias("exclusive"))


def wilson(found: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    """N28."""
    if not n:
        return 0.0, 1.0
    p, d = found / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (mid - half) / d), min(1.0, (mid + half) / d)


def upper_bound(found: int, n: int, confidence: float = 0.95) -> float:
    """One-sided Clopper-Pearson: the share at which so few finds are as likely as 1 less the confidence."""
    if n == 0 or found >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(found + 1)]
    lo, hi = 0.0, 1.0
    for _ in range(100):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + (i * math.log(p) if i else 0.0) + (n - i) * math.log1p(-p)) for i, c in enumerate(log_choose)) if 0 < p < 1 else float(p == 0)
        lo, hi = (p, hi) if tail > 1 - confidence else (lo, p)
    return hi

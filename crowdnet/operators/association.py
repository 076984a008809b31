"""Association networks from an expression table (sample, gene, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.operators import tiles
from crowdnet.operators.query import symmetric

#: Order of the splines, powers tried for soft thresholds and the fit that is enough.
SPLINE_ORDER, MOST_POWER, ENOUGH_FIT, FIT_BINS = 3, 30, 0.8, 10
#: Weights of splines that are held at once.
WEIGHTS = 1_000_000


def zscore(expr: DataFrame) -> DataFrame:
    s = expr.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return expr.join(s, "gene").select("sample", "gene", ((F.col("value") - F.col("m")) / F.nullif("sd", F.lit(0.0))).alias("value"))


def column_ranks(expr: DataFrame) -> DataFrame:
    """Values replaced by their midranks within a gene."""
    w = Window.partitionBy("gene")
    rank = F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy("gene", "value")) - 1) / 2.0
    return expr.select("sample", "gene", rank.alias("value"))


def vectors(expr: DataFrame) -> DataFrame:
    """(gene, v): the values in sample order."""
    return expr.groupBy("gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("v"))


def validated(expr: DataFrame, genes: int | None = None) -> DataFrame:
    """expr, after a check that all genes have the same samples, finite values and some variance; genes is their number."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    by_gene = expr.groupBy("gene").agg(F.count("*").alias("n"), F.count_if(~finite).alias("bad"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    found = by_gene.agg(F.count("*").alias("genes"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("bad").alias("bad"), F.count_if(F.col("lo") == F.col("hi")).alias("flat")).first()
    if genes is not None and found["genes"] != genes:
        raise ValueError(f"{found['genes']} columns of values for {genes} genes")
    if found["least"] != found["most"]:
        raise ValueError("genes have different numbers of samples")
    if found["bad"]:
        raise ValueError(f"{found['bad']} values aren't finite numbers")
    if found["flat"]:
        raise ValueError(f"{found['flat']} genes have no variance")
    return expr


def pearson(expr: DataFrame) -> DataFrame:
    """(i, j, score) for i > j: products of tiles of standardised genes."""
    v = vectors(zscore(expr))
    return tiles.all_pairs(v.select("gene", F.transform("v", lambda x: x / F.sqrt(F.size("v") - 1)).alias("v")), tiles.dot)


def spearman(expr: DataFrame) -> DataFrame:
    return pearson(column_ranks(expr))


def gaussian_mi(cor: DataFrame) -> DataFrame:
    return cor.select("i", "j", (-0.5 * F.log(1 - F.col("score") * F.col("score"))).alias("score"))


def _soft(r: Column, power: int, kind: str) -> Column:
    return {"unsigned": F.pow(F.abs(r), F.lit(power)), "signed": F.pow((1 + r) / 2, F.lit(power)), "hybrid": F.when(r > 0, F.pow(r, F.lit(power))).otherwise(0.0)}[kind]


def power_fits(cor: DataFrame, kind: str = "signed", most: int = MOST_POWER) -> DataFrame:
    """(power, fit) of even powers: how well the strengths of nodes follow a power law.

    The strengths of a power are counted in FIT_BINS equal bins; the fit is the absolute correlation of the logarithms of
    counts and of bin centres. Empty bins and bins centred on 0 have no logarithm and are left out.
    """
    powers = range(2, most + 1, 2)
    s = symmetric(cor).groupBy("node").agg(*[F.sum(_soft(F.col("score"), p, kind)).alias(str(p)) for p in powers])
    s = s.select(F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.col(str(p)).alias("k")) for p in powers])).alias("x")).select("x.*")
    span = s.groupBy("power").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / FIT_BINS
    place = F.when(width > 0, F.greatest(F.least(F.ceil((F.col("k") - F.col("lo")) / F.nullif(width, F.lit(0.0))) - 1, F.lit(FIT_BINS - 1)), F.lit(0))).otherwise(0)
    d = s.join(F.broadcast(span), "power").groupBy("power", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))  # a row for each power
    d = d.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width).filter("centre > 0").select("power", F.log("n").alias("y"), F.log("centre").alias("x"))
    return d.groupBy("power").agg(F.when((F.min("x") < F.max("x")) & (F.min("y") < F.max("y")), F.abs(F.corr("x", "y"))).alias("fit"))


def fitting_power(cor: DataFrame, kind: str = "signed", enough: float = ENOUGH_FIT, most: int = MOST_POWER) -> int:
    """The least even power whose fit is above enough, or the last one tried."""
    found = power_fits(cor, kind, most).filter(F.col("fit") > enough).agg(F.min("power")).first()[0]
    return found if found is not None else most - most % 2


def tom(cor: DataFrame, power: int | None = None, kind: str = "signed") -> DataFrame:
    """Topological overlap of soft-thresholded correlations; without a power, the least that fits is taken."""
    if power is None:
        power = fitting_power(cor, kind)
    a = cor.select("i", "j", _soft(F.col("score"), power, kind).alias("w"))
    s = symmetric(a)
    k = s.groupBy("node").agg(F.sum("w").alias("k"))
    paths = tiles.all_pairs(tiles.rows_of(a.select("i", "j", F.col("w").alias("score"))), tiles.dot).withColumnRenamed("score", "l")
    d = a.join(paths, ["i", "j"], "left").join(k.select(F.col("node").alias("i"), F.col("k").alias("ki")), "i").join(k.select(F.col("node").alias("j"), F.col("k").alias("kj")), "j")
    return d.select("i", "j", ((F.coalesce("l", F.lit(0.0)) + F.col("w")) / (F.least("ki", "kj") + 1 - F.col("w"))).alias("score"))


def clr(mi: DataFrame, genes: int) -> DataFrame:
    """Context likelihood: sqrt(zi^2 + zj^2) with z clipped at 0; mean and deviation include the 0 of the diagonal."""
    m = mi.withColumn("score", F.abs("score"))
    s = symmetric(m).groupBy("node").agg(F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2"))
    s = s.select("node", (F.col("s1") / genes).alias("m"), F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / genes) / (genes - 1)).alias("sd"))
    side = lambda e, p: s.select(F.col("node").alias(e), F.col("m").alias(f"m{p}"), F.col("sd").alias(f"sd{p}"))
    d = m.join(side("i", 1), "i").join(side("j", 2), "j")
    z = lambda p: F.greatest((F.col("score") - F.col(f"m{p}")) / F.col(f"sd{p}"), F.lit(0.0))
    return d.select("i", "j", F.sqrt(z(1) * z(1) + z(2) * z(2)).alias("score"))


def _weakest_links(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each two rows, the best of the worse of both values at the same place."""
    out = np.full((len(left), len(right)), -np.inf)
    for k in range(len(left)):
        np.maximum(out[k], np.minimum(left[k], right).max(axis=1), out=out[k])
    return out


def dpi(mi: DataFrame) -> DataFrame:
    """Edges that are the weakest of a triangle get score 0; scores must not be negative, and pairs without edges have 0."""
    over = tiles.all_pairs(tiles.rows_of(mi.select("i", "j", "score")), _weakest_links).withColumnRenamed("score", "over")
    d = mi.select("i", "j", "score").join(over, ["i", "j"], "left")
    return d.select("i", "j", F.when(F.col("over") > F.col("score"), 0.0).otherwise(F.col("score")).alias("score"))


def bicor(expr: DataFrame) -> DataFrame:
    """(i, j, score): biweight midcorrelation of genes; null where more than half of a gene's values are the same."""
    mid = expr.groupBy("gene").agg(F.percentile("value", 0.5).alias("mid"))
    d = expr.join(mid, "gene").withColumn("x", F.col("value") - F.col("mid"))
    mad = d.groupBy("gene").agg(F.percentile(F.abs("x"), 0.5).alias("mad"))
    u = F.col("x") / F.nullif(9 * F.col("mad"), F.lit(0.0))
    d = d.join(mad, "gene").select("sample", "gene", F.when(F.abs(u) < 1, F.col("x") * F.pow(1 - u * u, 2)).when(u.isNotNull(), 0.0).alias("x"))
    norms = d.groupBy("gene").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    d = d.join(norms, "gene").select("sample", "gene", (F.col("x") / F.nullif("norm", F.lit(0.0))).alias("x"))
    v = vectors(d.select("sample", "gene", F.coalesce("x", F.lit(float("nan"))).alias("value")))
    out = tiles.all_pairs(v, tiles.dot)
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def bicor_or_pearson(expr: DataFrame) -> DataFrame:
    """bicor, and Pearson's correlation where that has no value."""
    p = pearson(expr).withColumnRenamed("score", "r")
    return p.join(bicor(expr), ["i", "j"], "left").select("i", "j", F.coalesce("score", "r").alias("score"))


def knots(order: int, bins: int) -> np.ndarray:
    inner = bins - order
    return np.concatenate([np.zeros(order), np.arange(1, inner + 1) / (inner + 1), np.ones(order)])


def spline_weights(x: np.ndarray, bins: int, order: int = SPLINE_ORDER, span: tuple | None = None) -> np.ndarray:
    """(bins, samples): how far each value, scaled from span (its extremes, if not given) to 0..1, belongs to each bin of a B-spline basis."""
    lo, hi = span or (x.min(), x.max())
    t = (x - lo) / (hi - lo)
    k = knots(order, bins)
    w = ((t >= k[:-1, None]) & (t < k[1:, None])).astype(float)
    w[bins - 1, t == 1] = 1.0
    for p in range(2, order + 1):
        n = len(w) - 1
        up, down = k[p - 1 : p - 1 + n] - k[:n], k[p : p + n] - k[1 : n + 1]
        a = np.divide(t - k[:n, None], up[:, None], out=np.zeros((n, len(t))), where=up[:, None] > 0)
        b = np.divide(k[p : p + n, None] - t, down[:, None], out=np.zeros((n, len(t))), where=down[:, None] > 0)
        w = np.maximum(a * w[:n] + b * w[1 : n + 1], 0)
    return w[:bins]


def _entropy(p: np.ndarray, axis) -> np.ndarray:
    return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=axis)


def percentile(values: np.ndarray, p: int) -> float:
    """The p-th percentile of sorted values, between those whose ranks, rounded to whole percents, stand around it."""
    n = len(values)
    at = np.floor(100 / n * (np.arange(1, n + 1) - 0.5) + 0.5).astype(int)
    if p <= at[0] or p >= at[-1]:
        return float(values[0] if p <= at[0] else values[-1])
    k = int(np.searchsorted(at, p))
    if at[k] == p:
        return float(values[k])
    return float(values[k - 1] + n * (p - at[k - 1]) / 100 * (values[k] - values[k - 1]))


def bin_count(x: np.ndarray) -> float:
    """Bins of a gene's values by Scott's rule with the smaller of deviation and scaled inter-quartile range."""
    x = np.sort(x)
    spread = min(x.std(ddof=1), (percentile(x, 75) - percentile(x, 25)) / 1.349)
    return float(np.ceil((x[-1] - x[0]) / (len(x) ** (-1 / 3) * spread * 3.49)))


def usual_bins(expr: DataFrame) -> int:
    """The median of the genes' numbers of bins."""

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bin_count(x) for x in tiles.matrix(pa.chunked_array([b.column(0)]))] if b.num_rows else [], pa.float64())], names=["bins"])

    return int(vectors(expr).select("v").mapInArrow(count, "bins double").agg(F.percentile("bins", 0.5)).first()[0])


def spline_mi(expr: DataFrame, bins: int | None = None, order: int = SPLINE_ORDER) -> DataFrame:
    """(i, j, score): mutual information in bits of genes that are spread over bins by B-splines; bins may be found from the data."""
    n = bins or usual_bins(expr)
    if n < order:
        raise ValueError(f"{n} bins are too few for splines of order {order}")

    def mutual(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        samples, sides = left.shape[1], (left, right)
        spans = [list(zip(v.min(axis=1), v.max(axis=1), strict=True)) for v in sides]
        own = [np.zeros((len(v), n)) for v in sides]
        joint = np.zeros((len(left) * n, len(right) * n))
        step = max(1, WEIGHTS // ((len(left) + len(right)) * n))
        for lo in range(0, samples, step):  # as many samples at once as have WEIGHTS weights
            x, y = (np.stack([spline_weights(g, n, order, e) for g, e in zip(v[:, lo : lo + step], span, strict=True)]) for v, span in zip(sides, spans, strict=True))
            own[0] += x.sum(axis=2)
            own[1] += y.sum(axis=2)
            joint += x.reshape(len(joint), -1) @ y.reshape(joint.shape[1], -1).T
        hx, hy = (_entropy(p / samples, 1) for p in own)
        joint = joint.reshape(len(left), n, len(right), n) / samples
        return hx[:, None] + hy - np.stack([_entropy(p, (0, 2)) for p in joint])

    return tiles.all_pairs(vectors(expr), mutual, tile=128)


def shrinkage(x: np.ndarray) -> float:
    """How far to shrink the correlations of standardised columns towards none, from the variance of their estimates."""
    n = len(x)
    r = x.T @ x / n
    off = float((r * r).sum() - (np.diag(r) ** 2).sum())
    if off == 0:
        return 1.0
    squares = x * x
    product = float((squares.sum(axis=1) ** 2).sum() - (squares**2).sum()) / n
    return float(min(1.0, max(0.0, (product - off) / off / (n - 1))))


def partial_matrix(x: np.ndarray) -> np.ndarray:
    """Partial correlations of standardised columns from the inverse of their shrunken correlations."""
    lam = shrinkage(x)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    keep = s > s.max() * max(x.shape) * np.finfo(float).eps
    s, v = s[keep], v[keep]
    own = (1 - lam) * s * s / (len(x) - 1)
    inverse = (v.T * (1 / own)) @ v if lam == 0 else np.eye(x.shape[1]) / lam + (v.T * (1 / (own + lam) - 1 / lam)) @ v
    scale = 1 / np.sqrt(np.diag(inverse))
    out = -inverse * scale * scale[:, None]
    np.fill_diagonal(out, 1.0)
    return out


#: Genes of which the inverse of all correlations is still worked out in one task.
MOST_GENES = 20_000


def partial_correlation(expr: DataFrame) -> DataFrame:
    """(i, j, score): shrinkage partial correlations. The inverse of a matrix of all genes is one task's work."""
    v = vectors(zscore(expr))
    if v.limit(MOST_GENES + 1).count() > MOST_GENES:
        raise ValueError(f"partial correlations of more than {MOST_GENES} genes don't fit into a task")
    gene = dict(expr.dtypes)["gene"]

    def one(table: pa.Table) -> pa.Table:
        genes = table.column("gene").combine_chunks()
        order = np.argsort(np.array(genes.to_pylist()), kind="stable")
        out = partial_matrix(tiles.matrix(table.column("v"))[order].T)
        a, b = np.tril_indices(len(order), -1)
        return pa.table({"i": genes.take(pa.array(order[a])), "j": genes.take(pa.array(order[b])), "score": pa.array(out[a, b])})

    return v.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(one, f"i {gene}, j {gene}, score double")

"""Networks from designed experiments: agreement of fold changes against controls, and differences between two conditions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdnet.operators import tiles
from crowdnet.operators.association import vectors
from crowdnet.scratch import Scratch

#: Cells of matrices that permutations get; chips of whole experiments, about, and genes whose fold changes are made in one task.
MOST_CELLS, CHIPS, GENES = 5_000_000, 4_096, 256


def controls(chips: list[dict]) -> list[tuple[int, int, int]]:
    """(first chip, chips of the condition, first chip of its control) of all conditions and their controls.

    chips have sample, experiment, perturbations (a set), time and repeat, in order. Within an experiment a condition's
    control is the first one of the same perturbations at an earlier time, and of each group of equal proper subsets of
    its perturbations the one nearest in time.
    """
    out = []
    by_experiment: dict = {}
    for k, c in enumerate(chips):
        if c["repeat"] == 1:
            by_experiment.setdefault(c["experiment"], []).append(k)
    for own in by_experiment.values():
        for k in own:
            mine, count = chips[k]["perturbations"], 1
            while k + count < len(chips) and chips[k + count]["experiment"] == chips[k]["experiment"] and chips[k + count]["repeat"] == count + 1:
                count += 1
            found, groups = [], {}
            for c in own:
                theirs = chips[c]["perturbations"]
                if c == k or theirs - mine:
                    continue
                if theirs == mine:
                    if chips[c]["time"] < chips[k]["time"] and not found:
                        found.append(c)
                else:
                    groups.setdefault(frozenset(theirs), []).append(c)
            found += [min(g, key=lambda c: abs(chips[k]["time"] - chips[c]["time"])) for g in groups.values()]
            out += [(k, count, c) for c in found]
    return out


def replicates(expr: DataFrame, chips: DataFrame) -> DataFrame:
    """(condition, gene, value): means over the repeats of each condition; chips has sample and condition."""
    return expr.join(chips.select("sample", "condition"), "sample").groupBy("condition", "gene").agg(F.avg("value").alias("value"))


def _fold_changes(weight: float):
    """(part, gene, v): of a part's tests by their order the sum and squares of a gene's fold changes, its weight and the test's chips."""

    def run(values: pa.Table, chips: pa.Table) -> pa.Table:
        rows = chips.to_pylist()
        for r in rows:
            r["perturbations"], r["time"] = frozenset(r["perturbations"] or ()), float(r["time"] or 0)
        rows.sort(key=lambda r: (r["experiment"] is not None, r["experiment"], ",".join(sorted(r["perturbations"])), r["time"], r["repeat"], r["sample"]))
        place = {r["sample"]: k for k, r in enumerate(rows)}
        genes, of = np.unique(np.array(values.column("gene").to_pylist()), return_inverse=True)
        x = np.full((len(rows), len(genes)), np.nan)
        if len(genes):
            samples, at = np.unique(np.array(values.column("sample").to_pylist()), return_inverse=True)
            x[np.array([place[s] for s in samples.tolist()])[at], of] = values.column("value").to_numpy()
        out = []
        for k, n, c in controls(rows):
            repeats = 1
            while c + repeats < len(rows) and rows[c + repeats]["experiment"] == rows[c]["experiment"] and rows[c + repeats]["repeat"] == repeats + 1:
                repeats += 1
            d = x[k : k + n] - x[c : c + repeats].mean(axis=0)
            heavy = set(rows[k]["changed"] or ()) - set(rows[c]["changed"] or ())
            out.append(np.stack([d.sum(axis=0), (d * d).sum(axis=0), np.where(np.isin(genes, list(heavy)), weight, 1.0), np.full(len(genes), float(n))]))
        v = np.stack(out).transpose(2, 0, 1).ravel() if out else np.empty(0)
        at = np.arange(len(genes) + 1, dtype=np.int32) * (4 * len(out))
        own = pa.array(np.full(len(genes), chips.column("part")[0].as_py() if len(rows) else 0), pa.int32())
        return pa.table({"part": own, "gene": pa.array(genes.tolist(), values.schema.field("gene").type), "v": pa.ListArray.from_arrays(pa.array(at), pa.array(v))})

    return run


def anoverence(expr: DataFrame, chips: DataFrame, weight: float = 1.0) -> DataFrame:
    """(i, j, score) for i > j: share of the squared fold changes of both genes that lies between conditions.

    chips(sample, experiment, perturbations array, time, repeat, changed array) describes the samples; changed are genes
    deleted or overexpressed, whose fold changes weigh weight against controls without the change. A missing time is 0.
    Experiments are dealt over the cluster, as conditions and their controls are in one; an experiment is in one task.
    """
    n, genes = chips.count(), expr.select("gene").distinct().count()
    parts, blocks = max(1, -(-n // CHIPS)), max(1, -(-genes // GENES))
    own = chips.select(F.pmod(F.xxhash64("experiment"), F.lit(parts)).cast("int").alias("part"), "sample", "experiment", "perturbations", F.col("time").cast("double").alias("time"), F.col("repeat").cast("int").alias("repeat"), "changed")
    scratch = Scratch(expr.sparkSession)
    own = scratch.cut(own, "chips")
    block = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("block")
    values = expr.join(own.select("sample", "part"), "sample").select(F.col("part").alias("part"), block, F.col("sample").alias("sample"), F.col("gene").alias("gene"), F.col("value").cast("double").alias("value"))
    meta = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    gene = dict(expr.dtypes)["gene"]
    changes = values.groupBy("part", "block").cogroup(meta.groupBy("part", "block")).applyInArrow(_fold_changes(weight), f"part int, gene {gene}, v array<double>")
    vectors = changes.groupBy("gene").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "v"))), lambda c: c["v"])).alias("v"))
    vectors = scratch.cut(vectors, "changes")
    if vectors.filter(F.size("v") > 0).isEmpty():
        raise ValueError("no condition has a control")

    def between(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sums, squares, p, n = (np.ascontiguousarray(right.reshape(len(right), -1, 4)[:, :, k]) for k in range(4))
        out = np.empty((len(left), len(right)))
        for k, own in enumerate(left.reshape(len(left), -1, 4)):
            s, w = own[:, 0] + p * sums, n * (1 + p)
            base = s.sum(axis=1) ** 2 / w.sum(axis=1)
            out[k] = ((s * s / w).sum(axis=1) - base) / ((own[:, 1] + p * squares).sum(axis=1) - base)
        return out

    return tiles.all_pairs(vectors, between, ordered=True)


# differences between networks


def correlations(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.corrcoef(x.T))


def distance(a: np.ndarray, b: np.ndarray, p: float) -> tuple[float, np.ndarray]:
    """The p-norm of the differences of two networks by pairs of genes, of all of them and of each gene's."""
    d = np.abs(a - b) ** p
    pairs = len(a) * (len(a) - 1) / 2
    return float((d.sum() / pairs) ** (1 / p)), (d.sum(axis=0) / pairs) ** (1 / p)


def network_distance(x: DataFrame, y: DataFrame, p: float = 2.0) -> DataFrame:
    """(distance): the p-norm of the differences of two networks (i, j, score); missing edges are 0, pairs are those of all nodes."""
    both = x.select("i", "j", F.col("score").alias("a")).join(y.select("i", "j", F.col("score").alias("b")), ["i", "j"], "full")
    n = both.select(F.explode(F.array("i", "j")).alias("node")).agg(F.countDistinct("node").alias("n"))
    total = both.agg(F.sum(F.pow(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))), F.lit(p))).alias("s"))
    return total.crossJoin(F.broadcast(n)).select(F.pow(2 * F.col("s") / (F.col("n") * (F.col("n") - 1) / 2), F.lit(1 / p)).alias("distance"))  # one row each


def rank_sum_p(value: float, others: np.ndarray) -> float:
    """One-sided Mann-Whitney p of one value being less than others, exact without ties."""
    return float(((others < value).sum() + 0.5 * (others == value).sum() + 1) / (len(others) + 1))


def differential(first: DataFrame, second: DataFrame, pathways: DataFrame, permutations: int = 100, p: float = 2.0, infer=correlations, seed: int = 0) -> DataFrame:
    """(pathway, gene, distance, mean_permuted, p_value) for pathways(pathway, gene); gene is null for a whole pathway.

    Samples of both conditions (sample, gene, value) are dealt anew permutations times; p_value is the share of these whose
    networks differ at least as much. Only genes of both tables count; the permutations are dealt over the cluster.
    """
    spark = first.sparkSession
    common = first.select("gene").distinct().intersect(second.select("gene").distinct())
    used = pathways.select("pathway", "gene").distinct().join(common, "gene", "left_semi")
    sets = {r["pathway"]: sorted(r["genes"]) for r in used.groupBy("pathway").agg(F.collect_set("gene").alias("genes")).filter("size(genes) > 1").collect()}
    need = used.select("gene").distinct()
    mats = []
    for e in (first, second):
        v = vectors(e.join(need, "gene", "left_semi"))
        if v.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] > MOST_CELLS:
            raise ValueError(f"the pathways' genes have more than {MOST_CELLS} cells")
        mats.append({r["gene"]: np.array(r["v"]) for r in v.collect()})  # MOST_CELLS numbers at most
    shared = spark.sparkContext.broadcast((sets, mats))

    def run(parts):
        own, (a, b) = shared.value
        for part in parts:
            for k in part["k"].tolist():
                rng = np.random.default_rng([seed, k])
                for name, genes in own.items():
                    x, y = (np.stack([m[g] for g in genes], axis=1) for m in (a, b))
                    if k:
                        both = np.concatenate([x, y])[rng.permutation(len(x) + len(y))]
                        x, y = both[: len(x)], both[len(x) :]
                    whole, each = distance(infer(x), infer(y), p)
                    yield pd.DataFrame({"k": k, "pathway": [name] * (len(genes) + 1), "gene": [None, *genes], "d": [whole, *each]}).astype({"gene": object})

    kinds = dict(pathways.dtypes)
    runs = spark.range(permutations + 1).withColumnRenamed("id", "k").repartition(min(permutations + 1, 4 * spark.sparkContext.defaultParallelism))
    d = runs.mapInPandas(run, f"k long, pathway {kinds['pathway']}, gene {kinds['gene']}, d double")
    real = F.max(F.when(F.col("k") == 0, F.col("d")))
    out = d.groupBy("pathway", "gene").agg(real.alias("distance"), F.avg(F.when(F.col("k") > 0, F.col("d"))).alias("mean_permuted"), F.collect_list(F.when(F.col("k") > 0, F.col("d"))).alias("others"))
    hits = F.size(F.filter("others", lambda x: x >= F.col("distance")))
    return out.select("pathway", "gene", "distance", "mean_permuted", F.least(F.lit(1.0), (hits + 1) / F.lit(permutations)).alias("p_value"))

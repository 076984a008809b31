"""The commands by name: each takes networks or expression tables and the options it has as keywords.

A network is a ``store.Network`` whose edges are long: (i, j, alg, direction, score, rank), one row for each algorithm that
has the edge. meta["algorithms"] lists them in order; ``index`` picks one, counted from 1, and 0 is the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdnet import __version__
from crowdnet.functions import filters
from crowdnet.operators import association, centrality, clusters, components, consensus, ensembles, networks, perturbations, query, ranking, thresholds
from crowdnet.sources import store, text
from crowdnet.sources.store import Network

#: Networks of these are undirected, ranked by absolute scores, and written as lower triangles (others as matrices).
UNDIRECTED = {"ARACNE", "CLR", "MI", "PCOR", "PEARSON", "SPEARMAN", "TOMSIMILARITY", "BICOR"}
ABSOLUTE = {"PCOR", "PEARSON", "SPEARMAN", "BICOR"}
FORMATS = ("el", "lm", "m", "ara")


def version() -> str:
    return __version__


def import_preset(algorithm: str) -> dict:
    """The options that ``import_network`` usually has for an algorithm's file."""
    name = algorithm.upper()
    return {"name": name, "reverse": True, "drop_zero": True, "undirected": name in UNDIRECTED, "absolute": name in ABSOLUTE, "format": "lm" if name in UNDIRECTED else "m"}


def algorithms(net: Network) -> list[str]:
    return net.meta["algorithms"].split(",")


def pick(net: Network, index: int = 0) -> DataFrame:
    """(i, j, direction, score, rank) of one algorithm."""
    names = algorithms(net)
    if not 0 <= index <= len(names):
        raise ValueError(f"there are {len(names)} scores, so no index {index}")
    return net.edges.filter(F.col("alg") == names[index - 1]).select("i", "j", "direction", "score", "rank")


def _weight(d: DataFrame, rank: bool) -> DataFrame:
    return d.withColumn("score", F.col("rank")) if rank else d


def import_network(spark: SparkSession, infile: str, genes: str, name: str, format: str = "el", absolute: bool = False, reverse: bool = False, drop_zero: bool = False, undirected: bool = False) -> Network:
    if format not in FORMATS:
        raise ValueError(f"no format {format}; there are {FORMATS}")
    names = text.nodes(spark, genes)
    readers = {"el": lambda: text.edge_list(spark, infile, names), "lm": lambda: text.lower_triangle(spark, infile), "m": lambda: text.full_matrix(spark, infile), "ara": lambda: text.gene_rows(spark, infile, names)}
    edges = ranking.import_edges(readers[format](), absolute=absolute, reverse=reverse, drop_zero=drop_zero, undirected=undirected)
    return Network(names, edges.withColumn("alg", F.lit(name)).select("i", "j", "alg", "direction", "score", "rank"), None, {"algorithms": name})


def aggregate(nets: list[Network], method: str = "irp", keep: bool = False) -> Network:
    """All networks with their consensus as one more algorithm; with keep, edges have the other networks' directions as d_<name>."""
    names = [a for n in nets for a in algorithms(n)]
    if len(set(names)) < len(names):
        raise ValueError("networks have the same name")
    edges = nets[0].edges
    for n in nets[1:]:
        edges = edges.unionByName(n.edges)
    fused = consensus.aggregate(edges, method, len(names), nets[0].nodes.count(), first=names[0], keep=names if keep else None)
    fused = fused.withColumn("alg", F.lit(method)).drop("value")
    return Network(nets[0].nodes, edges.unionByName(fused, allowMissingColumns=True), None, {"algorithms": ",".join([*names, method]), "method": method})


def _wide(net: Network) -> DataFrame:
    """(i, j, direction, s_<name>, r_<name>, ...): the direction is the last algorithm's, or that of the first that has the edge."""
    names = algorithms(net)
    last = F.max(F.when(F.col("alg") == names[-1], F.col("direction")))
    other = F.min_by("direction", "alg")
    d = query.wide(net.edges, names)
    return d.join(net.edges.groupBy("i", "j").agg(F.coalesce(last, other).alias("direction")), ["i", "j"])


def view(
    net: Network, threshold: float | None = None, threshold_rank: bool = False, index: int = 0, filter: str | None = None, nodelist: list[str] | None = None, lines: int | None = None, no_names: bool = False,
    column_headers: bool = False, dense: bool = False, case_insensitive: bool = False, strict: bool = False, sc_delim: str = ";", compat: bool = False,
) -> DataFrame:
    """(i, j, value): a line for each edge in order of i and j; column_headers puts the titles first, with null i and j."""
    names = algorithms(net)
    d = _wide(net)
    if nodelist is not None:
        d = query.lookup(d, net.nodes, nodelist, case_insensitive, strict)
    chosen = names[index - 1]
    if threshold is not None:
        d = d.filter(F.col(f"r_{chosen}") < threshold) if threshold_rank else d.filter(F.col(f"s_{chosen}") > threshold)
    if filter is not None:
        d = d.filter(filters.parse(filter, [F.col(f"s_{a}") for a in names], [F.col(f"r_{a}") for a in names], compat))
    d = d.orderBy("i", "j") if lines is None else d.orderBy("i", "j").limit(lines)
    measures = net.centrality if dense else None
    out = text.wide_lines(d, None if no_names else net.nodes, names, delimiter=sc_delim, dense=measures).orderBy("i", "j")
    if column_headers:
        own = [c for c in measures.columns if c != "node"] if measures is not None else []
        kinds = dict(out.dtypes)
        title = out.sparkSession.createDataFrame([(None, None, text.wide_titles(names, measures=own, delimiter=sc_delim))], f"i {kinds['i']}, j {kinds['j']}, value string")
        out = title.unionByName(out).orderBy(F.col("i").asc_nulls_first(), F.col("j").asc_nulls_first())
    return out


def view_subset(net: Network, condition: Column | str) -> Network:
    """The network with the edges that fulfil a condition, to be written again."""
    return net.subset(condition)


def index(net: Network, path: str) -> Network:
    """The network written in the order of its edges, which lets readers skip to nodes and pairs."""
    store.write_network(net, path)
    return store.read_network(net.nodes.sparkSession, path)


def top(net: Network, number: int = 10, index: int = 0) -> DataFrame:
    return query.top(pick(net, index), number)


def neighbours(net: Network, neighbours: int = 10, genes: list[str] | None = None, rank: bool = False, unique: bool = False, index: int = 0, case_insensitive: bool = False, strict: bool = False) -> DataFrame:
    wanted = None
    if genes is not None:
        fold = F.lower if case_insensitive else (lambda c: c)
        asked = {g.lower() if case_insensitive else g for g in genes}
        wanted = net.nodes.filter(fold(F.col("name")).isin(sorted(asked))).select("node", fold(F.col("name")).alias("name"))
        if strict and (gone := asked - {r["name"] for r in wanted.collect()}):
            raise ValueError(f"unknown nodes: {sorted(gone)}")
    return query.neighbours(pick(net, index), neighbours, rank, unique, wanted)


def sample(net: Network, nedges: int | None = None, fraction: float | None = None, replacement: bool = False, seed: int = 0, index: int = 0) -> DataFrame:
    d = pick(net, index)
    if (nedges is None) == (fraction is None):
        raise ValueError("either a number or a fraction of edges")
    return query.sample(d, nedges if nedges is not None else round(fraction * d.count()), seed, replacement)


def adjacency(net: Network, index: int = 0, fmt: str = "m", diagonal: bool = False, missing: float = 0.0, precision: int = 8) -> DataFrame:
    kinds = {"m": "sym-mat", "lm": "low-tri"}
    return text.matrix_lines(pick(net, index), net.nodes, kinds[fmt], diagonal, missing, precision)


def convert(spark: SparkSession, infile: str, genes: str, source: str, target: str, fill: float = float("nan"), precision: int = 8, out_separator: str = "\t") -> DataFrame:
    """(i, value): lines of one format from a file of another: edge-list, sym-mat, low-tri, up-tri (each triangle also with -diag) and aracne."""
    names = text.nodes(spark, genes)
    part = lambda k: ("lower" if k.startswith("low") else "upper", k.endswith("-diag"))
    if source.startswith(("low", "up")):
        raw = text.triangle(spark, infile, *part(source))
    else:
        raw = {"edge-list": lambda: text.edge_list(spark, infile, names), "sym-mat": lambda: text.full_matrix(spark, infile), "aracne": lambda: text.gene_rows(spark, infile, names)}[source]()
    net = ranking.canonical(raw.filter(~F.isnan("w")), "a", "b").groupBy("i", "j").agg(F.max_by("w", "direction").alias("score"))
    return text.matrix_lines(net, names, target.removesuffix("-diag"), target.endswith("-diag"), fill, precision, out_separator)


def asp(net: Network, index: int = 0, use_rank: bool = False, invert: bool = False, absolute: bool = False) -> DataFrame:
    """(source, node, distance) of all pairs; zero weights count as a small one, then absolute and invert are applied."""
    w = F.when(F.col("score") == 0, centrality.LEAST_WEIGHT).otherwise(F.col("score"))
    w = F.abs(w) if absolute else w
    d = _weight(pick(net, index), use_rank).withColumn("score", 1 / w if invert else w)
    return centrality.distances(d, invert=False)


def backbone(net: Network, index: int = 0, filter: float | None = None) -> DataFrame:
    return networks.backbone(pick(net, index), filter)


def compare(first: Network, second: Network, index_a: int = 0, index_b: int = 0, translate: DataFrame | None = None, nodes: bool = False) -> DataFrame:
    """Edges (or nodes) of both networks by name with where they are from; translate(old, new) renames the second's nodes."""

    def named(net: Network, k: int) -> DataFrame:
        a, b = (net.nodes.select(F.col("node").alias(e), F.col("name").alias(f"_{e}")) for e in "ij")
        d = pick(net, k).join(a, "i").join(b, "j")
        return d.select(F.greatest("_i", "_j").alias("i"), F.least("_i", "_j").alias("j"), "score", "rank")

    x, y = named(first, index_a), named(second, index_b)
    every = first.nodes.select(F.col("name").alias("node")), second.nodes.select(F.col("name").alias("node"))
    if translate is not None:
        names = networks.merged_names(every[0], every[1], translate)
        both = names.select(F.col("node").alias("old"), F.col("name").alias("new"))
        x, y = networks.translate(x, both), networks.translate(y, both)
        every = tuple(e.join(names, "node").select(F.col("name").alias("node")) for e in every)
    return networks.compare_nodes(x, y, every[0].union(every[1]).distinct()) if nodes else networks.compare(x, y)


def cluster_enrichment(first: DataFrame, second: DataFrame | None = None, delim: str = ",", alpha: float = clusters.ALPHA, min_members: int = clusters.LEAST_MEMBERS, max_members: int = clusters.MOST_MEMBERS) -> DataFrame:
    if second is None:
        return clusters.listing(clusters.members(first, min_members, max_members), delim)
    return clusters.enrichment(first, second, alpha, min_members, max_members)


def describe(net: Network, bins: int | None = None) -> DataFrame:
    return query.describe(net.edges) if bins is None else query.histogram(net.edges, bins)


def graphstats(net: Network, index: int = 0) -> DataFrame:
    return thresholds.graph_report(pick(net, index), net.nodes)


def reheader(net: Network) -> Network:
    return net.reheadered()


def roc(net: Network, gold: DataFrame, neg: DataFrame | None = None, index: int = 0, edges: int | None = None, fraction: float | None = None, points: int | None = None, tfs: DataFrame | None = None, all: bool = False) -> DataFrame:
    """The curve of one algorithm, or (alg, auc, aupr) of all; edges is the number of best edges, fraction the share of gold pairs to reach."""
    judged = lambda d: networks.judged(d.select("i", "j", "score"), gold, neg)
    if all:
        out = None
        for k, a in enumerate(algorithms(net), 1):
            one = networks.areas(judged(pick(net, k)), tfs, edges).select(F.lit(a).alias("alg"), "auc", "aupr")
            out = one if out is None else out.union(one)
        return out
    d = judged(pick(net, index))
    if fraction is not None:
        edges = networks.recall_cut(networks.roc(d, tfs), fraction).first()[0]
    return networks.roc(d, tfs, edges, points)


def tau(first: Network, second: Network, dict: DataFrame | None = None, index_a: int = 0, index_b: int = 0) -> DataFrame:
    """Kendall's tau by node of the first network; dict(old, new) takes the second network's nodes to those of the first, one to many."""
    y = pick(second, index_b)
    return networks.kendall(pick(first, index_a), networks.orthologs(y, dict) if dict is not None else y)


def threshold(net: Network, min: float = 0.0, max: float = 1.0, nsteps: int = 100, index: int = 0, rank: bool = False) -> DataFrame:
    return thresholds.suggested(thresholds.sweep(pick(net, index), min, max, nsteps, rank))


#: Measures of nodes by their short names; those of edges are SEC and EBC.
NODE_MEASURES = ("PR", "CLO", "BTW", "STR", "EV", "KTZ", "LPC")


def stats(net: Network, index: int = 0, metrics: tuple[str, ...] = (*NODE_MEASURES, "SEC", "EBC"), nsamples: float | None = None, eigenvector_tol: float = 1e-8, katz_alpha: float = 0.01, rounds: int = 100, weight_is_distance: bool = False, weight_rank: bool = False) -> Network:
    """The network with measures of nodes as its centrality, and those of edges as columns of the chosen algorithm's edges.

    nsamples is the share of nodes that closeness and betweenness search from; all, if it isn't given or the network isn't
    connected.
    """
    d = _weight(pick(net, index), weight_rank)
    invert = not weight_is_distance
    if nsamples is not None and components.components(d, a="i", b="j").select("component").distinct().count() > 1:
        nsamples = None
    own: dict[str, DataFrame] = {}
    between = centrality.betweenness(d, None if "EBC" in metrics else nsamples, invert) if {"BTW", "EBC"} & set(metrics) else None
    for m in metrics:
        if m == "PR":
            own[m] = networks.pagerank(d, rounds, tolerance=1e-8)
        elif m == "CLO":
            own[m] = centrality.closeness(centrality.distances(d, invert=invert)) if nsamples is None else centrality.approximate_closeness(d, nsamples)
        elif m == "BTW":
            own[m] = between[0]
        elif m == "STR":
            own[m] = networks.strength(d).select("node", "strength")
        elif m == "EV":
            own[m] = centrality.eigenvector(d, rounds, eigenvector_tol)
        elif m == "KTZ":
            own[m] = centrality.katz(d, rounds, katz_alpha, tolerance=1e-8)
        elif m == "LPC":
            own[m] = centrality.laplacian(d)
        elif m not in ("SEC", "EBC"):
            raise ValueError(f"no measure {m}")
    nodes = net.nodes.select("node")
    for m, found in own.items():
        nodes = nodes.join(found.select("node", F.col(found.columns[-1]).alias(m)), "node", "left")
    edges = net.edges
    name = algorithms(net)[index - 1]
    spanning = (centrality.spanning_edges(d) if nsamples is None else centrality.approximate_spanning_edges(d)) if "SEC" in metrics else None
    for m, found in (("SEC", spanning), ("EBC", between[1] if "EBC" in metrics else None)):
        if found is not None:
            edges = edges.join(found.select("i", "j", F.lit(name).alias("alg"), F.col(found.columns[-1]).alias(m)), ["i", "j", "alg"], "left")
    return Network(net.nodes, edges, nodes, dict(net.meta))


# inference: (i, j, score) or (source, target, score) of an expression table (sample, gene, value)


def _targets(d: DataFrame, targets: list | None, absolute: bool = False) -> DataFrame:
    d = d.withColumn("score", F.abs("score")) if absolute else d
    return d if targets is None else d.filter(F.col("i").isin(targets) | F.col("j").isin(targets))


def correlation(expr: DataFrame, method: str = "pearson", absolute: bool = False, targets: list | None = None) -> DataFrame:
    return _targets({"pearson": association.pearson, "spearman": association.spearman, "bicor": association.bicor_or_pearson}[method](expr), targets, absolute)


def pcor(expr: DataFrame, absolute: bool = False, targets: list | None = None) -> DataFrame:
    return _targets(association.partial_correlation(expr), targets, absolute)


def tomsimilarity(expr: DataFrame, method: str = "pearson", sft: int = 0, max_power: int = association.MOST_POWER, sft_cutoff: float = association.ENOUGH_FIT, tom_type: str = "signed", absolute: bool = False, targets: list | None = None) -> DataFrame:
    kind = {"signed-hybrid": "hybrid"}.get(tom_type, tom_type)
    cor = correlation(expr, method)
    return _targets(association.tom(cor, sft or association.fitting_power(cor, kind, sft_cutoff, max_power), kind), targets, absolute)


def mi(expr: DataFrame, mode: str = "RAW", spline: int = association.SPLINE_ORDER, bins: int = 0, mi_path: str | None = None, targets: list | None = None) -> DataFrame:
    """Mutual information, or CLR or ARACNE on it. mi_path keeps the information as a table, and uses it if it is there."""
    spark = expr.sparkSession
    found = None
    if mi_path is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{mi_path}/_SUCCESS")
        if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            association.spline_mi(expr, bins or None, spline).write.mode("overwrite").parquet(mi_path)
        found = spark.read.parquet(mi_path)
    found = found if found is not None else association.spline_mi(expr, bins or None, spline)
    if mode == "CLR":
        found = association.clr(found, expr.select("gene").distinct().count())
    elif mode == "ARACNE":
        found = association.dpi(found.withColumn("score", F.greatest("score", F.lit(0.0))))
    elif mode != "RAW":
        raise ValueError(f"no mode {mode}")
    return _targets(found, targets)


def infer(expr: DataFrame, algorithm: str, targets: list | None = None, no_scale: bool = False, seed: int = 0, **options) -> DataFrame:
    """(source, target, score) of genie3, elnet, tigress, plsnet, llr, svm or narromi; options are those of its kernel."""
    return ensembles.regress(expr, ensembles.KERNELS[algorithm](**options), targets, not no_scale, seed)


def anoverence(expr: DataFrame, features: DataFrame, weight: float = 1.0, targets: list | None = None) -> DataFrame:
    return _targets(perturbations.anoverence(expr, features, weight), targets)

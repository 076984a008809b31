"""Text formats of networks: readers to (a, b, w) or (i, j, score), and lines to write with DataFrameWriter.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crowdnet.operators.query import matrix_rows
from crowdnet.operators.ranking import running

FIELDS = r"\s+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one text file by number from 0; numbers come from the counts of its blocks."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("at")))
    sizes = d.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row for each block
    return d.join(before, "block").select((F.col("before") + F.col("k") - 1).alias("line"), "value")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, name): the names of a list in their order from 0."""
    d = lines(spark, path).select("line", F.posexplode(F.split(F.trim("value"), FIELDS)).alias("k", "name")).filter("name <> ''")
    return running(d, ["line", "k"], place="place").select((F.col("place") - 1).alias("node"), "name")


def _ids(named: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, w) with ids for names; a name that the list lacks raises an error when rows are read."""
    d = named.join(names.select(F.col("name").alias("a"), F.col("node").alias("x")), "a", "left").join(names.select(F.col("name").alias("b"), F.col("node").alias("y")), "b", "left")
    known = lambda c, name: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("unknown node: "), F.col(name)))).otherwise(F.col(c))
    return d.select(known("x", "a").alias("a"), known("y", "b").alias("b"), "w")


def edge_list(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(a, b, w) of lines: source, target, weight."""
    f = F.split(F.trim("value"), FIELDS)
    return _ids(spark.read.text(path).filter(F.trim("value") != "").select(f[0].alias("a"), f[1].alias("b"), f[2].cast("double").alias("w")), names)


def triangle(spark: SparkSession, path: str, part: str = "lower", diagonal: bool = False) -> DataFrame:
    """(a, b, w) of the rows of a triangle: a row's number is its line's among those that aren't blank.

    A lower triangle without its diagonal begins with the second node's row. Rows of an upper triangle may be padded with
    empty fields on the left; the diagonal's values are left out.
    """
    d = lines(spark, path).filter(F.trim("value") != "").select("line", F.filter(F.split("value", FIELDS), lambda x: x != "").alias("f"))
    d = running(d, ["line"], place="place").select((F.col("place") - 1).alias("row"), F.posexplode("f").alias("k", "v"))
    if part == "lower":
        a, b = F.col("row") + (0 if diagonal else 1), F.col("k").cast("long")
    else:
        a, b = F.col("row"), F.col("row") + F.col("k") + (0 if diagonal else 1)
    return d.select(a.alias("a"), b.alias("b"), F.col("v").cast("double").alias("w")).filter("a <> b")


def lower_triangle(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, w) of rows without the diagonal."""
    return triangle(spark, path)


def full_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, w) of a square matrix, the diagonal left out."""
    d = lines(spark, path).select(F.col("line").cast("int").alias("a"), F.posexplode(F.split(F.trim("value"), FIELDS)).alias("b", "v"))
    return d.filter("a <> b").select("a", "b", F.col("v").cast("double").alias("w"))


def gene_rows(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(a, b, w) of lines: a gene, then targets and weights in turn; lines that begin with > are comments."""
    d = spark.read.text(path).filter(~F.col("value").startswith(">") & (F.trim("value") != "")).select(F.split(F.trim("value"), FIELDS).alias("f"))
    d = d.select(F.col("f")[0].alias("a"), "f", F.posexplode("f").alias("k", "b")).filter("k % 2 = 1")
    return _ids(d.select("a", "b", F.get("f", F.col("k") + 1).cast("double").alias("w")), names)


def filled(raw: DataFrame, nodes: int, fill: float) -> DataFrame:
    """raw(a, b, w) with fill for the pairs b < a of nodes 0 to nodes - 1 that have no value in either direction."""
    have = raw.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    every = raw.sparkSession.range(1, nodes).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("b"))
    return raw.unionByName(every.join(have, ["a", "b"], "left_anti").withColumn("w", F.lit(float(fill))))


def matrix_lines(net: DataFrame, names: DataFrame, kind: str, diagonal: bool = False, fill: float = float("nan"), precision: int = 8, separator: str = "\t") -> DataFrame:
    """(i, value): the lines of net(i, j, score) over names(node, name), to be written in the order of i.

    kind is edge-list (finite values, both directions), sym-mat, low-tri, up-tri (left fields empty) or aracne (name, then
    names and values in turn). Gaps and the diagonal are fill. Numbers have precision decimals.
    """
    text = lambda v: F.when(F.isnan(v), "NaN").when(v == float("inf"), "Inf").when(v == float("-inf"), "-Inf").otherwise(F.format_string(f"%.{precision}f", v))
    own = names.select(F.col("node").alias("i"), "name")
    if kind == "edge-list":
        both = net.select("i", "j", "score").union(net.select("j", "i", "score")).filter(~F.isnan("score") & (F.abs("score") != float("inf")))
        other = names.select(F.col("node").alias("j"), F.col("name").alias("to"))
        return both.join(own, "i").join(other, "j").select("i", "j", F.concat_ws(separator, "name", "to", text(F.col("score"))).alias("value"))
    part = {"sym-mat": "full", "aracne": "full", "low-tri": "lower", "up-tri": "upper"}[kind]
    rows = matrix_rows(net, names.select("node"), part, diagonal, fill)
    rows = rows.filter(F.size("values") > 0).withColumn("cells", F.transform("values", text))
    if kind == "aracne":
        every = names.agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "name"))), lambda x: x["name"]).alias("every"))  # one row: as long as a line
        rows = rows.join(own, "i").crossJoin(F.broadcast(every))
        return rows.select("i", F.concat_ws(separator, "name", F.flatten(F.zip_with("every", "cells", lambda n, c: F.array(n, c)))).alias("value"))
    if kind == "up-tri":
        place = running(rows.select("i"), ["i"], place="place").select("i", (F.col("place") - 1).cast("int").alias("k"))
        return rows.join(place, "i").select("i", F.concat(F.repeat(F.lit(separator), F.col("k")), F.array_join("cells", separator)).alias("value"))
    return rows.select("i", F.array_join("cells", separator).alias("value"))


def expression(spark: SparkSession, path: str) -> DataFrame:
    """(sample, gene, value) of a matrix without a header: samples are rows."""
    return lines(spark, path).select(F.col("line").alias("sample"), F.posexplode(F.split(F.trim("value"), FIELDS)).alias("gene", "v")).select("sample", "gene", F.col("v").cast("double").alias("value"))


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """(name, level1, ..., levelN) of a tree's lines: path, flow, quoted name and an id; # begins a comment.

    N is the number of levels of the deepest path; shorter ones are filled with NA.
    """
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    d = d.select(F.split(F.regexp_extract("value", r"^\s*(\S+)", 1), ":").alias("path"), F.regexp_extract("value", '"([^"]*)"', 1).alias("name"))
    return levels(d)


def levels(d: DataFrame) -> DataFrame:
    """(name, level1, ..., levelN) of d(name, path), path being an array."""
    deepest = d.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    return d.select("name", *[F.coalesce(F.get("path", F.lit(k)), F.lit("NA")).alias(f"level{k + 1}") for k in range(deepest)])


def view_lines(net: DataFrame, names: DataFrame) -> DataFrame:
    """(value): source, target, Directed or Undirected, score;rank of each edge; direction 2 runs from j to i."""
    d = net.join(names.select(F.col("node").alias("i"), F.col("name").alias("x")), "i").join(names.select(F.col("node").alias("j"), F.col("name").alias("y")), "j")
    back = F.col("direction") == 2
    kind = F.when(F.col("direction") == 0, "Undirected").otherwise("Directed")
    return d.select(F.concat_ws("\t", F.when(back, F.col("y")).otherwise(F.col("x")), F.when(back, F.col("x")).otherwise(F.col("y")), kind, F.concat_ws(";", "score", "rank")).alias("value"))


def wide_lines(net: DataFrame, names: DataFrame | None, algs: list[str], extra: list[str] = (), delimiter: str = ";", missing: str = "nan", dense: DataFrame | None = None) -> DataFrame:
    """(i, j, value): source, target, Directed or Undirected, score and rank of each network, and the extra columns joined.

    net has i, j, direction, s_<name> and r_<name> of each network and the extra columns. names(node, name) may be left out,
    which gives ids. dense(node, ...) adds the measures of both ends, one field of each pair. Fields are joined by tabs.
    """
    back = F.col("direction") == 2
    d, text = net, lambda c: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    label = {"i": F.col("i").cast("string"), "j": F.col("j").cast("string")}
    if names is not None:
        for e in "ij":
            d = d.join(names.select(F.col("node").alias(e), F.col("name").alias(f"_{e}")), e)
            label[e] = F.col(f"_{e}")
    measures = []
    if dense is not None:
        measures = [c for c in dense.columns if c != "node"]
        for e in "ij":
            d = d.join(dense.select(F.col("node").alias(e), *[F.col(c).alias(f"_{e}_{c}") for c in measures]), e, "left")
    fields = [
        F.when(back, label["j"]).otherwise(label["i"]), F.when(back, label["i"]).otherwise(label["j"]), F.when(F.col("direction") == 0, "Undirected").otherwise("Directed"),
        *[F.concat_ws(delimiter, text(f"s_{a}"), text(f"r_{a}")) for a in algs],
        *([F.concat_ws(delimiter, *[text(c) for c in extra])] if extra else []),
        *[F.concat_ws(delimiter, F.when(back, text(f"_j_{c}")).otherwise(text(f"_i_{c}")), F.when(back, text(f"_i_{c}")).otherwise(text(f"_j_{c}"))) for c in measures],
    ]
    return d.select("i", "j", F.concat_ws("\t", *fields).alias("value"))


def wide_titles(algs: list[str], extra: list[str] = (), measures: list[str] = (), delimiter: str = ";") -> str:
    """The line of titles above ``wide_lines``."""
    return "\t".join(["Source", "Target", "Type", *[f"{a}_score{delimiter}{a}_rank" for a in algs], *([delimiter.join(extra)] if extra else []), *[f"{m}_source{delimiter}{m}_target" for m in measures]])

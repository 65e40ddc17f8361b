"""Text formats: tab-separated tables, scaffold files, alignments, masks, decompositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A tab-separated file without header; a field that doesn't parse is an error."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CONTIG)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.LINK)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.BUNDLE)


def write_weights(weights: DataFrame, path: str) -> None:
    """Rows of ``schemas.WEIGHT`` as a Parquet table."""
    weights.select(schemas.WEIGHT.names).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WEIGHT).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines numbered from 0 per file.

    Files are read in splits; a line's number is its place in its split plus the
    lines of the splits before.  Only counts per split are brought together.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Scaffold rows with their line number; comment and runtime lines are left out.

    A W row has an orientation (+ is 0, anything else 1); any other row is a
    gap: its length is comp_stop, its comp_start 1, its linkage yes or no.
    """
    f = F.split(F.trim("value"), r"\s+")
    number = lambda i: f[i].cast("long")
    contig = f[4] == "W"
    rows = read_lines(spark, path).where("value not like '#%' and value not like 'RUNTIME:%' and trim(value) <> ''")
    return rows.select(
        "line_no", f[0].alias("scaf_name"), number(1).alias("scaf_start"), number(2).alias("scaf_stop"), number(3).alias("scaf_idx"), f[4].alias("comp_type"),
        F.when(contig, f[5]).otherwise(f[6]).alias("comp_name"), F.when(contig, number(6)).otherwise(1).alias("comp_start"),
        F.when(contig, number(7)).otherwise(number(5)).alias("comp_stop"), F.when(contig, F.when(F.get(f, F.lit(8)) == "+", 0).otherwise(1)).cast("long").alias("comp_orien"),
        F.when(~contig, F.when(F.get(f, F.lit(7)) == "yes", 1).otherwise(0)).cast("long").alias("comp_linkage"),
    )


def agp_violations(agp: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name: first row is contig 1, indexes follow one another, start before stop, gaps between contigs."""
    order = Window.partitionBy("scaf_name").orderBy("scaf_idx", "line_no")
    idx, kind = F.lag("scaf_idx").over(order), F.lag("comp_type").over(order)
    rules = F.array_compact(
        F.array(
            F.when(idx.isNull() & ((F.col("scaf_idx") != 1) | (F.col("comp_type") != "W")), "first row"),
            F.when(F.col("scaf_idx") != idx + 1, "index"),
            F.when(F.col("scaf_start") >= F.col("scaf_stop"), "start and stop"),
            F.when((kind == "W") & (F.col("comp_type") == "W"), "missing gap"),
        )
    )
    return agp.withColumn("rules", rules).select(*agp.columns, F.explode("rules").alias("rule"))


def agp_lines(agp: DataFrame) -> DataFrame:
    """(line_no, value): scaffold rows as text; a gap's length is written as comp_stop less comp_start."""
    start = ["scaf_name", "scaf_start", "scaf_stop", "scaf_idx", "comp_type"]
    contig = F.concat_ws("\t", *start, "comp_name", "comp_start", "comp_stop", F.when(F.col("comp_orien") == 0, "+").otherwise("-"))
    gap = F.concat_ws("\t", *start, F.col("comp_stop") - F.col("comp_start"), "comp_name", F.when(F.col("comp_linkage") == 1, "yes").otherwise("no"))
    return agp.select("line_no", F.when(F.col("comp_type") == "W", contig).otherwise(gap).alias("value"))


def write_agp(agp: DataFrame, path: str, runtime: float | None = None, in_order: bool = False) -> None:
    """Scaffold rows in line order, in as many files as the range sort makes; with a runtime line at the end if given.

    With ``in_order``, rows stand in their order already, inside partitions and
    from one to the next, and are written as they stand, without a shuffle.
    """
    lines = agp_lines(agp.withColumn("line_no", F.lit(0).cast("long")) if in_order else agp)
    if runtime is not None:
        last = agp.sparkSession.createDataFrame([((1 << 63) - 1, f"RUNTIME:\t{runtime:f}")], "line_no long, value string")
        lines = lines.unionByName(last)  # its partitions come after all others
    (lines if in_order else lines.orderBy("line_no")).select("value").write.mode("overwrite").text(path)


def read_runtime(spark: SparkSession, path: str) -> DataFrame:
    """(runtime): seconds of the runtime line, -1.0 without one."""
    seconds = F.try_to_number(F.trim(F.substring_index("value", ":", -1)), F.lit("999999999.999999")).cast("double")
    return spark.read.text(path).where("value like 'RUNTIME:%'").agg(F.coalesce(F.max(seconds), F.lit(-1.0)).alias("runtime"))


def read_alignment_ids(spark: SparkSession, path: str, id_suffix: str = "", cutoff: int = -1) -> DataFrame:
    """(read_id, line_no): reads of a SAM file, plain or gzip, with the line of their only hit, or -1 for several.

    Header lines, lines of one or two fields and unmapped reads are left out; a
    read id is the name without ``id_suffix``.  With a cutoff, the first
    cutoff + 1 ids by their first line.
    """
    f = F.split("value", "\t")
    hits = read_lines(spark, path).where(~F.col("value").startswith("@") & (F.size(f) > 2)).where(f[2] != "*")
    name = F.replace(f[0], F.lit(id_suffix), F.lit("")) if id_suffix else f[0]
    ids = hits.groupBy(name.alias("read_id")).agg(F.min("line_no").alias("first"), F.count("*").alias("n"))
    if cutoff >= 0:
        ids = ids.orderBy("first").limit(cutoff + 1)
    return ids.select("read_id", F.when(F.col("n") > 1, -1).otherwise(F.col("first")).alias("line_no"))


def read_masks(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ctg_name, start, end) of a GFF file; entries on unknown contigs are left out."""
    fields = "ctg_name string, source string, feature string, start long, end long"
    rows = spark.read.schema(fields).option("sep", "\t").option("comment", "#").csv(path)
    return rows.join(contigs.select("ctg_name"), "ctg_name", "left_semi").select("ctg_name", "start", "end")


def read_previous_solution(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Forced orientations (node_idx, orien), the last line wins, and forced directions (idxa, idxb, patha, pathb)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = read_lines(spark, path).where("trim(value) <> ''").select("line_no", *(f[i].cast("long").alias(n) for i, n in enumerate(schemas.SOLUTION.names)))
    ends = rows.select("line_no", F.inline(F.array(*(F.struct(F.col(f"idx{x}").alias("node_idx"), F.col(f"orien{x}").alias("orien"), F.lit(i).alias("at")) for i, x in enumerate("ab")))))
    oriented = ends.groupBy("node_idx").agg(F.max_by("orien", F.struct("line_no", "at")).alias("orien"))
    paths = rows.groupBy("idxa", "idxb").agg(F.max_by(F.struct("patha", "pathb"), "line_no").alias("p")).select("idxa", "idxb", "p.*")
    return oriented, paths


def read_cluster_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi): contig pairs of a cluster list, from its first and third field; any order."""
    f = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).where(F.size(f) > 2)
    return pairs.select(F.least(f[0], f[2]).alias("lo"), F.greatest(f[0], f[2]).alias("hi")).distinct()


def read_decomposition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (stage, path, members), edges (stage, a, b, cut) and roots (stage, path) of decomposition files.

    A piece's number follows those of the pieces that it lies in: path is an
    array of stage + 1 numbers, and so are a and b.  Lines are tab-separated
    key=value fields; a list may end in commas.
    """
    text = spark.read.text(path).select(F.str_to_map("value", F.lit("\t"), F.lit("=")).alias("f"))
    numbers = lambda c: F.transform(F.filter(F.split(F.col("f")[c], ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    stage = F.col("f")["stage"].cast("int").alias("stage")
    nodes = text.where("f['type'] = 'N'").select(stage, numbers("idx").alias("path"), numbers("set").alias("members"))
    edges = text.where("f['type'] = 'E'").select(stage, numbers("idx1").alias("a"), numbers("idx2").alias("b"), numbers("cut").alias("cut"))
    roots = text.where("f['type'] = 'R'").select(stage, numbers("idx").alias("path"))
    return nodes, edges, roots


def write_decomposition(nodes: DataFrame, edges: DataFrame, roots: DataFrame, path: str) -> None:
    """Decomposition tables as lines that :func:`read_decomposition` reads: nodes, edges and roots of all stages."""
    listed = lambda c: F.array_join(c, ",")
    stage = F.concat(F.lit("stage="), F.col("stage"))
    # A piece of the first stage has two empty places after its number.
    number = F.concat(F.lit("idx="), listed("path"), F.when(F.col("stage") == 0, ",,").otherwise(""))
    n = nodes.select(F.concat_ws("\t", stage, F.lit("type=N"), number, F.concat(F.lit("set="), listed("members"), F.lit(","))).alias("value"))
    cut = F.concat(F.lit("cut="), listed("cut"), F.when(F.col("stage") > 1, ",").otherwise(""))
    e = edges.select(F.concat_ws("\t", stage, F.lit("type=E"), F.concat(F.lit("idx1="), listed("a")), F.concat(F.lit("idx2="), listed("b")), cut).alias("value"))
    r = roots.select(F.concat_ws("\t", stage, F.lit("type=R"), F.concat(F.lit("idx="), listed("path"))).alias("value"))
    n.union(e).union(r).write.mode("overwrite").text(path)


def member_edges(nodes: DataFrame, stage: int = 1) -> DataFrame:
    """(a, b, cut): pieces (paths) of one stage and one parent that share members, with those, found from the sets alone."""
    sets = nodes.where(F.col("stage") == stage).select("path", F.slice("path", 1, stage).alias("parent"), F.explode("members").alias("node"))
    a, b = sets.withColumnRenamed("path", "a"), sets.withColumnRenamed("path", "b")
    return a.join(b, ["parent", "node"]).where("a < b").groupBy("a", "b").agg(F.sort_array(F.collect_list("node")).alias("cut"))


def write_solution(rows: DataFrame, path: str) -> None:
    """Rows of ``schemas.SOLUTION`` as lines that :func:`read_previous_solution` reads."""
    write_table(rows.select(schemas.SOLUTION.names), path)


def write_matching_lines(spark: SparkSession, source: str, pairs: DataFrame, path: str) -> None:
    """Lines of a bundle file whose first two fields are one of ``pairs`` (lo, hi: strings) in either order, byte for byte."""
    f = F.split("value", "\t")
    keyed = spark.read.text(source).select("value", F.least(f[0], f[1]).alias("lo"), F.greatest(f[0], f[1]).alias("hi"))
    keyed.join(pairs.select("lo", "hi").distinct(), ["lo", "hi"], "left_semi").select("value").write.mode("overwrite").text(path)


def sort_agp(agp: DataFrame) -> DataFrame:
    """Scaffold rows by name and place, numbered anew in this order by ``line_no`` from 0."""
    from ..operators.paths import with_rank

    return with_rank(agp.drop("line_no"), ["scaf_name", "scaf_idx"]).withColumnRenamed("rank", "line_no").select("line_no", *(c for c in agp.columns if c != "line_no"))

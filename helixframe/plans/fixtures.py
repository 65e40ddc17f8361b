"""Contigs, links, bundles and scaffold paths derived from the driver's tables, in SQL that runs on Spark and DuckDB alike.

Two parts of one order are a read-pair link between two contigs; an order is a
scaffold and its lines are the contigs on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTIGS = """
SELECT CAST(p_partkey AS BIGINT) AS node_idx, concat('ctg_', CAST(p_partkey AS STRING)) AS ctg_name, CAST(200 + p_size AS BIGINT) AS ctg_width,
       CAST(p_partkey % 2 AS BIGINT) AS ctg_orien, CAST(0 AS BIGINT) AS ctg_order, CAST(0 AS BIGINT) AS invalid
FROM {part}
"""

LINKS = """
WITH p AS (
  SELECT a.l_orderkey AS ok, a.l_partkey AS pa, b.l_partkey AS pb, CAST(a.l_quantity AS BIGINT) AS qa, CAST(b.l_quantity AS BIGINT) AS qb,
         CASE WHEN a.l_linestatus = 'O' THEN 1 ELSE 0 END AS oa, CASE WHEN b.l_linestatus = 'O' THEN 1 ELSE 0 END AS ob,
         CASE WHEN a.l_returnflag = 'R' AND b.l_returnflag = 'R' THEN 1 ELSE 0 END AS bad
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
s AS (
  SELECT CASE WHEN ok % 2 = 0 THEN pa ELSE pb END AS a, CASE WHEN ok % 2 = 0 THEN pb ELSE pa END AS b,
         CASE WHEN ok % 2 = 0 THEN qa ELSE qb END AS x, CASE WHEN ok % 2 = 0 THEN qb ELSE qa END AS y,
         CASE WHEN ok % 2 = 0 THEN oa ELSE ob END AS ao, CASE WHEN ok % 2 = 0 THEN ob ELSE oa END AS bo, bad, ok FROM p)
SELECT a AS ctg_a_idx, b AS ctg_b_idx, x AS read_a_left_pos, x + 100 AS read_a_right_pos, y AS read_b_left_pos, y + 100 AS read_b_right_pos,
       CAST(ao AS BIGINT) AS read_a_orien, CAST(bo AS BIGINT) AS read_b_orien, CAST(400 + ok % 200 AS BIGINT) AS insert_size,
       CAST(CASE WHEN a < b THEN 2 * ao + bo WHEN ao = 1 AND bo = 1 THEN 0 WHEN ao = 0 AND bo = 0 THEN 3 ELSE 2 * ao + bo END AS BIGINT) AS implied_state,
       CAST(250 AS BIGINT) AS std_dev, CAST(bad AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS used, CAST(ok AS BIGINT) AS order_key
FROM s
"""

BUNDLES = """
SELECT least(ctg_a_idx, ctg_b_idx) AS ctg_a_idx, greatest(ctg_a_idx, ctg_b_idx) AS ctg_b_idx,
       CAST(sum(CASE WHEN implied_state = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS WT_A, CAST(sum(CASE WHEN implied_state = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS WT_B,
       CAST(sum(CASE WHEN implied_state = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS WT_C, CAST(sum(CASE WHEN implied_state = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS WT_D
FROM ({links}) WHERE invalid <> 1 GROUP BY least(ctg_a_idx, ctg_b_idx), greatest(ctg_a_idx, ctg_b_idx) HAVING count(*) >= {least}
"""

#: Links between contigs of one region: 64 orders in a row, {contigs} contigs.  However large the tables are, regions are as
#: dense, so graphs over them keep their shape and only get more.
REGION_LINKS = """
SELECT a AS ctg_a_idx, b AS ctg_b_idx, read_a_left_pos, read_a_right_pos, read_b_left_pos, read_b_right_pos, read_a_orien, read_b_orien, insert_size,
       CAST(CASE WHEN a < b THEN 2 * read_a_orien + read_b_orien WHEN read_a_orien = 1 AND read_b_orien = 1 THEN 0
                 WHEN read_a_orien = 0 AND read_b_orien = 0 THEN 3 ELSE 2 * read_a_orien + read_b_orien END AS BIGINT) AS implied_state, std_dev, invalid, used, order_key
FROM (SELECT *, order_key - order_key % 64 + ctg_a_idx % {contigs} AS a, order_key - order_key % 64 + ctg_b_idx % {contigs} AS b FROM ({links})) WHERE a <> b
"""

#: Orientations by the second bit of the contig, states the heavier of those that fit, directions as they follow.
SOLVED = """
SELECT u, v, orien_a, orien_b, state, CAST(CASE WHEN state = 2 * orien_a + orien_b THEN 1 ELSE 0 END AS BIGINT) AS X, CAST(CASE WHEN state = 3 - 2 * orien_a - orien_b THEN 1 ELSE 0 END AS BIGINT) AS Y
FROM (SELECT u, v, orien_a, orien_b, CAST(CASE WHEN orien_a = orien_b THEN CASE WHEN WT_A >= WT_D THEN 0 ELSE 3 END ELSE CASE WHEN WT_B >= WT_C THEN 1 ELSE 2 END END AS BIGINT) AS state
      FROM (SELECT ctg_a_idx AS u, ctg_b_idx AS v, CAST(CASE WHEN ctg_a_idx % 4 > 1 THEN 1 ELSE 0 END AS BIGINT) AS orien_a, CAST(CASE WHEN ctg_b_idx % 4 > 1 THEN 1 ELSE 0 END AS BIGINT) AS orien_b,
                   WT_A, WT_B, WT_C, WT_D FROM ({bundles})))
"""

#: {key}: columns besides, in front; {order}: what a scaffold's contigs are ordered by; {gap}: the gap before one.
PATHS = """
SELECT {key}concat('scaf_', CAST(l_orderkey AS STRING)) AS scaf_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS BIGINT) AS pos,
       concat('c', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS comp_name,
       CAST(100 + l_quantity AS BIGINT) AS size, {gap} AS gap, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS orien
FROM {lineitem}
"""
_TRUE = {"order": "l_linenumber, l_partkey, l_suppkey, l_shipdate", "gap": "CAST(round(l_discount * 100) AS BIGINT) - 2"}
_TEST = {"order": "l_shipdate, l_partkey, l_suppkey, l_linenumber", "gap": "CAST(round(l_tax * 100) AS BIGINT)"}


def views(part: str, lineitem: str) -> dict[str, str]:
    """SQL of each view over two named tables; bundles3 and bundles2 have at least 3 and 2 links.

    ``regions`` and ``dense`` are bundles of 3 links between 64 and 40 contigs a region; ``solved`` and
    ``region_solved`` are solutions by rule of bundles2 and regions; ``dense_solved`` one of dense.
    """
    links = LINKS.format(lineitem=lineitem)
    region_links, dense_links = (REGION_LINKS.format(links=links, contigs=n) for n in (64, 40))
    regions, bundles2 = BUNDLES.format(links=region_links, least=3), BUNDLES.format(links=links, least=2)
    return {
        "region_links": region_links, "regions": regions, "dense": BUNDLES.format(links=dense_links, least=3),
        "solved": SOLVED.format(bundles=bundles2), "region_solved": SOLVED.format(bundles=regions),
        "dense_solved": SOLVED.format(bundles=BUNDLES.format(links=dense_links, least=3)),
        "contigs": CONTIGS.format(part=part), "links": links,
        "bundles3": BUNDLES.format(links=links, least=3), "bundles2": BUNDLES.format(links=links, least=2),
        "path_ref": PATHS.format(lineitem=lineitem, key="", **_TRUE), "path_test": PATHS.format(lineitem=lineitem, key="", **_TEST),
    }


#: Bytes of Parquet of line items for each task of links; a line item takes about 18, and makes two links.
_TASK_BYTES = 4 << 20


def link_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks work on links takes, so that a task's rows stay as many however large the table of line items is."""
    path = f"{sf_dir}/lineitem.parquet"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame.

    Links come from line items dealt by order into as many tasks as their size
    asks for: a line item is small in a shuffle and becomes several links, so
    that what is read says little about what a task holds.
    """
    table = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    lineitem = table("lineitem")
    if name in ("contigs", "path_ref", "path_test"):
        return spark.sql(views(table("part"), lineitem)[name])
    tasks = link_tasks(spark, sf_dir)
    dealt = f"(SELECT /*+ REPARTITION({tasks}, l_orderkey) */ l_orderkey, l_partkey, l_quantity, l_linestatus, l_returnflag FROM {lineitem})"
    return spark.sql(views(table("part"), dealt)[name])


def keyed_paths(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of paths with ``scaf_key``, a number for each scaffold, by which its rows are dealt; they are names only after that shuffle."""
    made = {"path_ref": _TRUE, "path_test": _TEST}[name]
    needed = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus, l_shipdate"
    dealt = f"(SELECT /*+ REPARTITION({link_tasks(spark, sf_dir)}, l_orderkey) */ {needed} FROM parquet.`{sf_dir}/lineitem.parquet`)"
    return spark.sql(PATHS.format(lineitem=dealt, key="l_orderkey AS scaf_key, ", **made))


def ordered_paths(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As :func:`keyed_paths`, dealt by ranges of names: ``scaf_key`` is the scaffold's number as text, so that names stand in its order, from partition to partition."""
    made = {"path_ref": _TRUE, "path_test": _TEST}[name]
    needed = "CAST(l_orderkey AS STRING) AS l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_linestatus, l_shipdate"
    dealt = f"(SELECT /*+ REPARTITION_BY_RANGE({link_tasks(spark, sf_dir)}, l_orderkey) */ * FROM (SELECT {needed} FROM parquet.`{sf_dir}/lineitem.parquet`))"
    return spark.sql(PATHS.format(lineitem=dealt, key="l_orderkey AS scaf_key, ", **made))


def both_paths(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The reference and the test paths as :func:`keyed_paths`, for queries that need both: of the same line items, which such a query shuffles once.

    Discount and tax travel as one array, so that the shuffle has the same
    columns whichever of them a side reads, and Spark takes one for the other.
    """
    needed = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_shipdate"
    dealt = f"(SELECT /*+ REPARTITION({link_tasks(spark, sf_dir)}, l_orderkey) */ {needed}, array(l_discount, l_tax) AS rates FROM parquet.`{sf_dir}/lineitem.parquet`)"
    told = f"(SELECT {needed}, rates[0] AS l_discount, rates[1] AS l_tax FROM {dealt})"
    return [spark.sql(PATHS.format(lineitem=told, key="l_orderkey AS scaf_key, ", **made)) for made in (_TRUE, _TEST)]


def solved(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """As the views of solutions, from bundles that are there already."""
    return spark.sql(SOLVED.format(bundles="SELECT * FROM {bundles}"), bundles=bundles)

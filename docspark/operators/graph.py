"""Graphs as a vertex and an edge DataFrame: neighbours, shortest paths, cycles.

Iterative operators run one join a round over the frontier only, and cut the
lineage with ``checkpoint`` in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side of a join is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: The same for nodes with a number each, if nodes are numbers.
BROADCAST_NODES = 1_000_000
#: Rows that one task sorts or groups.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where none is set and all run in this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``most`` rows (it should be a written or checkpointed table: it is counted)."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` partitioned by keys, in so many partitions that a task has about ``TASK_ROWS`` of its rows at most (else it is counted)."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-(df.count() if rows is None else rows) // TASK_ROWS)), *keys)


def unique_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge a pair: the one of the greatest ``order``, or any."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    if order is None:
        return edges.dropDuplicates(["src", "dst"])
    out = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), order).alias("_e"))
    return out.select("src", "dst", "_e.*")


def with_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with those that only edges name."""
    named = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return vertices.unionByName(named.join(vertices, "id", "left_anti"), allowMissingColumns=True)


def neighbours(edges: DataFrame, vertices: DataFrame, node, label: str | None = None) -> DataFrame:
    """Vertices one edge away, of a label if given."""
    out = edges.where(F.col("src") == F.lit(node))
    if label is not None:
        out = out.where(F.col("label") == label)
    return vertices.join(out.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def shortest_paths(edges: DataFrame, source, *, weight: str = "weight", max_rounds: int = 100) -> DataFrame:
    """(node, distance, path) of every node that can be reached; weights are positive.

    Bellman-Ford rounds from a frontier of improved nodes; ties go to the path that sorts first.  Edges are reduced once
    and stay where they are while a frontier is small enough to be broadcast.  A round first finds the least distances,
    then the paths of these only, so no path is carried along every edge.
    """
    spark = edges.sparkSession
    steps = written(spread(edges, "src", "dst").groupBy("src", "dst").agg(F.min(weight).cast("double").alias("w")), "steps")
    kind = edges.schema["src"].dataType
    start = F.lit(source).cast(kind)
    best = spark.range(1).select(start.alias("node"), F.lit(0.0).alias("distance"), F.array(start).alias("path"))
    best = frontier = checkpointed(best)
    for _ in range(max_rounds):
        tails = sized(frontier.toDF("src", "_distance", "_path"))
        moves = steps.join(tails, "src").select(F.col("dst").alias("node"), (F.col("_distance") + F.col("w")).alias("d"), "_path")
        least = moves.groupBy("node").agg(F.min("d").alias("least")).join(best.select("node", "distance"), "node", "left")
        least = checkpointed(least.where(F.col("distance").isNull() & F.col("least").isNotNull() | (F.col("least") < F.col("distance"))).select("node", "least"))
        if least.isEmpty():
            return best
        reached = moves.join(sized(least), "node").where(F.col("d") == F.col("least")).groupBy("node").agg(F.min("d").alias("_d"), F.min(F.concat("_path", F.array("node"))).alias("_p"))
        frontier = checkpointed(reached.toDF("node", "distance", "path"))
        merged = best.join(frontier.toDF("node", "_d", "_p"), "node", "full")
        best = checkpointed(merged.select("node", F.coalesce("_d", "distance").alias("distance"), F.coalesce("_p", "path").alias("path")))
    raise RuntimeError(f"shortest paths not settled in {max_rounds} rounds")


def shortest_path(edges: DataFrame, source, target, **options) -> DataFrame:
    """The row of one target; no row if it can't be reached."""
    return shortest_paths(edges, source, **options).where(F.col("node") == F.lit(target))


def reachable(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(src, dst) pairs joined by a path of one edge or more."""
    steps = edges.select("src", "dst").distinct()
    known = fresh = checkpointed(steps)
    for _ in range(max_rounds):
        longer = fresh.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh = checkpointed(longer.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = checkpointed(known.union(fresh))
    raise RuntimeError(f"reachability not settled in {max_rounds} rounds")


def nodes_in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves; edges to self are ignored.

    They are those of the strongly connected components of two nodes or more, found by colouring: every node takes the
    greatest node that reaches it, and of each colour the nodes that reach its namesake are a component.  Components
    of all colours are found at once and taken out until no edge is left, so no pairs of nodes are kept, only a row a node.
    Every round takes a component of each colour out, so the rounds end by themselves.
    """
    left = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    most = BROADCAST_NODES if isinstance(left.schema["src"].dataType, T.NumericType) else BROADCAST_ROWS
    found = left.select(F.col("src").alias("node")).limit(0)
    while not left.isEmpty():
        colour = checkpointed(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("colour")))
        while True:
            into = left.join(sized(colour, most), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_new"))
            step = checkpointed(colour.join(into, "node", "left").select("node", F.greatest("colour", "_new").alias("colour"), (F.coalesce("_new", "colour") > F.col("colour")).alias("_moved")))
            colour = step.drop("_moved")
            if step.where("_moved").isEmpty():
                break
        tails, heads = sized(colour.toDF("src", "colour"), most), sized(colour.toDF("dst", "_colour"), most)
        within = written(left.join(tails, "src").join(heads, "dst").where(F.col("colour") == F.col("_colour")).select("src", "dst"), "edges")
        back = fresh = checkpointed(colour.where("node = colour").select("node"))
        while not fresh.isEmpty():
            fresh = checkpointed(within.join(sized(fresh, most), F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).distinct().join(back, "node", "left_anti"))
            back = checkpointed(back.union(fresh))
        tails, heads = sized(back.toDF("src"), most), sized(back.toDF("dst"), most)
        cyclic = within.join(tails, "src", "left_semi").join(heads, "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        found = checkpointed(found.union(cyclic))
        left = written(within.join(tails, "src", "left_anti").join(heads, "dst", "left_anti"), "edges")
    return found

"""Reading the graph: snapshots, neighbourhoods, paths. Loops cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampType

from ..plans.durable import cut

HOPS = 5


def valid_at(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Both bounds belong to the interval; a missing one is open."""
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) >= t))


def snapshot(entities: DataFrame, relations: DataFrame, t: Column) -> tuple[DataFrame, DataFrame]:
    """The relations valid at t and the entities on them."""
    kept = relations.where(valid_at(t))
    ends = kept.select(F.explode(F.array("src_id", "tgt_id")).alias("name")).distinct()
    return entities.join(ends, "name", "left_semi"), kept


#: Levels of pieces of time: the span of the snapshots has 2**LEVELS smallest ones.
LEVELS = 14


def _place(t: Column, kind: DataType) -> Column:
    """A number that grows with time, in seconds or finer, whatever the session's time zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(t)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, DateType):
        return days
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def at_snapshots(relations: DataFrame, snapshots: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Relations at each of many times, snapshot_at: an equi-join of pieces of time.

    The span of the snapshots is halved LEVELS times. A relation's interval is cut into the fewest pieces of any level, two a level at most, and a
    snapshot belongs to one piece a level, so a pair meets once at most; then the bounds are compared as they are. Bounds are inclusive, a
    missing one is open. Null snapshots meet nothing; a snapshot that is listed twice gives its rows twice.
    """
    kind = snapshots.schema["snapshot_at"].dataType
    row = snapshots.agg(F.min(_place(F.col("snapshot_at"), kind)).alias("lo"), F.max(_place(F.col("snapshot_at"), kind)).alias("hi")).first()
    if row["lo"] is None:
        return relations.crossJoin(snapshots.where("false"))
    unit = (row["hi"] - row["lo"]) // (1 << LEVELS) + 1
    piece = lambda t: F.floor((t - row["lo"]) / F.lit(unit)).cast("long")
    of = lambda c: _place(F.col(c), relations.schema[c].dataType)
    lo = F.greatest(F.coalesce(of(start), F.lit(row["lo"])), F.lit(row["lo"]))
    hi = F.least(F.coalesce(of(end), F.lit(row["hi"])), F.lit(row["hi"]))
    # Bounds of a level's pieces: the first that lies inside, and the first beyond.
    held = relations.withColumns({"_lo": piece(lo), "_hi": piece(hi) + 1}).where(F.col("_lo") < F.col("_hi"))

    def pieces(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(F.col("_lo") / size).cast("long"), F.floor(F.col("_hi") / size).cast("long")
        one = lambda here, n: F.when((a < b) & here, F.struct(level.alias("level"), n.alias("piece")))
        return F.array(one(a % 2 == 1, a), one(b % 2 == 1, b - 1))

    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    held = held.withColumn("_piece", F.explode(F.array_compact(F.flatten(F.transform(levels, pieces))))).drop("_lo", "_hi")
    at = piece(_place(F.col("snapshot_at"), kind))
    each = snapshots.where("snapshot_at is not null").withColumn("_piece", F.explode(F.transform(levels, lambda n: F.struct(n.alias("level"), F.floor(at / F.pow(F.lit(2.0), n)).cast("long").alias("piece")))))
    return held.join(each, "_piece").drop("_piece").where(valid_at(F.col("snapshot_at"), start, end))


def both_ways(relations: DataFrame) -> DataFrame:
    """src, dst of each edge in both directions, once."""
    return relations.select(F.explode(F.array(F.struct(F.col("src_id").alias("src"), F.col("tgt_id").alias("dst")), F.struct(F.col("tgt_id").alias("src"), F.col("src_id").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()


def neighbors(relations: DataFrame, names: DataFrame) -> DataFrame:
    """name, neighbor of the named nodes: their edges are sought before any are told apart."""
    own = names.select("name").distinct()
    side = lambda a, b: relations.select(F.col(a).alias("name"), F.col(b).alias("neighbor")).join(own, "name", "left_semi")
    return side("src_id", "tgt_id").unionByName(side("tgt_id", "src_id")).where("name <> neighbor").distinct()


def reach(relations: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """name, depth: nodes at most `hops` edges from a start, at their least depth. A round joins the last frontier only."""
    edges = cut(both_ways(relations))
    seen = cut(starts.select("name").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        found = frontier.select(F.col("name").alias("src")).join(edges, "src").select(F.col("dst").alias("name")).distinct()
        frontier = cut(found.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def subgraph(entities: DataFrame, relations: DataFrame, starts: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within `hops` and all edges among them."""
    near = reach(relations, starts, hops)
    inside = near.select("name")
    edges = relations.join(inside, F.col("src_id") == F.col("name"), "left_semi").join(inside, F.col("tgt_id") == F.col("name"), "left_semi")
    return entities.join(near, "name"), edges


def neighborhood(relations: DataFrame, starts: DataFrame, hops: int, t: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes by depth, and the edges of nodes nearer than `hops`, optionally as of t."""
    valid = relations.where(valid_at(t)) if t is not None else relations
    near = reach(valid, starts, hops)
    inner = near.where(F.col("depth") < hops).select("name")
    return near.orderBy("depth", "name"), _touching(valid, inner)


def _touching(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with an end among the names: two equi-joins rather than one on either end."""
    by_src = relations.join(names, F.col("src_id") == F.col("name"), "left_semi")
    by_tgt = relations.join(names, F.col("tgt_id") == F.col("name"), "left_semi").join(names, F.col("src_id") == F.col("name"), "left_anti")
    return by_src.unionByName(by_tgt)


def shortest_path(relations: DataFrame, pairs: DataFrame, hops: int = HOPS, t: Column | None = None) -> DataFrame:
    """start, goal, path: for each pair the fewest edges, of equal paths the one whose names sort first; no row beyond `hops`.

    Each frontier row holds the least path to its node, so a round's rows are at most nodes a start.
    """
    edges = cut(both_ways(relations.where(valid_at(t)) if t is not None else relations))
    starts = pairs.select("start").distinct()
    seen = cut(starts.select("start", F.col("start").alias("name"), F.array("start").alias("path")))
    frontier = seen
    for _ in range(hops):
        step = frontier.join(edges, F.col("name") == F.col("src")).select("start", F.col("dst").alias("name"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("start", "name").agg(F.min("path").alias("path"))
        frontier = cut(step.join(seen.select("start", "name"), ["start", "name"], "left_anti"))
        if not frontier.take(1):
            break
        seen = cut(seen.unionByName(frontier))
    return pairs.join(seen.withColumnRenamed("name", "goal"), ["start", "goal"]).select("start", "goal", "path")

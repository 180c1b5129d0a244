"""Traffic monitoring: positions are matched to roads, and each road keeps a running speed without outliers."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geo import KM_PER_DEGREE, cell_key, metres, segment_distance
from weftline.operators.loops import keyed_scan
from weftline.operators.nodes import in_box, running

#: Bounding boxes (south, north, west, east), a road's width, how far off it a position may be, the window.
BEIJING = (39.689602, 40.122410, 116.105789, 116.670021)
DUBLIN = (53.28006, 53.406071, -6.381911, -6.141994)
ROAD_WIDTH = 5.0
REACH = sqrt(5.0**2 + 10.0**2)
WINDOW = 1000
#: Rows of (segment, square) up to this number are broadcast (some sixty bytes each); more are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000
#: The side of a square by which points and segments meet, in degrees.
SQUARE = 0.001


def grid(segments: DataFrame, drop_first: bool = True) -> DataFrame:
    """Segments (road_id, file_order, ord, x1, y1, x2, y2) with the ``cell`` of their road.

    A road belongs to the cell of the point midway between its first and last vertex. With ``drop_first`` the first road
    of each cell is lost, as it is where a cell is created without storing the road that made it.
    """
    ends = segments.groupBy("road_id", "file_order").agg(F.min_by(F.struct("x1", "y1"), "ord").alias("a"), F.max_by(F.struct("x2", "y2"), "ord").alias("b"))
    placed = ends.select(F.col("road_id").alias("_road"), F.col("file_order").alias("_file"), cell_key((F.col("a.y1") + F.col("b.y2")) / 2, (F.col("a.x1") + F.col("b.x2")) / 2).alias("cell"))
    if drop_first:
        first = placed.groupBy("cell").agg(F.min("_file").alias("_lost"))
        placed = placed.join(first, "cell").where(F.col("_file") > F.col("_lost")).drop("_lost")
    return segments.join(placed, (F.col("road_id") == F.col("_road")) & (F.col("file_order") == F.col("_file"))).drop("_road", "_file")


def _squares(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The squares of SQUARE degrees that lie within reach of a segment, as (sx, sy): column by column, so that their
    number grows with the segment's length."""
    room = F.lit(REACH / 1000 / KM_PER_DEGREE * 1.001)
    index = lambda v: F.floor(v / SQUARE).cast("int")
    dx, dy = x2 - x1, y2 - y1

    def part(edge: Column) -> Column:
        """Where on the segment, 0 to 1, its x is ``edge``."""
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (edge - x1) / dx))

    def column(i: Column) -> Column:
        a, b = part(i * SQUARE - room), part((i + 1) * SQUARE + room)
        upright = F.abs(dx) < 1e-12
        ya, yb = F.when(upright, y1).otherwise(y1 + a * dy), F.when(upright, y2).otherwise(y1 + b * dy)
        rows = F.sequence(index(F.least(ya, yb) - room), index(F.greatest(ya, yb) + room))
        return F.transform(rows, lambda j: F.struct(i.alias("sx"), j.alias("sy")))

    return F.flatten(F.transform(F.sequence(index(F.least(x1, x2) - room), index(F.greatest(x1, x2) + room)), column))


def match(points: DataFrame, cells: DataFrame, key: str = "event_id", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """``points`` with ``road_id``: the first road in file order nearer than half its width, else the nearest within reach, else -1.

    A point is held against the segments of its own cell that come near its square of some hundred metres; squares are
    joined, so neither a city's cell nor a long road makes a hot key.
    """
    roads = cells.select(F.col("cell").alias("_cell"), F.col("road_id").alias("_road"), "file_order", "x1", "y1", "x2", "y2", F.explode(_squares(*map(F.col, ("x1", "y1", "x2", "y2")))).alias("_s")).select("*", "_s.sx", "_s.sy").drop("_s")
    small = roads.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS
    at = points.select(F.col(key).alias("_key"), F.col(x).alias("_x"), F.col(y).alias("_y"), cell_key(F.col(y), F.col(x)).alias("_at"), F.floor(F.col(x) / SQUARE).cast("int").alias("_sx"), F.floor(F.col(y) / SQUARE).cast("int").alias("_sy"))
    near = at.join(F.broadcast(roads) if small else roads, (F.col("_sx") == F.col("sx")) & (F.col("_sy") == F.col("sy")) & (F.col("_at") == F.col("_cell")))
    near = near.withColumn("d", metres(segment_distance(F.col("_x"), F.col("_y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))).where(F.col("d") < REACH)
    best = near.groupBy("_key").agg(
        F.min_by("_road", F.when(F.col("d") < ROAD_WIDTH / 2, F.col("file_order"))).alias("hit"),
        F.min_by("_road", F.struct("d", "file_order")).alias("nearest"),
    )
    return points.join(best, points[key] == best["_key"], "left").select(*points.columns, F.coalesce("hit", "nearest", F.lit(-1)).cast("long").alias("road_id"))


@dataclass
class RoadSpeed:
    """A road's state. ``corrected`` mends what ``reference`` mode keeps: evicted speeds stay in the sum of squares, and
    the average and deviation have one added after, not before, the division."""

    window: int = WINDOW
    corrected: bool = False
    speeds: deque = field(default_factory=deque)
    total: float = 0.0
    squares: float = 0.0
    average: float = 0.0

    def add(self, speed: float) -> float:
        n = len(self.speeds)
        if not n:
            self._take(speed)
            self.average = speed
            return self.average
        if n > self.window - 1:
            old = self.speeds.popleft()
            self.total -= old
            self.squares -= old * old if self.corrected else 0.0
            n -= 1
        if n <= 1:
            self._take(speed)
            self.average = self.total / len(self.speeds)
            return self.average
        if self.corrected:
            mean = (self.total + speed) / (n + 1)
            spread = max(0.0, (self.squares + speed * speed) / (n + 1) - mean * mean)
        else:
            mean = (self.total + speed) / n + 1
            spread = ((self.squares + speed * speed) - (n + 1) * mean * mean) / n + 1
        if spread >= 0 and abs(speed - mean) <= 2 * sqrt(spread):
            self._take(speed)
            self.average = mean
        return self.average

    def _take(self, speed: float) -> None:
        self.speeds.append(speed)
        self.total += speed
        self.squares += speed * speed


def speeds(tuples: DataFrame, key: str = "road_id", order: str = "event_id", speed: str = "speed", window: int = WINDOW, corrected: bool = False) -> DataFrame:
    """(key, order, average): the road's average after each tuple, in the order of ``order`` within a road.

    Whether a speed counts depends on all before it, so a road's tuples go through one state, one after another. They are
    sorted on the JVM, which may spill, and streamed through: memory holds one window, however many tuples a road has.
    """
    rows = tuples.select(F.col(key).cast("long").alias("road"), F.col(order).cast("long").alias("at"), F.col(speed).cast("double").alias("speed"))
    return keyed_scan(rows, "road", "at", ["speed"], lambda: RoadSpeed(window, corrected), lambda state, row: state.add(row[0]), "average double")


def tuples(records: DataFrame, key: str, order: str, x: str, y: str, speed: str | None) -> DataFrame:
    """Records of any form as (key, order, latitude, longitude, speed); forms without a speed, as buses send, have 0.0."""
    value = F.col(speed).cast("double") if speed else F.lit(0.0)
    return records.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(y).cast("double").alias("latitude"), F.col(x).cast("double").alias("longitude"), value.alias("speed"))


def monitor(points: DataFrame, segments: DataFrame, box: tuple[float, float, float, float] = BEIJING, corrected: bool = False, order: str = "event_id") -> DataFrame:
    """(road_id, n, last_average): positions in the box, matched to roads; per road how many and the last average."""
    matched = match(points.where(in_box("latitude", "longitude", "speed", box)), grid(segments), order).where("road_id <> -1")
    return speeds(matched, order=order, corrected=corrected).groupBy(F.col("key").alias("road_id")).agg(F.count("*").alias("n"), F.round(F.max_by("average", "ord"), 6).alias("last_average"))


def recent_average(df: DataFrame, key: str, order: str, value: str, rows: int, chunk: int = 1 << 20) -> DataFrame:
    """``df`` with ``avg_recent``: the mean over the key's last ``rows`` items, this one included.

    A key's items are numbered, in blocks, and dealt out in chunks of ``chunk``; each chunk also gets the last items of the
    one before it, so a key of any size is no single task's.
    """
    placed = running(df, key, order, chunk, _place=F.lit(1).cast("long"))
    at = F.floor((F.col("_place") - 1) / chunk)
    more = F.when(F.pmod(F.col("_place") - 1, F.lit(chunk)) >= chunk - (rows - 1), F.array(at, at + 1)).otherwise(F.array(at))
    dealt = placed.withColumn("_chunk", F.explode(more)).withColumn("_own", F.col("_chunk") == at)
    mean = F.avg(value).over(Window.partitionBy(key, "_chunk").orderBy("_place").rowsBetween(1 - rows, 0))
    return dealt.withColumn("avg_recent", mean).where("_own").drop("_place", "_chunk", "_own")

"""Loops of stencil and reduction over grids held as (i, j, v) rows or lines held as (j, v) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.iterate import cut

Neighbours = dict[tuple[int, int], Column]


def neighbourhood(grid: DataFrame, offsets: list[tuple[int, int]], tile: int = 64, carry: list[str] | None = None) -> DataFrame:
    """``grid`` with a column ``n_{di}_{dj}`` for the value at each offset, null beyond the border.

    A cell goes to its tile of ``tile`` by ``tile`` cells and, if it lies at the tile's edge, to the tiles that read it
    there: little more than one row a cell is shuffled, by tile. Inside a tile cells meet in one aggregation, which needs
    no other shuffle, and no join for each offset.
    """
    carry = carry or []
    own = offsets.index((0, 0)) if (0, 0) in offsets else None
    if own is None:
        raise ValueError("the cell itself must be among the offsets")
    tile_of = lambda c, d: F.floor((F.col(c) - d) / tile).cast("int")
    readers = F.array_distinct(F.array(*[F.struct(tile_of("i", di).alias("ti"), tile_of("j", dj).alias("tj")) for di, dj in offsets]))
    dealt = grid.select("i", "j", "v", *carry, F.explode(readers).alias("t")).select("t.ti", "t.tj", "i", "j", "v", *carry).repartition("ti", "tj")
    targets = F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(offsets)])
    inside = F.filter(targets, lambda t: (F.floor(t["i"] / tile) == F.col("ti")) & (F.floor(t["j"] / tile) == F.col("tj")))
    sent = dealt.select("ti", "tj", "v", *carry, F.explode(inside).alias("t")).select("ti", "tj", "t.i", "t.j", "t.k", "v", *carry)
    cells = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(_name(o)) for k, o in enumerate(offsets)]
    kept = [F.max(F.when(F.col("k") == own, F.col(c))).alias(c) for c in carry]
    return sent.groupBy("ti", "tj", "i", "j").agg(*cells, *kept, F.max(F.when(F.col("k") == own, F.lit(1))).alias("_in")).where("_in = 1").drop("_in", "ti", "tj")


def _name(offset: tuple[int, int]) -> str:
    return f"n_{offset[0]}_{offset[1]}".replace("-", "m")


def at(di: int, dj: int) -> Column:
    return F.col(_name((di, dj)))


BOX = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def loop(
    grid: DataFrame,
    compute: Column,
    offsets: list[tuple[int, int]],
    reduce: Column | None = None,
    identity: float | int = 0,
    combine: Callable = lambda a, b: a + b,
    go_on: Callable[[object, int], bool] = lambda value, done: True,
    most: int = 1,
    carry_reduce: bool = False,
    within: Column | None = None,
    carry: list[str] | None = None,
    reduce_input: bool = False,
    before: Callable[[DataFrame], DataFrame] = lambda g: g,
    after: Callable[[DataFrame], DataFrame] = lambda g: g,
    start: Callable[[DataFrame], DataFrame] = lambda g: g,
    end: Callable[[DataFrame], DataFrame] = lambda g: g,
    check_every: int = 8,
) -> tuple[DataFrame, object, int]:
    """(grid, reduced value, sweeps): sweeps while fewer than ``most`` are done and ``go_on(value, sweeps)`` holds.

    A sweep applies ``before``, computes every cell (those ``within`` only; the others keep the value of the generation
    before the last, as two buffers swap), reduces the output (or, with ``reduce_input``, what it was computed from) and
    applies ``after``; ``start`` and ``end`` are applied once, before and after all sweeps. With ``carry_reduce`` values accumulate over the sweeps; without, each starts at the identity.
    The one reduced row is all that comes to the driver. Lineage is cut every ``check_every`` sweeps.
    """
    grid = start(grid)
    columns, value, done = grid.columns, identity, 0
    older = grid
    while done < most:
        now = before(grid)
        near = neighbourhood(now, offsets, carry=carry)
        if within is None:
            new = near.select("i", "j", compute.alias("v"), *(carry or []))
        else:
            old = older.select("i", "j", F.col("v").alias("_old"))
            new = near.join(old, ["i", "j"]).select("i", "j", F.when(within, compute).otherwise(F.col("_old")).alias("v"), *(carry or []))
        if reduce is not None or done % check_every == check_every - 1 or within is not None:
            new = cut(new.select(*columns))
        if reduce is not None:
            got = (now if reduce_input else new).agg(reduce.alias("r")).first()["r"]
            got = identity if got is None else got
            value = combine(value if carry_reduce else identity, got)
        older, grid, done = grid, after(new), done + 1
        if not go_on(value, done):
            break
    return end(grid), value, done


def life(v: Column, alive: Column) -> Column:
    """Birth on three neighbours, survival on two or three."""
    return F.when((alive == 3) | ((v == 1) & (alive == 2)), 1).otherwise(0)


def life_step() -> Column:
    ring = [F.coalesce(at(a, b), F.lit(0)) for a, b in BOX if (a, b) != (0, 0)]
    return life(at(0, 0), sum(ring[1:], ring[0])).cast("int")


def box_step() -> Column:
    """The 3 by 3 sum with zeros beyond the border, divided by nine as integers."""
    total = " + ".join(f"coalesce({_name(o)}, 0)" for o in BOX)
    return F.expr(f"cast(({total}) div 9 as int)")


def sobel_step(rows: int, cols: int) -> Column:
    """The gradient's size by absolute sums, at most 255; zero on the border of a square image."""
    gx = at(-1, -1) + 2 * at(0, -1) + at(1, -1) - at(-1, 1) - 2 * at(0, 1) - at(1, 1)
    gy = at(-1, -1) + 2 * at(-1, 0) + at(-1, 1) - at(1, -1) - 2 * at(1, 0) - at(1, 1)
    edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == rows - 1) | (F.col("j") == cols - 1)
    return F.when(edge, 0).otherwise(F.least(F.lit(255), F.abs(gx) + F.abs(gy))).cast("int")


def helmholtz_step(ax: float, ay: float, b: float, omega: float) -> Column:
    """One relaxation of interior cells with right-hand side ``f`` carried beside the grid; border cells keep their value."""
    inner = at(-1, 0).isNotNull() & at(1, 0).isNotNull() & at(0, -1).isNotNull() & at(0, 1).isNotNull()
    residual = (ax * (at(-1, 0) + at(1, 0)) + ay * (at(0, -1) + at(0, 1)) + b * at(0, 0) - F.col("f")) / b
    return F.when(inner, at(0, 0) - omega * residual).otherwise(at(0, 0))

"""Tables of pages from ruling lines and words that lie between them.

Lines, cells and words meet on a grid of square tiles: each is dealt to the tiles that
it touches, and a crossing point or the middle of a word lies in exactly one, so that
each pair that meets is found once, by equal keys. Lines, crossings and cells are each
used twice and so written to the shared folder between, lest plans double at every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import merged_lines
from ledgerloom.sources.shared import kept

#: Lines that are closer than this are one; so far a line may end from one that it meets.
SNAP = 3.0
#: Side of a tile.
TILE = 64.0
PAGE = ["doc", "page"]
CELL = [*PAGE, "tbl", "row", "col"]


def _tiles(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / TILE), F.floor(high / TILE))


def merged_rulings(rulings: DataFrame, snap: float = SNAP) -> DataFrame:
    """doc, page, level, at, low, high: the horizontal (level) and vertical lines of pages, from
    segments (doc, page, x0, top, x1, bottom) whose ends may be in any order. Neighbours
    that lie within snap are moved to their mean; then those of a place that overlap or
    leave a gap of up to twice snap are one. Slanting segments are left out."""
    flat, upright = F.abs(F.col("bottom") - F.col("top")) <= snap, F.abs(F.col("x1") - F.col("x0")) <= snap
    ends = lambda a, b: (F.least(a, b).cast("double").alias("low"), F.greatest(a, b).cast("double").alias("high"))
    across = rulings.where(flat & (F.abs(F.col("x1") - F.col("x0")) > snap)).select(*PAGE, F.lit(True).alias("level"), ((F.col("top") + F.col("bottom")) / 2.0).alias("at"), *ends("x0", "x1"))
    down = rulings.where(upright & (F.abs(F.col("bottom") - F.col("top")) > snap)).select(*PAGE, F.lit(False).alias("level"), ((F.col("x0") + F.col("x1")) / 2.0).alias("at"), *ends("top", "bottom"))
    by = [*PAGE, "level"]
    near = Window.partitionBy(*by).orderBy("at")
    far = F.when(F.col("at") - F.lag("at").over(near) <= snap, 0).otherwise(1)
    placed = across.unionByName(down).withColumn("__far", far).withColumn("__place", F.sum("__far").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    # The middle of the outermost ones doesn't depend on the order of rows, as a mean would.
    whole = Window.partitionBy(*by, "__place")
    moved = placed.withColumn("at", (F.min("at").over(whole) + F.max("at").over(whole)) / 2.0)
    along = Window.partitionBy(*by, "at").orderBy("low", "high")
    apart = F.when(F.col("low") - F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)) <= 2 * snap, 0).otherwise(1)
    pieces = moved.withColumn("__apart", apart).withColumn("__line", F.sum("__apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(*by, "at", "__line").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("__line")


def ruled_cells(rulings: DataFrame, snap: float = SNAP) -> DataFrame:
    """doc, page, tbl, row, col (from 0), x0, top, x1, bottom of the cells that ruling lines close.

    From a crossing whose lines go on to the right and down, a cell reaches to the next
    crossing of its upper line from which a line goes down, and to the next of its left
    line from which one goes right; it counts if lines come back from the corner across.
    So a merged cell is one cell. Rows and columns are numbered by where cells begin.
    Cells whose heights touch or overlap are of one table: tables beside one another are
    one, with the columns of both.
    """
    lines = kept(merged_rulings(rulings, snap), "lines")
    tile = F.floor(F.col("at") / TILE)
    across = lines.where("level").select(*PAGE, F.col("at").alias("y"), F.col("low").alias("left"), F.col("high").alias("right"), tile.alias("__ty"), F.explode(_tiles(F.col("low") - snap, F.col("high") + snap)).alias("__tx"))
    down = lines.where("NOT level").select(*PAGE, F.col("at").alias("x"), F.col("low").alias("upper"), F.col("high").alias("lower"), tile.alias("__tx"), F.explode(_tiles(F.col("low") - snap, F.col("high") + snap)).alias("__ty"))
    meet = F.col("x").between(F.col("left") - snap, F.col("right") + snap) & F.col("y").between(F.col("upper") - snap, F.col("lower") + snap)
    flags = {"goes_right": F.col("right") > F.col("x") + snap, "goes_left": F.col("left") < F.col("x") - snap, "goes_down": F.col("lower") > F.col("y") + snap, "goes_up": F.col("upper") < F.col("y") - snap}
    points = kept(across.join(down, [*PAGE, "__tx", "__ty"]).where(meet).select(*PAGE, "x", "y", "left", "upper", *(f.alias(n) for n, f in flags.items())), "points")
    # Growing frames over descending places: the nearest further one is the last.
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    on_line, on_side = Window.partitionBy(*PAGE, "y", "left").orderBy(F.desc("x")), Window.partitionBy(*PAGE, "x", "upper").orderBy(F.desc("y"))
    beyond = F.last(F.when(F.col("goes_down"), F.struct("x", "upper")), ignorenulls=True).over(before(on_line))
    below = F.last(F.when(F.col("goes_right"), F.struct("y", "left")), ignorenulls=True).over(before(on_side))
    corners = points.withColumn("__beyond", beyond).withColumn("__below", below).where("goes_right AND goes_down AND __beyond IS NOT NULL AND __below IS NOT NULL")
    cells = corners.select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("top"), F.col("__beyond.x").alias("x1"), F.col("__below.y").alias("bottom"), F.col("__beyond.upper").alias("__upper"), F.col("__below.left").alias("__left"))
    across_it = points.where("goes_left AND goes_up").select(*PAGE, F.col("x").alias("x1"), F.col("y").alias("bottom"), F.col("upper").alias("__upper"), F.col("left").alias("__left"))
    closed = cells.join(across_it, [*PAGE, "x1", "bottom", "__upper", "__left"], "left_semi")
    order = Window.partitionBy(*PAGE).orderBy("top", "x0", "bottom")
    apart = F.when(F.col("top") <= F.max("bottom").over(before(order)), 0).otherwise(1)
    tabled = closed.withColumn("__apart", apart).withColumn("tbl", (F.sum("__apart").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    within = Window.partitionBy(*PAGE, "tbl")
    return tabled.select(*PAGE, "tbl", (F.dense_rank().over(within.orderBy("top")) - 1).alias("row"), (F.dense_rank().over(within.orderBy("x0")) - 1).alias("col"), "x0", "top", "x1", "bottom")


def cell_texts(words: DataFrame, cells: DataFrame) -> DataFrame:
    """cells with the text of the words (doc, page, x0, top, x1, bottom, text) whose middle
    lies in each, its left and upper edge included: lines by height, joined by line
    breaks, words of a line by blanks. A cell without words is empty; a word in a cell
    that lies in another belongs to both, one outside of all to none."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    placed = words.where("text IS NOT NULL").select(*PAGE, F.col("x0").alias("__left"), F.rint("top").alias("__top"), "text", middle("x0", "x1").alias("__x"), middle("top", "bottom").alias("__y"))
    placed = placed.withColumns({"__tx": F.floor(F.col("__x") / TILE), "__ty": F.floor(F.col("__y") / TILE)})
    tiled = cells.select("*", F.explode(_tiles(F.col("x0"), F.col("x1"))).alias("__tx")).select("*", F.explode(_tiles(F.col("top"), F.col("bottom"))).alias("__ty"))
    inside = (F.col("__x") >= F.col("x0")) & (F.col("__x") < F.col("x1")) & (F.col("__y") >= F.col("top")) & (F.col("__y") < F.col("bottom"))
    held = tiled.join(placed, [*PAGE, "__tx", "__ty"]).where(inside).select(*CELL, "__left", "__top", "text")
    lines = merged_lines(held, CELL, "__top", "text", "__left")
    texts = lines.groupBy(*CELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return cells.join(texts, CELL, "left").withColumn("text", F.coalesce("text", F.lit("")))


def ruled_tables(words: DataFrame, rulings: DataFrame, snap: float = SNAP) -> DataFrame:
    """doc, page, tbl, top, rows of the tables that ruling lines draw, as ``section_rows`` takes
    them: an array of rows, each with a text for every column of the table, null where no
    cell begins."""
    cells = cell_texts(words, kept(ruled_cells(rulings, snap), "cells"))
    wide = cells.withColumn("__cols", F.max("col").over(Window.partitionBy(*PAGE, "tbl")))
    rows = wide.groupBy(*PAGE, "tbl", "row", "__cols").agg(F.min("top").alias("top"), F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("__by"))
    filled = rows.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("__cols")), lambda c: F.try_element_at(F.col("__by"), c)))
    listed = F.array_sort(F.collect_list(F.struct("row", "cells")))
    return filled.groupBy(*PAGE, "tbl").agg(F.min("top").alias("top"), F.transform(listed, lambda r: r["cells"]).alias("rows"))

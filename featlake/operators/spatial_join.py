"""Many boxes against one feature table: a grid join with exact tests, without a cross join.

Every box lives on one of a few grid levels, the finest on which it spans at most a few cell edges
(two for a feature, four for a request), so it covers at most nine or 25 cells there. A pair of
boxes meets on the coarser of the two levels: there that box is listed with its own cells and the
other one with the cells above it. The pair is kept only in the cell that holds the lower-left
corner of the intersection, so it comes out exactly once and no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators import geometry as G

_ORIGIN = -180.0
# Cell edges in degrees, each a quarter of the one before: from the whole circle to less than a metre.
DEGREE_LEVELS = tuple(360.0 / 4**k for k in range(14))
# Most cell edges that a box spans on its own level. Requests are fewer than features: they take smaller
# cells, where they meet fewer features that they do not touch.
_SPAN, _ASKED_SPAN = 2, 4
# Tag a: the request is on its own level, the feature on that level or a finer one.
# Tag b: the feature is on its own level, the request on a strictly finer one.
_TAGS = ("a", "b")


def _cell(value: Column, edge: Column) -> Column:
    return F.floor((value - _ORIGIN) / edge).cast("bigint")


def _level(box: dict[str, Column], levels: tuple[float, ...], span: int) -> Column:
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    level = F.lit(0)
    for i, edge in enumerate(levels):
        if i:
            level = F.when(extent <= edge * span, i).otherwise(level)
    return level


def _keyed(
    df: DataFrame, prefix: str, levels: tuple[float, ...], span: int, wanted: Callable[[Column, int, bool], Column]
) -> DataFrame:
    """Repeat rows per (level, tag) that is wanted for them, and per cell covered on that level.

    ``wanted`` says of a row's own level, a level and whether the tag is a if the row needs it. ``_key``
    numbers level, tag and cell; ``_first`` says if the cell is the row's first in x (1) and in y (2).
    """
    box = {b: F.col(f"{prefix}{b}") for b in G.BOUNDS}
    # Plain expressions: an array that is filtered by a lambda takes microseconds a row.
    codes = [
        F.when(wanted(F.col("_own"), i, tag == "a"), i * len(_TAGS) + k) for i in range(len(levels)) for k, tag in enumerate(_TAGS)
    ]
    rows = df.withColumn("_own", _level(box, levels, span)).withColumn("_code", F.explode(F.array(*codes)))
    edge = F.get(F.array(*[F.lit(e) for e in levels]), F.floor(F.col("_code") / len(_TAGS)).cast("int"))
    rows = rows.where("_code IS NOT NULL").withColumn("_edge", edge)
    low = {f"_{c}0": _cell(box[f"{c}min"], F.col("_edge")) for c in "xy"}
    high = {f"_{c}1": _cell(box[f"{c}max"], F.col("_edge")) for c in "xy"}
    rows = rows.withColumns(low | high)
    for c in "xy":
        # Bounds the wrong way round are their first cell.
        rows = rows.withColumn(f"_c{c}", F.explode(F.sequence(f"_{c}0", F.greatest(f"_{c}0", f"_{c}1"))))
    # Cells of equal numbers are so far apart that boxes on their own level or a coarser one do not overlap.
    low_bits = (len(_TAGS) * len(levels) - 1).bit_length()
    bits = (64 - low_bits) // 2
    x, y = (F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) for c in ("_cx", "_cy"))
    key = F.shiftleft(x, bits + low_bits).bitwiseOR(F.shiftleft(y, low_bits)).bitwiseOR(F.col("_code").cast("bigint"))
    first = F.when(F.col("_cx") == F.col("_x0"), 1).otherwise(0) + F.when(F.col("_cy") == F.col("_y0"), 2).otherwise(0)
    rows = rows.withColumns({"_key": key, f"_{prefix}first": first.cast("tinyint")})
    return rows.select(*df.columns, "_key", f"_{prefix}first")


def _too_large_to_broadcast(boxes: DataFrame) -> bool:
    """Whether requests, each listed for a dozen cells, should be shuffled.

    Spark's size of a table does not know of the rows that ``explode`` adds, and is that of compressed
    files, so it would broadcast listings of many times the size it allows.
    """
    limit = boxes.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(boxes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * 3 > limit


def join_boxes(
    features: DataFrame,
    boxes: DataFrame,
    exact: Column | None = None,
    levels: tuple[float, ...] = DEGREE_LEVELS,
) -> DataFrame:
    """Pairs of features and request boxes that intersect.

    ``features`` carries xmin..ymax, ``boxes`` carries q_xmin..q_ymax; no other names may be
    shared. ``exact`` refines the bounds test with columns of both. Rows without bounds never
    match. Small boxes are broadcast, by a third of Spark's own limit; beyond it, both sides are plain
    shuffles, and adaptive execution splits a crowded cell by its measured size. A small box lies on
    a level of small cells, so it meets no more of a crowded place than about its own surroundings.

    Most of the work is on pairs of one cell, so they are tested by comparisons of stored numbers
    first. An ``exact`` with a lambda keeps Spark from compiling the join.
    """
    f = features.where(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())
    q = boxes.where(F.col("q_xmin").isNotNull() & (F.col("q_xmin") <= F.col("q_xmax")))
    q = q.where(F.col("q_ymin") <= F.col("q_ymax"))
    # The few levels the requests live on as bits, so that features list no cells nobody asks for.
    asked = _level({b: F.col(f"q_{b}") for b in G.BOUNDS}, levels, _ASKED_SPAN)
    used = q.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), asked))).scalar()

    def of_feature(own: Column, level: int, is_a: bool) -> Column:
        if is_a:
            return (own >= level) & (F.col("_used").bitwiseAND(F.lit(1 << level)) != 0)
        return (own == level) & (F.shiftright("_used", level + 1) != 0)

    def of_request(own: Column, level: int, is_a: bool) -> Column:
        return own == level if is_a else own > level

    f = _keyed(f.withColumn("_used", used), "", levels, _SPAN, of_feature).drop("_used")
    q = _keyed(q, "q_", levels, _ASKED_SPAN, of_request)
    if _too_large_to_broadcast(boxes):
        q = q.hint("merge")
    # The corner's cell is the first in x of one of the two, and the first in y of one of them.
    once = F.col("_first").bitwiseOR(F.col("_q_first")) == F.lit(3).cast("tinyint")
    overlap = G.bounds_overlap({b: F.col(b) for b in G.BOUNDS}, {b: F.col(f"q_{b}") for b in G.BOUNDS})
    kept = f.join(q, "_key").where(overlap & once)
    if exact is not None:
        kept = kept.where(exact)
    return kept.drop("_key", "_first", "_q_first")

"""Operators over consecutive observations of an entity.

An entity's rows are never sorted in one piece.  Time is cut into chunks of
fixed length and neighbours are found inside (entity, chunk).  That one windowed
pass is written down; what crosses a chunk border is read back from the last row
of each chunk, and only the first rows of chunks are joined with it.  So the
input is read once and its rows are shuffled once.  A feed that sends a third of
all rows is spread over as many tasks as it has chunks, and the cut is a pure
function of the row, so a lost task recomputes the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions.quality import track_label, track_rank
from fairlead.functions.timeline import MICROS
from fairlead.operators.windows import assign_windows, prune_to_windows
from fairlead.schema import FREIGHT_TYPES
from fairlead.session import stage

CHUNK_SECONDS = 86_400
_ORDER = ["observed_at", "observation_id"]


def _chunk(seconds: int, at: str = "observed_at") -> Column:
    return F.floor(F.unix_micros(at) / F.lit(seconds * MICROS))


def _within(keys: list[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy(*_ORDER)


def _across(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk")


def _filled(rows: DataFrame, handed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose ``name`` is null take it from ``handed`` (keys, _chunk, name); the others are not joined at all."""
    missing = F.col(name).isNull()
    return rows.filter(~missing).unionByName(
        rows.filter(missing).drop(name).join(handed.select(*keys, "_chunk", name), [*keys, "_chunk"], "left")
    )


def with_previous(df: DataFrame, keys: list[str], carry: list[str], chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add ``prev``: a struct of the ``carry`` columns of the preceding row of the same keys.

    All columns of ``df`` are written down once: select the needed ones before.
    """
    within, carried = _within(keys), F.struct(*carry)
    rows = stage(
        df.withColumn("_chunk", _chunk(chunk_seconds)).select(
            "*", F.lag(carried).over(within).alias("prev"), F.lead(F.lit(True)).over(within).isNull().alias("_tail")
        ),
        "neighbours",
    )
    handed = rows.filter("_tail").select(*keys, "_chunk", F.lag(carried).over(_across(keys)).alias("prev"))
    return _filled(rows, handed, keys, "prev").drop("_tail", "_chunk")


def segment_rows(
    df: DataFrame, keys: list[str], carry: list[str], max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``prev``, ``_us``, ``_chunk``, ``_pos`` and ``_own_start``, and the start that each chunk inherits.

    A gap strictly above the limit starts a segment.  ``_own_start`` is the time of the
    segment's first row where that lies in the row's own chunk behind another row; where it
    is null the segment starts at the chunk's ``_start`` (second table: keys, _chunk,
    _start).  Aggregates over segments group by both first and look up the start of the
    few pieces afterwards; see ``of_segments``.  ``_pos`` numbers the rows of the keys in
    their order.  ``carry`` must have observed_at.
    """
    if not max_gap_seconds > 0:
        raise ValueError("max_gap_seconds must be positive")
    gap = F.lit(int(max_gap_seconds * MICROS))
    within, across = _within(keys), _across(keys)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.struct(*carry, "_us")
    linked = df.withColumn("_us", F.unix_micros("observed_at")).withColumn("_chunk", _chunk(chunk_seconds)).select(
        "*", F.lag(carried).over(within).alias("prev"), F.lead(F.lit(True)).over(within).isNull().alias("_tail"),
        F.first("_us").over(upto).alias("_first_us"),
        F.shiftleft(F.col("_chunk"), 32).bitwiseOR(F.row_number().over(within).cast("bigint")).alias("_pos"),
    )
    starts = F.when(F.col("_us") - F.col("prev._us") > gap, F.col("_us"))
    rows = stage(linked.withColumn("_own_start", F.last(starts, ignorenulls=True).over(upto)), "segment-rows")
    tails = rows.filter("_tail").select(
        *keys, "_chunk", "_first_us", "_own_start", F.lag(carried).over(across).alias("prev"),
    ).withColumn("_opens", F.col("prev").isNull() | (F.col("_first_us") - F.col("prev._us") > gap))
    last_start = F.coalesce("_own_start", F.when(F.col("_opens"), F.col("_first_us")))
    inherited = F.last(last_start, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    borders = tails.select(*keys, "_chunk", "prev", F.when(F.col("_opens"), F.col("_first_us")).otherwise(inherited).alias("_start"))
    return _filled(rows, borders, keys, "prev").drop("_tail", "_first_us"), borders.drop("prev")


def of_segments(pieces: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (keys, _chunk, _own_start, ...) with ``segment_start_us``."""
    return pieces.join(borders, [*keys, "_chunk"], "left").withColumn(
        "segment_start_us", F.coalesce("_own_start", "_start")
    ).drop("_chunk", "_own_start", "_start")


def with_segments(
    df: DataFrame, keys: list[str], carry: list[str], max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Add ``prev`` and ``segment_start_us`` to every row.

    ``segment_start_us`` (time of the segment's first row) identifies a segment of
    the keys: two segments are always more than the gap apart.
    """
    rows, borders = segment_rows(df, keys, carry, max_gap_seconds, chunk_seconds)
    return of_segments(rows, borders, keys).drop("_us", "_pos")


def longest_first(count: Column, start_us: Column) -> Column:
    """Orders segments by their rows, the earlier one higher on a tie; of fixed width, so that maxima hash-aggregate."""
    return count.cast("decimal(20,0)") * F.lit(10 ** 17).cast("decimal(18,0)") - start_us.cast("decimal(20,0)")


def track_segments(obs: DataFrame, max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Tracks: runs of an entity's observations without a gap above the limit."""
    rows, borders = segment_rows(
        obs.select("entity_id", *_ORDER, "source_state"), ["entity_id"], ["observed_at"], max_gap_seconds, chunk_seconds
    )
    step = F.col("_us") - F.col("prev._us")
    pieces = rows.groupBy("entity_id", "_chunk", "_own_start").agg(
        F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count("*").alias("n"),
        F.max(F.when(step <= int(max_gap_seconds * MICROS), step).otherwise(0)).alias("gap"),
        F.max(track_rank(F.col("source_state"))).alias("rank"),
    )
    return (
        of_segments(pieces, borders, ["entity_id"]).groupBy("entity_id", "segment_start_us")
        .agg(
            F.min("start_at").alias("start_at"),
            F.max("end_at").alias("end_at"),
            F.sum("n").alias("observed_points"),
            (F.max("gap") / F.lit(float(MICROS))).alias("largest_gap_seconds"),
            track_label(F.max("rank")).alias("source_state"),
        )
        .withColumn("interpolated_points", F.lit(0))
        .withColumn("track_id", F.concat("entity_id", F.lit("@"), F.col("segment_start_us").cast("string")))
        .drop("segment_start_us")
    )


def track_points(obs: DataFrame, max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Lineage of the tracks as rows: which observation belongs to which track."""
    rows = with_segments(obs.select("entity_id", *_ORDER), ["entity_id"], ["observed_at"], max_gap_seconds, chunk_seconds)
    return rows.select(
        F.concat("entity_id", F.lit("@"), F.col("segment_start_us").cast("string")).alias("track_id"),
        "entity_id", *_ORDER,
    )


def entity_classifications(obs: DataFrame, keys: list[str] | None = None,
                           chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """The last row decides an entity's type; type changes along the way are counted.

    Both come from one row per (entity, chunk): its last type, its first type and the
    number of changes inside it.
    """
    group = [*(keys or []), "entity_id"]
    within, across = _within(group), _across(group)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fields = ["entity_type", "classification", "observation_id"]
    chunked = obs.select(*group, *_ORDER, "entity_type", "classification").withColumn("_chunk", _chunk(chunk_seconds))
    changed = (F.lag("entity_type").over(within) != F.col("entity_type")).cast("int")
    marked = chunked.select(
        *group, "_chunk", *_ORDER, "entity_type", "classification", changed.alias("_changed"),
        F.first("entity_type").over(upto).alias("_first_type"), F.lead(F.lit(True)).over(within).isNull().alias("_tail"),
    )
    tails = marked.withColumn("_changes", F.sum("_changed").over(upto)).filter("_tail").select(
        *group, "_chunk", *fields, "_first_type", F.coalesce("_changes", F.lit(0)).alias("_changes")
    )
    linked = tails.select(
        "*", (F.lag("entity_type").over(across) != F.col("_first_type")).cast("int").alias("_crossed"),
        F.lead(F.lit(True)).over(across).isNull().alias("_last"),
    )
    counts = Window.partitionBy(*group)
    total = F.sum(F.col("_changes") + F.coalesce("_crossed", F.lit(0))).over(counts)
    return linked.withColumn("classification_changes", total).filter("_last").select(
        *group, "entity_type", (F.col("classification") == "confirmed").alias("reliable"),
        F.col("observation_id").alias("decided_by"), "classification_changes",
    )


def cohorts(classified: DataFrame, allowlist: list[str] = FREIGHT_TYPES) -> DataFrame:
    """Each classified entity with its bucket; members stay rows."""
    return classified.withColumn(
        "bucket",
        F.when(~F.col("reliable"), "unclassified").when(F.col("entity_type").isin(allowlist), "freight").otherwise("other"),
    )


def crossing_flags(rows: DataFrame, max_gap_seconds: float, floor: Column | None = None) -> DataFrame:
    """Mark boundary crossings between consecutive rows: ``entry``, ``exit`` or ``uncertain``.

    Needs ``prev.inside`` and ``prev.observed_at``.  With ``floor`` (a window start)
    a predecessor before it does not count: the first row never crosses.
    """
    flips = F.col("prev").isNotNull() & (F.col("prev.inside") != F.col("inside"))
    if floor is not None:
        flips = flips & (F.col("prev.observed_at") >= floor)
    gap = F.unix_micros("observed_at") - F.unix_micros("prev.observed_at")
    return rows.withColumn(
        "crossing",
        F.when(~flips | F.col("prev").isNull(), F.lit(None).cast("string"))
        .when(gap > F.lit(int(max_gap_seconds * MICROS)), "uncertain")
        .when(F.col("inside"), "entry")
        .otherwise("exit"),
    )


def entry_exit(
    flagged: DataFrame, wins: DataFrame, keys: list[str], max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Entries, exits and uncertain crossings per key and window.

    ``flagged``: observations with ``inside``.  Neighbours are found once, before
    the rows fan out to overlapping windows.
    """
    if not max_gap_seconds > 0:
        raise ValueError("max_gap_seconds must be positive")
    bounded = prune_to_windows(flagged, wins).select(*keys, "entity_id", *_ORDER, "inside")
    rows = with_previous(bounded, [*keys, "entity_id"], ["observed_at", "inside"], chunk_seconds)
    # Only rows whose flag differs from the predecessor's can cross: filter before the fan-out.
    candidates = rows.filter(F.col("prev").isNotNull() & (F.col("prev.inside") != F.col("inside")))
    marked = crossing_flags(assign_windows(candidates, wins), max_gap_seconds, F.col("start_at"))
    return marked.groupBy(*keys, "window_id").agg(
        F.count_if(F.col("crossing") == "entry").alias("entries"),
        F.count_if(F.col("crossing") == "exit").alias("exits"),
        F.count_if(F.col("crossing") == "uncertain").alias("uncertain"),
    )


def visits(
    rows: DataFrame, wins: DataFrame, keys: list[str], max_gap_seconds: float, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Visits of entities per window: in-scope rows split on gaps above the limit.

    Rows are segmented once over all time; a window is an interval, so clipping a
    segment to it gives the window's visit.
    """
    group = [*keys, "entity_id"]
    inside = prune_to_windows(rows, wins).select(*group, *_ORDER)
    linked, borders = segment_rows(inside, group, ["observed_at"], max_gap_seconds, chunk_seconds)
    step = F.col("_us") - F.col("prev._us")
    inner = (step <= int(max_gap_seconds * MICROS)) & (F.col("prev.observed_at") >= F.col("start_at"))
    pieces = assign_windows(linked, wins).groupBy(*group, "window_id", "_chunk", "_own_start").agg(
        F.count("*").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"),
        F.max(F.when(inner, step).otherwise(0)).alias("gap"),
    )
    return of_segments(pieces, borders, group).groupBy(*keys, "window_id", "entity_id", "segment_start_us").agg(
        F.sum("n").alias("observation_count"),
        F.min("first").alias("first_inside_at"),
        F.max("last").alias("last_inside_at"),
        F.max("gap").alias("largest_gap_us"),
    )


def dwell_per_entity(
    rows: DataFrame,
    wins: DataFrame,
    keys: list[str],
    membership: Column | None = None,
    min_observations: int = 2,
    max_gap_seconds: float = 3600,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Longest visit (most rows, earliest on a tie) of each entity per window.

    ``membership`` is any boolean Column over the observation row, a pandas UDF
    included; without it every row is in scope.
    """
    if min_observations < 1:
        raise ValueError("min_observations must be at least 1")
    in_scope = rows if membership is None else rows.filter(membership)
    per_visit = visits(in_scope, wins, keys, max_gap_seconds, chunk_seconds)
    order = longest_first(F.col("observation_count"), F.col("segment_start_us"))
    names = ["first_inside_at", "last_inside_at", "observation_count", "largest_gap_us"]
    best = per_visit.withColumn("_order", order).groupBy(*keys, "window_id", "entity_id").agg(
        *[F.max_by(name, "_order").alias(name) for name in names]
    )
    return (
        best.filter(F.col("observation_count") >= min_observations)
        .select(
            *keys, "window_id", "entity_id", "first_inside_at", "last_inside_at",
            (F.unix_micros("last_inside_at") - F.unix_micros("first_inside_at")).alias("dwell_us"),
            "observation_count",
            (F.col("largest_gap_us") / F.lit(float(MICROS))).alias("largest_gap_seconds"),
        )
        .withColumn("dwell_seconds", F.col("dwell_us") / F.lit(float(MICROS)))
    )


def asof_classification(frames: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Give each position report the type of the latest static report that arrived before it.

    ``frames``: mmsi, arrival_seq, received_at, kind ("static" or "position"),
    entity_type, classification (static rows).  A later unknown static overwrites.
    """
    order = ["received_at", "arrival_seq"]
    within = Window.partitionBy("mmsi", "_chunk").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    static = F.when(F.col("kind") == "static", F.struct("entity_type", "classification"))
    rows = stage(
        frames.withColumn("_chunk", _chunk(chunk_seconds, "received_at")).select(
            "*", F.last(static, ignorenulls=True).over(upto).alias("_known"), F.lead(F.lit(True)).over(within).isNull().alias("_tail")
        ),
        "typed-frames",
    )
    earlier = _across(["mmsi"]).rowsBetween(Window.unboundedPreceding, -1)
    handed = rows.filter("_tail").select("mmsi", "_chunk", F.last("_known", ignorenulls=True).over(earlier).alias("_known"))
    return (
        _filled(rows.filter(F.col("kind") == "position"), handed, ["mmsi"], "_known")
        .withColumn("entity_type", F.coalesce(F.col("_known.entity_type"), F.lit("unknown")))
        .withColumn("classification", F.coalesce(F.col("_known.classification"), F.lit("unknown")))
        .drop("_known", "_tail", "_chunk", "kind")
    )

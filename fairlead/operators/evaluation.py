"""Scoring detected events against labels."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fairlead.functions.timeline import MICROS
from fairlead.session import stage


_ITEM = (
    "event_type string, scope string, chunk bigint, kind int, at_us bigint, seq bigint, item_id string, "
    "holder_seq bigint, holder_id string, holder_at bigint, past_distance bigint, past_seq bigint, past_id string"
)
# Kinds of rows that a chunk sees: its own detections, those of its neighbours near the border, labels that are open.
_OWN, _NEAR, _OPEN = 0, 1, 2


def _next_free(links: list[int], i: int) -> int:
    """First position from ``i`` on that is not closed, with path compression."""
    root = i
    while links[root] != root:
        root = links[root]
    while links[i] != root:
        links[i], i = root, links[i]
    return root


def _propose(pdf: pd.DataFrame, limit_us: int, chunk_us: int) -> pd.DataFrame:
    """One chunk until none of its labels is open: labels ask the nearest detection that no earlier label holds.

    Labels are taken in their order, so a detection asked in this round is closed to all that
    follow.  A later label that loses its detection is open again and goes on behind it.  A
    label whose next detection lies in another chunk is sent there.
    """
    detections, labels = pdf[pdf["kind"] != _OPEN], pdf[pdf["kind"] == _OPEN]
    times, seqs, ids = (detections[c].tolist() for c in ("at_us", "seq", "item_id"))
    own = (detections["kind"] == _OWN).tolist()
    taken = detections["holder_id"].notna().tolist()
    holders = [
        (seq, name, at) if t else None
        for t, seq, name, at in zip(taken, *(detections[c].tolist() for c in ("holder_seq", "holder_id", "holder_at")))
    ]
    n = len(times)
    # Two orders, away from a label to either side; equal instants by the order of the detections.
    after = sorted(range(n), key=lambda i: (times[i], seqs[i], ids[i]))
    before = sorted(range(n), key=lambda i: (-times[i], seqs[i], ids[i]))
    sides = []
    for order, sign in ((after, 1), (before, -1)):
        place = [0] * n
        for k, i in enumerate(order):
            place[i] = k
        sides.append((order, sign, [sign * times[i] for i in order], place, list(range(n + 1))))

    def close(i: int) -> None:
        for _, _, _, place, links in sides:
            links[place[i]] = place[i] + 1

    held = sorted((h[:2], i) for i, h in enumerate(holders) if h)
    closing = 0
    waiting = [
        (seq, name, at, (distance, past_seq, past_id))
        for seq, name, at, distance, past_seq, past_id in zip(
            *(labels[c].tolist() for c in ("seq", "item_id", "at_us", "past_distance", "past_seq", "past_id"))
        )
    ]
    heapq.heapify(waiting)
    sent = []
    while waiting:
        seq, name, at, past = heapq.heappop(waiting)
        while closing < len(held) and held[closing][0] < (seq, name):
            close(held[closing][1])
            closing += 1
        best = None
        for order, sign, instants, _, links in sides:
            # The label's own instant belongs to the side after it.
            start = max(past[0], 0 if sign > 0 else 1)
            k = _next_free(links, bisect.bisect_left(instants, sign * at + start))
            while k < n:
                i = order[k]
                option = (abs(times[i] - at), seqs[i], ids[i])
                if option > past:
                    best = min(best, (option, i)) if best else (option, i)
                    break
                k = _next_free(links, k + 1)
        if best is None or best[0][0] > limit_us:
            continue
        i = best[1]
        if not own[i]:
            sent.append((times[i] // chunk_us, at, seq, name, *past))
            continue
        lost = holders[i]
        holders[i] = (seq, name, at)
        close(i)
        if lost:
            heapq.heappush(waiting, (*lost, (abs(times[i] - lost[2]), seqs[i], ids[i])))
    event_type, scope, chunk = (pdf[c].iloc[0] for c in ("event_type", "scope", "chunk"))
    rows = [
        (event_type, scope, chunk, _OWN, times[i], seqs[i], ids[i], *(holders[i] or (0, None, 0)), -1, 0, "")
        for i in range(n) if own[i]
    ] + [
        (event_type, scope, to, _OPEN, at, seq, name, 0, None, 0, distance, past_seq, past_id)
        for to, at, seq, name, distance, past_seq, past_id in sent
    ]
    return pd.DataFrame(rows, columns=list(pdf.columns))


def _deferred_matches(items: DataFrame, keys: list[str], limit_us: int, chunk_us: int) -> DataFrame:
    """Matches of the items by rounds over time chunks, until no label is open.

    Labels have one order for all detections, so there is one stable matching: the greedy
    one in label order.  Proposals may therefore be made in any order, and chunks work side
    by side; a detection keeps the earliest label that asked.  A round reads only chunks that
    labels were sent to.
    """
    # A label sent to a chunk sees both its neighbours as far as it can reach.
    halo = 2 * limit_us
    chunk_us = max(chunk_us, halo, 1)
    none = F.lit(None).cast("string")
    laid = items.select(
        *keys, F.floor(F.col("at_us") / F.lit(chunk_us)).alias("chunk"), F.when(F.col("is_label"), _OPEN).otherwise(_OWN).alias("kind"),
        "at_us", "seq", "item_id", F.lit(0).cast("bigint").alias("holder_seq"), none.alias("holder_id"), F.lit(0).cast("bigint").alias("holder_at"),
        F.lit(-1).cast("bigint").alias("past_distance"), F.lit(0).cast("bigint").alias("past_seq"), F.lit("").alias("past_id"),
    )
    laid = stage(laid, "contested-items")
    state, waiting = laid.filter(F.col("kind") == _OWN), laid.filter(F.col("kind") == _OPEN)
    into = F.col("at_us") - F.col("chunk") * chunk_us
    sides = F.array_compact(F.array(
        F.when(into < halo, F.col("chunk") - 1), F.when(into >= chunk_us - halo, F.col("chunk") + 1)
    ))
    group = [*keys, "chunk"]
    while not waiting.isEmpty():
        asked = waiting.select(*group).distinct()
        near = state.withColumn("chunk", F.explode(sides)).withColumn("kind", F.lit(_NEAR))
        seen = state.unionByName(near).join(asked, group, "left_semi").unionByName(waiting)
        done = stage(
            seen.select(*state.columns).groupBy(*group).applyInPandas(lambda pdf: _propose(pdf, limit_us, chunk_us), _ITEM), "label-round"
        )
        waiting = done.filter(F.col("kind") == _OPEN)
        untouched = state.join(asked, group, "left_anti")
        state = stage(untouched.unionByName(done.filter(F.col("kind") == _OWN)), "label-holders")
    return state.filter("holder_id is not null").select(
        F.col("holder_id").alias("label_id"), F.col("item_id").alias("detection_id"), F.abs(F.col("at_us") - F.col("holder_at")).alias("distance_us")
    )


def match_labels(
    labels: DataFrame, detections: DataFrame, match_window_seconds: int = 3600, chunk_seconds: int = 86_400
) -> DataFrame:
    """One-to-one matches (label_id, detection_id, distance_us).

    ``labels``: label_id, event_type, scope, onset_at, label_seq.
    ``detections``: detection_id, event_type, scope, detected_at, detection_seq.

    A label can only meet a detection inside the match window, so each (type,
    scope) timeline is first cut wherever two neighbours are further apart than
    the window.  The clusters are independent.  Those with a choice are matched in rounds over
    time chunks of ``chunk_seconds`` (at least twice the match window): a cluster of any
    length spreads over its chunks, and the result does not depend on the chunks.  One task
    holds the items of one chunk of one (type, scope); a shorter chunk makes that less.
    Items without an id, type, scope or instant match nothing; one without a number comes last.
    """
    limit = match_window_seconds * MICROS
    keys = ["event_type", "scope"]
    last = F.lit((1 << 63) - 1)
    items = labels.select(
        *keys, F.unix_micros("onset_at").alias("at_us"), F.lit(True).alias("is_label"),
        F.col("label_id").alias("item_id"), F.coalesce(F.col("label_seq").cast("bigint"), last).alias("seq"),
    ).unionByName(
        detections.select(
            *keys, F.unix_micros("detected_at").alias("at_us"), F.lit(False).alias("is_label"),
            F.col("detection_id").alias("item_id"), F.coalesce(F.col("detection_seq").cast("bigint"), last).alias("seq"),
        )
    ).filter("item_id is not null")
    # Read by the sizes, by the contested items and again by the single matches of the result.
    clustered = stage(_clusters(items, keys, limit), "clustered-items")
    cluster = [*keys, "_cluster"]
    label = F.col("is_label")
    sizes = clustered.groupBy(*cluster).agg(
        F.count_if(label).alias("_l"), F.count_if(~label).alias("_d"),
        F.max(F.when(label, F.col("item_id"))).alias("label_id"),
        F.max(F.when(~label, F.col("item_id"))).alias("detection_id"),
        F.abs(F.max(F.when(label, F.col("at_us"))) - F.max(F.when(~label, F.col("at_us")))).alias("distance_us"),
    )
    # One label and one detection: nothing to choose.  Clusters with only one side have no match.
    single = sizes.filter("_l = 1 and _d = 1").filter(F.col("distance_us") <= limit)
    contested = sizes.filter("_l > 0 and _d > 0 and _l + _d > 2").select(*cluster)
    items = clustered.join(contested, cluster, "left_semi").drop("_cluster")
    chosen = _deferred_matches(items, keys, limit, chunk_seconds * MICROS)
    return single.select("label_id", "detection_id", "distance_us").unionByName(chosen)


def _clusters(items: DataFrame, keys: list[str], limit_us: int, chunk_us: int = 86_400 * MICROS) -> DataFrame:
    """Id of the gap-separated cluster of each item, computed in time chunks."""
    chunked = items.withColumn("_chunk", F.floor(F.col("at_us") / F.lit(chunk_us)))
    within = Window.partitionBy(*keys, "_chunk").orderBy("at_us", "is_label", "item_id")
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = F.lag("at_us").over(within)
    borders = (
        chunked.withColumn("_break", F.when(F.col("at_us") - before > limit_us, F.col("at_us")))
        .groupBy(*keys, "_chunk")
        .agg(F.min("at_us").alias("_first"), F.max("at_us").alias("_last"), F.max("_break").alias("_last_break"))
        .withColumn("_prev_last", F.lag("_last").over(across))
        .withColumn("_opens", F.col("_prev_last").isNull() | (F.col("_first") - F.col("_prev_last") > limit_us))
        .withColumn("_start", F.coalesce("_last_break", F.when(F.col("_opens"), F.col("_first"))))
        .withColumn(
            "_handed", F.last("_start", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
        )
        .select(*keys, "_chunk", "_opens", "_handed")
    )
    joined = chunked.join(borders, [*keys, "_chunk"])
    start = F.when(
        F.when(before.isNull(), F.col("_opens")).otherwise(F.col("at_us") - before > limit_us), F.col("at_us")
    )
    return (
        joined.withColumn("_own", start)
        .withColumn("_cluster", F.coalesce(F.last("_own", ignorenulls=True).over(within), F.col("_handed")))
        .drop("_own", "_opens", "_handed", "_chunk")
    )


def detector_scores(
    labels: DataFrame, detections: DataFrame, matches: DataFrame, entity_hours: float | None = None,
    true_negatives: int = 0,
) -> DataFrame:
    """Precision, recall, F1, false positives per entity-hour and mean distance, as one row."""
    counts = (
        labels.agg(F.count("*").alias("labels"))
        .join(F.broadcast(detections.agg(F.count("*").alias("detections"))))
        .join(F.broadcast(matches.agg(F.count("*").alias("true_positives"), F.sum("distance_us").alias("_us"))))
    )
    tp = F.col("true_positives")
    precision = F.try_divide(tp, F.col("detections"))
    recall = F.try_divide(tp, F.col("labels"))
    hours = F.lit(entity_hours).cast("double") if entity_hours and entity_hours > 0 else F.lit(None).cast("double")
    return counts.select(
        "true_positives",
        (F.col("detections") - tp).alias("false_positives"),
        (F.col("labels") - tp).alias("false_negatives"),
        F.lit(true_negatives).cast("bigint").alias("true_negatives"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide((F.col("detections") - tp).cast("double"), hours).alias("false_positives_per_entity_hour"),
        F.try_divide(F.col("_us") / F.lit(float(MICROS)), tp).alias("mean_latency_seconds"),
    )

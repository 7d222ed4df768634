"""Similarity join of notices on word n-grams, by vertical partitioning of the global n-gram order.

The global order puts rare n-grams first and frequent ones last; the order is cut into
fragments.  The first fragment of a set (its prefix) finds candidates; the overlap of a
candidate pair is counted per fragment and the counts are summed.  Links are exact.

Notices with the same set form one class and take part once.  Candidates meet in blocks
(all sets that share a prefix n-gram with a leading one).  Within a block, pairs are first
formed with a few centres only; after the components of those links are known, pairs are
formed between different components alone, so a group of near copies costs no square.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fairlead.llm.common import field, key_type, keyed, map_batches, per_row
from fairlead.llm.components import connected_components
from fairlead.session import stage

N = 5
FRAGMENTS = 4
# The most frequent n-grams that get a rank of their own in the global order.  The order
# decides the cost only: any order gives the same links.
RANKED = 1 << 17
# Frequencies are counted over runs of this many n-grams; a run reports those it has this often.
RUN_GRAMS, RUN_LEAST = 2_000_000, 4
CENTRES = 4
PARITY_WORDS = 16
# Distinct classes a task remembers so as not to send a copy again.
SEEN = 200_000
# Bytes hashed at a time; a longer text goes piece by piece, cut between words.
PIECE = 1 << 22

_RNG = np.random.default_rng(20_240_115)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_PLACE = _RNG.integers(1, 1 << 63, 2 * N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for the first n places."""
    while len(_powers[0]) < n:
        have = len(_powers[0])
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, have, 1 << 64))])
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit value per word of a text (UTF-8, A-Z lower-cased, white space ASCII), all words at once."""
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            cut = np.flatnonzero(_SPACE[raw[at:end]])
            while not len(cut) and end < len(raw):  # one word longer than a piece
                end = min(end + PIECE, len(raw))
                cut = np.flatnonzero(_SPACE[raw[at:end]])
            if end < len(raw):
                end = at + int(cut[-1]) + 1
        part = raw[at:end]
        edges = np.flatnonzero(np.diff(~_SPACE[part], prepend=False, append=False))
        starts, ends = edges[0::2], edges[1::2]
        powers, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * powers[: len(part)], out=sums[1:])
        out.append(_mixed((sums[ends] - sums[starts]) * inverse[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_set(text: str, n: int = N) -> np.ndarray:
    """The distinct word n-grams of a text as sorted 64-bit values; a shorter text is one gram, none is empty."""
    words = word_hashes(text.encode("utf-8"))
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        grams += words[k:len(words) - width + 1 + k] * _PLACE[k if width == n else n + k]
    return np.unique(_mixed(grams + np.uint64(width)))


def _class_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bits telling where an odd number of grams fall: two sets differ in at least as many grams as bits."""
    bits = 64 * PARITY_WORDS
    while bits < 2 * len(grams) and bits < 1 << 20:
        bits *= 2
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(parity: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(parity.reshape(-1, words), axis=0)


def _difference_at_least(first: bytes, second: bytes) -> int:
    a, b = np.frombuffer(first, "<u8"), np.frombuffer(second, "<u8")
    words = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())


_LANES = [f"p{k}" for k in range(PARITY_WORDS)]


def _described(rows: DataFrame) -> DataFrame:
    """Per row: its number, key, set size, class and parity; and per run of grams the frequent ones.

    ``gram`` is null in the rows of the first kind.
    """
    schema = T.StructType([
        field("row", "bigint"), T.StructField("key", key_type(rows)), field("n", "bigint"), field("cls", "bigint"),
        field("parity", "binary"), *[field(p, "bigint") for p in _LANES], field("gram", "bigint"), field("times", "bigint"),
    ])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        row, seen, grams, owners, held = TaskContext.get().partitionId() << 40, set(), [], [], 0

        def frequent():
            every = np.concatenate(grams)
            by = np.repeat(np.asarray(owners, np.int64), [len(g) for g in grams])
            values, first, times = np.unique(every, return_index=True, return_counts=True)
            often = times >= RUN_LEAST
            nulls = [None] * int(often.sum())
            columns = {"gram": values[often].view(np.int64), "times": times[often], "cls": by[first[often]]}
            return pa.RecordBatch.from_arrays(
                [pa.array(columns.get(f.name, nulls), type=f.type) for f in arrow], schema=arrow
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, out = batch.slice(i, 512), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = gram_set(text)
                    if len(own):
                        cls, parity = _class_of(own), _parity(own)
                        lanes = _folded(parity, PARITY_WORDS).view(np.int64).tolist()
                        out.append((row, key, len(own), cls, parity.tobytes(), *lanes, None, None))
                        if cls not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(cls)
                            grams.append(own)
                            owners.append(cls)
                            held += len(own)
                            if held >= RUN_GRAMS:
                                yield frequent()
                                grams, owners, held = [], [], 0
                    else:
                        out.append((row, key, 0, None, None, *[None] * PARITY_WORDS, None, None))
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
        if grams:
            yield frequent()

    return map_batches(rows, run, schema)


def _ranked(described: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent grams, at most RANKED: values (sorted), ranks (1 the rarest), and a class that has each."""
    counts = stage(
        described.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"), F.min("cls").alias("owner")), "frequent"
    )
    steps = sorted(counts.groupBy(F.floor(F.log2("times") * 8).alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for step, n in steps:
        total += n
        if total > RANKED:
            break
        least = step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = counts.filter(F.floor(F.log2("times") * 8) >= least).toPandas().sort_values(["times", "gram"])
    values, owners = table["gram"].to_numpy(np.int64).view(np.uint64), table["owner"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], (np.arange(len(values)) + 1)[order], owners[order]


def _blocks(rows: DataFrame, ranked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Blocks of classes that share a prefix gram: leader, cls.

    A set of n grams links only with sets that share one of its first n - ceil(3n/4) + 1
    grams in the global order.  A rare gram's block is named by its smallest class, found
    in the one shuffle of the prefixes; a frequent gram's by a class known to have it, so
    its rows need not meet in one task.
    """
    table = rows.sparkSession.sparkContext.broadcast(ranked)  # at most RANKED entries
    schema = T.StructType([field("place", "bigint"), field("leader", "bigint"), field("cls", "bigint")])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        values, ranks, owners = table.value
        seen, out, held = set(), [], 0

        def sent():
            place, leader, cls, known = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(leader, mask=~known), pa.array(cls)], schema=arrow
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for text in batch.slice(i, 512).column(1).to_pylist():
                    own = gram_set(text)
                    if not len(own):
                        continue
                    cls = _class_of(own)
                    if cls in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                    prefix = len(own) - (3 * len(own) + 3) // 4 + 1
                    if len(values):
                        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                        hit = values[at] == own
                    else:
                        at, hit = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                    if hit.any():
                        order = np.lexsort((own, np.where(hit, ranks[at], 0)))[:prefix]
                        hit, at, first = hit[order], at[order], own[order]
                        leaders = np.unique(owners[at[hit]])
                        rare = first[~hit]
                    else:
                        leaders, rare = np.zeros(0, np.int64), own[:prefix]
                    n = len(rare) + len(leaders)
                    out.append((
                        np.concatenate([rare.view(np.int64), np.full(len(leaders), cls)]), np.concatenate([np.zeros(len(rare), np.int64), leaders]),
                        np.full(n, cls, np.int64), np.concatenate([np.zeros(len(rare), bool), np.ones(len(leaders), bool)]),
                    ))
                    held += n
                    if held >= 200_000:
                        yield sent()
                        out, held = [], 0
        if out:
            yield sent()

    same = Window.partitionBy("place", F.col("leader").isNull())
    posted = map_batches(rows, run, schema)
    led = posted.select(
        "leader", "cls", F.min("cls").over(same).alias("least"), F.max("cls").over(same).alias("most")
    ).filter("leader is not null or least < most")
    return led.select(F.coalesce("leader", "least").alias("leader"), "cls").distinct()


def _close(a: str, b: str):
    """Necessary for a link, from set sizes and folded parities alone; exact arithmetic on integers.

    100 * intersection >= 75 * union means 7 * difference <= size + size.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _LANES[1:]),
               F.bit_count(F.col(f"{a}.{_LANES[0]}").bitwiseXOR(F.col(f"{b}.{_LANES[0]}"))))
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * bits <= na + nb)


def _pair(a: str, b: str) -> list:
    return [F.least(F.col(f"{a}.cls"), F.col(f"{b}.cls")).alias("a"), F.greatest(F.col(f"{a}.cls"), F.col(f"{b}.cls")).alias("b")]


def _links(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Whole parities go first, then the overlaps by fragment."""
    of = lambda side: classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"q_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "q_a", "q_b")
    schema = T.StructType([field(c, "bigint") for c in ("a", "b", "n_a", "n_b")])

    def begin():
        def near(a, b, n_a, n_b, q_a, q_b):
            if 7 * _difference_at_least(q_a, q_b) <= n_a + n_b:
                yield a, b, n_a, n_b

        return near

    near = stage(per_row(both, begin, schema), "near")
    asked = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
    # One reading of each asked class brings its text; copies have the same set.
    owners = stage(asked.join(classes.select("cls", "owner"), "cls").select("cls", "owner"), "asked")
    texts = rows.alias("r").join(
        owners.select("owner").distinct().alias("o"), F.col("r.key").eqNullSafe(F.col("o.owner")), "left_semi"
    )
    piece = T.StructType([field("cls", "bigint"), field("fragment", "int"), field("grams", "array<bigint>")])
    cuts = np.asarray([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], np.uint64)

    def start():
        def fragments(key, text):
            own = gram_set(text)
            if len(own):
                cls = _class_of(own)
                for k, part in enumerate(np.split(own, np.searchsorted(own, cuts))):
                    if len(part):
                        yield cls, k, part.view(np.int64).tolist()

        return fragments

    cut = per_row(texts, start, piece, lambda r: 8 * len(r[2])).join(owners.select("cls"), "cls", "left_semi")
    sets = stage(cut.dropDuplicates(["cls", "fragment"]), "fragments")
    side = lambda s: sets.select(F.col("cls").alias(s), "fragment", F.col("grams").alias(f"g_{s}"))
    counted = near.join(side("a"), "a").join(side("b"), ["b", "fragment"]).groupBy("a", "b", "n_a", "n_b").agg(
        F.sum(F.size(F.array_intersect("g_a", "g_b"))).alias("shared")
    )
    return stage(counted.filter("7 * shared >= 3 * (n_a + n_b)").select("a", "b"), "links")


def similar_notices(readings: DataFrame, key: str = "metric_id", text: str = "construction_notice") -> DataFrame:
    """Components of readings whose notices share at least three quarters of their word 5-grams.

    One row per input row: ``<key>``, n_shingles (size of its set), component_id (the
    smallest key it reaches by links, its own included).

    Words are cut at ASCII white space and A-Z lower-cased.  A notice with fewer than five
    words is one gram; one without words, null or empty, has no gram and links with
    nothing, its own copies included.  Equal sets link.  Grams and sets are compared as
    64-bit values.  Repeated rows are reported each, a null key reports a null only if its
    whole component has none; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = keyed(readings, key, text=text)
    described = stage(_described(rows), "described")
    light = described.filter("gram is null")
    classes = stage(
        light.filter("cls is not null").groupBy("cls").agg(
            F.first("n").alias("n"), F.min("key").alias("owner"), F.first("parity").alias("parity"), *[F.first(p).alias(p) for p in _LANES]
        ),
        "classes",
    )
    small = classes.select("cls", "n", *_LANES)
    blocks = stage(stage(_blocks(rows, _ranked(described)), "blocks").join(small, "cls"), "block-members")

    # First with a few centres of each block, picked by different hash orders.
    picks = blocks.groupBy("leader").agg(*[
        F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "n", *_LANES)).alias(f"c{k}") for k in range(CENTRES)
    ])
    centres = picks.select("leader", F.explode(F.array(*[f"c{k}" for k in range(CENTRES)])).alias("c")).select(
        "leader", "c.cls", "c.n", *[f"c.{p}" for p in _LANES]
    ).distinct()
    centres = stage(centres, "centres")
    first = blocks.alias("x").join(centres.alias("y"), (F.col("x.leader") == F.col("y.leader")) & (F.col("x.cls") != F.col("y.cls")) & _close("x", "y"))
    tested = stage(first.select(*_pair("x", "y")).distinct(), "pairs")
    found = _links(tested, classes, rows)
    merged = stage(connected_components(found), "components")

    # Then between different components of a block.
    labelled = stage(
        blocks.join(merged.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "labelled"
    )
    mixed = labelled.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("leader")
    open_blocks = stage(labelled.join(mixed, "leader", "left_semi"), "open-blocks")
    rest = open_blocks.alias("x").join(
        open_blocks.alias("y"),
        (F.col("x.leader") == F.col("y.leader")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & _close("x", "y"),
    )
    pairs = stage(rest.select(*_pair("x", "y")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        found = found.unionByName(_links(pairs, classes, rows))
        merged = stage(connected_components(found), "components")

    placed = stage(
        light.select("row", "key", "n", "cls").join(merged.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .select("key", "n", F.coalesce("root", "cls").alias("root")),
        "placed",
    )
    ids = stage(placed.filter("root is not null").groupBy("root").agg(F.min("key").alias("component_id")), "ids")
    return placed.join(ids, "root", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )

"""Archives, Merkle manifests and whitening: round trips, brute force and odd rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from fairlead.llm import archive, manifest_tree, whitening
from fairlead.session import shared_dir

LONG = "Inspection lane closed. " * 60
NOTICES = [
    (1, "a", LONG), (2, "b", LONG), (3, "c", LONG), (3, "c", LONG), (4, None, None), (5, "e", ""), (6, "x\r\nWARC-Type: forged", "short"),
    (7, "g", "short"), (None, "n", LONG + "é"), (None, "n", LONG + "é"), (8, "h", LONG + "é"), (9, "i", "é" * 500), (10, "j", "é" * 500),
    (11, "k", "e" * 999), (12, "l", "e" * 999), (13, "m", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
]
CLASHING = ["payload", "address", "slot", "header", "key", "keep", "n", "part", "lo", "level", "node", "claimed", "x"]


def readings(spark, rows):
    schema = "metric_id bigint, record_ref string, construction_notice string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], schema).repartition(3)


# --- archives ---------------------------------------------------------------------------------


def test_archived_records_come_back(spark):
    path = shared_dir(spark, "archive")
    archive.write_archive(readings(spark, NOTICES), path)
    got = archive.read_archive(spark, path).collect()
    keeper = {}
    for k, _, text in NOTICES:
        keeper[text or ""] = max(keeper.get(text or "", -1), -1 if k is None else k)
    want = []
    for k, _, text in NOTICES:
        data = (text or "").encode()
        keep = keeper[text or ""]
        revisit = len(data) >= 1000 and k != keep
        want.append((k, "revisit" if revisit else "response", keep if revisit else None, len(data), hashlib.sha1(data).hexdigest(), data))
    assert sorted(map(str, want)) == sorted(
        str((r.metric_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload))) for r in got
    )
    assert all(r.intact for r in got)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({text or "" for _, _, text in NOTICES})  # every payload once
    assert sorted(bytes(r.payload) for r in stored.collect()) == sorted({(text or "").encode() for _, _, text in NOTICES})


def test_exported_files_are_warc(spark):
    path, out = shared_dir(spark, "archive"), shared_dir(spark, "warc")
    archive.write_archive(readings(spark, NOTICES), path)
    archive.export_warc(archive.read_archive(spark, path), out)
    kinds, ids = defaultdict(int), set()
    for (data,) in spark.read.format("binaryFile").load(out + "/*.txt").select("content").collect():
        data = bytes(data)
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            assert version == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines)
            block, data = rest[:int(fields["Content-Length"])], rest[int(fields["Content-Length"]):]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK")
            kinds[fields["WARC-Type"]] += 1
            ids.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            else:
                assert payload == b"" and fields["WARC-Refers-To"]
    assert kinds == {"response": 11, "revisit": 5} and len(ids) == 14


def test_a_damaged_payload_is_noticed(spark):
    path, bad = shared_dir(spark, "archive"), shared_dir(spark, "damaged")
    archive.write_archive(readings(spark, NOTICES[:3]), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    broken = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken.write.parquet(f"{bad}/payloads")
    assert not any(r.intact for r in archive.read_archive(spark, bad).collect())
    broken.filter("false").write.mode("overwrite").parquet(f"{bad}/payloads")
    lost = archive.read_archive(spark, bad).collect()
    assert len(lost) == 3 and not any(r.intact for r in lost) and all(r.payload is None for r in lost)


def test_payload_of_many_records_is_dealt_over_slots(spark):
    rows = spark.range(20_000).select(F.col("id").alias("metric_id"), F.lit("u").alias("record_ref"), F.lit(LONG).alias("construction_notice"))
    path = shared_dir(spark, "archive")
    archive.write_archive(rows, path)
    assert spark.read.parquet(f"{path}/payloads").select("slots").collect() == [(5,)]
    assert spark.read.parquet(f"{path}/headers").select("slot").distinct().count() == 5
    got = archive.read_archive(spark, path)
    assert got.filter("record_type = 'revisit' and refers_to = 19999 and intact").count() == 19_999


def test_string_keys_and_an_empty_table(spark):
    path = shared_dir(spark, "archive")
    rows = readings(spark, NOTICES[:3]).withColumn("metric_id", F.concat(F.lit("cbp:é %"), F.col("metric_id").cast("string")))
    archive.write_archive(rows, path)
    assert {r.refers_to for r in archive.read_archive(spark, path).collect()} == {None, "cbp:é %3"}
    empty = shared_dir(spark, "archive")
    archive.write_archive(rows.filter("false"), empty)
    assert archive.read_archive(spark, empty).count() == 0


# --- Merkle manifests ---------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return levels


def steps(levels, i):
    found = []
    for level in levels[:-1]:
        other = i ^ 1
        found.append((level[other] if other < len(level) else None, other < i))
        i //= 2
    return found


def by_force(rows):
    """rows of (key, part, size, text): the manifest, with size claimed one higher where 3 divides the key."""
    parts = defaultdict(list)
    for row in rows:
        key, part, size, text = row
        claimed = size + 1 if size is not None and key is not None and key % 3 == 0 else size
        parts[part].append((key, digest("".join(map(value, row))), digest("".join(map(value, (key, part, claimed, text))))))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for part in order:
        parts[part].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[part] = grown([leaf for _, leaf, _ in parts[part]])
    top = grown([trees[part][-1][0] for part in order])
    out = []
    for number, part in enumerate(order):
        for i, (key, leaf, claimed) in enumerate(parts[part]):
            path = steps(trees[part], i) + steps(top, number)
            at = claimed
            for sibling, before in path:
                at = digest(at if sibling is None else sibling + at if before else at + sibling)
            root = top[-1][0]
            out.append((key, part, leaf, trees[part][-1][0], root, digest("".join(s for s, _ in path if s)), at, at == root))
    return out


TREES = {
    "one": [(5, "a", 3, "t")],
    "odd": [
        (1, None, 1, "x"), (2, None, None, None), (None, "a", 1, "é"), (None, "a", 1, "é"), (3, "a", 7, ""), (3, "a", 7, ""), (3, "a", 8, ""),
        (4, "", 2, "b"), (5, "b", 2, "b" * 5000), (6, "é", 9, "z"), (9, "Z", None, "z"), (0, "-", 1, "m"), (12, "=", 1, "m"),
    ],
    "sizes": [(i, f"p{n}", i, "t") for n in range(1, 20) for i in range(n)],
    "deep": [(i, "p", i, "t") for i in range(700)] + [(i, "q", i, "t") for i in range(257)] + [(i, "r", i, "t") for i in range(256)],
    "wide": [(i, f"p{i}", i, "t") for i in range(300)],
}


@pytest.mark.parametrize("name", TREES)
def test_manifest_equals_brute_force(spark, name):
    rows = TREES[name]
    table = spark.createDataFrame(
        [(*r, *["clash"] * len(CLASHING)) for r in rows],
        "metric_id bigint, provider_id string, port_status bigint, construction_notice string, " + ", ".join(f"{c} string" for c in CLASHING),
    ).repartition(5)
    got = manifest_tree.merkle_manifest(
        table, fields=("metric_id", "provider_id", "port_status", "construction_notice"),
        claimed={"port_status": F.when(F.col("metric_id") % 3 == 0, F.col("port_status") + 1).otherwise(F.col("port_status"))},
    )
    columns = ["metric_id", "provider_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, by_force(rows))) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())


def test_nodes_are_intervals(spark):
    leaves = spark.range(1000).select(F.lit("=p").alias("part"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"))
    ranked = manifest_tree._ranked(leaves)
    nodes = manifest_tree._nodes(ranked, manifest_tree._steps(ranked)).collect()
    assert len({(n.level, n.lo) for n in nodes}) == len(nodes)
    for level in range(11):
        covered = sorted((n.lo, n.hi) for n in nodes if n.level == level)
        assert covered[0][0] == 0 and covered[-1][1] == 1000
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    assert max(n.level for n in nodes) == 10


def test_no_rows_no_manifest(spark):
    table = readings(spark, NOTICES).filter("false")
    got = manifest_tree.merkle_manifest(table, part="record_ref", fields=("metric_id", "construction_notice"))
    assert got.count() == 0 and "verified" in got.columns


# --- whitening ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_inertia_counts_positive_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 8, 20):
        a = rng.standard_normal((n, n))
        a = a + a.T
        if seed % 2:
            np.fill_diagonal(a, 0)
        assert whitening.positive_pivots(a) == int((np.linalg.eigvalsh(a) > 0).sum())


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1], [3, 3, 3, 1, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [1e6, 1, 1e-3], [7], [2, 1, 0, 0], [1, 1 - 1e-15, 1, 1, 1],
])
def test_components_are_found_and_numbered(spectrum):
    rng = np.random.default_rng(3)
    d = len(spectrum)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    values, axes = whitening.leading_components(v, 16)
    want = np.sort([s for s in spectrum if s])[::-1]
    assert np.allclose(values, want, rtol=0, atol=1e-13 * sum(spectrum))
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.abs(v @ axes - axes * values).max() <= 1e-13 * sum(spectrum)


def whiten_by_force(rows, most=16):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, (_, v) in enumerate(rows)}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    w, e = np.linalg.eigh(centred.T @ centred / n)
    w, e = w[::-1][:most], e[:, ::-1][:, :most]
    return n, total, w, w / (centred ** 2).sum() * n, {i: (rows[i][0], (v - total / n) @ e / np.sqrt(w), int(((n * v - total) ** 2).sum())) for i, v in x.items()}


VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("key", T.StringType()),
                       T.StructField("x", T.StringType()), T.StructField("component", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "clash", "clash", "clash") for k, v in rows], VECTOR).repartition(4)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    base = (rng.standard_normal((400, 20)) * np.linspace(3, 0.3, 20)).astype(np.float32)
    good = [(i, list(map(float, v))) for i, v in enumerate(base)] + [(i, list(map(float, base[7]))) for i in range(1000, 1300)] + [(None, list(map(float, base[8])))] * 2
    nan, inf = float("nan"), float("inf")
    bad = [(2000, None), (2001, [nan] + [0.0] * 19), (2002, [inf] + [0.0] * 19), (2003, [None] + [0.0] * 19), (2004, []), (2005, [1.0, 2.0]), (2006, [-3e38] * 20)]
    got = whitening.whitened_vectors(vectors(spark, good + bad)).collect()
    n, total, w, explained, want = whiten_by_force(good)
    assert n == len(np.unique(np.floor(64 * base.astype(float)), axis=0))
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {k for k, _ in good}
    place = {k: i for i, (k, _) in enumerate(good)}
    z = np.zeros((len(good), 16))
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == want[place[r.vec_id]][2]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10)
    seen = sorted(set(place.values()))
    z, expected = z[seen], np.array([want[i][1] for i in seen])
    signs = np.sign((z * expected).sum(axis=0))
    assert np.abs(z - expected * signs).max() < 1e-8
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() <= 1e-10


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-2 ** 40, 2 ** 40, 3)]) for i in range(50)]
    schema = "vec_id bigint, embedding array<double>"
    got = whitening.whitened_vectors(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 150 and all(r.deviation is None for r in got)  # beyond a long
    assert max(r.identity_error for r in got) < 1e-10
    big = [(i, [float(10 ** 9 + i * i), float(-(10 ** 9) - 3 * i)]) for i in range(20)]
    n, total, w, explained, want = whiten_by_force(big)
    got = whitening.whitened_vectors(spark.createDataFrame(big, schema)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(i, want[i][2]) for i in range(20)}


@pytest.mark.parametrize("rows, components", [([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 4.0])], 1),
                                              ([(1, None)], 0), ([(1, []), (2, [])], 0)])
def test_few_vectors(spark, rows, components):
    got = whitening.whitened_vectors(vectors(spark, rows) if rows else spark.createDataFrame([], VECTOR)).collect()
    assert len(got) == components * len(rows)
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)


# --- the queries -------------------------------------------------------------------------------------


def test_tampered_documents_are_told(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    n_chars = {r.doc_id: r.n_chars for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(n_chars)
    for r in got:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n_chars[r.doc_id] is not None
        assert r.verified == (not tampered) and (r.folded_root == r.root) == r.verified


def test_whitening_query_covers_all_vectors(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, total, w, explained, want = whiten_by_force(rows)
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and got[0].identity_error <= 1e-4
    z, e = np.zeros((2, len(rows), 16))
    place = {k: i for i, (k, _) in enumerate(rows)}
    for r in got:
        i = place[r.vec_id]
        z[i, r.component - 1], e[i] = r.whitened, want[i][1]
        assert r.deviation == want[i][2]
    assert np.abs(z - e * np.sign((z * e).sum(axis=0))).max() < 1e-8

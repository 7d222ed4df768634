"""Registered queries: against SQL on the small tables, and the shape of their plans."""

import io
import contextlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairlead.operators import claims
from conftest import SMALL
from tools.run_queries import TABLES, rows_of, same

CHECKED = ["all_snapshots", "entry_exit", "dwell_per_entity", "normalize_observations", "dedupe_observations", "claim_verdicts",
           "route_questions", "health_as_of", "stream_sessions", "stream_health", "compare_rows", "headline_series", "network_totals",
           "metric_provenance", "readiness_rollup", "answers"]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, result.fetchall())
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("name", ["track_segments", "entry_exit", "dwell_per_entity", "vessel_count", "fence_membership",
                                  "normalize_frames", "dedupe_observations", "source_health", "numeric_grounding"])
def test_plans_have_no_cartesian_product_and_no_row_python(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()[name](spark, SMALL).explain()
    plan = text.getvalue()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_manifests_with_broken_bodies_reach_the_guard(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").collect()
    # The list is left out of one manifest in 29, and with it the body.
    broken = {f"fx-{r.event_id}.json" for r in events if r.event_id % 257 == 0 and r.event_id % 29}
    guarded = {r.file: r for r in entry.queries()["manifest_guard"](spark, SMALL).collect()}
    assert broken and len(guarded) == len(events)
    assert {f for f, r in guarded.items() if r.violation == "manifest.not_object"} == broken
    assert all(guarded[f].fixture_id is None for f in broken)
    counted = entry.queries()["dataset_manifest"](spark, SMALL).filter("truth_state is null").collect()
    assert {(r.file, r.fixture_id, r.observations) for r in counted} == {(f, None, 0) for f in broken}


def test_all_claims_and_all_events_are_judged(spark, con):
    got = {r.category: r for r in entry.queries()["groundedness"](spark, SMALL).collect()}
    events, documents = (con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("events", "documents"))
    assert sum(r.cases for r in got.values()) == events + documents
    # A planted fault is found unless the document's own words break an earlier rule.
    own = [t for (t,) in con.execute("SELECT text FROM documents WHERE text IS NOT NULL").fetchall()
           if any(re.search(pattern, t, re.I) for pattern in [b[1] for b in claims.BANNED] + [claims.SCOPE_OVERREACH])]
    assert sum(r.cases - r.passed for r in got.values()) <= len(own) < documents / 2
    ids = {True: set(), False: set()}
    for kind, user, early in con.execute("SELECT event_type, user_id, ts < TIMESTAMP '2024-01-16' FROM events").fetchall():
        ids[early].add((kind, user))
    differing = {k: sum(x[0] == k for x in ids[True] ^ ids[False]) for k in {x[0] for x in ids[True] | ids[False]}}
    assert {r.event_type: r.differing_ids for r in entry.queries()["cohort_stability"](spark, SMALL).collect()} == differing
    assert all(r.stable == (r.differing_ids == 0) for r in entry.queries()["cohort_stability"](spark, SMALL).collect())


def test_filters_and_columns_reach_the_scan(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()["scoped_read"](spark, SMALL).explain("formatted")
    plan = text.getvalue()
    assert "GreaterThanOrEqual(ts,2024-01-15" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


NEIGHBOURS = ["track_segments", "entity_classification", "asof_classification", "entry_exit", "dwell_per_entity", "source_health", "health_as_of"]


@pytest.mark.parametrize("name", NEIGHBOURS)
def test_neighbours_read_and_shuffle_their_input_once(spark, monkeypatch, name):
    from fairlead.operators import health, sequence

    plans = []

    def explained(df):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain()
        plans.append(text.getvalue())
        return df

    for module in (sequence, health):
        real = module.stage
        monkeypatch.setattr(module, "stage", lambda df, label, real=real: real(explained(df), label))
    explained(entry.queries()[name](spark, SMALL))
    reading = [p for p in plans if "events.parquet" in p]
    # health_as_of looks probes up among refreshes: both are made from the same events here.
    tables = 2 if name == "health_as_of" else 1
    assert sum(p.count("events.parquet") for p in reading) == tables
    # Rows are shuffled by (keys, chunk) once; what follows are rows of chunk ends.  The states that
    # health_as_of builds on take what earlier chunks hand on in a join of their own.
    wide = sum(len(re.findall(r"Exchange hashpartitioning\([^)]*_chunk", p)) for p in reading)
    assert wide <= tables + (name == "health_as_of")
    assert not any("SortAggregate" in p or "CartesianProduct" in p for p in plans)


@pytest.mark.parametrize("name,unread", [
    ("baseline_comparison", ["land_readings"]), ("metric_grid", ["land_readings"]), ("watch_evaluation", ["land_readings"]),
    ("facility_windows", ["observations", "aircraft"]),
])
def test_snapshot_parts_that_a_query_does_not_return_are_not_made(spark, monkeypatch, name, unread):
    from fairlead.plans import catalog, views

    def unasked(*_):
        raise AssertionError("made for nothing")

    for view in unread:
        monkeypatch.setattr(views, view, unasked)
    assert catalog.catalog()[name](spark, SMALL).count() > 0


def test_metrics_do_not_depend_on_facility_readings(spark):
    from fairlead.plans import catalog

    whole, metric = catalog._snapshot(spark, SMALL), catalog._metric_snapshot(spark, SMALL)
    for part in ("metrics", "comparisons"):
        a, b = getattr(whole, part), getattr(metric, part)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_evaluation_report_makes_only_what_it_reads(spark, monkeypatch):
    """Clusters of labels and detections are found once, and the manifests, which the report by scope has not, are left alone."""
    from fairlead.operators import evaluation
    from fairlead.plans import catalog as plans

    made, found = [], evaluation._clusters
    monkeypatch.setattr(evaluation, "_clusters", lambda *a: made.append(found(*a)) or made[-1])
    labels, detections = plans.V.labelled_events(spark, SMALL)
    matches = evaluation.match_labels(labels, detections, 1800)
    assert len(made) == 1 and "Window" not in matches._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(plans.V, "manifests", lambda *a: pytest.fail("manifests are not part of the result"))
    report = plans.catalog()["evaluation_report"](spark, SMALL).collect()
    assert sum(r.true_positives or 0 for r in report) == matches.count() > 0
    assert sum(r.labels or 0 for r in report) == labels.count()


def test_compare_rows_finds_waits_without_all_newest_readings(spark, monkeypatch):
    """Its rows show one wait for each land profile and window; readings are neither de-duplicated nor counted as a whole."""
    from fairlead.operators import facility
    from fairlead.plans import catalog as plans

    whole = plans.network.by_anomaly(plans.network.compare_rows(
        (snap := plans._snapshot(spark, SMALL)).wide, snap.comparisons, plans.compare.detect_events(snap.metrics, plans._eager_rules(spark)),
        plans.network.coverage_states(plans.registry.profiles(spark), plans.registry.fences(spark)),
    )).collect()
    seen, dedupe = [], facility.dedupe_facility
    monkeypatch.setattr(facility, "dedupe_facility", lambda rows: seen.append(rows.count()) or dedupe(rows))
    rows = plans.catalog()["compare_rows"](spark, SMALL).collect()
    assert sorted(map(str, rows)) == sorted(map(str, whole))
    assert 0 < sum(seen) < 0.1 * spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_land_readings_are_moved_by_the_number_in_their_id(spark):
    from fairlead.plans import views

    rows = views.land_readings(spark, SMALL)
    assert "l_orderkey" not in rows.columns and "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    number = F.element_at(F.split("metric_id", "-"), 2).cast("bigint") % 86_400
    assert rows.filter((F.unix_micros("observed_at") / 1_000_000).cast("bigint") % 86_400 != number).count() == 0 < rows.count()

"""The pipeline and the registered queries of the operators on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from fairlead.llm import quality
from test_text_operators import components_by_force, word_tokens

WANTED = set(range(1, 14))


def test_one_query_per_operator():
    numbers = [int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(numbers) == sorted(WANTED) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [q for q in entry.oracle_sql() if q.startswith("op") and q[2].isdigit()])
def test_query_equals_its_sql(spark, name):
    from tools.run_queries import TABLES, rows_of, same

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, result.fetchall())
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        from fairlead.session import stage as written

        current = written(stage(spark, current, SMALL), "stage")
        tables[name] = current
    judge = quality._judge(quality.BandSettings())
    raw = {r.doc_id: r for r in docs.collect()}
    first = {r.doc_id: r for r in tables["quality rules"].collect()}
    assert set(first) == {k for k, r in raw.items() if next(iter(judge(k, r.text or "")))[7]}
    assert all(first[k] == raw[k] for k in first)
    for name in ("quality rules", "line dedup", "near duplicates"):
        assert tables[name].schema.names == docs.columns
    second = tables["line dedup"].collect()
    for r in second:
        assert r.text.split() and set(r.text.split("\n")) <= set(first[r.doc_id].text.split("\n")) and r.n_chars == len(r.text)
    groups = components_by_force([(r.doc_id, r.text) for r in second])
    third = {r.doc_id: r.text for r in tables["near duplicates"].collect()}
    assert set(third) == {c for _, _, c in groups}
    packed = tables["packing"].collect()
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {k: len(word_tokens(t)) + 1 for k, t in third.items()}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    from test_text_operators import prose

    a, b = prose(80), prose(80)
    rows = [(None, a), (None, a + " late"), (None, b), (None, b), (5, b + " x"), (5, b + " x"), (7, a), (8, None), (8, ""), (9, prose(40))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(3), SMALL)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(7, a), (5, b + " x"), (8, ""), (8, ""), (9, rows[-1][1])])
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), SMALL).count() == 0

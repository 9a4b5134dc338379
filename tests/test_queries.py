"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest

from eddyforge import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(name, same):
    same(Q.QUERIES[name], Q.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


def test_entry_has_the_published_columns(spark):
    import __spark_entry__
    from eddyforge.schema import COLUMNS

    df = __spark_entry__.entry(spark)
    assert df.columns == [n for n, _, _ in COLUMNS] and len(df.columns) == 62
    assert df.count() > 0


@pytest.fixture(scope="module")
def shared_stamps(tmp_path_factory):
    """Twelve copies of the events with ids of their own; every fifth event of the second has its original's stamp."""
    import duckdb
    from tests.conftest import SF

    folder = tmp_path_factory.mktemp("stamps")
    c = duckdb.connect()
    stamp = "CASE WHEN j = 0 OR j = 1 AND event_id % 5 = 0 THEN ts ELSE make_timestamp(epoch_us(date_trunc('day', ts)) + 1 + (hash(event_id * 61 + j) % 86399999998)::BIGINT) END"
    c.execute(f"COPY (SELECT event_id + j * 1000000 AS event_id, {stamp} AS ts, user_id, event_type, value, props FROM '{SF}/events.parquet' CROSS JOIN range(12) r(j) ORDER BY ts, 1) TO '{folder}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert c.execute("SELECT count(*) - count(DISTINCT ts) FROM events").fetchone()[0] >= 200
    return str(folder), c


STAMPED = "absent_column_fill csv_roundtrip despike_series finite_counts min_samples_filter period_cut_left run_summary_short cell_conversion csv_cells failed_step_rows joint_counts period_cut_right sample_times thermo_state monotone_dedupe"


@pytest.mark.parametrize("name", STAMPED.split())
def test_events_that_share_a_stamp(name, spark, shared_stamps):
    folder, c = shared_stamps
    result = c.execute(Q.oracle_sql()[name])
    titles = [d[0] for d in result.description]
    want = sorted(repr(r) for r in result.fetchall())
    assert sorted(repr(tuple(r[n] for n in titles)) for r in Q.QUERIES[name](spark, folder).toArrow().to_pylist()) == want

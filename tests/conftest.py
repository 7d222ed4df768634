import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fairlead.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def observe(spark):
    """Build observations from short rows: id, entity, minute, lat, lon, and optional fields."""
    import datetime as dt

    from fairlead import schema
    from fairlead.sources.registry import local_table

    noon = dt.datetime(2026, 9, 9, 12, tzinfo=dt.timezone.utc)

    def build(rows):
        full = []
        for oid, entity, minute, lat, lon, *rest in rows:
            extra = rest[0] if rest else {}
            at = noon + dt.timedelta(minutes=minute)
            full.append({
                "observation_id": oid, "entity_id": entity, "mode": "sea", "entity_type": "cargo_vessel", "latitude": lat,
                "longitude": lon, "speed_knots": 10.0, "observed_at": at, "received_at": at + dt.timedelta(minutes=1),
                "provider_id": "p", "endpoint_id": "e", "license_id": "l", "source_state": "fresh",
                "position_accuracy": "exact", "classification": "confirmed", **extra,
            })
        names = schema.OBSERVATION.names
        return local_table(spark, [{n: r.get(n) for n in names} for r in full], schema.OBSERVATION)

    return build

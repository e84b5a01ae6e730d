import duckdb
import pytest

from codeloom.plans import registry
from tests.compare import oracle, spark_rows

#: The day's last half second counts as the next day's; before 1970 days are cut towards it.
TIMES = {
    "ends": [f"2024-01-{day:02} 23:59:{s}" for day in (1, 2) for s in ("58.5", "59", "59.499999", "59.5", "59.500001", "59.999999")],
    "starts": ["2024-01-02 00:00:00", "2024-01-02 00:00:00.000001", "2024-01-02 00:00:00.5"],
    "early": ["1969-12-31 00:00:00", "1969-12-31 12:00:00", "1969-12-30 23:59:59.5", "1969-12-30 00:00:00.5", "1969-12-29 23:59:59.5", "1969-12-29 23:59:59.499999", "1600-02-29 23:59:59.7"],
    "late": ["2300-06-30 23:59:59.499999", "2300-06-30 23:59:59.5", "9999-12-31 23:59:59.999999"],
    "none": [None],
}


@pytest.mark.parametrize("kind", sorted(TIMES))
def test_days_of_changes_are_those_of_the_sql(spark, tmp_path, kind):
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for i, ts in enumerate(TIMES[kind]):
        con.execute("INSERT INTO events VALUES (?, ?, ?, 'view', 1.0, '{}'), (?, ?, NULL, 'view', 1.0, '{}')", [2 * i, ts, i % 2, 2 * i + 1, ts])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = spark_rows(registry.QUERIES["change_throttle"](spark, str(tmp_path)))
    assert got == oracle(registry.ORACLE_SQL["change_throttle"], str(tmp_path))
    assert sum(row[0] for row in got[1]) == 2 * len(TIMES[kind])

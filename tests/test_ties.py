"""Values that tie but for the last bits of a plain sum, which depends on the rows' order."""

from datetime import datetime, timedelta

import duckdb
import pytest

from heatloom.plans import registry

LINEITEM = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP"


def lineitem(folder, rows):
    """rows: supplier, quantity, discount, tax, status, date."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE t ({LINEITEM})")
    con.executemany("INSERT INTO t VALUES (?, 0, ?, 1, ?, 1000, ?, ?, 'N', ?, ?)", [(k, s, q, less, tax, status, date) for k, (s, q, less, tax, status, date) in enumerate(rows)])
    con.sql(f"COPY t TO '{folder}/lineitem.parquet'")
    return str(folder)


def weeks_of_ties():
    """Twelve weeks of a cell whose values and thresholds are means of 0.1, 0.3, 0.4 and 0, in two orders: 0.8 and 0.7999999999999999 as plain sums of rows."""
    return [(1, q, less, tax, "F", datetime(1996, 1, 1) + timedelta(weeks=w)) for w in range(12) for q, less, tax in ((0.1, 0.0, 3.0), (0.3, 0.0, 0.0), (0.4, 0.75, 0.0), (0.0, 0.0, 0.0))]


@pytest.mark.parametrize("name", ["hourly_alerts", "daily_alerts", "alert_files", "stream_hourly_alerts", "stream_daily_alerts"])
@pytest.mark.parametrize("step", [1, -1])
def test_a_value_that_equals_its_threshold_is_not_over_it(spark, tmp_path, name, step):
    got = registry.queries()[name](spark, lineitem(tmp_path, weeks_of_ties()[::step])).collect()
    assert len(got) == 12 and {(r.affected_cells, r.alert_level, r.mean_exceedance_c) for r in got} == {(0, "normal", 0.0)}


def test_stations_with_equal_errors_are_in_order_of_their_names(spark, tmp_path):
    """Errors of 0.1, 0.3, 0.4 and 0 in two orders, each station's own: plain sums put 2 and 4 before 1 and 3."""
    errors = {1: (0.1, 0.3, 0.4, 0.0), 2: (0.4, 0.3, 0.1, 0.0), 3: (0.1, 0.3, 0.4, 0.0), 4: (0.4, 0.3, 0.1, 0.0)}
    rows = [(k, q, 0.0, 1.0, "F", datetime(1996, 1, 1)) for k, own in errors.items() for q in own]
    got = registry.queries()["station_model_matrix"](spark, lineitem(tmp_path, rows)).collect()
    assert [(r.station_id, r.order, r.F, r.O) for r in sorted(got, key=lambda r: r.order)] == [(str(k), k, 0.2, None) for k in (1, 2, 3, 4)]

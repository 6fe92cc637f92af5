"""Fleet queries over more devices than a page holds."""

import json
from datetime import datetime

from rigsense.queries import load


def test_filter_reads_the_whole_fleet(spark, tmp_path):
    risky = [20_000 + i for i in range(5_500)]  # all of them rank before the devices looked for
    devices = [(u, 99) for u in risky] + [(u, 80) for u in (1, 10, 11)]
    rows = [(3 * i, datetime(2024, 1, 20), u, "view", 1.0, json.dumps({"k": k})) for i, (u, k) in enumerate(devices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    found = load()[0]["fleet_filter"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("m-1", "critical"), ("m-10", "critical"), ("m-11", "critical")]

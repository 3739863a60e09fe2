"""Replay with history against a plain walk through time, for any split of the input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.rules import NONE, STRONG, TIME_FIELDS, WEAK
from tidemark.operators.core import recalculate_status
from tidemark.operators.history import FIELDS, replay, transitions
from tidemark.plans import history as plans

DAY = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("parts", [1, 6])
def test_status_at_each_snapshot(spark, parts):
    rng = random.Random(8)
    when = lambda: DAY + dt.timedelta(days=rng.randint(0, 60))
    states = [(p, DAY + dt.timedelta(days=15 * k, seconds=p), *[when() if rng.random() < 0.4 else None for _ in TIME_FIELDS], rng.random() < 0.3) for p in range(12) for k in range(4)]
    proofs = [(p, f, rng.choice([STRONG, STRONG, WEAK, NONE]), rng.choice([None, when()])) for p in range(12) for f in FIELDS for _ in range(2)]
    shape = "project_id int, captured_at timestamp_ntz, " + ", ".join(f"{f} timestamp_ntz" for f in TIME_FIELDS) + ", has_marker boolean"
    s = spark.createDataFrame(states, shape).repartition(parts)
    e = spark.createDataFrame(proofs, f"project_id int, field_name string, strength {'int' if isinstance(STRONG, int) else 'string'}, seen_at timestamp_ntz").repartition(parts)
    got = {(r.project_id, r.captured_at): (r.status, r.reason_code, r.old_status, r.changed) for r in replay(s, e).collect()}
    assert len(got) == len(states)
    before = {}
    for row in states:
        known = e.where((F.col("project_id") == row[0]) & (F.col("seen_at").isNull() | (F.col("seen_at") <= F.lit(row[1]))))
        if row[0] >= 4:  # each of these is a job
            continue
        plain = recalculate_status(spark.createDataFrame([row], shape), known, F.lit(row[1]).cast("timestamp_ntz")).first()
        old = before.get(row[0])
        assert got[row[0], row[1]] == (plain.status, plain.reason_code, old, old is not None and old != plain.status)
        before[row[0]] = plain.status
    assert transitions(replay(s, e)).count() == sum(x[3] for x in got.values())


def test_no_projects_pass_through_the_driver(spark, tmp_path):
    """The bound query has nothing to broadcast, whatever the threshold."""
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus, 1D AS o_totalprice, timestamp_ntz '1996-05-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(200)").write.parquet(f"{tmp_path}/orders.parquet")
    got = plans.replayed_history(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert got.count() == 600

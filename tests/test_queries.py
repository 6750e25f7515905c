"""Every query of the engine against its SQL, and the ones without SQL against what they must hold."""

import parity
import pytest

import __spark_entry__
from corvane.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, name):
    parity.compare(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_planted_loops_are_found(spark):
    found = QUERIES["loop_find"](spark, SF).collect()
    assert found and all(abs(r["period"] - 2400) < 0.05 and 0 <= r["intro"] <= 1100 for r in found)


def test_twins_lead_to_their_original(spark):
    found = QUERIES["sound_twins"](spark, SF).collect()
    assert found and all(r["item"] == r["leader"] + 1_000_000 for r in found)


def test_progress_against_a_loop(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    state = {}
    for r in rows:
        now, total, least = state.get(r["user_id"], (None, 0, 0))
        left = int(r["value"] // 1)
        if r["event_type"] != now or left > least:
            now, total = r["event_type"], left
        state[r["user_id"]] = (now, total, left)
    got = {int(r["job"]): (r["pass"], r["total"], r["total"] - r["done"]) for r in QUERIES["progress_stream"](spark, SF).collect()}
    assert got == state

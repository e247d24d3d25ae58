"""The registered queries against their SQL on the smallest tables.

By default one query per family runs; TRUEGAUGE_ALL=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_TINY
from verification.check import TABLES, compare

FAMILIES = ("a01_manifest", "b01_backend_agreement", "c06_densify", "c12_peri_event", "d06_state_epochs",
            "e05_held_out_region", "e12_interleaved", "g01_shared_bins_trials", "h07_pool_units",
            "k04_contract_choice", "k04_contract_per_session", "l05_transition_lags", "m02_auroc", "n03_capability_report",
            "o08_risk_coverage", "u04_conformal_sets", "z01_untraceable_numerals")
NAMES = sorted(entry.queries()) if os.environ.get("TRUEGAUGE_ALL") else FAMILIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_TINY}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    text, ok = compare(name, entry.queries()[name](spark, SF_TINY), duck)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_the_contract(spark):
    frame = entry.entry(spark)
    assert "null_trialstruct" in frame.columns and frame.count() > 0

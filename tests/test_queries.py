"""Every registered query with SQL against DuckDB on the smallest tables, if they are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarryline import queries_directory, queries_texts, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = (
    "phone_directory phone_parse_classes text_normalize fingerprints html_strip filter_search anti_join_orders detail_with_children group_counts coverage_by_region relevance_scores confidence_scores status_ladder blocking_pairs canonical_choice merge_remap conflict_flags validation_history query_plan ledger_admission queue_claim export_rows failure_streaks "
    "robots_verdicts robots_rates paced_fetches paced_shipments adapter_items item_candidates leased_items bucketed_totals observed_stream recorded_exports ladder_verdicts"
).split()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    flat = lambda d: d[columns].astype(object).where(d[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)
    assert flat(a).equals(flat(b))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


#: Every second query of those that run the operators themselves; the others run in the same way.
OWN = sorted(n for n, f in registry.QUERIES.items() if f.__module__ in (queries_directory.__name__, queries_texts.__name__))[::2]


@pytest.mark.parametrize("name", [*NAMES, *OWN])
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

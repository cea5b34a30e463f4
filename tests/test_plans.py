"""Plan checks: pushdown, pruning, no Python in the hot path, bounded
windows, shuffle reuse."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mercato.plans.inspect import explain_text, has_python, unpartitioned_windows

QUERIES = {name: entry.queries()[name] for name in entry.REPORTS}


def _plan(spark, sf_dir, name):
    return explain_text(QUERIES[name](spark, sf_dir), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cartesian_no_unbounded_window(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert not has_python(df)
    assert "CartesianProduct" not in explain_text(df)
    assert unpartitioned_windows(df) == [], name


def test_global_window_detector(spark, sf_dir):
    whole = spark.range(9).withColumn("r", F.rank().over(Window.orderBy(F.desc("id"))))
    assert unpartitioned_windows(whole)
    assert not unpartitioned_windows(QUERIES["top_categories_per_state"](spark, sf_dir))


def test_silver_dedup_limits_before_shuffle(spark, sf_dir):
    # staged sources are plain parquet: a partial limit runs before the
    # shuffle, so a hot order sends at most one row per map task
    for name in ("items_silver", "reviews_silver"):
        text = _plan(spark, sf_dir, name)
        assert "WindowGroupLimit" in text and "Partial" in text, name


def test_bucketed_staging_removes_the_shuffle(spark, sf_dir):
    from mercato.operators import quality
    from mercato.sources import stand_in_tables
    from mercato.sources.staging import stage_tables
    t = stage_tables(spark, stand_in_tables(spark, sf_dir), f"{sf_dir}#b", buckets=8)
    for df in (quality.items_silver(t.items), quality.reviews_silver(t.reviews)):
        text = explain_text(df)
        assert "WindowGroupLimit" in text and "Exchange (" not in text


def test_silver_dedup_limits_before_shuffle_on_raw_sources(spark, sf_dir):
    from mercato.operators import quality
    from mercato.sources import stand_in_tables
    t = stand_in_tables(spark, sf_dir)
    for df in (quality.items_silver(t.items), quality.reviews_silver(t.reviews)):
        text = explain_text(df)
        assert "WindowGroupLimit" in text and "Partial" in text


def _first_scan(text):
    return text.split("(1) Scan parquet", 1)[1].split("\n\n", 1)[0]


def test_filters_reach_the_scan_and_columns_are_pruned(spark, sf_dir):
    scan = _first_scan(_plan(spark, sf_dir, "order_status_counts"))
    assert "ReadSchema: struct<order_status:string>" in scan
    assert "PushedFilters: [IsNotNull(order_status)]" in scan
    text = _plan(spark, sf_dir, "seller_cancellations")
    assert "EqualTo(order_status,canceled)" in text


def test_raw_source_scans_are_pruned(spark, sf_dir):
    from mercato.operators import sales
    from mercato.sources import stand_in_tables
    text = explain_text(sales.order_status_counts(stand_in_tables(spark, sf_dir)))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in _first_scan(text)


def test_means_are_scalar_subqueries_not_windows(spark, sf_dir):
    for name in ("price_outliers", "freight_outliers", "order_value_outliers", "delayed_orders"):
        text = _plan(spark, sf_dir, name)
        assert "Subquery" in text and "Window (" not in text, name


def test_rfm_thresholds_run_once(spark, sf_dir):
    df = QUERIES["rfm_segments"](spark, sf_dir)
    df.collect()
    text = explain_text(df, "formatted")
    executed = [l for l in text.splitlines()
                if l.startswith("Subquery:") and "ReusedSubquery" not in l]
    assert len(executed) == 1, executed


def test_reports_read_stored_tables(spark, sf_dir):
    """Reports over the silver items carry no de-duplication, H24 no quantile step."""
    for name in ("aov_monthly", "category_revenue", "customer_lifetime_value",
                 "revenue_by_customer_state", "delivery_days_by_state"):
        assert "WindowGroupLimit" not in _plan(spark, sf_dir, name), name
    text = _plan(spark, sf_dir, "best_customer_payments")
    assert "Subquery" not in text and "percentile" not in text


def test_facts_are_reduced_before_product_and_order_shuffles(spark, sf_dir):
    """Every exchange above a scan of items or reviews follows a partial aggregate
    or is a semi join's distinct key."""
    for name in ("state_service_profile", "state_profile_top_categories", "delivery_days_by_state",
                 "delivery_days_by_category", "score_vs_delays"):
        lines = explain_text(QUERIES[name](spark, sf_dir), "simple").splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line and ("price" in "".join(lines[i:i + 6])
                                                        and "FileScan" in "".join(lines[i:i + 4])):
                assert "HashAggregate" in "".join(lines[i:i + 3]), (name, lines[i:i + 4])

import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.operators import quality, rfm, sales
from mercato.plans.materialize import store_scores, store_silver
from mercato.sources import ConflictError, LazyTables, read_table, update_table, write_table
from mercato.sources.files import drop_old_versions, input_state, version_number
from mercato.sources.staging import stage_tables
from tests.fixtures import item, make_tables, order, review


def test_store_and_read_back_silver_and_scores(spark):
    t = make_tables(spark, orders=[order("o1", approved=None), order("o2",
                                                                     approved="2018-01-02 00:00:00")],
                    items=[item("o1", 2, price=3), item("o1", 1, price=2), item("o2", 1, price=5)],
                    reviews=[review("r2", "o1"), review("r1", "o1")])
    folder = tempfile.mkdtemp(prefix="mercato-test-")
    s = store_silver(spark, t, folder)
    assert sorted((r.order_id, r.order_item_id) for r in s.items.collect()) == [("o1", 1),
                                                                                ("o2", 1)]
    assert [r.review_id for r in s.reviews.collect()] == ["r1"]
    assert s.orders.filter("order_approved_at IS NULL").count() == 0
    assert sales.aov_all_time(s.items).first().total_revenue == 7.0
    scores = rfm.rfm_scores(t, as_of="2018-02-01")
    back = store_scores(spark, scores, folder)
    assert sorted(back.collect()) == sorted(scores.collect())


def _items(spark, price):
    return make_tables(spark, orders=[order("o1")], items=[item("o1", 1, price=price)])


def test_stored_bundles_keep_their_data(spark):
    a, b = (store_silver(spark, _items(spark, p)) for p in (3, 4))
    assert [float(t.items.first().price) for t in (a, b)] == [3.0, 4.0]
    again = store_silver(spark, a)
    assert float(again.items.first().price) == float(a.items.first().price) == 3.0


def test_replacing_a_table_keeps_its_readers(spark):
    folder = tempfile.mkdtemp(prefix="mercato-test-")
    first = store_silver(spark, _items(spark, 3), folder)
    second = store_silver(spark, _items(spark, 4), folder)
    own = store_silver(spark, second, folder)  # reads what it replaces
    assert [float(t.items.first().price) for t in (first, second, own)] == [3.0, 4.0, 4.0]
    path = f"{folder}/items_silver"
    assert drop_old_versions(spark, path) == 2
    assert float(read_table(spark, path).first().price) == 4.0


def test_failed_write_leaves_the_table(spark):
    folder = tempfile.mkdtemp(prefix="mercato-test-")
    write_table(spark.range(3), f"{folder}/t")
    with pytest.raises(Exception):
        write_table(spark.range(5).selectExpr("assert_true(id < 2) AS x", "id"), f"{folder}/t")
    assert read_table(spark, f"{folder}/t").count() == 3


def test_changed_input_is_staged_anew(spark):
    source, folder = (tempfile.mkdtemp(prefix="mercato-test-") for _ in range(2))
    made = []

    def tables():
        made.append(1)
        return LazyTables({"items": lambda: spark.read.parquet(f"{source}/in"),
                           "never": lambda: pytest.fail("not asked for")})

    counts = []
    for n in (2, 2, 5):
        if n == 5 or not counts:
            spark.range(n).write.mode("overwrite").parquet(f"{source}/in")
        state = input_state(spark, [f"{source}/in"])
        counts.append(stage_tables(spark, tables(), state, folder).items.count())
    assert counts == [2, 2, 5]


def test_of_two_writers_one_gets_a_conflict(spark):
    path = tempfile.mkdtemp(prefix="mercato-test-") + "/t"
    assert write_table(spark.range(3), path) == 1
    base = version_number(spark, path)  # both start here
    assert write_table(spark.range(4), path, base=base) == 2
    with pytest.raises(ConflictError, match="version 2"):
        write_table(spark.range(5), path, base=base)
    assert read_table(spark, path).count() == 4
    with pytest.raises(ConflictError):
        update_table(spark, path, F.col("id") == 1, {"id": F.lit(9)}, base=base)
    assert write_table(spark.range(5), path) == 3 and read_table(spark, path).count() == 5
    assert drop_old_versions(spark, path) >= 2 and read_table(spark, path).count() == 5
    # in any session, a writer that begins and ends between another's begin and end wins
    late = spark.range(6).select(F.col("id"))
    begun = version_number(spark, path)
    write_table(spark.range(7), path)
    with pytest.raises(ConflictError):
        write_table(late, path, base=begun)


def test_update_rewrites_only_files_with_a_match(spark):
    path = tempfile.mkdtemp(prefix="mercato test-") + "/orders"
    t = make_tables(spark, orders=[
        order(f"o{i:03d}", approved=None if i in (7, 8, 55) else "2018-01-02 00:00:00") for i in range(100)])
    write_table(t.orders.repartitionByRange(10, "order_id").sortWithinPartitions("order_id"), path)
    before = read_table(spark, path)
    files = set(before.inputFiles())
    assert quality.fill_missing_approval(spark, path) == 2
    after = read_table(spark, path)
    name = lambda df: {f.rsplit("/", 1)[1] for f in df.inputFiles()}
    assert len(files) == 10 and len(name(before) & name(after)) == 8
    assert sorted(after.collect()) == sorted(quality.orders_silver(t.orders).collect())
    assert before.where("order_approved_at IS NULL").count() == 3  # its readers keep their files
    assert quality.fill_missing_approval(spark, path) == 0 and version_number(spark, path) == 2
    # a second update mixes three generations of files; cleaning up keeps those in use
    assert update_table(spark, path, F.col("order_id") == "o099", {"order_status": F.lit("canceled")}) == 1
    assert drop_old_versions(spark, path) == 0
    again = read_table(spark, path)
    assert again.count() == 100 and again.where("order_status = 'canceled'").count() == 1
    assert again.schema == after.schema
    write_table(again, path)
    assert drop_old_versions(spark, path) == 3 and read_table(spark, path).count() == 100


def test_partitioned_tables_are_not_updated(spark):
    path = tempfile.mkdtemp(prefix="mercato-test-") + "/t"
    write_table(spark.range(6).selectExpr("id", "id % 2 AS p"), path, ["p"])
    assert read_table(spark, path).where("p = 1").count() == 3
    with pytest.raises(ValueError, match="partitions"):
        update_table(spark, path, F.col("id") == 1, {"id": F.lit(9)})

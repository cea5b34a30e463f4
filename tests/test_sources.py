"""Reading an export (CSV with headers or parquet) with explicit schemas."""

import tempfile

from pyspark.sql import functions as F

from mercato.operators import quality, sales
from mercato.sources import read_export
from mercato.sources.schema import SOURCE_SCHEMAS
from tests.fixtures import item, make_tables, order


def _write_export(spark, t, fmt, folder):
    for name in t.names():
        df = getattr(t, name)
        full = SOURCE_SCHEMAS[name]
        # the export carries every column of its schema, in schema order
        cols = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in full.fields]
        out = df.select(*cols).coalesce(1).write.mode("overwrite")
        path = f"{folder}/{name}_file.{fmt}"
        (out.option("header", "true").csv(path) if fmt == "csv" else out.parquet(path))
    return {name: f"{name}_file" for name in t.names()}


def test_read_export_csv_and_parquet(spark):
    t = make_tables(spark, orders=[order("o1", approved="2018-01-02 03:04:05"),
                                   order("o2", approved=None)],
                    items=[item("o1", 1, price="10.50"), item("o2", 1, price=4)])
    for fmt in ("csv", "parquet"):
        folder = tempfile.mkdtemp(prefix=f"mercato-export-{fmt}-")
        files = _write_export(spark, t, fmt, folder)
        back = read_export(spark, folder, fmt=fmt, files=files)
        assert back.items.schema["price"].dataType.simpleString() == "decimal(18,2)"
        assert back.orders.filter("order_approved_at IS NULL").count() == 1
        aov = sales.aov_all_time(quality.items_silver(back.items)).first()
        assert (aov.total_revenue, aov.average_order_value) == (14.5, 7.25)

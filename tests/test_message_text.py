from pyspark.sql import functions as F

from tallyhouse import catalog

SF = "/root/testdata/sf0.001"


def test_a_message_has_one_text_in_whatever_order_its_rows_come(spark, tmp_path):
    """Else two readings of it fall into different halves of a delivery, and messages come twice or never."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    for name, order in (("up", "l_linenumber"), ("down", "l_linenumber desc")):
        items.selectExpr("*", f"row_number() over (partition by l_orderkey order by {order}) n").orderBy("n").drop("n").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
    up, down = (sorted(r["value"] for r in catalog._item_text(spark, f"{tmp_path}/{name}").collect()) for name in ("up", "down"))
    assert up == down and len(up) > 100


def test_messages_are_made_once(spark, monkeypatch):
    """Items that have other keys whenever they are read: each half was of a reading of its own."""
    key = F.col("id") + F.unix_micros(F.current_timestamp()) * 1000
    items = lambda s, d: s.range(400).select(key.alias("transaction_id"), F.lit(1).cast("long").alias("item_id"), F.lit(2).cast("long").alias("quantity"), F.lit(3.0).alias("subtotal"))
    monkeypatch.setattr(catalog.D, "items", items)
    folder = catalog._messages_in_two_runs(spark, SF)
    assert spark.read.text(f"{folder}/in").count() == 400
    assert len({int(r["transaction_id"]) // 1000 for r in spark.read.parquet(f"{folder}/rows").collect()}) == 1

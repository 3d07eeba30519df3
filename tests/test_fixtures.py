"""The derived views hold cases of the rules: no job's result is what it would be without its rule."""

from pyspark.sql import functions as F

from quarry.plans import fixtures as fx
from quarry.plans.queries import REGISTRY
from quarry.sources.tables import Tables
from tests.conftest import SF0001


def rows(spark, key):
    return REGISTRY[key](spark, SF0001).collect()


def test_page_rules_have_cases(spark):
    shop = fx.shop_pages_fx(Tables(spark, SF0001)).cache()
    assert all("<input" not in r.html for r in rows(spark, "strip_inputs")) and shop.filter("html like '%<input%'").count() == shop.count()
    assert all("Your coupon" not in r.text for r in rows(spark, "drop_boilerplate")) and shop.filter("html like '%Your coupon%'").count() == shop.count()
    assert any("after the form" in r.text and "Buy now" not in r.text and "one choice" not in r.text for r in rows(spark, "drop_boilerplate"))
    seed = {r.depth == 0: "Shop header" in r.html for r in rows(spark, "strip_elements_seed")}
    assert seed == {True: True, False: False}
    assert 0 < len(rows(spark, "drop_untitled")) < shop.count()
    assert {r.ps_num == "N/A" for r in rows(spark, "url_part_num")} == {True, False}
    kept = {r.abs_url for r in rows(spark, "filter_links")}
    assert not any("elsewhere" in u or "ShoppingCart" in u for u in kept) and any("/page-" in u for u in kept)


def test_chunk_and_answer_rules_have_cases(spark):
    overlap, bare = rows(spark, "chunk_paragraphs"), rows(spark, "chunk_paragraphs_no_overlap")
    n = Tables(spark, SF0001).documents.count()
    assert len(overlap) > n and len(bare) > n and sorted(map(repr, overlap)) != sorted(map(repr, bare))
    assert {r.has_hits for r in rows(spark, "no_hit_answer")} == {True, False}
    quarter = REGISTRY["knn_postfilter_quarter"](spark, SF0001)
    whole = REGISTRY["knn_filtered"](spark, SF0001)
    assert 0 < quarter.count() < whole.count()
    assert quarter.join(whole, ["conv_id", "turn", "chunk_id"], "left_anti").count() == 0


def test_upsert_keeps_and_replaces(spark):
    sizes = REGISTRY["upsert_index"](spark, SF0001).select((F.col("depth") >= 3).alias("again"), F.length("text").alias("n")).collect()
    assert max(r.n for r in sizes if r.again) > 500 >= max(r.n for r in sizes if not r.again)

from pyspark.sql import functions as F

from quarry.functions import ids


def run(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    ps = ids.query_part_num(F.col("q"))
    m = ids.resolve_id_clash(ids.query_model_num(F.col("q")), ps)
    return [(r.m, r.p, r.r) for r in df.select(m.alias("m"), ps.alias("p"), ids.route(m, ps).alias("r")).collect()]


def test_question_ids_punctuation_and_threshold(spark):
    assert run(spark, ["Fits (WDT780SAEM1)?", "Take 12 of them"]) == [
        ("WDT780SAEM1", "N/A", "model"), ("N/A", "N/A", "none")]


def test_id_clash(spark):
    assert run(spark, ["Is PS1234 ok", "PS1234-x"]) == [("N/A", "PS1234", "part"), ("PS1234-x", "PS1234", "both")]


def test_first_word_wins_ties(spark):
    assert run(spark, ["AB123 CD456"])[0][0] == "AB123"

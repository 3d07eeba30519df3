
from quarry.operators import metrics as MT


def test_no_hit_runs_add_time_but_do_not_count(spark):
    t = spark.createDataFrame([(1, 0, "search", 1.0, True), (1, 0, "model", 2.0, True),
                               (1, 1, "search", 3.0, False), (2, 0, "search", 0.5, True)],
                              "conv_id long, turn long, stage string, seconds double, answered boolean")
    tot = {r.stage: (r.seconds, r.runs) for r in MT.stage_totals(t).collect()}
    assert tot == {"search": (4.5, 2), "model": (2.0, 2)}
    avg = {r.stage: r.avg_seconds for r in MT.stage_averages(t).collect()}
    assert avg == {"search": 2.25, "model": 1.0}
    last = {(r.conv_id, r.stage): r.seconds for r in MT.last_run_stats(t).collect()}
    assert last[(1, "search")] == 3.0


def test_no_runs_no_average(spark):
    t = spark.createDataFrame([(1, 0, "search", 1.0, False)],
                              "conv_id long, turn long, stage string, seconds double, answered boolean")
    assert MT.stage_averages(t).count() == 0

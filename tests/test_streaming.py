from loreline.streaming import event_log


def test_stream_removes_repeats(spark, tmp_path):
    spark.sql("select id % 50 as event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as ts, 'view' as event_type, 1.0 as value from range(100)").write.parquet(f"{tmp_path}/events.parquet")
    ev = event_log.read_events(spark, f"{tmp_path}/events.parquet")
    assert event_log.run(event_log.deduplicated(ev)).count() == 50


def test_tumbling_counts_every_event(spark, tmp_path):
    at = f"{tmp_path}/events.parquet"
    for part in ("select id as event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,id) as ts, if(id % 2 = 0, 'view', 'click') as event_type, cast(id as double) as value from range(60)", "select 60 as event_id, timestamp'2024-01-01 05:00:00' as ts, 'view' as event_type, 100.0D as value"):  # the second file is late
        spark.sql(part).write.mode("append").parquet(at)
    got = event_log.run(event_log.tumbling(event_log.read_events(spark, at)), "complete").collect()
    want = {}
    for i, hour, value in [(i, i, float(i)) for i in range(60)] + [(60, 5, 100.0)]:
        n, v, m = want.get((1 + hour // 24, i % 2 == 0), (0, 0.0, 0.0))
        want[1 + hour // 24, i % 2 == 0] = (n + 1, v + value, max(m, value))
    assert {(r.window_start.day, r.event_type == "view"): (r.events, r.value, r.most) for r in got} == want and len(got) == len(want)


def test_tumbling_of_an_empty_log(spark, tmp_path):
    spark.sql("select id as event_id, timestamp'2024-01-01' as ts, 'view' as event_type, 1.0 as value from range(0)").write.parquet(f"{tmp_path}/events.parquet")
    assert event_log.run(event_log.tumbling(event_log.read_events(spark, f"{tmp_path}/events.parquet")), "complete").count() == 0

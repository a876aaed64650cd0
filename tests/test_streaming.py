from pyspark.sql import functions as F

from bundlelens.streaming import requests

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    """The events as files of a stream, in order of time."""
    events = spark.read.parquet(EVENTS).orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def run(df, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


def test_windows_agree_with_the_batch(spark, tmp_path):
    batch = {tuple(r) for r in requests.by_window(spark.read.parquet(EVENTS), "6 hours").collect()}
    found = run(requests.by_window(stream(spark, tmp_path), "6 hours"), "windows")
    # windows that the last watermark hasn't passed are still open
    last = spark.read.parquet(EVENTS).agg(F.max("ts")).first()[0]
    closed = {r for r in batch if (last - r[1].replace(tzinfo=None)).total_seconds() > 3 * 3600}
    assert found <= batch and closed <= found and closed


def test_sessions_agree_with_the_batch(spark, tmp_path):
    batch = {tuple(r) for r in requests.sessions(spark.read.parquet(EVENTS)).collect()}
    found = run(requests.sessions(stream(spark, tmp_path)), "sessions")
    assert found <= batch and len(found) > 0.5 * len(batch)


def test_first_requests(spark, tmp_path):
    n = spark.read.parquet(EVENTS).select("user_id", "event_type").distinct().count()
    assert requests.first_requests(spark.read.parquet(EVENTS), ["user_id", "event_type"]).count() == n
    df = requests.first_requests(stream(spark, tmp_path), ["event_id"], "1 hour").select("event_id")
    assert len(run(df, "firsts")) == spark.read.parquet(EVENTS).count()

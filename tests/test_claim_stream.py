"""The stream's last word on a claim is what the batch says of all its events."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import lifecycle
from mnemolake.streaming.claims import claim_states

KINDS = ["create", "update", "challenged", "contradiction", "code_drift_detected", "expire", "correct", "seen"]
SCHEMA = "claim_id string, n long, event_type string, created_at timestamp"


def rows():
    """Forty claims' events over twenty days, two hours apart at least from their neighbours, in no order within a file."""
    start = pd.Timestamp("2024-01-01", tz="UTC")
    out = [(f"c{i * 7 % 40}", i % 3, KINDS[(i * i + i // 11) % 8], start + pd.Timedelta(hours=2 * i + (i % 2))) for i in range(240)]
    return [("tie", 1, "update", start), ("tie", 1, "challenged", start), ("old", 0, "challenged", start), ("old", 0, "contradiction", start + pd.Timedelta(days=1)), ("settled", 0, "challenged", start), ("settled", 0, "update", start + pd.Timedelta(days=2)), *out]


def test_stream_equals_batch(spark, tmp_path):
    events = rows()
    frame = pd.DataFrame(events, columns=["claim_id", "n", "event_type", "created_at"])
    files = [frame.iloc[k * 48 : (k + 1) * 48].sample(frac=1, random_state=k) for k in range(6)]
    tick = pd.DataFrame([("tick", 0, "seen", pd.Timestamp("2024-02-01", tz="UTC"))], columns=frame.columns)
    (tmp_path / "in").mkdir()
    for k, f in enumerate([*files, tick, tick]):
        pq.write_table(pa.Table.from_pandas(f.astype({"n": "int64", "created_at": "datetime64[us, UTC]"}), preserve_index=False), tmp_path / f"in/{k}.parquet")
        (tmp_path / f"in/{k}.parquet").touch()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    told: list[dict] = []
    run = claim_states(stream, ttl_hours=100, late="100 hours").writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, n: told.extend(r.asDict() for r in df.collect())).start()
    run.awaitTermination(600)
    last = {r["id"]: (r["last"], r["state"]) for r in told}
    batch = spark.createDataFrame(frame.astype({"n": "int64"}), SCHEMA)
    want = {r["id"]: (r["last"], r["state"]) for r in lifecycle.with_ttl(batch, "2024-01-27", 100).collect()}  # the watermark at the end
    assert last == want
    assert last["tie"] == last["old"] == ("auto_expired_challenged", "expired") and last["settled"] == ("update", "active")
    assert any(r["state"] == "challenged" and r["id"] == "old" for r in told)  # it was told before its time was over


@pytest.mark.parametrize(("hours", "state"), [(24, "expired"), (48.5, "challenged"), (48, "expired")])
def test_time_to_live(spark, hours, state):
    df = spark.createDataFrame([("a", 0, "challenged", "2024-01-01"), ("a", 1, "contradiction", "2024-01-02"), ("b", 0, "contradiction", "2024-01-01"), ("c", 0, "challenged", "2024-01-01"), ("c", 1, "update", "2024-01-02"), ("d", 0, "challenged", "2024-01-04")], "claim_id string, n int, event_type string, at string").withColumn("created_at", F.to_timestamp("at"))
    got = {r["id"]: r["state"] for r in lifecycle.with_ttl(df, "2024-01-03", hours).collect()}
    assert got == {"a": state, "b": state, "c": "active"}

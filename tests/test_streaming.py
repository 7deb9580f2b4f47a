import json

import documents as D

from probeloom.streaming.ingest import ingest, snapshot_stream


def test_snapshots_are_taken_up_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    good = json.dumps(D.snapshot("baseline"))

    def deliver(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"snapshot_id": i, "received_at": f"2030-01-01T00:0{m}:00Z", "payload": p}) for i, m, p in rows))

    def run():
        seen = []
        query = ingest(snapshot_stream(spark, str(inbox)), "snapshot", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
        query.awaitTermination()
        return seen

    deliver("1.json", ("a", 0, good), ("a", 1, good), ("b", 1, "{"))
    assert sum(run()) == 1
    deliver("2.json", ("a", 2, good), ("c", 2, good))
    assert sum(run()) == 1
    assert sorted(r.snapshot_id for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a", "c"]
    assert [(r.snapshot_id, r.path) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("b", "$")]

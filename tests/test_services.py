"""The request log source and external memories."""

import json
import sys

from pyspark import cloudpickle

from recollect.providers import stub_extract
from recollect.sources import external, requests


def line(path=requests.ENDPOINT, **body):
    return json.dumps({"path": path, "sent": 3, "body": body}).encode()


def test_only_chat_requests_are_rows():
    said = [{"role": "user", "content": "é"}, {"role": "assistant", "content": None}]
    assert requests.parsed(line(user="u", messages=said)) == ("u", 3, [("user", "é"), ("assistant", None)])
    assert requests.parsed(line(messages=said))[0] == "default"
    for bad in (line("/v1/models", user="u", messages=said), line(user="u", messages=[]), line(user="u"), b"", b"{", b"[1]", b'{"path": 1}', line(user="u", messages=["x"])):
        assert requests.parsed(bad) is None


def test_stream_reads_each_file_once_and_goes_on_from_its_checkpoint(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}"
    log.mkdir()
    requests.registered(spark)

    def run():
        rows = spark.readStream.format("chat_requests").load(f"{path}/log")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        return sorted(r.namespace for r in spark.read.parquet(f"{path}/out").collect())

    text = lambda *users: b"\n".join([line(user=u, messages=[{"role": "user", "content": "x" * 3_000_000}]) for u in users] + [b"noise"])
    (log / "1.json").write_bytes(text("a", "b"))
    (log / "_SUCCESS").write_bytes(b"")
    assert run() == ["a", "b"]
    (log / "2.json").write_bytes(text("c"))
    assert run() == ["a", "b", "c"] and run() == ["a", "b", "c"]
    assert spark.read.format("chat_requests").load(f"{path}/log").count() == 3
    assert spark.read.format("chat_requests").load(f"{path}/none").count() == 0


class Refusing(external.FolderMemory):
    """Fails for what stub_extract refuses; queued for ever for slow."""

    def retain(self, namespace, source_id, text, metadata):
        stub_extract("bad")(text)
        return super().retain(namespace, source_id, text, metadata)

    def status(self, namespace, document_id):
        return "queued" if namespace == "slow" else super().status(namespace, document_id)


def test_a_service_is_asked_and_forgotten(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not see the tests
    client = Refusing(str(tmp_path / "memory"))
    assert not client.health()
    sessions = spark.createDataFrame([("n", "s1", "red fox\nblue hen"), ("n", "s2", "red red"), ("n", "s3", "bad"), ("slow", "s1", "red"), ("m", "s1", "green")], "namespace string, source_id string, text string")
    kept = external.retained(sessions, client).cache()
    assert {(r.namespace, r.source_id): (r.document_id is None, r.error) for r in kept.collect()}[("n", "s3")] == (True, "no answer")
    assert client.health()
    state = {(r.namespace, r.source_id): (r.status, r.polls) for r in external.readiness(kept, client, timeout_s=0.4).collect()}
    assert state[("n", "s1")] == ("done", 2) and state[("n", "s3")][0] == "failed" and state[("slow", "s1")][0] == "timeout"
    asked = spark.createDataFrame([("q1", "n", "Red hen?", 100), ("q2", "n", "red", 2), ("q3", "n", "nothing", 100), ("q4", "none", "red", 9)], "query_id string, namespace string, query string, budget_tokens bigint")
    got = {r.query_id: (r.context, r.sources, r.n_candidates) for r in external.recalled(asked, client).collect()}
    assert got == {"q1": ("- red fox\nblue hen\n- red red", ["s1", "s2"], 2), "q2": ("- red red", ["s2"], 2), "q3": ("", [], 0), "q4": ("", [], 0)}
    assert {r.namespace: r.deleted for r in external.forgotten(sessions.select("namespace"), client).collect()} == {"n": 2, "slow": 1, "m": 1}
    assert external.recalled(asked, client).filter("n_candidates > 0").count() == 0

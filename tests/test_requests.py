"""Requests and watch lists as streams, with restarts, against a fold and a batch."""

import random

from pyspark.sql import Row

from linkforge.streaming import requests as q

STATE = "urn string, status string, version long, holder string, taken_at long"


def rows(seed, n):
    r = random.Random(seed)
    return [(f"u{r.randrange(6)}" if r.random() < 0.97 else None, i, r.choice(["ACT", "ACT", "ACT", "LOCK", "UNLOCK", "SAVE", "odd"]), r.choice(["ann", "bob"]), i * 400, r.choice(["SUBMIT", "AUTHORISE", "REJECT", "RETURN_TO_DRAFT", "SUPPRESS", None]), r.choice([None, " ", "why"]), r.random() < 0.7, r.choice([None, 0, 1, 2, 3])) for i in range(n)]


def fold(standing, requests):
    held = {u: q.Report(s, v, h, t) for u, s, v, h, t in standing}
    out = []
    names = [c.split()[0] for c in q.REQUEST.split(", ")]
    for row in requests:
        r = dict(zip(names, row))
        if r["urn"] is None:
            continue
        before = held.get(r["urn"], q.Report(None))
        after, error = q.judged(before, r)
        held[r["urn"]] = after
        out.append((r["urn"], r["seq"], r["kind"], error is None, after.status, after.version, after.holder, error))
    return sorted(out, key=lambda x: x[1])


def test_a_stream_with_a_restart_equals_the_fold(spark, tmp_path):
    standing = [("u0", "DRAFT", 0, None, None), ("u1", "PENDING_AUTH", 2, "ann", 0), ("u2", "DRAFT", 0, None, None), ("u3", "REJECTED", 1, None, None), ("u4", "DRAFT", 0, None, None)]
    all_ = rows(1, 120)
    folder, path = str(tmp_path / "in"), f"file://{tmp_path}/out"

    def arrive(part, mode):
        spark.createDataFrame(part, q.REQUEST).coalesce(1).write.mode(mode).parquet(folder)

    def run():
        stream = spark.readStream.schema(q.REQUEST).option("maxFilesPerTrigger", 1).parquet(folder)
        return q.run(q.verdicts(stream, spark.createDataFrame(standing, STATE)), path)

    arrive(all_[:50], "overwrite")
    assert sorted(map(tuple, run().collect()), key=lambda x: x[1]) == fold(standing, all_[:50])
    arrive(all_[50:90], "append")
    arrive(all_[90:], "append")
    got = sorted(map(tuple, run().collect()), key=lambda x: x[1])
    assert got == fold(standing, all_) and len({x[4] for x in got}) > 3
    assert sorted(map(tuple, run().collect()), key=lambda x: x[1]) == got


def test_a_batch_judges_in_order_of_seq():
    report, verdicts = q.Report("DRAFT"), []
    for r in ({"kind": "ACT", "action": "SUBMIT", "who": "a", "at": 0}, {"kind": "ACT", "action": "AUTHORISE", "ready": True, "who": "a", "at": 0}, {"kind": "LOCK", "who": "a", "at": 5}, {"kind": "SAVE", "who": "b", "at": 6, "base": 2}, {"kind": "SAVE", "who": "b", "at": 1806, "base": 1}, {"kind": "SAVE", "who": "a", "at": 7, "base": 2}):
        report, error = q.judged(report, r)
        verdicts.append(error)
    assert verdicts == [None, None, None, "Locked by a", "Conflict: version 2, edit of 1", None] and report == q.Report("AUTHORISED", 3, "a", 5)


def test_watched_entities_once_each(spark, tmp_path):
    watch = spark.createDataFrame([("w1", "person", "r", "s1"), ("w1", "person", "r", "s2"), ("w2", "phone", "r", "s1")], "watch_id string, type string, rule string, sig string")
    kind = "urn string, id string, type string, rule string, sig string"
    one = [("r1", "e1", "person", "r", "s1"), ("r1", "e1", "person", "r", "s2"), ("r2", "e2", "phone", "r", "s1"), ("r2", "e3", "phone", "r", "s9")]
    two = [("r1", "e1", "person", "r", "s1"), ("r3", "e4", "person", "r", "s2"), (None, None, "phone", "r", "s1")]
    folder, path = str(tmp_path / "in"), f"file://{tmp_path}/out"

    def run():
        return sorted(map(tuple, q.watched(spark.readStream.schema(kind).parquet(folder), watch, path).collect()), key=str)

    spark.createDataFrame(one, kind).write.parquet(folder)
    assert run() == [("w1", "r1", "e1"), ("w2", "r2", "e2")]
    spark.createDataFrame(two, kind).write.mode("append").parquet(folder)
    both = spark.createDataFrame(one + two, kind).join(watch, ["type", "rule", "sig"]).select("watch_id", "urn", "id").distinct()
    assert run() == sorted(map(tuple, both.collect()), key=str) == run()


def test_a_report_costs_no_frames_and_no_needless_calls_to_its_state():
    class Held:
        def __init__(self, value=None):
            self.value, self.calls = value, []

        def getValueState(self, name, kind):  # noqa: N802
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    def asked(*requests):
        return iter([Row(urn="u", seq=seq, kind="ACT", who="a", at=0, action=action, reason=None, ready=True, base=None) for seq, action in requests])

    judge, held = q.Judge(), Held()
    judge.init(held)
    judge.handleInitialState(("u",), Row(urn="u", status="DRAFT", version=None, holder=None, taken_at=None), None)
    out = [tuple(r) for r in judge.handleInputRows(("u",), asked((None, "odd"), (2, "AUTHORISE"), (1, "SUBMIT")), None)]
    assert [(x[1], x[3], x[4], x[5]) for x in out] == [(1, True, "PENDING_AUTH", 1), (2, True, "AUTHORISED", 2), (None, False, "AUTHORISED", 2)]
    assert held.calls == ["update", "update"] and held.value == ("AUTHORISED", 2, None, None)
    list(judge.handleInputRows(("u",), asked((3, "odd")), None))
    assert held.calls == ["update", "update", "get"]
    unknown = Held()
    judge.init(unknown)
    assert [r["error"] for r in judge.handleInputRows(("v",), asked((1, "SUBMIT")), None)] == ["No such report."] and unknown.calls == ["get"]

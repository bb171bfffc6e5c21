"""Binary files written by the codec, read by Spark, against plain Python."""

import random

import pytest

from millrace.operators import journal as J
from millrace.operators import queue as Q
from millrace.sources import codec, spool


def mid(n):
    return n.to_bytes(8, "big") + (7 * n + 1).to_bytes(8, "big")


def place(segment, offset, generation=0, length=512):
    return {"shard": 0, "segment": segment, "offset": offset, "length": length, "ordinal": 0, "generation": generation}


def test_records_round_trip_and_every_header_flip_is_seen():
    raw = codec.encode_record(mid(3), -(10**12), "a@b.c", ["x@y.z", "é@y.z"], b"body", 42, 7)
    r = codec.decode_header(memoryview(raw))
    assert (r["message_id"], r["enqueue_ms"], r["generation"], r["ordinal"], r["sender"], r["recipients"]) == (mid(3), -(10**12), 42, 7, "a@b.c", ["x@y.z", "é@y.z"])
    for k in range(r["header_len"]):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises(codec.Corrupt):
            list(codec.records(bytes(bad), bodies=True))
    bad = raw[:-1] + bytes([raw[-1] ^ 1])
    with pytest.raises(codec.Corrupt):
        list(codec.records(bad, bodies=True))
    assert list(codec.records(raw[:50], "stop")) == []
    for no in ([], ["x" * 65_536]):
        with pytest.raises(ValueError):
            codec.encode_record(mid(1), 0, "a", no, b"")


def plain_fold(entries):
    state, dead, tomb = {}, {}, set()

    def kill(i, loc):
        if (loc["segment"], i) not in tomb:
            tomb.add((loc["segment"], i))
            n = dead.setdefault(loc["segment"], [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + loc["length"]

    for e in entries:
        i, loc = e["id"], e["location"]
        if e["kind"] == codec.DEFERRED:
            state[i] = [loc, e["attempts"]]
        elif e["kind"] in (codec.DELIVERED, codec.BOUNCED):
            state.pop(i, None)
            kill(i, loc)
        else:
            new = e["new_location"]
            if i in state and new["generation"] > state[i][0]["generation"]:
                state[i][0] = new
                kill(i, loc)
            elif i in state:
                kill(i, new)
            else:
                if (loc["segment"], i) in tomb or (new["segment"], i) in tomb:
                    kill(i, new)
                kill(i, loc)
    return state, dead


def random_entries(n, seed):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        kind, i = rnd.choice([1, 1, 2, 3, 4, 4]), mid(rnd.randrange(12))
        e = {"kind": kind, "id": i, "location": place(rnd.randrange(1, 4), 512 * rnd.randrange(4), rnd.randrange(3))}
        if kind == 1:
            e |= {"attempts": rnd.randrange(9), "next_attempt_ms": rnd.randrange(10**12), "remaining": ["r@x.y"] * rnd.randrange(3), "last_error": "451 try later"}
        elif kind == 4:
            e["new_location"] = place(rnd.randrange(1, 9), 512 * rnd.randrange(4), rnd.randrange(4))
        else:
            e |= {"timestamp_ms": 5, "reason": "no"}
        out.append(e)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_against_plain_python(spark, tmp_path, seed):
    entries = random_entries(200, seed)
    folder = tmp_path / "shard-0000"
    folder.mkdir()
    raw = [codec.encode_entry(e) for e in entries]
    (folder / "journal-000000000001.log").write_bytes(b"".join(raw[:120]))
    (folder / "journal-000000000002.log").write_bytes(b"".join(raw[120:]) + raw[0][:9])
    (folder / "journal-2.log").write_bytes(b"junk")
    state, dead = plain_fold(entries)
    folded = J.fold(spool.state_entries(spark, str(tmp_path))).cache()
    got = {bytes(r.id): (r.location.segment, r.location.generation, r.attempts) for r in folded.where("state = 'deferred'").collect()}
    assert got == {i: (loc["segment"], loc["generation"], n) for i, (loc, n) in state.items()}
    assert {r.segment: [r.dead_records, r.dead_bytes] for r in J.dead_by_segment(folded).collect()} == dead


def test_list_show_and_stats(spark, tmp_path):
    folder = tmp_path / "shard-0000"
    folder.mkdir()
    recs = [codec.encode_record(mid(n), 1_752_000_000_000 + n, f"s{n}@x.y", ["r@x.y"], b"body %d" % n, ordinal=n) for n in range(5)]
    (folder / "segment-000000000001.open").write_bytes(b"".join(recs) + b"torn")
    offsets = [sum(map(len, recs[:n])) for n in range(5)]
    at = [place(1, o, length=len(r)) for o, r in zip(offsets, recs)]
    cp = {"replay_from": (2, 0), "cursor": (1, 0), "ready": [{"id": mid(0), "location": at[0], "attempts": 1, "enqueue_ms": 3, "remaining": []}], "deferred": [], "tombstones": [(1, [mid(4)])], "segment_stats": [(1, 0, 0, 1, 100)]}
    assert codec.decode_checkpoint(codec.encode_checkpoint(cp)) == cp
    (folder / "checkpoint").write_bytes(codec.encode_checkpoint(cp))
    (folder / "journal-000000000001.log").write_bytes(codec.encode_entry({"kind": 2, "id": mid(0), "location": at[0], "timestamp_ms": 1}))
    late = [{"kind": 1, "id": mid(1), "location": at[1], "attempts": 1, "next_attempt_ms": 60_000, "remaining": ["r@x.y"], "last_error": "451"}, {"kind": 2, "id": mid(3), "location": at[3], "timestamp_ms": 9}]
    (folder / "journal-000000000002.log").write_bytes(b"".join(map(codec.encode_entry, late)))
    rows = Q.queue_list(spark, str(tmp_path), 1_752_000_192_000).collect()
    assert [(r.message_id, r.state, r.age, r.attempts, r.next_attempt) for r in rows] == [
        (mid(0).hex().upper(), "ready", "3m12s", 1, "-"),
        (mid(2).hex().upper(), "ready", "3m11s", 0, "-"),
        (mid(1).hex().upper(), "deferred", "-", 1, "1970-01-01T00:01:00.000Z"),
    ]
    assert Q.queue_show(spark, str(tmp_path), mid(2)).first().sender == "s2@x.y"
    stats = Q.queue_stats(spark, str(tmp_path)).collect()
    assert [(r.shard, r.segment, r.dead_bytes, r.tombstones) for r in stats] == [(0, 1, len(recs[3]), 1), (0, None, len(recs[3]), 1), (None, None, len(recs[3]), 1)]
    assert stats[0].total_bytes == sum(map(len, recs)) + 4


def test_a_broken_chain_is_an_error(spark, tmp_path):
    folder = tmp_path / "shard-0003"
    folder.mkdir()
    raw = [codec.encode_entry(e) for e in random_entries(9, 4)]
    for k, n in enumerate((4, 5, 7)):
        (folder / f"journal-{n:012d}.log").write_bytes(b"".join(raw[3 * k : 3 * k + 3]))
    with pytest.raises(Exception, match="gap between 4 and 7"):
        Q.state(spark, str(tmp_path)).collect()
    (folder / "journal-000000000006.log").write_bytes(raw[0])
    assert spool.state_entries(spark, str(tmp_path)).count() == 10
    cp = {"replay_from": (5, len(raw[3])), "cursor": None, "ready": [], "deferred": [], "tombstones": [], "segment_stats": []}
    (folder / "checkpoint").write_bytes(codec.encode_checkpoint(cp))
    assert [(r.first, r.last, r.fault) for r in spool.journal_chain(spark, str(tmp_path), spool.checkpoint_jobs(spark, str(tmp_path))).collect()] == [(5, 7, None)]
    assert Q.state(spark, str(tmp_path)).count() > 0
    (folder / "checkpoint").write_bytes(codec.encode_checkpoint(cp | {"replay_from": (3, 0)}))
    with pytest.raises(Exception, match="goes on from journal 3"):
        Q.state(spark, str(tmp_path)).collect()
    (folder / "checkpoint").unlink()
    (folder / "journal-000000000005.log").write_bytes(raw[3] + raw[4][:7])  # torn, and not the last
    with pytest.raises(Exception, match="(?i)incomplete|corrupt|torn"):
        spool.state_entries(spark, str(tmp_path)).collect()


def test_cursor_and_point_reads(spark, tmp_path):
    folder = tmp_path / "shard-0000"
    folder.mkdir()
    recs = [codec.encode_record(mid(n), 1000 + n, "s@x.y", ["r@x.y"], b"body %d" % n, ordinal=n) for n in range(4)]
    (folder / "segment-000000000001.open").write_bytes(b"".join(recs))
    offsets = [sum(map(len, recs[:n])) for n in range(4)]
    cp = {"replay_from": (0, 0), "cursor": (1, offsets[2]), "ready": [], "deferred": [], "tombstones": [], "segment_stats": []}
    (folder / "checkpoint").write_bytes(codec.encode_checkpoint(cp))
    assert {bytes(r.id) for r in Q.live_messages(spark, str(tmp_path)).collect()} == {mid(2), mid(3)}
    [row] = spool.record_at(spark, str(tmp_path), 0, 1, offsets[1]).collect()
    assert (bytes(row.message_id), bytes(row.body), row.offset) == (mid(1), b"body 1", offsets[1])
    assert spool.record_at(spark, str(tmp_path), 0, 1, sum(map(len, recs))).count() == 0 == spool.record_at(spark, str(tmp_path), 0, 2, 0).count()


def test_older_store_and_events(spark, tmp_path):
    for d in ("queued", "deferred"):
        (tmp_path / d).mkdir()
    (tmp_path / "queued/a.json").write_bytes(b'FORMAT1 {"message_id":"a","from":"f@x","to":["t@x"],"queued_at":"2025-01-02T03:04:05Z"}\nline 1\nline 2')
    (tmp_path / "deferred/b.json").write_text('{"message_id":"b","from":"f@x","to":["t@x","u@x"],"body":"hello"}')
    (tmp_path / "deferred/b.meta.json").write_text('{"msg_id":"b","attempts":2,"last_attempt":"2025-01-01T00:00:00Z","next_attempt":"2025-01-01T01:00:00Z"}')
    got = {r.message_id: (r.body, r.status, len(r.to)) for r in spool.legacy_messages(spark, str(tmp_path)).collect()}
    assert got == {"a": ("line 1\nline 2", "queued", 1), "b": ("hello", "deferred", 2)}
    assert [(r.msg_id, r.attempts, r.last_error) for r in spool.legacy_meta(spark, str(tmp_path)).collect()] == [("b", 2, None)]
    (tmp_path / "log.json").write_text('{"timestamp":"t","level":"INFO","fields":{"message":"email delivery","job_id":"j","status":"deferred","smtp_response":"421 4.7.0 [TSS04]","delay_ms":"12","attempt":"1"}}\n{"fields":{"message":"other"}}\n')
    assert [(r.job_id, r.status, r.delay_ms, r.attempt) for r in spool.delivery_events(spark, str(tmp_path / "log.json")).collect()] == [("j", "deferred", 12, 1)]


def test_stream_of_segments_and_life_cycle(spark, tmp_path):
    from millrace.streaming.lifecycle import _after, discovered, lifecycle

    folder = tmp_path / "spool/shard-0000"
    folder.mkdir(parents=True)
    for s in (1, 2, 3):
        (folder / f"segment-{s:012d}.log").write_bytes(b"".join(codec.encode_record(mid(10 * s + n), n, "s@x", ["r@x"], b"b", ordinal=n) for n in range(4)))
    q = discovered(spool.payload_records(spark, str(tmp_path / "spool"), stream=True, per_trigger=1)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").select("message_ulid").distinct().count() == 12

    rnd, events = random.Random(4), []
    for lsn in range(300):
        kind = rnd.choice(["append", "claim", "claim", "due", "abandoned", "limited", "deferred", "delivered", "bounced"])
        events.append((rnd.randrange(6), lsn, kind, rnd.randrange(1, 6), rnd.choice([60, 120])))
    from collections import namedtuple

    event = namedtuple("event", "id lsn kind generation due_ms")
    want, states = [], {}
    for e in map(event._make, events):
        got = _after(states.get(e.id, (None, None, 0, 0, None)), e)
        if got:
            states[e.id] = got[0]
            want.append((e.id, *got[0], got[1]))
    schema = "id long, lsn long, kind string, generation long, due_ms long"
    for k in range(3):
        spark.createDataFrame(events[100 * k : 100 * k + 100] + events[max(0, 100 * k - 5) : 100 * k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle(stream).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((tuple(r) for r in spark.table("steps").collect()), key=repr) == sorted(want, key=repr)
    assert {r.id: r.n for r in spark.table("steps").groupBy("id").agg({"lsn": "max"}).withColumnRenamed("max(lsn)", "n").collect()} == {i: s[0] for i, s in states.items()}

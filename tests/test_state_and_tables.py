"""Streams that decide, writes that can be repeated, page files, containment of any size of page."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoin.operators import corrections
from quoin.sources import page_files, tables
from quoin.streaming import machines
from quoin.streaming.states import drained

# ── overlap of texts on a page ─────────────────────────────────────────────

ROWS = "id string, job_id string, page_number int, position long, category string, original_text string"


def kept_by_hand(rows):
    out = []
    for page in {(r[1], r[2]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[1], r[2]) == page), key=lambda r: ("ABCDEFGH".find(r[4]) % 99, r[3])):
            text = r[5].lower().strip()
            inside = lambda a, b: min(len(a), len(b)) >= 5 and (a in b or b in a)
            if not any(inside(text, k) for k in kept):
                kept.append(text)
                out.append(r[0])
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_equals_the_ordered_fold(spark, seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for i in range(600):
        job, page = f"j{rng.randint(0, 1)}", rng.randint(0, 2)
        text = "".join(rng.choice("abé ") for _ in range(rng.choice([0, 3, 4, 5, 5, 6, 8, 12, 20, 60])))
        if (job, page, text.strip().lower()) not in seen:
            seen.add((job, page, text.strip().lower()))
            rows.append((str(i), job, page, i, rng.choice("ABCDEFGHX"), text))
    frame = spark.createDataFrame(rows, ROWS)
    assert sorted(r.id for r in corrections.undominated(frame).collect()) == kept_by_hand(rows)


def test_a_chain_of_texts_is_settled_in_order(spark):
    # each text lies in the next: of five the first, and what it does not reach, stay
    rows = [(str(i), "j", 0, i, "A", "word" + "x" * (30 - i)) for i in range(20)] + [("y", "j", 0, 99, "A", "other text"), ("z", "k", 0, 1, "B", "xxxxx")]
    assert sorted(r.id for r in corrections.undominated(spark.createDataFrame(rows, ROWS)).collect()) == kept_by_hand(rows) == ["0", "y", "z"]
    links = [(str(i), "j", 0, i, "A", f"text{i:02d}text{i + 1:02d}" if i % 2 == 0 else f"text{i:02d}") for i in range(20)]
    assert sorted(r.id for r in corrections.undominated(spark.createDataFrame(links, ROWS)).collect()) == kept_by_hand(links)


def test_one_large_page_is_dealt_to_many_tasks(spark):
    rows = spark.range(60_000).select(F.col("id").cast("string"), F.lit("j").alias("job_id"), F.lit(0).alias("page_number"), F.col("id").alias("position"), F.lit("A").alias("category"), F.sha2(F.col("id").cast("string"), 256).alias("original_text"))
    pairs = corrections.containments(rows.select("job_id", "page_number", "position", F.lit(1).alias("p"), F.col("original_text").alias("k")))
    assert pairs.count() == 0
    assert corrections.undominated(rows.union(rows.limit(100).select(F.concat("id", F.lit("b")), "job_id", "page_number", F.col("position") + 100_000, F.lit("B"), F.substring("original_text", 5, 20)))).count() == 60_000


# ── streams ────────────────────────────────────────────────────────────────

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_job_states_follow_legal_transitions_and_timers(spark, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    events = [
        (1, hour(0), 1, "awaiting_confirmation"),
        (1, hour(1), 2, "pending"),
        (1, hour(2), 3, "extracting"),
        (1, hour(3), 4, "processing"),
        (1, hour(4), 5, "done"),
        (1, hour(5), 6, "processing"),  # nothing follows done
        (2, hour(0), 7, "done"),  # no job begins so
        (2, hour(1), 8, "awaiting_confirmation"),
        (2, hour(2), 9, "extracting"),
        (2, hour(9), 10, "processing"),  # has been an error since hour 8
        (2, hour(10), 11, "awaiting_confirmation"),
        (3, hour(1), 12, "awaiting_confirmation"),
        (3, hour(2), 13, "extracting"),  # stays so until its timer goes off
        (4, hour(1), 14, "awaiting_confirmation"),
        (5, hour(40), 15, "awaiting_confirmation"),
        (6, hour(41), 16, "processing"),  # never a job
    ]
    want = {1: ("done", hour(4), 5, 1, 0), 2: ("awaiting_confirmation", hour(10), 3, 2, 1), 3: ("error", hour(8), 2, 0, 1), 4: ("awaiting_confirmation", hour(1), 1, 0, 0), 5: ("awaiting_confirmation", hour(40), 1, 0, 0), 6: (machines.FORGOTTEN, hour(41), 0, 1, 0)}
    schema = "job_id long, ts timestamp, event_id long, status string"
    events.sort(key=lambda e: e[1])
    for k, cuts in enumerate(([events], [events[:5], events[5:9], events[9:14], events[14:]])):
        updates = drained(machines.job_states(stream_of(spark, tmp_path / str(k), cuts, schema)), "update")
        got = {r.job_id: (r.status, r.updated_at, r.legal, r.illegal, r.timed_out) for r in machines.last_updates(updates).collect()}
        assert got == want


def test_finished_jobs_are_forgotten():
    state = machines.after_event(machines.after_event((None, None, None, 0, 0, 0), "awaiting_confirmation", 0), "extracting", 0)
    state = machines.after_event(machines.after_event(state, "processing", 0), "done", 0)
    assert state == ("done", 0, 0, 4, 0, 0)
    late = machines.KEEP // machines.MICRO
    assert machines.after_event(state, "awaiting_confirmation", late) == ("awaiting_confirmation", late, late, 1, 0, 0)
    assert machines.after_event(state, "error", late - 1)[4] == 1
    assert machines.after_event(("pending", 5, 5, 2, 0, 0), "extracting", 4) == ("pending", 5, 5, 2, 1, 0)
    stale = machines.STALE // machines.MICRO
    assert machines.after_event(("pending", 5, 5, 2, 0, 0), "extracting", 5 + stale) == ("error", 5 + stale, 5 + stale, 2, 1, 1)


def test_the_rate_limit_answers_every_request(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(i, 1, at(i)) for i in range(25)] + [(100 + i, 2, at(2 * i)) for i in range(5)]
    rows += [(200, 1, at(59.9)), (201, 1, at(60))] + [(300, 1, at(7200)), (301, 1, at(3600)), (302, 1, at(3660))]
    cuts = [rows[:8], rows[8:27], rows[27:33], rows[33:]]
    got = {r.event_id: r for r in drained(machines.decisions(stream_of(spark, tmp_path, cuts, "event_id long, client long, ts timestamp")), "append").collect()}
    assert len(got) == len(rows)
    assert [i for i in range(25) if got[i].upload_accepted] == list(range(10)) and [i for i in range(25) if got[i].confirm_accepted] == list(range(20))
    assert all(got[100 + i].upload_accepted for i in range(5))
    assert not got[200].confirm_accepted and got[201].upload_accepted and got[300].upload_accepted
    assert got[301].late and not got[301].confirm_accepted and not got[302].late and got[302].upload_accepted


# ── tables ─────────────────────────────────────────────────────────────────


def test_inserts_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "key string, note string")
    rows = lambda: sorted((r.key, r.note) for r in spark.read.parquet(path).collect())
    tables.insert_new(frame([("a", "1"), ("a", "0"), ("b", "1")]), path, "key", "r", 0)
    assert rows() == [("a", "0"), ("b", "1")]
    tables.insert_new(frame([("b", "2"), ("c", "2")]), path, "key", "r", 1)
    want = [("a", "0"), ("b", "1"), ("c", "2")]
    assert rows() == want
    for run, batch in (("r", 1), ("r", 0), ("other", 0)):
        tables.insert_new(frame([("b", "2"), ("c", "2")] if batch else [("a", "1"), ("a", "0"), ("b", "1")]), path, "key", run, batch)
        assert rows() == want
    tables.insert_new(frame([]), path, "key", "r", 2)
    assert rows() == want


def test_an_insert_stream_is_run_twice(spark, tmp_path):
    schema = "key string, note string"
    stream = stream_of(spark, tmp_path, [[("a", "1"), ("b", "1")], [("a", "2"), ("c", "2")]], schema)
    for run in ("first", "second", "first"):
        tables.insert_stream(stream, str(tmp_path / "t"), "key", run, str(tmp_path / f"state-{run}"))
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("key", "note").collect()) == [("a", "1"), ("b", "1"), ("c", "2")]


def test_reset_replaces_failed_jobs_only(spark, tmp_path):
    rows, states = str(tmp_path / "rows"), str(tmp_path / "jobs")
    data = spark.createDataFrame([(f"j{i % 7}", f"c{i}", i) for i in range(70)], "job_id string, id string, n int")
    status = spark.createDataFrame([(f"j{i}", "error" if i in (2, 5) else "done", 80, 10) for i in range(7)], "job_id string, status string, progress int, corrections_count int")
    for _ in range(2):
        tables.insert_by_job(data, rows)
        tables.insert_by_job(status, states)
    assert tables.read_by_job(spark, rows, data.schema).count() == 70
    asked = spark.createDataFrame([("j2",), ("j3",), ("nobody",)], "job_id string")
    for accepted in (["j2"], []):  # asked again, it no longer is in error
        answer = tables.reset_jobs(spark, rows, data.schema, states, status.schema, asked)
        assert sorted(r.job_id for r in answer.collect() if r.accepted) == accepted
        assert {r.job_id for r in tables.read_by_job(spark, rows, data.schema).collect()} == {"j0", "j1", "j3", "j4", "j5", "j6"}
        got = {r.job_id: tuple(r)[1:] for r in tables.read_by_job(spark, states, status.schema).collect()}
        assert got["j2"] == ("awaiting_confirmation", 0, 0) and got["j5"] == ("error", 80, 10) and len(got) == 7
    tables.insert_by_job(data.where("job_id = 'j2' AND n < 30"), rows)
    assert [r.n for r in tables.read_by_job(spark, rows, data.schema, ["j2"]).orderBy("n").collect()] == [2, 9, 16, 23]
    assert tables.read_by_job(spark, rows, data.schema).count() == 64


def test_only_the_buckets_of_named_jobs_are_read(spark, tmp_path):
    data = spark.createDataFrame([(f"j{i}", f"c{i}") for i in range(200)], "job_id string, id string")
    tables.insert_by_job(data, str(tmp_path / "t"))
    one = tables.read_by_job(spark, str(tmp_path / "t"), data.schema, ["j7"])
    assert one.count() == 1 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() or "bucket#" in one._jdf.queryExecution().toString()


def test_schemas_grow_and_widen_but_never_narrow(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, 1.5)], "id int, pages int, cost float")
    new = spark.createDataFrame([(2, 1 << 40, 2.5, "quick")], "id int, pages long, cost double, preset string")
    old.write.parquet(str(tmp_path / "t"))
    new.write.mode("append").parquet(str(tmp_path / "t"))
    schema = tables.evolved_schema(old.schema, new.schema)
    rows = sorted(tuple(r) for r in tables.read_evolved(spark, str(tmp_path / "t"), schema, {"preset": "complete"}).collect())
    assert rows == [(1, 5, 1.5, "complete"), (2, 1 << 40, 2.5, "quick")]
    with pytest.raises(ValueError):
        tables.evolved_schema(new.schema, old.schema)
    assert tables.evolved_schema(old.schema, StructType()).names == old.columns


# ── page files ─────────────────────────────────────────────────────────────


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1 << 20])
def test_page_files_in_pieces_of_any_size(spark, tmp_path, split):
    texts = {"a.txt": "page une\fpage deux é\f", "b.txt": "\f\f", "c.txt": "sans fin", "d.txt": "x\f\f" + "long " * 50 + "\fé\f\f"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    if split == 1:
        (tmp_path / "d.txt").unlink()  # a task a byte
    rows = page_files.read_pages(spark, str(tmp_path), split).collect()
    want = [(name, k, page) for name, text in texts.items() if (tmp_path / name).exists() for k, page in enumerate(text.removesuffix("\f").split("\f"))]
    assert sorted((r.path.split("/")[-1], r.page_num, r.text) for r in rows) == sorted(want)
    assert {r.text: r.word_count for r in rows}["page deux é"] == 3


def test_missing_and_empty_page_files_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="no page files"):
        page_files.read_pages(spark, str(tmp_path / "none")).collect()
    (tmp_path / "empty.txt").write_bytes(b"")
    with pytest.raises(Exception, match="a file without pages"):
        page_files.read_pages(spark, str(tmp_path)).collect()

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from records import event, lineage_log, process, run
from pyspark.sql import functions as F

from tracewell.operators import audit, record
from tracewell.plans import pipelines
from tracewell.sources import commits, workspace
from tracewell.sources.log import append, append_log, compact, create_log, read_log

KIND = pipelines.EntryKind("t", "k", "a")


def jobs(spark, *numbers):
    rows = [("p", "us", f"j{n}", "Job", "Run", [("a", f"b{n}", "table")]) for n in numbers]
    schema = record.JOB_SCHEMA.replace("started_at timestamp_ntz, ", "")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return spark.createDataFrame(rows, schema).withColumn("started_at", at)


def counts(spark, root, as_of=None):
    log = read_log(spark, root, as_of)
    return [df.count() for df in (log.processes, log.runs, log.events, log.links, log.entries)]


@pytest.mark.parametrize("name", ["rename", "write_text"])
@pytest.mark.parametrize("after", [False, True])
def test_all_kinds_at_once_or_none(spark, path, monkeypatch, name, after):
    """The job is cut off before or after the one rename, or the one file, that makes a commit."""
    root = path("log")
    pipelines.append_jobs(jobs(spark, 1), root)

    def cut_off(*args):
        if after:
            getattr(workspace, name)(*args)
        raise OSError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(commits, name, cut_off)
        with pytest.raises(OSError):
            pipelines.append_jobs(jobs(spark, 2), root, token="job 2")
    recorded = after and name == "rename"
    assert counts(spark, root)[:4] == [1 + recorded] * 4
    # The repeat of the job is recorded once, whatever became of the first try.
    assert pipelines.append_jobs(jobs(spark, 2), root, token="job 2") == 2
    assert counts(spark, root) == [2, 2, 2, 2, 0]


def test_a_job_that_fails_while_writing_leaves_nothing(spark, path):
    root = path("log")
    records = pipelines.job_records(jobs(spark, 1))
    records["links"] = records["links"].withColumn("source", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        append(root, records)
    assert counts(spark, root) == [0] * 5


def test_a_repeated_token_counts_once(spark, path):
    root = path("log")
    first = [pipelines.append_jobs(jobs(spark, 1), root, token="a") for _ in range(3)]
    assert first == [1, 1, 1]
    assert pipelines.append_jobs(jobs(spark, 2), root, token="b") == 2
    assert counts(spark, root)[:4] == [2] * 4 and counts(spark, root, 1)[:4] == [1] * 4
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: pipelines.append_jobs(jobs(spark, 3), root, token="c"), range(4)))
    assert done == [3] * 4 and counts(spark, root)[:4] == [3] * 4


def test_earlier_states_stay_readable(spark, path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    root = path("log")
    for n in range(1, 8):
        pipelines.append_jobs(jobs(spark, n), root)
    assert [counts(spark, root, n)[0] for n in range(1, 8)] == list(range(1, 8))
    assert workspace.children(spark, f"{root}/snapshots") and len(commits.history(spark, root)) == 7
    with pytest.raises(LookupError):
        read_log(spark, root, 9)
    with pytest.raises(FileNotFoundError):
        read_log(spark, path("nothing"))


def test_jobs_that_register_one_id_at_once_make_one_entry(spark, path):
    root = path("log")
    create_log(spark, root)

    def register(n):
        rows = [("shared", "ns", f"gs://b/{n}", f"by {n}"), (f"own {n}", "ns", f"gs://b/own{n}", "")]
        paths = spark.createDataFrame(rows, "entry_id string, namespace string, path string, display_name string")
        return pipelines.register_paths(paths, KIND, root)

    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(register, range(6)))
    assert sorted(numbers) == list(range(1, 7))
    entries = {row.entry_id: row.entry_source.display_name for row in read_log(spark, root).entries.collect()}
    assert read_log(spark, root).entries.count() == len(entries) == 7
    # The first to commit has it, at every later state.
    winner = numbers.index(1)
    assert entries["shared"] == f"by {winner}"
    # Registered again, nothing changes.
    register(5)
    assert read_log(spark, root).entries.count() == 7


def texts(df):
    return sorted(row[0] for row in df.select(F.to_json(F.struct("*"))).collect())


def many(spark, location, names):
    return lineage_log(
        spark,
        [process(location, n) for n in names],
        [run(location, n, "r") for n in names],
        [event(location, n, "r", f"e{i}", [("a", "b")]) for n in names for i in range(2)],
    )


def test_a_purge_rewrites_only_mixed_files(spark, path):
    root = path("log")
    append_log(many(spark, "us", ["a", "b"]), root)
    append_log(many(spark, "eu", ["a", "b"]), root)
    # Records without their process stay.
    orphans = many(spark, "us", ["x", "y"])
    append(root, {"runs": orphans.runs.coalesce(1), "events": orphans.events.coalesce(1), "links": orphans.links.coalesce(1)})
    mixed = many(spark, "us", ["b", "z"])
    append(root, {"events": mixed.events.coalesce(1), "links": mixed.links.coalesce(1)})
    log = read_log(spark, root)
    expected = audit.purge(log, ["us"])
    before = commits.state(spark, root)
    done = audit.purge_log(spark, root, ["us"])
    after = commits.state(spark, root)
    for kind in ("processes", "runs", "events", "links", "entries"):
        assert texts(getattr(read_log(spark, root), kind)) == texts(getattr(expected, kind)), kind
    assert done.rewritten == 2
    assert done.dropped + done.rewritten + done.kept == len(before.files)
    assert len(set(before.files) & set(after.files)) == done.kept
    assert {f.location for p, f in before.files.items() if p not in after.files} == {"us"}
    assert counts(spark, root, before.number)[0] == 4
    # Nothing is left to purge.
    assert audit.purge_log(spark, root, ["us"]).rewritten == 0


def test_a_clone_shares_files_and_changes_apart(spark, path):
    append_log(many(spark, "us", ["a", "b"]), path("log"))
    commits.clone(spark, path("log"), path("other"))
    audit.purge_log(spark, path("other"), ["us"])
    pipelines.append_jobs(jobs(spark, 9), path("other"))
    assert counts(spark, path("log"))[:4] == [2, 2, 4, 4]
    assert counts(spark, path("other"))[:4] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        commits.clone(spark, path("log"), path("other"))


def test_compaction_beside_appends_loses_nothing(spark, path):
    root = path("log")
    for n in range(6):
        pipelines.append_jobs(jobs(spark, n), root)
    before = commits.state(spark, root)
    with ThreadPoolExecutor(3) as pool:
        packing = pool.submit(compact, spark, root)
        appends = [pool.submit(pipelines.append_jobs, jobs(spark, 10 + n), root) for n in range(4)]
        number = packing.result()
        [done.result() for done in appends]
    assert counts(spark, root)[:4] == [10] * 4
    after = commits.state(spark, root)
    assert not set(before.files) & set(after.files) or number is None
    assert len(after.files) < len(before.files) + 4 * 4
    assert counts(spark, root, before.number)[:4] == [6] * 4
    compact(spark, root)
    assert len(commits.state(spark, root).of("links")) == 1
    assert compact(spark, root) is None
    assert counts(spark, root)[:4] == [10] * 4


def test_files_replaced_meanwhile_are_a_conflict(spark, path):
    root = path("log")
    for n in range(3):
        pipelines.append_jobs(jobs(spark, n), root)
    [file, *_] = commits.state(spark, root).files
    compact(spark, root)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, remove=[file])
    assert counts(spark, root)[:4] == [3] * 4

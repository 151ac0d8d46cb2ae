from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from records import NOON, entry, event, lineage_log, process, rows

from tracewell.operators import audit, links
from tracewell.plans import standing
from tracewell.sources import commits
from tracewell.sources.log import append_log, compact, create_log, read_log
from tracewell.sources.workspace import children, write_text

PLACES = ["us-east1", "us-central1", "us"]


def some_log(spark, draw, number):
    """Few names, so that edges come again in later commits, earlier ones too; some ends are missing."""
    processes = [process(place, f"p{number}") for place in PLACES]
    names = ["custom:a", "custom:b", "gcs:c", "bigquery:p.n.t", None]
    events = []
    for i in range(25):
        place = draw.choice(PLACES)
        start = NOON + timedelta(hours=draw.randrange(48))
        some = [(draw.choice(names), draw.choice(names)) for _ in range(draw.randrange(4))]
        events.append(event(place, f"p{draw.randrange(number + 1)}", "r", f"e{number}-{i}", some, start))
    return lineage_log(spark, processes, (), events, [entry("a", "custom:a")] if number == 0 else ())


def same_answers(spark, root, state):
    log = read_log(spark, root, state.number)
    pairs = [
        (links.edges_per_process(state.links), links.edges_per_process(log.links)),
        (links.edges_first_seen(state.links), links.edges_first_seen(log.links)),
        (standing.upstream_links(state.links), links.upstream_links(log.links)),
        (standing.ghost_nodes(state.links, log.entries), audit.ghost_nodes(log)),
    ]
    for merged, full in pairs:
        assert rows(merged, *full.columns) == rows(full, *full.columns)


def same_state(spark, root, state):
    full = standing.distinct_links(read_log(spark, root, state.number).links)
    assert rows(state.links, *full.columns) == rows(full, *full.columns)


def link_files(commit):
    return {file.path for file in commit.add if file.kind == "links"}


def test_merged_answers_are_those_of_the_whole_log(spark, path):
    root, draw = path("log"), random.Random(4)
    for number in range(3):
        append_log(some_log(spark, draw, number), root)
        state = standing.refresh(spark, root)
        same_state(spark, root, state)
        # Only what the commit brought was read.
        assert set(state.read) == link_files(commits.history(spark, root)[-1])
    same_answers(spark, root, state)
    assert standing.refresh(spark, root).read == ()


@pytest.mark.parametrize("purge_first, refreshed", [(False, False), (True, False), (False, True)])
def test_purge_and_compaction_in_between(spark, path, purge_first, refreshed):
    root, draw = path("log"), random.Random(7)
    append_log(some_log(spark, draw, 0), root)
    standing.refresh(spark, root)
    for number in (1, 2):
        append_log(some_log(spark, draw, number), root)
    steps = [lambda: compact(spark, root), lambda: audit.purge_log(spark, root, PLACES[:1])]
    for step in reversed(steps) if purge_first else steps:
        step()
        if refreshed:
            same_state(spark, root, standing.refresh(spark, root))
    append_log(some_log(spark, draw, 3), root)
    same_state(spark, root, standing.refresh(spark, root))


def test_a_compaction_alone_reads_nothing(spark, path):
    root, draw = path("log"), random.Random(9)
    for number in range(2):
        append_log(some_log(spark, draw, number), root)
    standing.refresh(spark, root)
    compact(spark, root)
    state = standing.refresh(spark, root)
    assert state.read == ()
    same_state(spark, root, state)


def test_refreshes_at_the_same_time_agree(spark, path):
    root, draw = path("log"), random.Random(2)
    for number in range(2):
        append_log(some_log(spark, draw, number), root)
        with ThreadPoolExecutor(3) as pool:
            for state in pool.map(lambda _: standing.refresh(spark, root), range(3)):
                same_state(spark, root, state)


def test_an_empty_log_and_one_without_links(spark, path):
    root = path("log")
    create_log(spark, root)
    assert standing.refresh(spark, root).links.count() == 0
    append_log(lineage_log(spark, [process("us", "p")]), root)
    assert standing.refresh(spark, root).links.count() == 0
    append_log(some_log(spark, random.Random(1), 1), root)
    same_state(spark, root, standing.refresh(spark, root))


def areas(spark, root):
    number = max(int(name) for name in children(spark, f"{root}/standing") if name.isdigit())
    return standing._parts(spark, f"{root}/standing", number)


def one_link(spark, place, name, ends=("custom:a", "gcs:c")):
    return lineage_log(spark, [process(place, "p")], (), [event(place, "p", "r", name, [ends])])


def test_areas_that_nothing_changed_in_are_not_written_again(spark, path):
    root = path("log")
    for place in PLACES:
        append_log(one_link(spark, place, "e1"), root)
    same_state(spark, root, standing.refresh(spark, root))
    before = areas(spark, root)
    assert set(before) == set(PLACES)
    append_log(one_link(spark, "us", "e2"), root)
    same_state(spark, root, standing.refresh(spark, root))
    after = areas(spark, root)
    assert {place for place in PLACES if before[place] != after[place]} == {"us"}
    audit.purge_log(spark, root, PLACES[:1])
    same_state(spark, root, standing.refresh(spark, root))
    assert areas(spark, root) == {place: after[place] for place in PLACES[1:]}


def test_names_without_a_location_and_locations_that_differ_from_names(spark, path):
    root = path("log")
    odd = [(name, NOON, None, "us", [("a", "b", "table")]) for name in (None, "x", "p/q/locations/us", "p/q/locations//processes/r")]
    odd.append(event("a%b c", "p", "r", "e", [("a", "b")]))
    odd.append((event("us-east1", "p", "r", "e", [])[0], NOON, None, "us", [("a", "b", "table")]))
    log = lineage_log(spark, [], (), odd)
    for _ in range(2):
        append_log(log, root)
        same_state(spark, root, standing.refresh(spark, root))
    assert set(areas(spark, root)) == {standing.NO_AREA, "a%b c", "us-east1"}


def test_a_state_without_areas_is_brought_on(spark, path):
    root = path("log")
    append_log(one_link(spark, "us", "e1"), root)
    folder = f"{root}/standing"
    data = f"{folder}/data-old"
    standing.distinct_links(read_log(spark, root).links).write.parquet(data)
    write_text(spark, f"{folder}/{1:020d}/state.json", json.dumps({"data": data}))
    same_state(spark, root, standing.refresh(spark, root))
    append_log(one_link(spark, "us-east1", "e2"), root)
    same_state(spark, root, standing.refresh(spark, root))
    assert set(areas(spark, root)) == {"us", "us-east1"}


def test_a_purge_is_followed_without_joining_for_samples(spark, path, monkeypatch):
    root, draw = path("log"), random.Random(11)
    append_log(some_log(spark, draw, 0), root)
    standing.refresh(spark, root)
    audit.purge_log(spark, root, PLACES[:1])
    sampled = []

    def watched(rows, key, sample=links._sampled_hot):
        sampled.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return sample(rows, key)

    monkeypatch.setattr(links, "_sampled_hot", watched)
    same = standing.refresh(spark, root)
    assert sampled and not any("Join" in plan for plan in sampled)
    same_state(spark, root, same)

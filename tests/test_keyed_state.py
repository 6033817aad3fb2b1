"""Final minutes and running journeys: against plain Python, out of order, late, over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from events import SCHEMA

from clickloom.sources.messages import decode, encode, normalize
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.streaming import journeys, minutes

BEGIN = datetime(2024, 5, 1, 8)
STAGES = ("view", "click", "add_to_cart", "purchase")


def write(spark, folder, events):
    rows = [(f"e{i}", kind, user, "p", 1.0, at, "c", "") for i, (kind, user, at) in enumerate(events)]
    encode(spark.createDataFrame(rows, SCHEMA)).coalesce(1).write.mode("append").text(f"{folder}/in")


def run(spark, folder, start, **settings):
    stream = normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)))
    query = start(stream, f"{folder}/out", f"{folder}/checkpoint", every=None, **settings)
    query.awaitTermination()
    return str(query.id)


def disordered(rng, n, spread):
    """Batches of (kind, user, time): time goes on, events are up to ``spread`` seconds late."""
    users = ["hot"] * 10 + [f"u{i}" for i in range(12)] + [""]
    batches = []
    for b in range(4):
        at = [BEGIN + timedelta(seconds=max(0, 1800 * b + rng.randrange(1800) - rng.choice((0, 0, rng.randrange(spread))))) for _ in range(n)]
        batches.append([(rng.choice((*STAGES, "search")), rng.choice(users), t) for t in at])
    return batches


def test_minutes_once_and_late_events_aside(spark):
    rng = random.Random(1)
    batches = disordered(rng, 150, 3000)
    # An event whose minute ends just when it becomes final.
    newest = max(t for _, _, t in batches[0] + batches[1])
    batches[2].append(("view", "edge", newest.replace(second=0) - timedelta(minutes=6)))
    folder, query_id = fresh_folder(spark, "t"), ""
    for first, second in ((0, 1), (2, 3)):
        for number in (first, second):
            write(spark, folder, batches[number])
        query_id = run(spark, folder, minutes.start_final_minutes, delay_minutes=5, spread=3)
    mark, counts, late = datetime(1970, 1, 1), {}, []
    for batch in batches:
        for kind, user, at in batch:
            minute = at.replace(second=0)
            if minute + timedelta(minutes=1) <= mark:
                late.append((kind, user, at))
            else:
                row = counts.setdefault(minute, [0] * 5)
                row[-1] += 1
                if kind in STAGES:
                    row[STAGES.index(kind)] += 1
        mark = max(mark, max(t for _, _, t in batch) - timedelta(minutes=5))
    wanted = sorted((m, *c) for m, c in counts.items() if m + timedelta(minutes=1) <= mark)
    assert len(late) > 20 and len(wanted) > 80
    got = minutes.final_minutes(spark, f"{folder}/out", query_id).collect()
    assert sorted(tuple(r) for r in got) == wanted
    aside = minutes.late_events(spark, f"{folder}/out", query_id)
    assert sorted((r.event_type, r.user_id, r.timestamp) for r in aside.collect()) == sorted(late)
    assert {r.price for r in aside.collect()} == {1.0}


def walked(events, forget):
    """(user, stage number, time) of every stage reached, of events in order."""
    out, state = [], {}
    for at, stage, user in sorted((at, STAGES.index(kind), user) for kind, user, at in events if kind in STAGES):
        reached, last = state.get(user, (0, at))
        if at - last > forget:
            reached = 0
        if stage == reached:
            out.append((user, stage, at))
            reached += 1
        state[user] = reached, at
    return sorted(out)


@pytest.mark.parametrize("forget_hours", [1, 1000])
def test_journeys_in_order_of_time(spark, forget_hours):
    rng = random.Random(forget_hours)
    batches = [
        [(k, u, BEGIN + (t - BEGIN) * 3) for k, u, t in batch] for batch in disordered(rng, 60, 600)
    ]
    folder, query_id = fresh_folder(spark, "t"), ""
    for first, second in ((0, 1), (2, 3)):
        for number in (first, second):
            write(spark, folder, batches[number])
        query_id = run(spark, folder, journeys.start_running_funnel, delay="60 minutes", forget_hours=forget_hours)
    forget = timedelta(hours=forget_hours)
    events = [e for batch in batches for e in batch]
    mark = max(t for _, _, t in events) - timedelta(minutes=60)

    def stored():
        return sorted((r.user_id, r.stage, r.at) for r in journeys.advances(spark, f"{folder}/out", query_id).collect())

    def totals():
        return {r.stage: r.reached for r in journeys.running_totals(spark, f"{folder}/out", query_id).collect()}

    assert stored() == walked([e for e in events if e[2] <= mark], forget)
    end = ("search", "nobody", BEGIN + timedelta(days=400))
    write(spark, folder, [end])
    assert run(spark, folder, journeys.start_running_funnel, delay="60 minutes", forget_hours=forget_hours) == query_id
    wanted = walked(events, forget)
    assert stored() == wanted and len(wanted) > 20
    assert totals() == {stage: sum(w[1] == i for w in wanted) for i, stage in enumerate(STAGES)}


def test_forgotten_users_leave_the_state(spark):
    folder = fresh_folder(spark, "t")
    for day in range(4):
        write(spark, folder, [("view", f"u{day}-{i}", BEGIN + timedelta(days=day, seconds=i)) for i in range(20)])
    stream = normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)))
    query = journeys.start_running_funnel(stream, f"{folder}/out", f"{folder}/checkpoint", delay="0 seconds", forget_hours=2, every=None)
    query.awaitTermination()
    rows = [p["stateOperators"][0]["customMetrics"].get("numValueStateVars") for p in query.recentProgress]
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert rows and kept[-1] <= max(kept) and kept[-1] < 80 * 2


def test_state_store_setting_comes_back(spark):
    from clickloom.streaming.state import _PROVIDER, keyed_state_store

    before = spark.conf.get(_PROVIDER, None)
    with keyed_state_store(spark):
        assert "RocksDB" in spark.conf.get(_PROVIDER)
    assert spark.conf.get(_PROVIDER, None) == before


def test_users_share_rows_of_state(spark):
    """However many users there are, state is read and written once for each group of them, and in all the session's tasks."""
    folder = fresh_folder(spark, "t")
    write(spark, folder, [("view", f"u{i}", BEGIN + timedelta(seconds=i)) for i in range(6000)])
    stream = normalize(decode(read_message_files(spark, f"{folder}/in", max_files_per_trigger=1)))
    query = journeys.start_running_funnel(stream, f"{folder}/out", f"{folder}/checkpoint", delay="9 hours", every=None)
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(kept) <= journeys.GROUPS < 6000

"""Streams over several micro-batches, with a restart from the checkpoint between them; and the level loop on fixed rows."""

import time
import uuid

from dutyweave.operators import levels
from dutyweave.streaming import runs

EVENTS = "run long, event_id long, status string"


def feed(spark, folder, batches, shape):
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)


def test_run_completion_goes_on_after_a_restart(spark):
    base = runs.new_base(spark)
    first = [[(1, 1, "running"), (2, 2, "running")], [(1, 3, "awaiting_input"), (3, 4, "failed")]]
    later = [[(3, 5, "running"), (2, 6, "running")], [(1, 7, "running"), (1, 8, "completed"), (1, 9, "running")], [(2, 10, "completed"), (1, 11, "completed")]]

    def go():
        return sorted((r.run, r.event_index, r.kind, r.status) for r in runs.append_to_end(runs.run_completion(runs.event_stream(spark, f"{base}/in", spark.createDataFrame([], EVENTS).schema), heartbeat=None), f"{base}/a").collect())

    feed(spark, f"{base}/in", first, EVENTS)
    e, p, c = "pipeline_event", "run_paused", "run_complete"
    want = [(1, 0, e, "running"), (1, 1, e, "awaiting_input"), (1, 2, p, "awaiting_input"), (2, 0, e, "running"), (3, 0, e, "failed"), (3, 1, c, "failed")]
    assert go() == want
    feed(spark, f"{base}/in", later, EVENTS)
    want += [(1, 2, e, "running"), (1, 3, e, "completed"), (1, 4, c, "completed"), (2, 1, e, "running"), (2, 2, e, "completed"), (2, 3, c, "completed")]
    assert go() == sorted(want)


def test_runs_without_events_get_heartbeats_and_ended_ones_do_not(spark):
    base, name = runs.new_base(spark), f"beats_{uuid.uuid4().hex}"
    feed(spark, f"{base}/in", [[(1, 1, "running"), (2, 2, "completed")]], EVENTS)
    stream = runs.run_completion(runs.event_stream(spark, f"{base}/in", spark.createDataFrame([], EVENTS).schema), heartbeat="1 second")
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{base}/c").start()
    try:
        for _ in range(90):
            time.sleep(1)
            beats = [(r.run, r.event_index) for r in spark.table(name).where("kind = 'heartbeat'").collect()]
            if len(beats) >= 2:
                break
    finally:
        q.stop()
    assert len(beats) >= 2 and set(beats) == {(1, 1)}


def test_aggregated_state_goes_on_after_a_restart(spark):
    base = runs.new_base(spark)
    shape = "run long, event_id long, status string, ts long"
    source = lambda: runs.event_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema)
    go = lambda: {r.run: (r.status, r.last_event) for r in runs.run_to_end(runs.run_state(source()), ["run"], f"{base}/a").collect()}
    feed(spark, f"{base}/in", [[(1, 1, "a", 10), (2, 2, "a", 20)], [(1, 3, "b", 30)], [(2, 4, "old", 5)]], shape)
    assert go() == {1: ("b", 3), 2: ("a", 4)}
    feed(spark, f"{base}/in", [[(2, 5, "late", 19), (3, 6, "new", 1)]], shape)
    assert go() == {1: ("b", 3), 2: ("a", 5), 3: ("new", 6)}


def test_requests_stay_open_over_a_restart(spark):
    base, shape = runs.new_base(spark), "signature long, event_id long, status string"
    source = lambda: runs.event_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema)
    go = lambda: sorted((r.signature, r.event_id) for r in runs.append_to_end(runs.active_requests(source()), f"{base}/a").collect())
    feed(spark, f"{base}/in", [[(1, 1, "request")], [(1, 2, "request"), (2, 3, "request")], [(2, 4, "closed")]], shape)
    assert go() == [(1, 1), (2, 3)]
    feed(spark, f"{base}/in", [[(1, 5, "request"), (2, 6, "request")], [(1, 7, "closed"), (1, 8, "request")]], shape)
    assert go() == [(1, 1), (1, 8), (2, 3), (2, 6)]


def test_answers_re_evaluate_only_what_waits_for_them(spark):
    details = spark.createDataFrame(
        [(1, "a", 1, "", "contains", None, "k1"), (1, "a", 2, "", "not_contains", None, "k2"), (1, "b", 3, "g", "contains", None, "k1"), (1, "b", 4, "g", "contains", False, "k9"), (2, "a", 5, "", "contains", None, "k3"), (3, "a", 6, "", "contains", None, "k4")],
        "product long, code string, row_id long, alt_group string, op string, verdict boolean, question_key string",
    )
    base, shape = runs.new_base(spark), "question_key string, answer string, answered_at long"

    def go():
        decided, judged = runs.replay_answers(runs.event_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema), details, f"{base}/a")
        return {(r.product, r.code): r.decision for r in decided.collect()}, [r.status for r in judged.orderBy("answered_at").collect()]

    feed(spark, f"{base}/in", [[("k1", "unknown", 1)], [("k1", "yes", 2), ("k1", "no", 3), ("k7", "yes", 4)]], shape)
    assert go() == ({(1, "a"): "undecided", (1, "b"): "confirmed"}, ["accepted", "accepted", "rejected", "no_question"])
    feed(spark, f"{base}/in", [[("k1", "yes", 5), ("k3", "perhaps", 6)], [("k2", "no", 7)], [("k3", "no", 8), ("k2", "yes", 9)]], shape)
    decided, status = go()
    assert decided == {(1, "a"): "confirmed", (1, "b"): "confirmed", (2, "a"): "violated"}
    assert status[4:] == ["repeated", "invalid", "accepted", "accepted", "rejected"]


def test_level_loop(spark):
    df = spark.createDataFrame
    nodes = df([("0101", "01", False), ("0102", "01", True), ("010110", "0101", False), ("010190", "0101", True), ("01011010", "010110", False), ("010210", "0102", False), ("010290", "0102", True)], "code string, parent string, residual boolean")
    conditions = df(
        [("0101", 1, "", "kind", "fish"), ("0102", 1, "", "kind", "meat"), ("010110", 1, "a", "state", "frozen"), ("010110", 2, "a", "form", "whole"), ("010190", 1, "", "state", "fresh"), ("010210", 1, "", "state", "dried"), ("010290", 1, "", "state", "fresh")],
        "code string, row_id int, alt_group string, field string, value string",
    )
    facts = df(
        [(1, "kind", "fish"), (1, "state", "frozen"), (2, "kind", "fish"), (3, "kind", "meat"), (3, "state", "chilled"), (4, "kind", "fish"), (4, "state", "fresh"), (4, "form", "cut"), (5, "state", "frozen")],
        "product long, field string, value string",
    )
    starts = df([(p, "01") for p in (1, 2, 3, 4, 5)] + [(6, "99")], "product long, parent string")
    result, silent = levels.classify_levels(starts, nodes, conditions, facts, df([], "product long, code string"))
    got = {(r.product, r.level): (r.code, r.authority) for r in result.collect()}
    assert got == {
        (1, 4): ("0101", "confirmed"), (1, 6): ("010110", "confirmed"), (1, 8): ("01011010", "pass_through"),  # one of two alternatives is met
        (2, 4): ("0101", "confirmed"), (2, 6): (None, "open"),  # nothing known below
        (3, 4): ("0102", "confirmed"), (3, 6): (None, "open"),  # all violated, the residual code too
        (4, 4): ("0101", "confirmed"), (4, 6): ("010190", "confirmed"), (4, 8): (None, "no_children"),
        (5, 4): (None, "open"), (6, 4): (None, "no_children"),
    }
    asked = {(r.product, r.level, r.field, r.value) for r in levels.level_questions(silent).collect()}
    assert asked == {(2, 6, "state", "frozen"), (2, 6, "form", "whole"), (2, 6, "state", "fresh"), (5, 4, "kind", "fish"), (5, 4, "kind", "meat")}


def test_residual_codes_lead_only_by_proof(spark):
    shape = "product long, parent string, code string, residual boolean, score long, asked boolean, answered boolean"
    rows = [
        (1, "p", "10", False, 3, True, True), (1, "p", "90", True, 0, True, False),  # nobody proven: promoted
        (2, "p", "10", False, 3, True, True), (2, "p", "90", True, 0, True, False),  # proven: the named code leads
        (3, "p", "10", False, 3, False, False), (3, "p", "90", True, 0, False, False),  # no questions: a guess
        (4, "p", "10", False, 3, True, True), (4, "p", "90", True, -100, True, False),  # the residual code is violated
        (5, "p", "10", False, 0, False, False), (5, "p", "90", True, 0, False, False),  # nothing at all
    ]
    got = levels.promote_residual(spark.createDataFrame(rows, shape), spark.createDataFrame([(2, "10")], "product long, code string"))
    assert {(r.product, r.code): (r.place, r.phase) for r in got.collect()} == {
        (1, "90"): (1, "residual_promoted"), (1, "10"): (2, "residual_promoted"), (2, "10"): (1, "qualified_named"), (2, "90"): (2, None),
        (3, "10"): (1, "unqualified_question"), (3, "90"): (2, "unqualified_question"), (4, "10"): (1, "qualified_named"), (4, "90"): (2, None),
        (5, "90"): (1, "unqualified_question"), (5, "10"): (2, "unqualified_question"),
    }


def test_a_met_value_of_the_residual_code_is_no_explicit_match(spark):
    df = spark.createDataFrame
    nodes = df([("10", "1", False), ("11", "1", False), ("19", "1", True)], "code string, parent string, residual boolean")
    conditions = df([("10", 1, "", "w", "shrimp"), ("11", 1, "", "w", "prawn"), ("19", 1, "", "w", "shrimp")], "code string, row_id int, alt_group string, field string, value string")
    facts = df([(1, "w", "shrimp"), (2, "w", "prawn")], "product long, field string, value string")
    candidates = df([(1, "1"), (2, "1")], "product long, parent string").join(nodes, "parent")
    details = levels.detail_verdicts(candidates, conditions, facts)
    explicit = levels.explicit_matches(details, nodes, conditions)
    got = {(r.product, r.code): r.decision for r in levels.rank_candidates(candidates, details, explicit).collect()}
    assert got[1, "10"] == "undecided" and got[1, "19"] == "confirmed" and got[2, "11"] == "confirmed" and got[2, "10"] == "violated"


def test_products_alike_are_worked_out_once(spark, monkeypatch):
    df, kept, write = spark.createDataFrame, {}, levels.stage
    monkeypatch.setattr(levels, "stage", lambda rows, label: kept.setdefault(label, []).append(write(rows, label)) or kept[label][-1])
    nodes = df([("0101", "01", False), ("0102", "01", True)], "code string, parent string, residual boolean")
    conditions = df([("0101", 1, "", "kind", "fish"), ("0102", 1, "", "kind", "meat")], "code string, row_id int, alt_group string, field string, value string")
    # values that no code asks, and fields and precedents of other scopes, make no difference
    facts = df([(p, "kind", ["fish", f"none {p}", "meat", None][p % 4]) for p in range(40)] + [(p, "look", str(p)) for p in range(40)], "product long, field string, value string")
    starts = df([(p, "01") for p in range(41)], "product long, parent string")
    before = df([(p, f"99{p:02}") for p in range(40)] + [(40, "0101")], "product long, code string")
    result, silent = levels.classify_levels(starts, nodes, conditions, facts, before, (4,))
    assert kept["level-details"][0].count() == 2 * 4  # fish, meat, another kind, nothing known with a precedent
    got = {r.product: (r.code, r.authority) for r in result.collect()}
    assert got == {p: [("0101", "confirmed"), (None, "open"), ("0102", "confirmed"), (None, "open")][p % 4] for p in range(40)} | {40: (None, "open")}
    assert {tuple(r) for r in silent.select("product", "field", "value").collect()} == {(40, "kind", "fish"), (40, "kind", "meat")}
    asked = levels.questions_of_levels(starts, nodes, conditions, facts, before, (4,)).collect()
    assert sorted((r.product, r.level, r.value) for r in asked) == [(40, 4, "fish"), (40, 4, "meat")]


def test_slices_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(50, numPartitions=2).mapInPandas(counted, "id long")
    stream = runs.in_slices(rows, "id", most_rows=10)
    assert read.value == 2 * 50  # for the ends of the range, and to take the rows apart
    assert sorted(r.id for r in runs.append_to_end(stream).collect()) == list(range(50))

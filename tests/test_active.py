"""Guards by the thousand, feedback split over tasks, graphs and families of great diameter."""

import datetime as dt
import random
import re

import numpy as np
import pytest

from lorekeep.operators import active, graph
from lorekeep.operators.components import components

GUARD = "guard_id string, pattern string, status string, project string, path_regex string, tool string"


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [(r"\beval\s*\(", "eval"), (r"pickle\.loads?\s*\(", "pickle.load"), (r"(?i)Verify=FALSE", "verify=false"), (r"a|bcd", None), (r"(abc)?defg", "defg"), (r"(foo){2,}", "foo"), (r"x{2}", None), (r"[a-z]+", None), (r"[!=]=\s*None\b", "none"), (r"häuser", "user"), (r"(", None)],
)
def test_literals_that_every_match_holds(pattern, literal):
    assert active.required_literal(pattern) == literal


def test_thousands_of_guards_without_a_nested_loop(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    guards = [(f"g{i}", rng.choice([r"\b{}\b", "{}", r"{}\s*\(", "(?i){}"]).format(word()), "advisory", rng.choice([None, "p", "q"]), None, None) for i in range(3000)]
    guards += [("any", "[0-9]{3}", "blocking", None, None, None), ("path", "abc", "advisory", None, r"(^|/)x\.py$", None), ("tool", "abc", "advisory", None, None, "edit"), ("java", r"\p{Lu}bc", "advisory", None, None, None), ("off", "abc", "retired", None, None, None)]
    patterns = [g[1].replace(r"\b", "").replace(r"\s*\(", "(").replace("(?i)", "") for g in guards[:3000]]
    acts = [(i, rng.choice(["p", "q", None]), " ".join([rng.choice(patterns).upper() if i % 3 else rng.choice(patterns), "Abc abc" if i % 5 == 0 else "", "123" if i % 7 == 0 else "", word()]), rng.choice(["a\\x.py", "x.pyc", None]), rng.choice(["edit", None])) for i in range(600)]
    g, a = spark.createDataFrame(guards, GUARD), spark.createDataFrame(acts, "action_id long, project string, text string, path string, tool string")
    found = active.guard_scan(a, g)
    want = set()
    for i, project, text, path, tool in acts:
        for guard_id, pattern, status, own, path_regex, own_tool in guards:
            hit = re.search(pattern.replace(r"\p{Lu}", "[A-Z]"), text) and status != "retired" and own in (None, project)
            if hit and (path_regex is None or (path and re.search(path_regex, path.replace("\\", "/")))) and own_tool in (None, tool):
                want.add((i, guard_id, 0 if status == "blocking" else 1))
    assert {(r.action_id, r.guard_id, r.place) for r in found.collect()} == want and len(want) > 300
    assert "NestedLoop" not in active.guard_scan(a, g.where("guard_id <> 'java'"))._jdf.queryExecution().executedPlan().toString()


def test_text_beyond_the_head_is_read_when_asked(spark):
    guards = spark.createDataFrame([("g", "eval", "advisory", None)], "guard_id string, pattern string, status string, project string")
    acts = spark.createDataFrame([(1, "p", "x" * active.SCAN_CHARS + " eval")], "action_id int, project string, text string")
    assert active.guard_scan(acts, guards).count() == 0 and active.guard_scan(acts, guards, None).count() == 1


def fold(status, pack, events):
    helped = corroborations = wrong = 0
    seen = set()
    for _, outcome, session in events:
        good = outcome in ("helped", "corroborated")
        helped += outcome == "helped"
        if good and (session is None or session not in seen):
            corroborations += 1
            seen.add(session)
        if outcome == "false_positive":
            wrong += 1
            if wrong >= 3:
                status, wrong = {"blocking": "advisory"}.get(status, "retired"), 0
        elif good and status == "advisory" and corroborations >= 3 and not pack:
            status = "blocking"
    return status, helped, corroborations, wrong


def test_feedback_over_tasks_equals_the_fold(spark):
    rng = random.Random(11)
    guards = [(f"g{i}", rng.choice(["advisory", "advisory", "blocking", "retired"]), rng.random() < 0.3) for i in range(60)] + [("still", "advisory", False)]
    rows = []
    for i in range(60):
        for _ in range(rng.randrange(0, 40)):
            rows.append((f"g{i}", len(rows), rng.choices(["helped", "corroborated", "false_positive", "other"], [4, 3, rng.choice([1, 3]), 1])[0], rng.choice([None, "s1", "s2", "s3", "s4"])))
    rng.shuffle(rows)
    got = {r.guard_id: (r.status, r.helped, r.corroborations, r.false_positives) for r in active.guard_lifecycle(spark.createDataFrame(guards, "guard_id string, status string, pack boolean"), spark.createDataFrame(rows, "guard_id string, event_id long, outcome string, session string").repartition(7)).collect()}
    for g, status, pack in guards:
        assert got[g] == fold(status, pack, sorted((e, o, s) for k, e, o, s in rows if k == g)), g


def test_a_million_events_of_one_guard(spark):
    from pyspark.sql import functions as F

    events = spark.range(1_000_000).select(F.lit("g").alias("guard_id"), F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "false_positive").otherwise("helped").alias("outcome"), (F.col("id") % 1000).cast("string").alias("session"))
    guards = spark.createDataFrame([("g", "advisory", False)], "guard_id string, status string, pack boolean")
    rows = [(i, "false_positive" if i % 5 == 0 else "helped", str(i % 1000)) for i in range(1_000_000)]
    r = active.guard_lifecycle(guards, events).first()
    assert (r.status, r.helped, r.corroborations, r.false_positives) == fold("advisory", False, rows)


def test_stretches_compose():
    rng = np.random.default_rng(1)
    for _ in range(40):
        kind, fresh = rng.choice(4, 30, p=[0.3, 0.2, 0.3, 0.2]), rng.random(30) < 0.3
        good, wrong = kind < 2, kind == 2
        fresh &= good
        cut = int(rng.integers(1, 29))
        whole = active.stretch(good, fresh, wrong, False)
        a, b = (active.stretch(good[p], fresh[p], wrong[p], False) for p in (slice(0, cut), slice(cut, 30)))
        for c in range(4):
            for r in range(3):
                for s in range(3):
                    assert whole[c, r, s] == b[min(3, c + int(fresh[:cut].sum())), (r + int(wrong[:cut].sum())) % 3, a[c, r, s]]


def test_components_of_long_paths_and_cycles(spark):
    path = [(f"a{i:05}", f"a{i + 1:05}") for i in range(5000)]
    cycle = [(f"c{i:05}", f"c{(i + 1) % 5000:05}") for i in range(5000)]
    back = [("c00100", "d1"), ("d1", "d2"), ("d2", "c00050"), ("d2", "e1"), ("e1", "e2"), ("e2", "e1")]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(path + cycle + back, "source string, target string")).collect()}
    assert got == {f"c{i:05}": "c00000" for i in range(5000)} | {"d1": "c00000", "d2": "c00000", "e1": "e1", "e2": "e1"}


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((12, 16), (30, 34), (25, 60)):
        edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)}
        reach = {a: {a} for e in edges for a in e}
        for _ in range(n):
            for a, b in edges:
                for x in reach.values():
                    if a in x:
                        x.add(b)
        want = {}
        for a in reach:
            part = {b for b in reach[a] if a in reach[b]}
            if len(part) > 1:
                want[a] = min(part)
        assert {r.node: r.component for r in graph.strong_components(spark.createDataFrame(list(edges), "source string, target string")).collect()} == want


def test_families_of_long_chains_settle(spark):
    lesson = "project string, ntype string, slug string, date date, session string, pos int, text string, supersedes string"
    rows = [("p", "mistake", f"t{i:03}", dt.date(2024, 1, 1) + dt.timedelta(i), f"s{i}", 0, "x", f"t{i + 1:03}") for i in range(70)]
    notes = spark.createDataFrame([], "project string, ntype string, slug string, stem string, date date, recurrence long, session string, status string, superseded_by string")
    assert active.upsert(notes, spark.createDataFrame(rows, lesson)).count() == 70
    ends = components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long"))
    assert {r.root for r in ends.collect()} == {0}

"""Folders of files: source trees, session logs, and a stream of what they gain."""

import json
import os

import pytest

from lorekeep.sources import files, notes
from lorekeep.sources.tail import tail


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "tree"
    put(top / "a.py", "import os\nfrom x.y import z\ndef f():\n    pass\n")
    put(top / "b.py", "class C:\n    pass\n")
    put(top / "docs" / "read.me.md", "# Head\ntext")
    put(top / "docs" / "bad.md", b"caf\xe9 ok")
    put(top / "big.py", "x" * 5000)
    put(top / "node_modules" / "m.js", "var a")
    put(top / ".hidden" / "h.py", "a = 1")
    put(top / "deep" / ".git" / "c.py", "a = 1")
    put(top / "notes.log", "no")
    return top


def test_a_tree_is_listed_by_sizes_before_it_is_read(spark, root):
    found, over = files.read_tree(spark, f"file://{root}", cap=1000)
    assert {(r.path, r.bytes) for r in over.collect()} == {("big.py", 5000)}
    kept = files.listed(found)
    rows = {r.path: r for r in kept.collect()}
    assert set(rows) == {"a.py", "b.py", "docs/read.me.md", "docs/bad.md"}
    assert rows["docs/bad.md"].bad and rows["docs/bad.md"].text == "caf\ufffd ok" and not rows["a.py"].bad
    inventory = {r.path: r for r in notes.inventory(kept.select("path", "text")).collect()}
    assert inventory["a.py"].imports == ["os", "x.y"] and inventory["b.py"].exports == ["C"] and inventory["docs/read.me.md"].headings == ["Head"]
    total = files.totals(kept).first()
    code = len((root / "a.py").read_bytes()) + len((root / "b.py").read_bytes())
    assert (total.files, total.code_bytes, total.top) == (4, code, "md:2,py:2")
    # contents of files over the cap are not asked for
    assert "content" not in over._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_broken_lines_are_kept_apart(spark, tmp_path):
    put(tmp_path / "p" / "s1.jsonl", b'{"type": "user", "message": {"role": "user", "content": "a"}}\n{"type": "user", \n\n{"type": "assistant", "x": "\xff"}\n')
    put(tmp_path / "s2.jsonl", '{"type": "user"}\n' * 3)
    put(tmp_path / "s3.txt", "not a log")
    lines = files.read_lines(spark, f"file://{tmp_path}")
    good, bad = files.split_events(lines)
    assert good.count() == 5 and [r.line for r in bad.collect()] == ['{"type": "user", '] and good.where("bad").count() == 1
    assert files.read_lines(spark, f"file://{tmp_path}", cap=60).select("path").distinct().count() == 1


def run(spark, folder, state, name, **options):
    """One run of a restarted query over what is there: its lines, in the order of files and places."""
    out = []

    def take(df, _):
        out.append([(os.path.basename(r.path), r.line) for r in df.orderBy("path", "at").collect()])

    query = tail(spark, str(folder), **options).writeStream.foreachBatch(take).option("checkpointLocation", f"file://{state}/{name}").trigger(once=True).start()
    query.awaitTermination()
    return [x for batch in out for x in batch]


def line(i):
    return json.dumps({"n": i}) + "\n"


def test_tail_reads_what_files_gain_and_goes_on_after_restarts(spark, tmp_path):
    folder, state = tmp_path / "logs", tmp_path / "state"
    put(folder / "a.jsonl", line(1) + line(2) + '{"n"')
    put(folder / "sub" / "b.jsonl", line(10))
    put(folder / "c.txt", "no")
    assert run(spark, folder, state, "q") == [("a.jsonl", '{"n": 1}'), ("a.jsonl", '{"n": 2}'), ("b.jsonl", '{"n": 10}')]
    assert run(spark, folder, state, "q") == []
    # the half-written line is read once it is whole
    with open(folder / "a.jsonl", "a") as f:
        f.write(": 3}\n" + line(4)[:3])
    put(folder / "d.jsonl", b"\xff\n")
    assert run(spark, folder, state, "q") == [("a.jsonl", '{"n": 3}'), ("d.jsonl", "\ufffd")]
    # a rewritten file starts again, a shorter one too
    put(folder / "a.jsonl", line(7) + line(8) + line(9))
    put(folder / "sub" / "b.jsonl", line(5)[:-1] + " \n")
    assert run(spark, folder, state, "q") == [("a.jsonl", f'{{"n": {n}}}') for n in (7, 8, 9)] + [("b.jsonl", '{"n": 5} ')]
    assert run(spark, folder, state, "q") == []


def test_tail_keeps_large_files_for_later_and_limits_batches(spark, tmp_path):
    folder, state = tmp_path / "logs", tmp_path / "state"
    put(folder / "a.jsonl", "".join(map(line, range(10))))
    assert run(spark, folder, state, "q", maxFileBytes="20") == []
    assert len(run(spark, folder, state, "q", maxFileBytes="2000")) == 10
    put(folder / "b.jsonl", "".join(map(line, range(20))))
    positions = str(tmp_path / "positions")
    seen = []
    for _ in range(12):
        got = run(spark, folder, state, "limited", maxBytes="70", positions=positions)
        assert len(got) <= 8
        seen += got
    assert sorted(seen) == sorted([("a.jsonl", line(i).strip()) for i in range(10)] + [("b.jsonl", line(i).strip()) for i in range(20)])


def test_tail_splits_long_stretches_at_lines(spark, tmp_path, monkeypatch):
    from lorekeep.sources import tail as module

    monkeypatch.setattr(module, "STEP", 64)
    folder = tmp_path / "logs"
    put(folder / "a.jsonl", "".join(map(line, range(100))) + "y" * 300 + "\n" + line(5))
    reader = module.TailReader({"path": str(folder)})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    lines = [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert len(parts) > 10 and lines == [line(i).strip() for i in range(100)] + ["y" * 300, '{"n": 5}']


def test_numeric_references_and_blocks_that_are_never_closed(spark):
    rows = [(1, "it&#8217;s &#x41;&#66; &amp;#67; &#0; &#xD800; &#128512;"), (2, "<p>a</p><script>var x = 1;"), (3, "b<!-- c"), (4, "<style>x</style>d"), (5, None)]
    got = {r.page_id: r.body for r in notes.html_text(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {1: "it\u2019s AB &#67; &#0; &#xD800; \U0001f600", 2: "a", 3: "b", 4: "d", 5: ""}

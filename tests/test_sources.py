"""Walks, ignore files, reconciling and watching of real folders; keyed tables."""

import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, walk
from quarry.sources.manifest import Conflict, Manifest
from quarry.streaming import upkeep


def _tree(root, names):
    for name, text in names.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_walk_finds_hidden_names_and_keeps_to_ignore_files(spark, tmp_path):
    _tree(tmp_path, {"pkg/__init__.py": "", "pkg/_x.py": "x", "pkg/.hidden.ts": "x", "__tests__/a.ts": "x", "a b.py": "1", "node_modules/m/i.js": "x", "out/keep.ts": "x", "sub/.gitignore": "/only.ts\nlog/\n*.tmp.ts\n", "sub/only.ts": "", "sub/deep/only.ts": "", "sub/log/x.ts": "", "only.ts": "", "sub/b.tmp.ts": "", "b.tmp.ts": "", ".gitignore": "node_modules/\n# note\nout/*\n!out/keep.ts\n", ".indexignore": "big.ts\n", "big.ts": "y", "sub/deep/.gitignore": "!b.tmp.ts", "sub/deep/b.tmp.ts": ""})
    rows = {r.relative: r.ignored for r in walk.walked(spark, f"file://{tmp_path}").collect()}
    assert rows == {"pkg/__init__.py": False, "pkg/_x.py": False, "pkg/.hidden.ts": False, "__tests__/a.ts": False, "a b.py": False, "node_modules/": True, "out/keep.ts": False, "sub/.gitignore": False, "sub/only.ts": True, "sub/deep/only.ts": False, "sub/log/": True, "only.ts": False, "sub/b.tmp.ts": True, "b.tmp.ts": False, ".gitignore": False, ".indexignore": False, "big.ts": True, "sub/deep/.gitignore": False, "sub/deep/b.tmp.ts": False}
    got = {r.relative for r in walk.scan(spark, str(tmp_path)).collect()}
    assert got == {"pkg/__init__.py", "pkg/_x.py", "pkg/.hidden.ts", "a b.py", "out/keep.ts", "sub/deep/only.ts", "only.ts", "b.tmp.ts", "sub/deep/b.tmp.ts"}
    assert "big.ts" in {r.relative for r in walk.scan_all(spark, str(tmp_path)).collect()}
    everything = walk.listed(spark, str(tmp_path))
    assert everything.count() == 19 and {r.relative for r in walk.listed(spark, str(tmp_path), "*.js").collect()} == {"node_modules/m/i.js"}
    assert walk.walked(spark, str(tmp_path / "nothing here")).where("unreadable").count() == 1


def test_walk_of_many_folders_goes_by_rounds(spark, tmp_path):
    names = {f"d{a}/e{b}/f{c}.py": "" for a in range(12) for b in range(12) for c in range(2)} | {"/".join("x" * 40) + "/deep.py": ""}
    _tree(tmp_path, names)
    assert {r.relative for r in walk.walked(spark, str(tmp_path), per_task=20).collect()} == set(names)


def test_rules_hold_below_their_folder(spark):
    paths = ["a/x.log", "a/b/x.log", "x.log", "b/keep.log", "a/b/keep.log"]
    rules = [("", "keep.log"), ("a", "/x.log"), ("a/b", "!keep.log")]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.is_ignored_below(F.col("p"), rules).alias("gone")).collect()
    known = walk.Rules()
    want = {"a/x.log": True, "a/b/x.log": False, "x.log": False, "b/keep.log": True, "a/b/keep.log": False}
    assert {r.p: r.gone for r in rows} == want == {p: known.ignored(p, [{"base": b, "line": x} for b, x in rules]) for p in paths}


@pytest.mark.parametrize("most", [1, 2, 3, 100])
def test_reconcile_takes_all_files_of_one_time(spark, tmp_path, most):
    at = datetime(2024, 1, 1)
    rows = [(f"f{k}", at) for k in range(5)] + [("old", at - timedelta(days=1)), ("z", None), ("new", at + timedelta(days=1))]
    table = spark.createDataFrame(rows, "relative string, modified timestamp")
    got = []
    while True:
        again = files.Reconciler(spark, f"file://{tmp_path}/marks", most)  # a new run each time
        taken = [r.relative for r in again.batch(table).collect()]
        if not taken:
            break
        again.done(again.batch(table))
        got.extend(taken)
    assert got == ["z", "old", "f0", "f1", "f2", "f3", "f4", "new"]
    more = table.unionByName(spark.createDataFrame([("a-late", at + timedelta(days=2))], table.schema))
    run = files.Reconciler(spark, f"file://{tmp_path}/marks", most)
    assert [r.relative for r in run.batch(more).collect()] == ["a-late"]
    assert run.batch(more, F.lit(at + timedelta(days=1))).count() == 0
    run.done(run.batch(more.limit(0)))
    assert run.mark == files.Reconciler(spark, f"file://{tmp_path}/marks").mark


def test_manifest_gives_a_version_to_one_writer_only(spark, tmp_path):
    one, two = Manifest(spark, f"file://{tmp_path}/m"), Manifest(spark, f"file://{tmp_path}/m")
    assert one.latest() == (-1, None)
    for k in range(5):
        assert one.commit(k - 1, {"k": k, "é": "ü"}) == k
    assert two.latest() == (4, {"k": 4, "é": "ü"})
    with pytest.raises(Conflict):
        two.commit(3, {"k": "late"})
    assert sorted(p for p in os.listdir(tmp_path / "m") if not p.startswith(".")) == [f"manifest-{k}.json" for k in (2, 3, 4)]


def test_watch_tells_additions_changes_and_removals(spark, tmp_path):
    root, state = tmp_path / "root", f"file://{tmp_path}/state"
    _tree(root, {"a.py": "1", "_b.py": "2", "skip.log": "3", "sub/__init__.py": ""})
    later = datetime.now(UTC) + timedelta(seconds=60)
    look = lambda w, now=later: {r.relative: r.change for r in w.poll(now).collect()}
    watch = upkeep.Watch(spark, str(root), state, ["*.log"])
    assert look(watch) == {"a.py": "add", "_b.py": "add", "sub/__init__.py": "add"}
    assert look(watch) == {"a.py": "add", "_b.py": "add", "sub/__init__.py": "add"}  # not committed
    watch.commit()
    _tree(root, {"a.py": "longer", "new.py": "n"})
    (root / "_b.py").unlink()
    again = upkeep.Watch(spark, str(root), state, ["*.log"])
    assert look(again, datetime.now(UTC) - timedelta(seconds=60)) == {"_b.py": "unlink"}  # the others are too young
    assert look(again) == {"a.py": "change", "new.py": "add", "_b.py": "unlink"}
    again.commit()
    assert look(again) == {}
    quiet = upkeep.Watch(spark, str(root), f"file://{tmp_path}/other", initial=False)
    assert look(quiet) == {}


def test_watch_as_a_stream_repeats_a_failed_batch(spark, tmp_path):
    root, seen = tmp_path / "root", []
    _tree(root, {"a.py": "1"})
    watch = upkeep.Watch(spark, str(root), f"file://{tmp_path}/state", stable=0)

    def apply(found, batch):
        seen.append({r.relative: r.change for r in found.collect()})
        if len(seen) == 1:
            raise RuntimeError("not yet")

    with pytest.raises(Exception, match="not yet"):
        watch.stream(apply).start().awaitTermination(60)
    running = watch.stream(apply).start()
    try:
        until = time.time() + 90
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
        (root / "a.py").unlink()
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        running.stop()
    assert seen == [{"a.py": "add"}, {"a.py": "add"}, {"a.py": "unlink"}] and watch.counts == {"add": 1, "change": 0, "unlink": 1}

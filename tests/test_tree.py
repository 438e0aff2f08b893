"""The file-tree source against the operating system's own walk."""

import os
import random

import pytest

from capsift.sources import readers
from capsift.sources import tree as source


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    """10,000 files in folders of every depth, some empty, some folders empty, one folder with a third of all."""
    root = tmp_path_factory.mktemp("big")
    rng = random.Random(1)
    folders = [root]
    for i in range(400):
        folders.append(rng.choice(folders) / f"d{i}")
        folders[-1].mkdir()
    (root / "wide").mkdir()
    for i in range(10_000):
        at = root / "wide" if i % 3 == 0 else rng.choice(folders)
        (at / f"f{i}.{rng.choice(['log', 'py', 'x.gz'])}").write_bytes(b"x" * (i % 5))
    return str(root)


def walked(root):
    out = set()
    for folder, dirs, files in os.walk(root):
        out |= {(f"file:{folder}/{d}", True, 0) for d in dirs}
        out |= {(f"file:{folder}/{f}", False, os.path.getsize(f"{folder}/{f}")) for f in files}
    return out


@pytest.mark.parametrize("partitions,wide", [(1, 4096), (256, 4096), (64, 8)])
def test_tree_equals_a_walk(spark, big, monkeypatch, partitions, wide):
    monkeypatch.setattr(source, "WIDE", wide)
    df = source.tree(spark, big, partitions=partitions)
    rows = [(r.path, r.is_dir, r.size) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == walked(big)
    assert (df.rdd.getNumPartitions() > 1) == (partitions > 1)


def test_planner_holds_folders_not_files(big):
    parts = source.TreeReader({"roots": f'["file:{big}"]', "partitions": "64"}).partitions()
    assert 64 <= len(parts) < 600 and all(os.path.isdir(p.folder) for p in parts)


def test_wide_folders_are_cut_by_name(tmp_path, monkeypatch):
    monkeypatch.setattr(source, "WIDE", 3)
    for i in range(10):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f").write_text("")
    (tmp_path / "top").write_text("abc")
    reader = source.TreeReader({"roots": f'["file:{tmp_path}"]'})
    parts = reader.partitions()
    assert len(parts) == source.SLICES
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 21 and sum(r["size"] for r in rows) == 3


def test_empty_files_and_folders_are_listed(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "sub" / "node_modules" / "deep").mkdir(parents=True)
    (tmp_path / "sub" / "node_modules" / "deep" / "a.js").write_text("q")
    (tmp_path / "sub" / "zero.py").write_bytes(b"")
    (tmp_path / ".env").write_text("A=1")
    os.symlink(tmp_path, tmp_path / "loop")
    got = {(r["name"], r["is_dir"], r["ext"], r["size"]) for r in readers.listing(spark, str(tmp_path), folders=True).collect() if r["name"] != "loop"}
    assert got == {("none", True, None, 0), ("sub", True, None, 0), ("zero.py", False, ".py", 0), (".env", False, ".env", 3)}
    assert {r["name"] for r in readers.listing(spark, str(tmp_path), show_all=True).collect()} == {"zero.py", ".env", "a.js", "loop"}


def test_empty_text_files_become_empty_captures(spark, tmp_path):
    for name, text in {"a b+c%é[1].log": "", "sub/b.log": "x\r\n", "sub/c.log": "", "_skipped": "", ".hidden/x": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    first = {r.path: (r.capture_id, r.raw) for r in readers.text_captures(spark, str(tmp_path)).collect()}
    assert sorted(raw for _, raw in first.values()) == ["", "", "x\n"]
    for name in ("a b+c%é[1].log", "sub/c.log"):
        (tmp_path / name).write_text("now")
    later = {r.path: r.capture_id for r in readers.text_captures(spark, str(tmp_path)).collect()}
    assert {p: c for p, (c, _) in first.items()} == later  # an id does not change when a file is filled


def test_roots_may_be_files_and_patterns(spark, tmp_path):
    for name in ("x1/a", "x2/b", "y/c"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("1")
    assert {r["name"] for r in readers.listing(spark, f"{tmp_path}/x*").collect()} == {"a", "b"}
    assert {r["name"] for r in readers.listing(spark, f"{tmp_path}/y/c").collect()} == {"c"}
    with pytest.raises(FileNotFoundError):
        readers.listing(spark, f"{tmp_path}/none")
    os.mkdir(tmp_path / "empty")
    assert readers.listing(spark, f"{tmp_path}/empty", folders=True).collect() == []

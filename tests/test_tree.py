"""Listing and reading of folder trees, against os.walk."""

import os

import pytest

from millrace.plans import directory_to_requests, vision_to_requests
from millrace.sources import files, tree


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "root"
    for i, name in enumerate(["a.txt", "_b.txt", ".c.txt", "x/d.txt", "x/_y/.e.txt", ".git/f.txt", "x/z/noext", "x/p.PNG", "q.jpeg", ".r.webp"]):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x00\xff" * i + name.encode())
    (folder / "empty").mkdir()
    (folder / "x" / "loop").symlink_to(folder, target_is_directory=True)
    (folder / "link.txt").symlink_to(folder / "a.txt")
    (folder / "gone.txt").symlink_to(folder / "nothing.txt")
    return str(folder)


def listed(root):
    """Files below a folder; links to folders are not followed, links to nothing are no files."""
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if os.path.isfile(os.path.join(d, n)))


def test_walk_lists_every_file(spark, root):
    rows = tree.walk(spark, root).collect()
    assert sorted(r.path for r in rows) == listed(root)
    assert all(r.length == os.path.getsize(r.path) for r in rows)
    assert sorted(r.path for r in tree.walk(spark, "file://" + root, recursive=False).collect()) == [p for p in listed(root) if os.path.dirname(p) == root]
    with pytest.raises(Exception, match="No such file"):
        tree.walk(spark, root + "/missing")


def test_contents_limits_and_errors(spark, root):
    class Refuse:
        def __call__(self, path):
            assert not path.endswith("_b.txt"), "a file above the limit was opened"
            if path.endswith("d.txt"):
                raise PermissionError(13, "Permission denied")
            return tree.open_path(path)

    found = tree.walk(spark, root)
    got = {os.path.relpath(r.path, root): r for r in tree.read(found.where("path like '%.txt'"), 7, Refuse()).collect()}
    assert got["a.txt"].content == b"a.txt" and got["a.txt"].error is None
    assert got["_b.txt"].length == 8 and got["_b.txt"].content is None and got["_b.txt"].error is None
    os.truncate(os.path.join(root, "x", "d.txt"), 3)
    again = {os.path.relpath(r.path, root): r for r in tree.read(tree.walk(spark, root), 7, Refuse()).collect()}
    assert again["x/d.txt"].content is None and again["x/d.txt"].error == "cannot be read: Permission denied"


def test_reports_count_unreadable_files(spark, root):
    def refuse(path):
        raise OSError("the disk is gone")

    texts = files.read_text_files(spark, root, "*.txt", open_file=refuse)
    assert texts.where("error = 'cannot be read: the disk is gone'").count() == 7
    os.remove(os.path.join(root, "gone.txt"))
    report = directory_to_requests(spark, root, file_pattern="*.txt").report().first()
    assert (report.total, report.failed_conversions) == (7, 0)
    images = vision_to_requests(spark, root, file_pattern="**/*.{PNG,webp}").report().first()
    assert (images.found, images.converted, images.failed) == (2, 2, 0)


def test_unknown_schemes_are_left_to_spark():
    assert tree.reachable("/a/b") and tree.reachable("file:/a") and not tree.reachable("viewfs://c/a")

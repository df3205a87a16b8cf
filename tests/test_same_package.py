"""Test files and the files beside them, against brute force."""

from graphloom.plans import relations as rel
from graphloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_test_file_has_its_pairs(spark):
    files = rel.files(spark, DATA).select("path", "dir", "is_test").collect()
    want = sorted((t["path"], s["path"]) for t in files if t["is_test"] for s in files if s["dir"] == t["dir"] and s["path"] != t["path"])
    got = sorted(map(tuple, QUERIES["join_test_same_package_whole"](spark, DATA).collect()))
    assert got == want

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.model import normal, number, within
from tracecairn import TraceOptions
from tracecairn import functions as fn
from tracecairn.functions import syscalls
from tracecairn.functions.paths import absolute_target


# The syscall names of the two classes.
PATH_OPS = (
    "newfstatat", "statx", "stat", "lstat",
    "openat", "openat2", "open",
    "getdents64", "getdents",
    "mkdir", "mkdirat", "rmdir",
    "renameat", "renameat2",
    "utimensat",
    "setxattr", "lsetxattr", "getxattr", "lgetxattr", "listxattr", "llistxattr",
    "unlink", "unlinkat", "linkat", "symlinkat",
)
IO_OPS = ("read", "write", "pread64", "pwrite64", "readv", "writev")


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f, kind="string"):
    rows = column(spark, values, kind).select("i", f(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]


NUMBERS = ["0x80000", "0X1f", "0x", "0xzz", "-2", "12abc", "", None, " 7", "+7", "524288", "007",
           "9223372036854775807", "0x7fffffffffff", "-100x", "abc"]


@pytest.mark.parametrize("signed", [False, True])
def test_parse_num(spark, signed):
    got = apply(spark, NUMBERS, lambda c: fn.parse_num(c, signed))
    assert got == [number(v, signed) for v in NUMBERS]


def test_parse_num_overflow_is_zero(spark):
    assert apply(spark, ["99999999999999999999", "0xffffffffffffffffff"], fn.parse_num) == [0, 0]


def test_wrap_int32(spark):
    values = [0, 5, 2**31 - 1, 2**31, 2**32 - 100, 2**32 + 3, -100]
    assert apply(spark, values, fn.wrap_int32, "bigint") == [
        0, 5, 2**31 - 1, -2**31, -100, 3, -100]


def test_every_syscall_name_is_classified(spark):
    names = [*PATH_OPS, *IO_OPS, "rename", "close", "fsync", "", None]
    want = ["meta"] * 25 + ["io"] * 6 + ["other"] * 5
    assert apply(spark, names, fn.classify_op) == want
    assert set(syscalls.PATH_OPS) == set(PATH_OPS) and set(syscalls.IO_OPS) == set(IO_OPS)
    assert apply(spark, ["rename", "renameat"], fn.is_path_op) == [False, True]


def test_sides(spark):
    assert apply(spark, ["source", "target", "Source", "", None], fn.parse_side) == [
        "source", "target", "other", "other", "other"]


def test_unknown_fd_takes_the_first_marker(spark):
    values = ["/[unknown, fd=26]", "/data/fd=3/x fd=9", "fd=", "fd=x fd=4", "/p", "fd=007",
              "a\nfd=5", "/[unknown, fd=99999999999]"]
    assert apply(spark, values, fn.unknown_fd) == [26, 3, None, None, None, 7, 5, None]
    assert apply(spark, ["/p", "/[unknown, fd=4]"], fn.lookup_key) == ["p:/p", "fd:4"]


PATHS = ["/", "/a/../b", "/..", "//etc/x", "/../sandbox/x", "/a//b/./c/", "/a/b/../../..",
         "/.hidden/x", "/a/..b", "///x", "/plain/path", "/a/."]


@pytest.mark.parametrize("root", ["/tmp/sandbox", "/"])
def test_resolution(spark, root):
    targets = [p[1:] if p.startswith("//") else root.rstrip("/") + p for p in PATHS]
    resolved = apply(spark, PATHS, lambda c: fn.resolve_absolute(c, root))
    assert resolved == [normal(t) for t in targets]
    inside = apply(spark, PATHS, lambda c: fn.inside_root(fn.resolve_absolute(c, root), root))
    assert inside == [within(normal(t), root) for t in targets]
    assert apply(spark, ["/x"], lambda c: absolute_target(c, root)) == [root.rstrip("/") + "/x"]


def test_expected_resolutions_by_hand(spark):
    got = apply(spark, PATHS[:5], lambda c: fn.resolve_absolute(c, "/tmp/sandbox"))
    assert got == ["/tmp/sandbox", "/tmp/sandbox/b", "/tmp", "/etc/x", "/tmp/sandbox/x"]


def test_open_flags(spark):
    rows = column(spark, [0, 1, 2, 3, 0x80000, 0x241, 0x442, 0xC2], "bigint").select(
        "i", fn.decode_open_flags(F.col("v")).alias("f"), fn.open_mode(F.col("v")).alias("m"))
    got = [(r["f"]["access"], r["f"]["create"], r["f"]["excl"], r["f"]["trunc"], r["f"]["append"],
            r["m"]) for r in rows.orderBy("i").collect()]
    no = (False,) * 4
    assert got == [
        ("rdonly", *no, 0), ("wronly", *no, 0), ("rdwr", *no, 0), ("rdonly", *no, 0),
        ("rdonly", *no, 0), ("wronly", True, False, True, False, 0o644),
        ("rdwr", True, False, False, True, 0o644), ("rdwr", True, True, False, False, 0o644)]


def test_io_values(spark):
    assert apply(spark, [-5, 0, 10, 2**20, 2**20 + 1], fn.effective_length, "bigint") == [
        0, 0, 10, 2**20, 2**20]
    names = ["read", "pread64", "readv", "write", "pwrite64", "writev"]
    assert apply(spark, names, fn.io_direction) == ["read"] * 3 + ["write"] * 3
    assert apply(spark, names, fn.is_vectored) == [False, False, True, False, False, True]
    assert apply(spark, names, lambda c: fn.io_offset(c, F.lit(4096))) == [
        None, 4096, None, None, 4096, None]


def test_actions(spark):
    names = ["openat", "close", "read", "statx", "rename", "renameat", "getdents64", "fsync"]
    assert apply(spark, names, fn.dry_action) == [
        "open", "close", "io", "meta", "other", "meta", "meta", "other"]
    assert apply(spark, names, lambda c: fn.real_action(c, F.lit("/new"))) == [
        "open", "close", "io", "stat", "rename", "rename", "rename", "rename"]
    assert apply(spark, names[4:], lambda c: fn.real_action(c, F.lit(""))) == ["skip"] * 4


def test_options():
    assert TraceOptions().sandbox_root == "/tmp/sandbox"
    for bad in ({"pace_mode": "scaled", "speed": 0}, {"bucket_width": 0}, {"sandbox_root": ""},
                {"pace_mode": "slow"}, {"rows_per_slice": 0}):
        with pytest.raises(ValueError):
            TraceOptions(**bad)
    with pytest.raises(ValueError):
        TraceOptions().require_source()
    read = TraceOptions.from_json(
        '{"speed": 2, "max_events": "many", "pid_filter": [1, "x", 3], "pace_mode": "warp",'
        ' "dry_run": 1, "side_filter": "target", "unknown": 0}')
    assert (read.speed, read.max_events, read.pid_filter) == (2.0, 0, (1, 3))
    assert (read.pace_mode, read.dry_run, read.side_filter) == ("fast", False, "target")
    with pytest.raises(ValueError):
        TraceOptions.from_json("{")

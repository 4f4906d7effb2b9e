"""Classification of system calls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syscall names of each class.
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
RENAME_OPS = ("renameat", "renameat2", "rename")
OPEN_OPS = ("openat", "openat2", "open")
STAT_OPS = ("stat", "lstat", "newfstatat", "statx")
MKDIR_OPS = ("mkdir", "mkdirat")
UNLINK_OPS = ("unlink", "unlinkat")
READ_OPS = ("read", "pread64", "readv")
POSITIONED_OPS = ("pread64", "pwrite64")
VECTORED_OPS = ("readv", "writev")
CLOSE_OP = "close"
EXIT_OP = "exit_group"


def is_path_op(sc: Column) -> Column:
    return sc.isin(*PATH_OPS)


def is_io_op(sc: Column) -> Column:
    return sc.isin(*IO_OPS)


def is_rename_op(sc: Column) -> Column:
    return sc.isin(*RENAME_OPS)


def is_open_op(sc: Column) -> Column:
    return sc.isin(*OPEN_OPS)


def classify_op(sc: Column) -> Column:
    return F.when(is_io_op(sc), "io").when(is_path_op(sc), "meta").otherwise("other")


def parse_side(side: Column) -> Column:
    return F.when(side.isin("source", "target"), side).otherwise("other")


def is_rename(rename_dst: Column) -> Column:
    """A row counts as a rename when it has a destination, whatever its syscall."""
    return F.coalesce(F.length(rename_dst) > 0, F.lit(False))


def dry_action(sc: Column) -> Column:
    """How a simulated run treats a row."""
    return (
        F.when(is_open_op(sc), "open")
        .when(sc == CLOSE_OP, "close")
        .when(is_io_op(sc), "io")
        .when(is_path_op(sc), "meta")
        .otherwise("other")
    )


def real_action(sc: Column, rename_dst: Column) -> Column:
    """Which operation an executor would issue for a row."""
    return (
        F.when(is_open_op(sc), "open")
        .when(sc == CLOSE_OP, "close")
        .when(is_io_op(sc), "io")
        .when(sc.isin(*STAT_OPS), "stat")
        .when(sc.isin(*MKDIR_OPS), "mkdir")
        .when(sc.isin(*UNLINK_OPS), "unlink")
        .when(is_rename(rename_dst), "rename")
        .otherwise("skip")
    )


def io_direction(sc: Column) -> Column:
    return F.when(sc.isin(*READ_OPS), "read").when(is_io_op(sc), "write")


def io_offset(sc: Column, arg2: Column) -> Column:
    return F.when(sc.isin(*POSITIONED_OPS), arg2)


def is_vectored(sc: Column) -> Column:
    return sc.isin(*VECTORED_OPS)

"""Path selection, lookup keys and resolution under a sandbox root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracecairn.functions.syscalls import is_rename

# Fixed value: the marker before a descriptor number in an unresolved path.
FD_MARKER = "fd="


def best_path(path: Column, canonical_path: Column, mapped: Column) -> Column:
    """The canonical path where the row is mapped to one, else the recorded path."""
    return F.when(mapped & (F.length(canonical_path) > 0), canonical_path).otherwise(path)


def unknown_fd(path: Column) -> Column:
    """The number after the first ``fd=`` of a path, or null."""
    at = F.locate(FD_MARKER, path)
    digits = F.regexp_extract(F.substr(path, at + len(FD_MARKER)), "^[0-9]+", 0)
    return F.when(at > 0, digits.try_cast("int"))


def lookup_key(path: Column) -> Column:
    """Key that finds a descriptor: ``fd:<n>`` for unresolved paths, else ``p:<path>``."""
    fd = unknown_fd(path)
    return F.when(fd.isNotNull(), F.concat(F.lit("fd:"), fd.cast("string"))).otherwise(
        F.concat(F.lit("p:"), path)
    )


def operation_path(best: Column, rename_dst: Column) -> Column:
    """The path an operation acts on: the destination for renames."""
    return F.when(is_rename(rename_dst), rename_dst).otherwise(best)


def is_relative(raw: Column) -> Column:
    return (F.length(raw) > 0) & ~raw.startswith("/")


def normalize_path(path: Column) -> Column:
    """Lexical normal form: no ``.``, ``..``, doubled or trailing slashes.

    Only paths that contain such parts pay for the segment-wise rewrite.
    """
    absolute = path.startswith("/")
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(acc: Column, s: Column) -> Column:
        dangling = ~absolute & ((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == ".."))
        return (
            F.when((s != "..") | dangling, F.array_append(acc, s))
            .when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(acc)
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    rewritten = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    untidy = (
        F.contains(path, F.lit("//")) | F.contains(path, F.lit("/."))
        | path.startswith(".") | path.endswith("/")
    )
    return F.when(untidy, rewritten).otherwise(path)


def inside_root(path: Column, root: str) -> Column:
    """Whether a normalised path is the root or lies below it."""
    if root == "/":
        return path.startswith("/")
    return (path == root) | path.startswith(root + "/")


def under_root(relative: Column, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), relative)


def absolute_target(raw: Column, root: str) -> Column:
    """Where an absolute path points before normalisation.

    One leading slash is dropped and the rest placed under the root; a rest that
    still starts with a slash is absolute again and leaves the root.
    """
    rest = F.substr(raw, F.lit(2))
    return F.when(rest.startswith("/"), rest).otherwise(under_root(rest, root))


def resolve_absolute(raw: Column, root: str) -> Column:
    return normalize_path(absolute_target(raw, root))

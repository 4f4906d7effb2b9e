"""Text forms of events and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message formats.
EVENT_LINE = '[dry] ts=%.6f pid=%d %s ret=%d err=%d arg1=%d arg2=%d path="%s"'
NOTE_OPEN = "open %s -> ourFd=%d (origFd=%d)"
NOTE_CLOSE = 'close ourFd=%d (path="%s")'
NOTE_CLOSE_UNMAPPED = 'close fd mapping not found: pid=%d path="%s"'
NOTE_IO = "%s %d bytes via ourFd=%d (%s)"
NOTE_IO_UNMAPPED = 'IO fd mapping not found: pid=%d path="%s"'
NOTE_META = "%s -> %s"
NOTE_OTHER = "non open/io/close/meta operation, skipped"
NOTE_NO_PATH = "event has no resolvable path"
NOTE_DIRFD = "dirfd of a relative path is not registered in the fd table: pid=%d dirfd=%d"
NOTE_TRAVERSAL = "path traversal rejected: %s -> %s"
NOTE_FD_RANGE = "returned descriptor is out of range: %d"


def event_line(r: dict[str, Column] | None = None) -> Column:
    """One line of text per event, the timestamp with six decimals."""
    c = r or {}

    def col(name: str) -> Column:
        return c.get(name, F.col(name))

    return F.format_string(
        EVENT_LINE, col("machine_ts"), col("pid"), col("sc"), col("ret"), col("err"),
        col("arg1"), col("arg2"), col("path"),
    )


def outcome_note() -> Column:
    """Explanation of an outcome row (needs the columns of ``operators.outcomes``)."""
    c = F.col
    return (
        F.when(c("reason") == "no_path", NOTE_NO_PATH)
        .when(c("reason") == "dirfd_unregistered",
              F.format_string(NOTE_DIRFD, c("pid"), c("dirfd")))
        .when(c("reason") == "traversal",
              F.format_string(NOTE_TRAVERSAL, c("target"), c("resolved")))
        .when(c("reason") == "fd_range", F.format_string(NOTE_FD_RANGE, c("ret")))
        .when(c("action") == "open",
              F.format_string(NOTE_OPEN, c("resolved"), c("our_fd"), c("ret")))
        .when(c("action") == "meta", F.format_string(NOTE_META, c("sc"), c("resolved")))
        .when((c("action") == "io") & (c("status") == "ok"),
              F.format_string(NOTE_IO, c("sc"), c("ret"), c("our_fd"), c("session_path")))
        .when(c("action") == "io",
              F.format_string(NOTE_IO_UNMAPPED, c("pid"), c("lookup_path")))
        .when((c("action") == "close") & (c("status") == "ok"),
              F.format_string(NOTE_CLOSE, c("our_fd"), c("lookup_path")))
        .when(c("action") == "close",
              F.format_string(NOTE_CLOSE_UNMAPPED, c("pid"), c("lookup_path")))
        .otherwise(NOTE_OTHER)
    )

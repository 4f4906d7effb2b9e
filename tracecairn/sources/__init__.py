from tracecairn.sources.audit import order_certificate, read_report
from tracecairn.sources.normalize import normalize, row_filter
from tracecairn.sources.reader import buckets_opened, read_events, read_quarantine, read_trace
from tracecairn.sources.writer import (
    commit_outcomes,
    committed_outcomes,
    write_outcomes,
    write_trace,
)

__all__ = [
    "buckets_opened", "commit_outcomes", "committed_outcomes", "normalize", "order_certificate",
    "read_events", "read_quarantine", "read_report", "read_trace", "row_filter", "write_outcomes",
    "write_trace",
]

from tracecairn.functions.numbers import (
    as_fd,
    decode_open_flags,
    effective_length,
    open_mode,
    parse_num,
    wrap_int32,
)
from tracecairn.functions.paths import (
    best_path,
    inside_root,
    is_relative,
    lookup_key,
    normalize_path,
    operation_path,
    resolve_absolute,
    unknown_fd,
)
from tracecairn.functions.syscalls import (
    classify_op,
    dry_action,
    io_direction,
    io_offset,
    is_io_op,
    is_open_op,
    is_path_op,
    is_rename,
    is_rename_op,
    is_vectored,
    parse_side,
    real_action,
)
from tracecairn.functions.text import event_line, outcome_note

__all__ = [
    "as_fd", "best_path", "classify_op", "decode_open_flags", "dry_action", "effective_length",
    "event_line", "inside_root", "io_direction", "io_offset", "is_io_op", "is_open_op",
    "is_path_op", "is_relative", "is_rename", "is_rename_op", "is_vectored", "lookup_key",
    "normalize_path", "open_mode", "operation_path", "outcome_note", "parse_num", "parse_side",
    "real_action", "resolve_absolute", "unknown_fd", "wrap_int32",
]

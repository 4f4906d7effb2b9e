"""The catalog's queries as DuckDB SQL over the same ``events`` table.

The descriptor table is stepped with a recursive query: one row per process and
control row, the state a list of open descriptors.
"""

from __future__ import annotations

from tracecairn.plans import catalog
from tracecairn.sources.sample import CHAINED_SQL, EXITING_SQL, TRACE_SQL

ROOT = catalog.DEFAULT.sandbox_root

# The syscall names of each class, stated again so that the twins don't lean on what
# they check.
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


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _num(x: str, signed: bool = False) -> str:
    digits = "^-?[0-9]+" if signed else "^[0-9]+"
    return (
        f"coalesce(CASE WHEN {x} LIKE '0x%' THEN try_cast({x} AS BIGINT) "
        f"ELSE try_cast(nullif(regexp_extract({x}, '{digits}'), '') AS BIGINT) END, 0)"
    )


def _normal(x: str) -> str:
    parts = f"list_filter(string_split({x}, '/'), lambda s: s NOT IN ('', '.'))"
    step = ("lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') "
            "ELSE a || '/' || s END")
    return f"coalesce(nullif(list_reduce(list_prepend('', {parts}), {step}), ''), '/')"


def _resolved(x: str) -> str:
    return _normal(f"CASE WHEN {x} LIKE '//%' THEN substr({x}, 2) ELSE '{ROOT}' || {x} END")


def _inside(x: str) -> str:
    return f"({x} = '{ROOT}' OR starts_with({x}, '{ROOT}/'))"


def _typed(signed: bool = False, trace: str = TRACE_SQL) -> str:
    """``ev``: typed events with everything that follows from the row itself."""
    numbers = ", ".join(f"{_num(n, signed)} AS {n}" for n in ("ret", "err", "arg1", "arg2"))
    return f"""
trace AS MATERIALIZED ({trace}),
typed AS (
  SELECT log_offset, machine_ts, cast(round(machine_ts * 1e6) AS BIGINT) AS ts_us, pid, sc,
    {numbers}, path, coalesce(rename_src, '') AS rename_src,
    coalesce(rename_dst, '') AS rename_dst, coalesce(canonical_path, '') AS canonical_path,
    CASE WHEN mapped <> 0 AND canonical_path <> '' THEN canonical_path ELSE path END AS lookup_path,
    side, cast(bucket AS BIGINT) AS bucket,
    CASE WHEN sc IN {_in(IO_OPS)} THEN 'io' WHEN sc IN {_in(PATH_OPS)} THEN 'meta'
      ELSE 'other' END AS op_class,
    CASE WHEN sc IN {_in(OPEN_OPS)} THEN 'open' WHEN sc = 'close' THEN 'close'
      WHEN sc IN {_in(IO_OPS)} THEN 'io' WHEN sc IN {_in(PATH_OPS)} THEN 'meta'
      ELSE 'other' END AS action
  FROM trace),
raws AS (
  SELECT *, try_cast(nullif(regexp_extract(lookup_path, 'fd=([0-9]*)', 1), '') AS INTEGER) AS unknown_fd,
    CASE WHEN rename_dst <> '' THEN rename_dst ELSE lookup_path END AS raw
  FROM typed),
ev AS MATERIALIZED (
  SELECT *, CASE WHEN raw LIKE '/%' THEN {_resolved('raw')} END AS resolved FROM raws)"""


def _selected(where: str = "TRUE", cap: int | None = None) -> str:
    keep = f"QUALIFY row_number() OVER (ORDER BY machine_ts, log_offset) <= {cap}" if cap else ""
    return f"sel AS MATERIALIZED (SELECT * FROM ev WHERE {where} {keep})"


def _tracked(fd_rule: str = "ret >= 0") -> str:
    """From ``sel``: control rows ``ctl``, states ``st``, and ``att`` with each row's session."""
    ok = f"action = 'open' AND raw <> '' AND resolved IS NOT NULL AND {_inside('resolved')}"
    return f"""
numbered AS MATERIALIZED (
  SELECT *, 2 + row_number() OVER (ORDER BY machine_ts, log_offset) AS our_fd
  FROM sel WHERE {ok}),
ctl AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY machine_ts, log_offset) AS rn FROM (
    SELECT pid, machine_ts, log_offset, 'open' AS op, ret AS fd, lookup_path AS path
    FROM numbered WHERE {fd_rule}
    UNION ALL
    SELECT pid, machine_ts, log_offset, 'close', unknown_fd, lookup_path
    FROM sel WHERE action = 'close' AND lookup_path <> '')),
st AS (
  SELECT pid, cast(0 AS BIGINT) AS rn,
    cast([] AS STRUCT(fd BIGINT, off BIGINT, path VARCHAR, reach BOOLEAN)[]) AS s
  FROM (SELECT DISTINCT pid FROM sel)
  UNION ALL
  SELECT c.pid, c.rn, CASE
    WHEN c.op = 'open' THEN list_append(
      list_transform(list_filter(z.s, lambda x: x.fd <> c.fd), lambda x: struct_pack(
        fd := x.fd, off := x.off, path := x.path, reach := x.reach AND x.path <> c.path
          AND x.path IS DISTINCT FROM list_filter(z.s, lambda y: y.fd = c.fd)[1].path)),
      struct_pack(fd := c.fd, off := c.log_offset, path := c.path, reach := true))
    WHEN c.fd IS NOT NULL THEN
      list_transform(list_filter(z.s, lambda x: x.fd <> c.fd), lambda x: struct_pack(
        fd := x.fd, off := x.off, path := x.path, reach := x.reach
          AND x.path IS DISTINCT FROM list_filter(z.s, lambda y: y.fd = c.fd)[1].path))
    ELSE list_filter(z.s, lambda x: NOT (x.path = c.path AND x.reach)) END
  FROM st z JOIN ctl c ON c.pid = z.pid AND c.rn = z.rn + 1),
placed AS (
  SELECT e.*, coalesce(sum(CASE WHEN c.rn IS NULL THEN 0 ELSE 1 END) OVER (
    PARTITION BY e.pid ORDER BY e.machine_ts, e.log_offset
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM sel e LEFT JOIN ctl c ON c.log_offset = e.log_offset),
looked AS (
  SELECT p.*, list_filter(st.s, lambda x: CASE
      WHEN p.action IN ('io', 'close') AND p.unknown_fd IS NOT NULL THEN x.fd = p.unknown_fd
      WHEN p.action IN ('io', 'close') THEN x.reach AND x.path = p.lookup_path AND x.path <> ''
      WHEN p.raw <> '' AND p.raw NOT LIKE '/%' THEN x.fd = p.arg1 ELSE false END)[1] AS hit
  FROM placed p JOIN st ON st.pid = p.pid AND st.rn = p.prior),
found AS (
  SELECT * REPLACE (
      CASE WHEN target IS NOT NULL THEN {_normal('target')} END AS resolved) FROM (
    SELECT *, CASE WHEN raw LIKE '//%' THEN substr(raw, 2)
      WHEN raw LIKE '/%' THEN '{ROOT}' || raw
      WHEN raw <> '' AND hit IS NOT NULL THEN hit.path || '/' || raw END AS target FROM looked)),
att AS MATERIALIZED (
  SELECT f.*, f.hit.off AS session_offset, f.hit.path AS session_path,
    coalesce(own.our_fd, used.our_fd) AS our_fd,
    CASE WHEN f.raw = '' THEN 'no_path'
      WHEN f.resolved IS NULL AND f.hit IS NULL THEN 'dirfd_unregistered'
      WHEN NOT {_inside('f.resolved')} THEN 'traversal' END AS path_reason
  FROM found f LEFT JOIN numbered own ON own.log_offset = f.log_offset
  LEFT JOIN numbered used ON used.log_offset = f.hit.off),
outc AS MATERIALIZED (
  SELECT * EXCLUDE (session_offset),
    CASE WHEN action = 'open' THEN CASE WHEN path_reason IS NULL THEN log_offset END
      ELSE session_offset END AS session_offset,
    CASE WHEN action = 'other' THEN 'skipped'
      WHEN action IN ('io', 'close') THEN CASE WHEN hit IS NULL THEN 'skipped' ELSE 'ok' END
      WHEN path_reason IS NULL THEN 'ok' ELSE 'failed' END AS status,
    CASE WHEN action = 'other' THEN 'other_syscall'
      WHEN action IN ('io', 'close') THEN CASE WHEN hit IS NULL THEN 'fd_not_mapped' END
      ELSE path_reason END AS reason
  FROM att)"""


_TYPED = "WITH RECURSIVE " + _typed()
_FULL = f"{_TYPED}, {_selected()}, {_tracked()}"
_CAPPED_SEL = "side = 'source'"
_CAPPED = f"{_TYPED}, {_selected(_CAPPED_SEL, catalog.CAPPED.max_events)}, {_tracked()}"
_SIGNED = f"WITH RECURSIVE {_typed(True)}, {_selected()}, {_tracked()}"

# The texts of the notes.
_NOTE = """CASE
  WHEN reason = 'no_path' THEN 'event has no resolvable path'
  WHEN reason = 'dirfd_unregistered' THEN printf(
    'dirfd of a relative path is not registered in the fd table: pid=%d dirfd=%d', pid, arg1)
  WHEN reason = 'traversal' THEN printf('path traversal rejected: %s -> %s', target, resolved)
  WHEN action = 'open' THEN printf('open %s -> ourFd=%d (origFd=%d)', resolved, our_fd, ret)
  WHEN action = 'meta' THEN printf('%s -> %s', sc, resolved)
  WHEN action = 'io' AND status = 'ok' THEN
    printf('%s %d bytes via ourFd=%d (%s)', sc, ret, our_fd, session_path)
  WHEN action = 'io' THEN printf('IO fd mapping not found: pid=%d path="%s"', pid, lookup_path)
  WHEN action = 'close' AND status = 'ok' THEN
    printf('close ourFd=%d (path="%s")', our_fd, lookup_path)
  WHEN action = 'close' THEN
    printf('close fd mapping not found: pid=%d path="%s"', pid, lookup_path)
  ELSE 'non open/io/close/meta operation, skipped' END"""

_MOVED = "greatest(ret, 0)"
_IO_BYTES = f"least({_MOVED}, 1048576)"   # only where a buffer is issued

_OUTCOMES = f"""{_FULL}
SELECT log_offset, action, status, reason, {_NOTE} AS note FROM outc"""

# Opens of relative paths: whether one succeeds is known only at its turn.
_GOOD = f"""(op = 'open' AND CASE WHEN raw LIKE '/%' THEN static_ok
    ELSE raw <> '' AND base IS NOT NULL AND (base.path NOT LIKE '/%'
      OR {_inside(_normal("(base.path || '/' || raw)"))}) END)"""
_CHAINED_OPENS = f"""WITH RECURSIVE {_typed(trace=CHAINED_SQL)},
ctl AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY machine_ts, log_offset) AS rn FROM (
    SELECT pid, machine_ts, log_offset, action AS op, raw, arg1 AS dirfd,
      CASE WHEN action = 'open' THEN ret ELSE unknown_fd END AS fd, lookup_path AS path,
      coalesce(raw <> '' AND {_inside('resolved')}, false) AS static_ok
    FROM ev WHERE action = 'open' OR (action = 'close' AND lookup_path <> ''))),
st AS (
  SELECT pid, cast(0 AS BIGINT) AS rn,
    cast([] AS STRUCT(fd BIGINT, off BIGINT, path VARCHAR, reach BOOLEAN)[]) AS s
  FROM (SELECT DISTINCT pid FROM ctl)
  UNION ALL
  SELECT pid, rn, CASE
    WHEN op = 'open' AND NOT {_GOOD} THEN s
    WHEN op = 'open' THEN list_append(
      list_transform(list_filter(s, lambda x: x.fd <> fd), lambda x: struct_pack(
        fd := x.fd, off := x.off, path := x.path, reach := x.reach AND x.path <> path
          AND x.path IS DISTINCT FROM same.path)),
      struct_pack(fd := fd, off := log_offset, path := path, reach := true))
    WHEN fd IS NOT NULL THEN
      list_transform(list_filter(s, lambda x: x.fd <> fd), lambda x: struct_pack(
        fd := x.fd, off := x.off, path := x.path,
        reach := x.reach AND x.path IS DISTINCT FROM same.path))
    ELSE list_filter(s, lambda x: NOT (x.path = path AND x.reach)) END
  FROM (SELECT c.*, z.s, list_filter(z.s, lambda x: x.fd = c.dirfd)[1] AS base,
      list_filter(z.s, lambda x: x.fd = c.fd)[1] AS same
    FROM st z JOIN ctl c ON c.pid = z.pid AND c.rn = z.rn + 1)),
judged AS (
  SELECT *, {_GOOD} AS good, CASE WHEN raw LIKE '/%' OR raw = '' THEN 0 ELSE 1 END AS relative
  FROM (SELECT c.*, list_filter(z.s, lambda x: x.fd = c.dirfd)[1] AS base
    FROM st z JOIN ctl c ON c.pid = z.pid AND c.rn = z.rn + 1) WHERE op = 'open')
SELECT log_offset, pid, relative, cast(good AS INTEGER) AS opened,
  CASE WHEN raw = '' THEN 'no_path' WHEN good THEN NULL
    WHEN relative = 1 AND base IS NULL THEN 'dirfd_unregistered' ELSE 'traversal' END AS reason,
  CASE WHEN good THEN cast(2 + sum(cast(good AS INTEGER)) OVER (
    ORDER BY machine_ts, log_offset) AS BIGINT) END AS our_fd
FROM judged"""

# A process number is a new process after each exit.
_LIVES = f"""WITH RECURSIVE {_typed(trace=EXITING_SQL)},
sel AS MATERIALIZED (
  SELECT * REPLACE (pid * 1000000 + coalesce(sum(CASE WHEN sc = 'exit_group' THEN 1 ELSE 0 END) OVER (
    PARTITION BY pid ORDER BY machine_ts, log_offset
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pid) FROM ev), {_tracked()}"""

_GAPS = f"""{_TYPED}, gaps AS (
  SELECT *, greatest(machine_ts - coalesce(lag(machine_ts) OVER (
    ORDER BY machine_ts, log_offset), machine_ts), 0.0) AS gap_s FROM ev),
waits AS (
  SELECT *, cast(round(least(gap_s / 4.0, 3600.0) * 1e6) AS BIGINT) AS wait_us FROM gaps)"""


def _gap_table(by: str, where: str = "TRUE") -> str:
    return f"""{_TYPED}, g AS (
  SELECT {by}, cast(round((machine_ts - lag(machine_ts) OVER (
    PARTITION BY {by} ORDER BY machine_ts, log_offset)) * 1e6) AS BIGINT) AS gap
  FROM ev WHERE {where})
SELECT {by}, count(*) AS events, cast(coalesce(sum(gap), 0) AS BIGINT) AS idle_us,
  coalesce(max(gap), 0) AS longest_gap_us FROM g GROUP BY {by}"""


def _stats(prefix: str, keep: str, cap: int | None) -> str:
    if cap is None:
        seen = "SELECT * FROM ev"
    else:
        seen = f"""SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN {keep} THEN 1 ELSE 0 END) OVER (
    ORDER BY machine_ts, log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM ev) WHERE before <= {cap}"""
    return f"""{prefix}, seen AS ({seen}),
last_state AS (SELECT s FROM st QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rn DESC) = 1)
SELECT (SELECT count(*) FROM seen) AS total,
  count(*) FILTER (status <> 'failed') AS processed,
  count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed,
  (SELECT count(*) FROM seen WHERE NOT ({keep})) AS filtered,
  (SELECT cast(coalesce(sum(len(s)), 0) AS BIGINT) FROM last_state) AS residual,
  (SELECT min(ts_us) FROM seen) AS first_us, (SELECT max(ts_us) FROM seen) AS last_us
FROM outc"""


_SESSIONS = f"""{_FULL}, present AS (
  SELECT pid, rn, unnest(s) AS x FROM st),
lives AS (SELECT pid, x.off AS off, max(rn) AS last_rn FROM present GROUP BY pid, x.off)
SELECT o.pid, cast(o.ret AS INTEGER) AS fd, o.our_fd, o.lookup_path AS path,
  o.log_offset AS open_offset, e.log_offset AS end_offset,
  CASE WHEN e.op = 'close' THEN 'close' WHEN e.op = 'open' THEN 'reuse'
    ELSE 'open_at_end' END AS end_kind
FROM numbered o JOIN lives l ON l.pid = o.pid AND l.off = o.log_offset
LEFT JOIN ctl e ON e.pid = l.pid AND e.rn = l.last_rn + 1"""

_CHANGES = f"""{_FULL}, present AS (
  SELECT pid, rn, unnest(s) AS x FROM st),
keyed AS (
  SELECT pid, rn, concat('fd:', x.fd) AS key, x.off AS off FROM present
  UNION ALL SELECT pid, rn, 'p:' || x.path, x.off FROM present WHERE x.reach AND x.path <> ''),
changes AS (
  SELECT a.pid, a.key, a.rn, a.off FROM keyed a WHERE NOT EXISTS (
    SELECT 1 FROM keyed b WHERE b.pid = a.pid AND b.key = a.key AND b.rn = a.rn - 1
      AND b.off = a.off)
  UNION ALL
  SELECT a.pid, a.key, a.rn + 1, NULL FROM keyed a WHERE NOT EXISTS (
    SELECT 1 FROM keyed b WHERE b.pid = a.pid AND b.key = a.key AND b.rn = a.rn + 1))
SELECT h.pid, h.key, c.log_offset AS at_offset, h.off AS session_offset
FROM changes h JOIN ctl c ON c.pid = h.pid AND c.rn = h.rn"""

_PLAN = f"""{_FULL}, gaps AS (
  SELECT log_offset, cast(round(least(greatest(machine_ts - coalesce(lag(machine_ts) OVER (
    ORDER BY machine_ts, log_offset), machine_ts), 0.0) / 4.0, 3600.0) * 1e6) AS BIGINT) AS wait_us,
    machine_ts FROM sel),
paced AS (
  SELECT log_offset, wait_us, sum(wait_us) OVER (ORDER BY machine_ts, log_offset) AS issue_us
  FROM gaps),
acts AS (
  SELECT o.*, p.wait_us, cast(p.issue_us AS BIGINT) AS replay_offset_us,
    CASE WHEN sc IN {_in(OPEN_OPS)} THEN 'open' WHEN sc = 'close' THEN 'close'
      WHEN sc IN {_in(IO_OPS)} THEN 'io' WHEN sc IN {_in(STAT_OPS)} THEN 'stat'
      WHEN sc IN {_in(MKDIR_OPS)} THEN 'mkdir' WHEN sc IN {_in(UNLINK_OPS)} THEN 'unlink'
      WHEN rename_dst <> '' THEN 'rename' ELSE 'skip' END AS act,
    CASE WHEN rename_src LIKE '/%' THEN {_resolved('rename_src')} END AS src
  FROM outc o JOIN paced p USING (log_offset)),
why AS (
  SELECT *, CASE
    WHEN act = 'rename' THEN coalesce(CASE WHEN rename_src = '' THEN 'no_path'
      WHEN src IS NULL THEN 'dirfd_unregistered' WHEN NOT {_inside('src')} THEN 'traversal' END,
      path_reason)
    WHEN act IN ('open', 'stat', 'mkdir', 'unlink') THEN path_reason
    WHEN act IN ('io', 'close') AND hit IS NULL THEN 'fd_not_mapped'
    WHEN act = 'skip' THEN 'not_supported' END AS why
  FROM acts)
SELECT log_offset, act AS action,
  CASE WHEN why IN ('fd_not_mapped', 'not_supported') THEN 'skip'
    WHEN why IS NOT NULL THEN 'reject' ELSE 'issue' END AS status,
  why AS reason,
  CASE WHEN act IN ('open', 'stat', 'mkdir', 'unlink', 'rename') THEN resolved END AS target,
  CASE WHEN act = 'rename' THEN src END AS source,
  CASE WHEN act = 'open' THEN CASE arg1 & 3 WHEN 1 THEN 'wronly' WHEN 2 THEN 'rdwr'
    ELSE 'rdonly' END END AS access,
  CASE WHEN act = 'open' THEN cast((arg1 & 64) <> 0 AS INTEGER) END AS creates,
  CASE WHEN act = 'open' THEN CASE WHEN (arg1 & 64) <> 0 THEN 420 ELSE 0 END
    WHEN act = 'mkdir' THEN 493 END AS mode,
  CASE WHEN act = 'io' THEN CASE WHEN sc IN ('read', 'pread64', 'readv') THEN 'read'
    ELSE 'write' END END AS direction,
  CASE WHEN act = 'io' THEN {_IO_BYTES} END AS length,
  CASE WHEN sc IN ('pread64', 'pwrite64') THEN arg2 END AS file_offset,
  CASE WHEN act = 'io' THEN cast(sc IN ('readv', 'writev') AS INTEGER) END AS vectored,
  CASE WHEN act IN ('open', 'io', 'close') THEN session_offset END AS session_offset,
  CASE WHEN act IN ('open', 'io', 'close') THEN our_fd END AS our_fd,
  wait_us, replay_offset_us
FROM why"""



def _profile(bucket: str = "bucket") -> str:
    return f"""{_TYPED}
SELECT {bucket} AS bucket, count(*) AS ops, count(*) FILTER (op_class = 'io') AS io_ops,
  cast(coalesce(sum({_MOVED}) FILTER (op_class = 'io'), 0) AS BIGINT) AS io_bytes
FROM ev GROUP BY 1"""


def _late() -> str:
    clock = f"(machine_ts / {catalog.SQUEEZE})"
    early = f"{clock} < {catalog.SPLIT_TS / catalog.SQUEEZE}"
    return f"""{_TYPED}, timed AS (
  SELECT *, cast(floor({clock} / 600) AS BIGINT) AS b, {early} AS early FROM ev
), judged AS (
  SELECT *, early AND (b + 1) * 600 <= (
    SELECT max({clock}) FILTER (NOT early) - {catalog.LATE_SECONDS} FROM timed) AS is_late
  FROM timed
)
SELECT b AS bucket, count(*) FILTER (NOT is_late) AS ops,
  count(*) FILTER (NOT is_late AND op_class = 'io') AS io_ops,
  cast(coalesce(sum({_MOVED}) FILTER (NOT is_late AND op_class = 'io'), 0) AS BIGINT) AS io_bytes,
  count(*) FILTER (is_late) AS late
FROM judged GROUP BY b"""


_SIDES = f"""{_FULL}, calls AS (
  SELECT pid, session_offset, string_agg(sc, ',' ORDER BY machine_ts, log_offset) AS calls
  FROM outc WHERE status = 'ok' AND action IN ('open', 'io', 'close') AND session_offset IS NOT NULL
  GROUP BY ALL),
sess AS (
  SELECT c.calls, o.side, o.lookup_path AS path, row_number() OVER (
    PARTITION BY o.lookup_path, o.side ORDER BY o.machine_ts, o.log_offset) AS k
  FROM calls c JOIN outc o ON o.log_offset = c.session_offset
  WHERE o.side IN ('source', 'target')),
lined AS (
  SELECT path, k, max(calls) FILTER (side = 'source') AS s, max(calls) FILTER (side = 'target') AS t
  FROM sess GROUP BY path, k),
lone AS (
  SELECT path, calls, sum(a) AS a, sum(b) AS b FROM (
    SELECT path, s AS calls, 1 AS a, 0 AS b FROM lined WHERE s IS NOT NULL AND s IS DISTINCT FROM t
    UNION ALL SELECT path, t, 0, 1 FROM lined WHERE t IS NOT NULL AND s IS DISTINCT FROM t)
  GROUP BY ALL),
gone AS (SELECT path, sum(least(a, b)) AS reordered, sum(a - least(a, b)) AS missing_in_target,
  sum(b - least(a, b)) AS missing_in_source FROM lone GROUP BY path)
SELECT path, count(s) AS source_sessions, count(t) AS target_sessions,
  count(*) FILTER (s = t) AS matched, cast(coalesce(any_value(reordered), 0) AS BIGINT) AS reordered,
  cast(coalesce(any_value(missing_in_target), 0) AS BIGINT) AS missing_in_target,
  cast(coalesce(any_value(missing_in_source), 0) AS BIGINT) AS missing_in_source
FROM lined LEFT JOIN gone USING (path) GROUP BY path"""


def _audit() -> str:
    low, high = catalog.PART.bucket_min, catalog.PART.bucket_max
    return f"""{_TYPED}, placed AS (
  SELECT CASE WHEN log_offset % 50 = 0 THEN 'bucket=_unparsed' ELSE 'bucket=' || lpad(cast(cast(floor(
    machine_ts / {catalog.SQUEEZE} / 600) AS BIGINT) AS VARCHAR), 6, '0') END AS folder FROM ev)
SELECT folder, CASE WHEN folder = 'bucket=_unparsed' THEN 'special'
    WHEN cast(substr(folder, 8) AS BIGINT) BETWEEN {low} AND {high} THEN 'read'
    ELSE 'out of range' END AS status, count(*) AS rows,
  CASE WHEN folder = 'bucket=_unparsed' THEN 'side' ELSE '' END AS defaulted
FROM placed GROUP BY folder
UNION ALL SELECT 'bucket=000003', 'unreadable', 0, NULL"""


def _proof() -> str:
    return f"""{_TYPED}, again AS (
  SELECT count(*) AS n FROM ev WHERE machine_ts > {catalog.SPLIT_TS} AND log_offset % 7 = 0)
SELECT 'trace-order' AS dataset, count(*) AS rows, 0 AS unsorted, 0 AS overlapping FROM ev
UNION ALL SELECT 'in-partitions', count(*), 0, 0 FROM ev
UNION ALL SELECT 'overlap', count(*) + (SELECT n FROM again), 0, 1 FROM ev"""


def _consistency() -> str:
    tests = {
        "opens": ("count(*)", "action = 'open'"),
        "closes": ("count(*)", "action = 'close'"),
        "io_ops": ("count(*)", "action = 'io'"),
        "io_bytes": (f"cast(coalesce(sum({_MOVED})", "action = 'io'"),
    }
    columns = []
    for side in ("source", "target"):
        for name, (what, cond) in tests.items():
            value = f"{what} FILTER (side = '{side}' AND status = 'ok' AND {cond})"
            if name == "io_bytes":
                value = f"{what} FILTER (side = '{side}' AND status = 'ok' AND {cond}), 0) AS BIGINT)"
            columns.append(f"{value} AS {side}_{name}")
    same = " AND ".join(f"source_{n} = target_{n}" for n in tests)
    return f"""{_FULL}, t AS (
SELECT CASE WHEN action = 'open' THEN lookup_path ELSE coalesce(session_path, lookup_path) END AS path,
  {', '.join(columns)} FROM outc WHERE action IN ('open', 'close', 'io') GROUP BY 1)
SELECT *, cast({same} AS INTEGER) AS consistent FROM t"""


def _volume(by: str) -> str:
    return f"""{_FULL}
SELECT {by}, count(*) AS ops, cast(sum({_MOVED}) AS BIGINT) AS bytes
FROM outc WHERE action = 'io' AND status = 'ok' GROUP BY {by}"""


def _flag(cond: str, name: str) -> str:
    return f"cast({cond} AS INTEGER) AS {name}"


def _picked(pids: str) -> str:
    return f"(side = '{catalog.CAPPED.side_filter}' AND pid IN ({pids}))"


def all_oracles() -> dict[str, str]:
    pids = ", ".join(map(str, catalog.PIDS))
    low, high = catalog.BUCKETS.bucket_min, catalog.BUCKETS.bucket_max
    part_low, part_high = catalog.PART.bucket_min, catalog.PART.bucket_max
    return {
        "parse_num": f"""WITH trace AS ({TRACE_SQL}) SELECT log_offset, {', '.join(
            f"{_num(n)} AS {n}_num" for n in ('ret', 'err', 'arg1', 'arg2'))},
            {_num('ret', True)} AS ret_signed FROM trace""",
        "classify_ops": f"""{_TYPED} SELECT log_offset, sc, op_class,
            {_flag(f'sc IN {_in(PATH_OPS)}', 'path_op')}, {_flag(f'sc IN {_in(IO_OPS)}', 'io_op')},
            {_flag(f'sc IN {_in(RENAME_OPS)}', 'rename_op')},
            {_flag(f'sc IN {_in(OPEN_OPS)}', 'open_op')}, {_flag("rename_dst <> ''", 'renames')},
            action AS dry,
            CASE WHEN action IN ('open', 'close', 'io') THEN action
              WHEN sc IN {_in(STAT_OPS)} THEN 'stat' WHEN sc IN {_in(MKDIR_OPS)} THEN 'mkdir'
              WHEN sc IN {_in(UNLINK_OPS)} THEN 'unlink' WHEN rename_dst <> '' THEN 'rename'
              ELSE 'skip' END AS real FROM ev""",
        "parse_side": f"""WITH trace AS ({TRACE_SQL}) SELECT log_offset,
            CASE WHEN side IN ('source', 'target') THEN side ELSE 'other' END AS side,
            'other' AS upper_side FROM trace""",
        "lookup_key": f"""{_TYPED} SELECT log_offset, lookup_path AS best_path, unknown_fd,
            CASE WHEN unknown_fd IS NOT NULL THEN concat('fd:', unknown_fd)
              ELSE 'p:' || lookup_path END AS lookup_key FROM ev""",
        "resolve_path": f"""{_TYPED}, r AS (SELECT log_offset,
            CASE WHEN path LIKE '/%' THEN {_resolved('path')} END AS resolved,
            CASE WHEN path LIKE '/%' THEN {_resolved("(path || '/../x/./y//z')")} END AS detour FROM ev)
            SELECT *, cast({_inside('resolved')} AS INTEGER) AS inside FROM r""",
        "open_flags": f"""{_TYPED} SELECT log_offset, CASE arg1 & 3 WHEN 1 THEN 'wronly'
            WHEN 2 THEN 'rdwr' ELSE 'rdonly' END AS access,
            {_flag('(arg1 & 64) <> 0', 'flag_create')}, {_flag('(arg1 & 128) <> 0', 'flag_excl')},
            {_flag('(arg1 & 512) <> 0', 'flag_trunc')}, {_flag('(arg1 & 1024) <> 0', 'flag_append')},
            CASE WHEN (arg1 & 64) <> 0 THEN 420 ELSE 0 END AS mode FROM ev WHERE action = 'open'""",
        "io_plan": f"""{_TYPED} SELECT log_offset,
            CASE WHEN sc IN ('read', 'pread64', 'readv') THEN 'read' ELSE 'write' END AS direction,
            {_IO_BYTES} AS length,
            CASE WHEN sc IN ('pread64', 'pwrite64') THEN arg2 END AS file_offset,
            {_flag("sc IN ('readv', 'writev')", 'vectored')} FROM ev WHERE action = 'io'""",
        "event_line": f"""{_TYPED} SELECT log_offset, printf(
            '[dry] ts=%.6f pid=%d %s ret=%d err=%d arg1=%d arg2=%d path="%s"',
            machine_ts, pid, sc, ret, err, arg1, arg2, path) AS line FROM ev""",
        "bucket_of": f"""{_TYPED} SELECT cast(floor(machine_ts / 600) AS BIGINT) AS bucket,
            count(*) AS events FROM ev GROUP BY 1""",
        "pid_filter": f"{_TYPED} SELECT log_offset, ts_us, pid, sc FROM ev WHERE pid IN ({pids})",
        "pid_table_filter": f"""{_TYPED} SELECT log_offset, pid, sc FROM ev WHERE pid IN (
            SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
        "side_filter": f"{_TYPED} SELECT log_offset, ts_us, side, sc FROM ev WHERE side = 'target'",
        "bucket_prune": f"""{_TYPED} SELECT log_offset, bucket, sc FROM ev
            WHERE bucket BETWEEN {low} AND {high}""",
        "bucketed_scan": f"""{_TYPED}, squeezed AS (SELECT * REPLACE (
              cast(floor(machine_ts / {catalog.SQUEEZE} / 600) AS BIGINT) AS bucket) FROM ev)
            SELECT log_offset, bucket, pid, sc, ret, arg1, side, canonical_path
            FROM squeezed WHERE bucket BETWEEN {part_low} AND {part_high}""",
        "buckets": f"{_TYPED} SELECT count(DISTINCT bucket) AS buckets FROM ev",
        "first_n_events": f"""{_TYPED} SELECT log_offset, ts_us, sc FROM ev
            ORDER BY machine_ts, log_offset LIMIT {catalog.FIRST_N}""",
        "capped_events": f"""{_TYPED}, {_selected(_CAPPED_SEL, catalog.CAPPED.max_events)}
            SELECT log_offset, ts_us, pid, sc FROM sel""",
        "time_order_gap": f"""{_GAPS} SELECT log_offset,
            cast(round(gap_s * 1e6) AS BIGINT) AS gap_us FROM gaps""",
        "pacing_scaled": f"{_GAPS} SELECT log_offset, wait_us FROM waits",
        "replay_offset": f"""{_GAPS} SELECT log_offset, cast(sum(wait_us) OVER (
            ORDER BY machine_ts, log_offset) AS BIGINT) AS replay_offset_us FROM waits""",
        "gap_by_pid": _gap_table("pid"),
        "gap_by_file": _gap_table("lookup_path", "lookup_path <> ''"),
        "virtual_fd": f"{_FULL} SELECT log_offset, pid, ret AS orig_fd, our_fd FROM numbered",
        "fd_sessions": _SESSIONS,
        "fd_changelog": _CHANGES,
        "io_attribution": f"""{_FULL} SELECT log_offset, pid, sc, session_offset, our_fd,
            session_path FROM outc WHERE action = 'io'""",
        "close_attribution": f"""{_FULL} SELECT log_offset, pid, session_offset, our_fd, status
            FROM outc WHERE action = 'close'""",
        "unattributed_io": f"""{_FULL} SELECT log_offset, pid, sc, lookup_path FROM outc
            WHERE action = 'io' AND session_offset IS NULL""",
        "fd_residual": f"""{_FULL} SELECT cast(coalesce(sum(len(s)), 0) AS BIGINT) AS residual
            FROM (SELECT s FROM st QUALIFY row_number() OVER (
              PARTITION BY pid ORDER BY rn DESC) = 1)""",
        "seeded_window": f"""{_FULL} SELECT log_offset, action, status, reason, our_fd,
            session_offset FROM outc""",
        "relative_opens": _CHAINED_OPENS,
        "exit_outcomes": f"""{_LIVES} SELECT log_offset, action, status, reason, session_offset,
            our_fd FROM outc""",
        "dry_outcomes": _OUTCOMES,
        "signed_outcomes": f"""{_SIGNED} SELECT log_offset, action, status, reason,
            session_offset, our_fd FROM outc""",
        "outcome_reasons": f"""{_FULL} SELECT action, status, reason, count(*) AS events
            FROM outc GROUP BY ALL""",
        "first_failed_event": f"""{_FULL} SELECT ts_us, log_offset, pid, sc, action, reason
            FROM outc WHERE status = 'failed' ORDER BY machine_ts, log_offset LIMIT 1""",
        "traversals": f"""{_FULL} SELECT log_offset, pid, sc, path, target, resolved FROM outc
            WHERE reason = 'traversal'""",
        "run_stats": _stats(_FULL, "TRUE", None),
        "run_stats_capped": _stats(_CAPPED, _CAPPED_SEL, catalog.CAPPED.max_events),
        "syscall_distribution": f"{_TYPED} SELECT sc, count(*) AS events FROM ev GROUP BY sc",
        "skip_rate_by_window": f"""{_FULL}, n AS (SELECT status, row_number() OVER (
            ORDER BY machine_ts, log_offset) AS pos FROM outc),
            w AS (SELECT cast(unnest({list(catalog.WINDOWS)}) AS BIGINT) AS window_events),
            b AS (SELECT *, coalesce(lag(window_events) OVER (ORDER BY window_events), 0) AS low
              FROM w),
            r AS (SELECT window_events, count(*) AS events,
              count(*) FILTER (status = 'skipped') AS skipped
              FROM b JOIN n ON n.pos <= b.window_events
              GROUP BY window_events, low HAVING count(*) > low)
            SELECT *, cast(floor(skipped * 10000 / events) AS BIGINT) AS skip_bp FROM r""",
        "io_by_path": _volume("session_path"),
        "io_by_pid_side_bucket": _volume("pid, side, bucket"),
        "io_by_session": _volume("pid, session_offset"),
        "io_subtotals": f"""{_FULL} SELECT side, sc, cast(grouping(side, sc) AS BIGINT) AS level,
            count(*) AS ops, cast(sum({_MOVED}) AS BIGINT) AS bytes
            FROM outc WHERE action = 'io' AND status = 'ok' GROUP BY ROLLUP (side, sc)""",
        "bucket_profile": _profile(),
        "side_consistency": _consistency(),
        "side_lifecycles": _SIDES,
        "flat_scan": f"""{_TYPED} SELECT log_offset, cast(floor(machine_ts / 600) AS BIGINT) AS bucket,
            pid, sc, ret, 'other' AS side, 0 AS mapped FROM ev WHERE pid IN ({pids})""",
        "quarantine": f"""{_TYPED} SELECT log_offset, pid, sc, CASE WHEN log_offset % 50 = 0
            THEN 'bucket=_unparsed' ELSE 'read' END AS place FROM ev""",
        "read_audit": _audit(),
        "order_proof": _proof(),
        "sink_commits": f"""{_FULL} SELECT CASE WHEN machine_ts < {catalog.SPLIT_TS} THEN 1 ELSE 2
            END AS run, log_offset, action, status, reason FROM outc""",
        "options_run": _stats(
            f"{_TYPED}, {_selected(_picked(pids), catalog.CAPPED.max_events)}, {_tracked()}",
            _picked(pids), catalog.CAPPED.max_events),
        "replay_plan": _PLAN,
        "stream_bucket_profile": _profile(
            f"cast(floor(machine_ts / {catalog.SQUEEZE} / 600) AS BIGINT)"),
        "stream_outcomes": _OUTCOMES,
        "stream_late": _late(),
    }

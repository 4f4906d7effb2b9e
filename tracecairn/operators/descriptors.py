"""File-descriptor lifetimes, and the open session each row belongs to.

An open registers its descriptor and its path. From then on the session can be
found by descriptor, until that number is closed or opened again, and by path,
until the path is opened again, closed, or taken out of the path index because
some other session of the same path lost its descriptor.

The next event on a descriptor number is known from the rows alone. So each
session's life is found with windows on control rows: first the next event per
(process, descriptor), then, per (process, path), what happens between one open of
the path and the next. Only sessions whose path index another session may clear
depend on each other; they are settled by pointer doubling. IO rows then need one
as-of lookup of the last open before them, and a comparison with its end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.functions.numbers import AT_FDCWD, as_fd, wrap_int32
from tracecairn.functions.paths import (
    absolute_target,
    best_path,
    inside_root,
    is_relative,
    lookup_key,
    normalize_path,
    operation_path,
    under_root,
    unknown_fd,
)
from tracecairn.functions.syscalls import CLOSE_OP, EXIT_OP, OPEN_OPS, dry_action, is_rename
from tracecairn.operators.slices import (
    PART,
    SLICE,
    WHOLE,
    TimeSlices,
    add_running_sum,
    nearest,
)
from tracecairn.operators.storage import materialize
from tracecairn.options import TraceOptions

# Fixed value: the first virtual descriptor number.
FIRST_VIRTUAL_FD = 3

_IN_OWNER = ["machine_ts", "log_offset", "sc"]
_INT32_MAX = 2**31 - 1


@dataclass(frozen=True)
class Descriptors:
    """``opens``: every open row with its outcome. ``sessions``: every registered open
    with its end. ``rows``: the prepared events, opens included."""

    rows: DataFrame
    opens: DataFrame
    sessions: DataFrame
    slices: TimeSlices
    opts: TraceOptions


def at_key() -> Column:
    return F.struct(*_IN_OWNER)


def prepare(events: DataFrame, opts: TraceOptions, slices: TimeSlices) -> DataFrame:
    """Add per-row facts: action, lookup path and key, resolution target, failure reason.

    ``dirfd`` is set only where the outcome depends on an open descriptor. ``owner``
    is the key of a descriptor table: the process, or one of its lives when exits
    are honoured.
    """
    root = opts.sandbox_root
    c = F.col
    out = slices.assign(events) if SLICE not in events.columns else events
    out = (
        slices.assign_parts(out).withColumn("action", dry_action(c("sc")))
        .withColumn("lookup_path", best_path(c("path"), c("canonical_path"), c("mapped")))
        .withColumn("raw", F.when(
            c("action").isin("open", "meta")
            | ((c("action") == "other") & is_rename(c("rename_dst"))),
            operation_path(c("lookup_path"), c("rename_dst"))))
        .withColumn("dirfd", F.when(is_relative(c("raw")), wrap_int32(c("arg1"))))
        .withColumn("target", F.when(c("raw").startswith("/"), absolute_target(c("raw"), root))
                    .when(c("dirfd") == AT_FDCWD, under_root(c("raw"), root)))
        .withColumn("dirfd", F.when(c("target").isNull(), c("dirfd")))
        .withColumn("resolved", normalize_path(c("target")))
        .withColumn("reason", _failure(root))
        .withColumn("key", F.when(
            c("dirfd").isNotNull() | (is_rename(c("rename_dst")) & is_relative(c("rename_src"))
                                      & (wrap_int32(c("arg1")) != AT_FDCWD)),
            F.concat(F.lit("fd:"), wrap_int32(c("arg1"))))
                    .when(c("action").isin("io", "close") & (c("lookup_path") != ""),
                          lookup_key(c("lookup_path"))))
    )
    if not opts.exit_closes:
        return out.withColumn("owner", c("pid"))
    out = _with_exits_around(out)
    life = F.concat_ws("@", "pid", c("_left.machine_ts").cast("string"), "_left.log_offset")
    return out.withColumn("owner", life).drop("_left")


def _with_exits_around(rows: DataFrame) -> DataFrame:
    """Add the last exit of a row's process before it (``_left``) and the first after it (``exit_at``).

    Lives come from a table of exits alone, joined to the rows: a process's exits in the row's own
    slice, at most a slice of them, and the first and last exit of each other slice where it has any.
    Rows are not ordered for it.
    """
    c = F.col
    exits = materialize(
        rows.where(c("sc") == EXIT_OP).groupBy("pid", SLICE)
        .agg(F.sort_array(F.collect_list(at_key())).alias("_here")), "exits")
    edges = exits.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(
        SLICE, F.element_at("_here", 1).alias("first"), F.element_at("_here", -1).alias("last")
    ))).alias("_edges"))
    rows = rows.join(exits, ["pid", SLICE], "left").join(edges, "pid", "left")

    def pick(found: Column, at: int, field: str | None = None) -> Column:
        one = F.when(F.size(found) > 0, F.element_at(found, at))
        return one.getField(field) if field else one

    before = pick(F.filter("_here", lambda x: x < at_key()), -1)
    after = pick(F.filter("_here", lambda x: x > at_key()), 1)
    earlier = pick(F.filter("_edges", lambda x: x[SLICE] < c(SLICE)), -1, "last")
    later = pick(F.filter("_edges", lambda x: x[SLICE] > c(SLICE)), 1, "first")
    return (
        rows.withColumn("_left", F.coalesce(before, earlier))
        .withColumn("exit_at", F.coalesce(after, later)).drop("_here", "_edges")
    )


def _failure(root: str) -> Column:
    c = F.col
    return (
        F.when(c("raw") == "", "no_path")
        .when(c("resolved").isNotNull() & ~_accepted(c("resolved"), root), "traversal")
        .when((c("action") == "open") & c("resolved").isNotNull() & (c("ret") > _INT32_MAX),
              "fd_range")
    )


def _accepted(resolved: Column, root: str) -> Column:
    """A relative result (the base itself was relative) cannot be told to leave the root."""
    return inside_root(resolved, root) | ~resolved.startswith("/")


def with_base(rows: DataFrame, root: str) -> DataFrame:
    """Finish rows whose path is relative to ``session_path``, the looked-up directory."""
    c = F.col
    pending = c("dirfd").isNotNull()
    joined = F.when(c("session_path") == "", c("raw")).otherwise(
        F.concat(c("session_path"), F.lit("/"), c("raw")))
    return (
        rows.withColumn("target", F.when(pending, joined).otherwise(c("target")))
        .withColumn("resolved", F.when(pending, normalize_path(c("target")))
                    .otherwise(c("resolved")))
        .withColumn("reason", F.when(pending & c("target").isNull(), "dirfd_unregistered")
                    .when(pending, _failure(root)).otherwise(c("reason")))
    )


# --- sessions -------------------------------------------------------------------------------


def build_sessions(control: DataFrame, slices: TimeSlices) -> DataFrame:
    """Open sessions from control rows.

    ``control``: ``owner, part, machine_ts, log_offset, sc, op`` (open or close), ``fd``
    (null for a close by path), ``path``, ``our_fd``, ``reachable`` (false for a carried
    open that its path no longer finds), ``exit_at`` (null unless exits are honoured).

    Result: ``owner, part, open_at, fd, our_fd, path, path_end, fd_end, end_kind``. A
    session is found by path for keys up to ``path_end`` or its path's next open, and by
    descriptor up to ``fd_end``; null means open to the end.
    """
    c = F.col
    facts = ("fd", "our_fd", "reachable", "next", "exit_at")
    marks = materialize(_path_marks(control, slices), "marks")
    found = (
        marks.groupBy("owner", "path", "segment").agg(
            F.max(F.when(c("mark") == "open", F.struct(PART, *facts))).alias("opened"),
            F.min(F.when(c("mark") == "close", c("at"))).alias("closed_at"),
            F.min(F.when((c("mark") == "lost") & (c("of") == c("segment")), c("at")))
            .alias("own_end"),
            F.min(F.when((c("mark") == "lost") & (c("of") != c("segment")), c("at")))
            .alias("foreign_end"),
        )
        .select("owner", "path", "segment", "opened.*", "closed_at", "own_end", "foreign_end")
    )
    # The end as far as the session itself tells: a close of its path or its descriptor.
    limit = F.when(~c("reachable"), c("segment")).otherwise(F.least("closed_at", "own_end"))
    found = materialize(found.withColumn("limit", limit), "sessions-alone")
    found = _settle_foreign(found, marks)
    return found.select(
        "owner", PART, c("segment").alias("open_at"), "fd", "our_fd", "path",
        "path_end",
        F.when(c("closed"), c("closed_at"))
        .otherwise(F.coalesce(c("next.at"), c("exit_at"))).alias("fd_end"),
        F.when(c("closed") | (c("next.op") == "close"), "close")
        .when(c("next.op") == "open", "reuse")
        .when(c("exit_at").isNotNull(), "exit").otherwise("open_at_end").alias("end_kind"),
    )


def _path_marks(control: DataFrame, slices: TimeSlices) -> DataFrame:
    """What happens to each path, every mark with the open (``segment``) it falls under.

    Marks: the opens, the closes by path, and ``lost`` where session ``of`` loses its
    descriptor. Losing comes before opening on the same row. An open without a path
    only gets its own mark.
    """
    c = F.col
    control = control.withColumn("at", at_key())
    # Closes by path have no descriptor; whatever their window finds is not used.
    control = nearest(control, ["owner", "fd"], _IN_OWNER, F.struct("at", "op", PART), "next",
                      slices, following=True)
    if slices.parted:
        control = materialize(control, "next-on-descriptor")
    is_open = c("op") == "open"

    def mark(when: Column, name: str, turn: int, at: str, slice_: str) -> Column:
        return F.when(when, F.struct(
            F.lit(name).alias("mark"), F.lit(turn).alias("turn"), c(at).alias("at"),
            c(slice_).alias(PART)))

    own_close = (c("op") == "close") & c("fd").isNull() & (c("path") != "")
    found = F.array(
        mark(is_open, "open", 1, "at", PART),
        mark(own_close, "close", 1, "at", PART),
        mark(is_open & (c("path") != "") & c("next").isNotNull(), "lost", 0, "next.at",
             f"next.{PART}"),
    )
    marks = control.select(
        "owner", "path", "fd", "our_fd", "reachable", "next", "exit_at",
        F.when(is_open, c("at")).alias("of"), F.explode(F.array_compact(found)).alias("_mark"),
    ).select("owner", "path", "fd", "our_fd", "reachable", "next", "exit_at", "of", "_mark.*")
    opened = c("mark") == "open"
    marks = nearest(
        marks, ["owner", "path"], [*[f"at.{n}" for n in _IN_OWNER], "turn"],
        F.when(opened, c("of")), "_under", slices)
    return (
        marks.withColumn("segment", F.when(opened, c("of")).otherwise(c("_under")))
        .where(c("segment").isNotNull()).drop("_under")
    )


def _settle_foreign(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Add ``closed`` (ended by a close of its path) and ``path_end``.

    Without other sessions on the path both follow from ``limit``. A foreign ``lost``
    mark inside a session's reach ends the reach too, provided that the other session
    was not closed by path before.
    """
    c = F.col
    has_close = (c("closed_at") == c("limit")) & F.coalesce(c("reachable"), F.lit(True))
    found = found.withColumn("has_close", F.coalesce(has_close, F.lit(False)))
    touched = found.where(
        c("foreign_end").isNotNull() & (c("limit").isNull() | (c("foreign_end") < c("limit"))))
    if touched.isEmpty():
        return found.withColumn("closed", c("has_close")).withColumn("path_end", c("limit"))

    session = ["owner", "path", "segment"]
    hits = materialize(
        marks.where((c("mark") == "lost") & (c("of") != c("segment")))
        .select(*session, "of", "at")
        .join(touched.select(*session, "limit", "has_close"), session)
        .where(c("limit").isNull() | (c("at") < c("limit"))),
        "foreign-marks",
    )
    open_ids = (
        hits.select("owner", "path", "segment")
        .unionByName(hits.select("owner", "path", c("of").alias("segment"))).distinct()
    )
    parents = hits.where(c("has_close")).select(
        "owner", "path", c("of").alias("segment"), c("segment").alias("above"))
    # A close by path holds if it holds for every session that hangs below.
    nodes = (
        found.select(*session, "has_close").join(open_ids, session, "left_semi")
        .withColumn("failed", ~c("has_close")).drop("has_close")
        .join(parents, session, "left")
    )
    nodes = spread_failures(nodes, ["owner", "path"], "segment", "above")
    verdict = nodes.select(*session, (~c("failed")).alias("holds"))
    found = found.join(verdict, session, "left").withColumn(
        "closed", F.coalesce("holds", "has_close")).drop("holds")
    lost = (
        hits.join(verdict.where(~c("holds")).withColumnRenamed("segment", "of"),
                  ["owner", "path", "of"], "left_semi")
        .groupBy(*session).agg(F.min("at").alias("cleared_at"))
    )
    found = found.join(lost, session, "left").withColumn(
        "path_end", F.least("limit", "cleared_at")).drop("cleared_at")
    return materialize(found, "sessions")


def spread_failures(nodes: DataFrame, keys: list[str], node: str, above: str) -> DataFrame:
    """In a forest of ``node -> above`` links, mark ``failed`` on all nodes over a failed one.

    Pointer doubling: after step k every node has heard from 2^k levels below, so a
    chain of n nodes takes about log2(n) steps, each a join on the remaining links.
    """
    nodes = materialize(nodes, "links")
    while not nodes.where(F.col(above).isNotNull()).isEmpty():
        nodes = materialize(
            _double(_double(nodes, keys, node, above), keys, node, above), "links")
    return nodes


def inherit_failures(nodes: DataFrame, keys: list[str], node: str, above: str) -> DataFrame:
    """In a forest of ``node -> above`` links, mark ``failed`` on all nodes under a failed one.

    Pointer doubling: a step hands down what the node 2^k above has heard. Links to what is no node
    of the forest end there.
    """
    c = F.col
    nodes = materialize(nodes, "links")
    while not nodes.where(c(above).isNotNull()).isEmpty():
        upper = nodes.select(*keys, c(node).alias(above), c("failed").alias("_failed"),
                             c(above).alias("_further"))
        nodes = materialize(
            nodes.join(upper, [*keys, above], "left").select(
                *keys, node, (c("failed") | F.coalesce("_failed", F.lit(False))).alias("failed"),
                c("_further").alias(above)), "links")
    return nodes


def _double(nodes: DataFrame, keys: list[str], node: str, above: str) -> DataFrame:
    c = F.col
    news = (
        nodes.where(c(above).isNotNull() & c("failed"))
        .select(*keys, c(above).alias(node), F.lit(True).alias("_news")).distinct()
    )
    further = nodes.select(*keys, c(node).alias(above), c(above).alias("_further"))
    return (
        nodes.join(news, [*keys, node], "left").join(further, [*keys, above], "left")
        .select(*keys, node, (c("failed") | c("_news").isNotNull()).alias("failed"),
                c("_further").alias(above))
    )


# --- lookups --------------------------------------------------------------------------------


def attach_sessions(rows: DataFrame, sessions: DataFrame, slices: TimeSlices) -> DataFrame:
    """As-of lookup: add the session a row's ``key`` finds at that instant.

    Adds ``session_at, session_fd, session_path, our_fd``, null where nothing is found
    or the row has no key. One shuffle by (owner, key, part).
    """
    c = F.col
    session_type = F.struct("open_at", "fd", "path", "our_fd", c("end").alias("end"))
    keyed = sessions.select(
        "owner", PART, "open_at", "fd", "path", "our_fd",
        F.concat(F.lit("fd:"), "fd").alias("key"), c("fd_end").alias("end"),
    ).unionByName(
        sessions.where(c("path") != "").select(
            "owner", PART, "open_at", "fd", "path", "our_fd",
            F.concat(F.lit("p:"), "path").alias("key"), c("path_end").alias("end"))
    ).select("owner", PART, "key", "open_at.*", session_type.alias("_session"))
    # On one row the lookup comes before the open it may itself be.
    starts = keyed.withColumn("_turn", F.lit(1))
    if slices.parted:
        starts = starts.unionByName(_carried_sessions(rows, keyed))
    both = rows.withColumn("_turn", F.lit(0)).unionByName(starts, allowMissingColumns=True)
    until = (
        Window.partitionBy("owner", "key", PART).orderBy(*_IN_OWNER, "_turn")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    latest = F.last("_session", ignorenulls=True).over(until)
    found = both.withColumn("_found", latest).where(c("_turn") == 0).drop("_session", "_turn")
    valid = c("key").isNotNull() & (
        c("_found.end").isNull() | (at_key() <= c("_found.end")))
    return found.select(
        *[x for x in found.columns if x != "_found"],
        F.when(valid, c("_found.open_at")).alias("session_at"),
        F.when(valid, c("_found.fd")).alias("session_fd"),
        F.when(valid, c("_found.path")).alias("session_path"),
        F.when(valid, c("_found.our_fd")).alias("our_fd"),
    )


def _carried_sessions(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """For each part where a key is looked up, the last session opened in earlier parts."""
    c = F.col
    group = ["owner", "key", PART]
    cut = c(PART) != WHOLE
    latest = keyed.where(cut).groupBy(*group).agg(
        F.max_by("_session", F.col("_session.open_at")).alias("_session"))
    wanted = rows.where(cut).select(*group).distinct()   # a null key finds nothing and drops out below
    earlier = (
        Window.partitionBy("owner", "key").orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        latest.unionByName(wanted, allowMissingColumns=True)
        .groupBy(*group).agg(F.max("_session").alias("_session"))
        .withColumn("_session", F.last("_session", ignorenulls=True).over(earlier))
        .where(c("_session").isNotNull())
        .select(*group, F.lit(float("-inf")).alias("machine_ts"),
                F.lit(0).cast("bigint").alias("log_offset"), F.lit("").alias("sc"),
                "_session", F.lit(-1).alias("_turn"))
    )


# --- the whole ------------------------------------------------------------------------------


def track_descriptors(
    events: DataFrame, opts: TraceOptions, slices: TimeSlices,
    carried: DataFrame | None = None, first_virtual_fd: int = FIRST_VIRTUAL_FD,
) -> Descriptors:
    """Follow descriptors through selected events.

    ``carried`` holds sessions still open from before the events (the columns of
    ``carry_over``), so that a run may start in the middle of a trace.
    """
    c = F.col
    rows = prepare(events, opts, slices)
    if carried is not None and opts.exit_closes:
        carried = _with_exits(carried, rows)
    control = materialize(rows.where(c("sc").isin(*OPEN_OPS, CLOSE_OP)), "control")
    opens = control.where(c("action") == "open")
    closes = control.where((c("action") == "close") & c("key").isNotNull())
    opens = _resolve_relative_opens(opens, closes, carried, opts, slices)
    made = c("reason").isNull()
    opens = add_running_sum(
        opens.withColumn("_made", made.cast("bigint")), "_made", "our_fd", slices)
    opens = materialize(opens.drop("_made").withColumn(
        "our_fd", F.when(made, c("our_fd") + (first_virtual_fd - 1))), "opens")
    sessions = build_sessions(_control(opens, closes, carried, slices), slices)
    return Descriptors(rows, opens, sessions, slices, opts)


def _with_exits(carried: DataFrame, rows: DataFrame) -> DataFrame:
    """Carried sessions belong to the process life that runs until the first exit seen."""
    c = F.col
    life = F.substring_index("owner", "@", 1)
    exits = (
        rows.where(c("sc") == EXIT_OP).groupBy(c("pid").cast("string").alias("owner"))
        .agg(F.min(at_key()).alias("exit_at"))
    )
    return carried.withColumn("owner", life).join(exits, "owner", "left")


def _control(
    opens: DataFrame, closes: DataFrame, carried: DataFrame | None, slices: TimeSlices
) -> DataFrame:
    c = F.col
    shared = ["owner", PART, *_IN_OWNER]
    exit_at = c("exit_at") if "exit_at" in opens.columns else F.lit(None).cast(
        "struct<machine_ts:double,log_offset:bigint,sc:string>")
    started = opens.where(c("reason").isNull() & as_fd(c("ret")).isNotNull()).select(
        *shared, F.lit("open").alias("op"), as_fd(c("ret")).alias("fd"),
        c("lookup_path").alias("path"), "our_fd", F.lit(True).alias("reachable"),
        exit_at.alias("exit_at"))
    fd = unknown_fd(c("lookup_path"))
    ended = closes.select(
        *shared, F.lit("close").alias("op"), fd.alias("fd"),
        F.when(fd.isNull(), c("lookup_path")).alias("path"))
    control = started.unionByName(ended, allowMissingColumns=True)
    if carried is None:
        return control
    pid = F.substring_index(c("owner").cast("string"), "@", 1).cast("bigint")
    seeds = slices.assign_parts(slices.assign(carried.withColumn("pid", pid))).drop(
        "pid", SLICE).withColumn("op", F.lit("open"))
    return control.unionByName(seeds, allowMissingColumns=True)


def _resolve_relative_opens(
    opens: DataFrame, closes: DataFrame, carried: DataFrame | None, opts: TraceOptions,
    slices: TimeSlices,
) -> DataFrame:
    """Decide opens of relative paths, whose success depends on an open descriptor.

    Only those whose directory number some open of the same owner returned can succeed. They all
    do so at first. Sessions built from these verdicts give each one its directory, so the opens
    form a forest that hangs on their directories; whoever hangs on a failed one, however far
    below, fails in the same round (pointer doubling). Verdicts that no round changes are the
    right ones: whatever comes before the earliest wrong row is right, so a round puts it right, and
    it hangs on right rows alone. Chains of any length take two or three rounds.
    """
    c = F.col
    root = opts.sandbox_root
    pending = opens.where(c("dirfd").isNotNull())
    settled = opens.where(c("dirfd").isNull())
    returned = opens.select("owner", as_fd(c("ret")).alias("dirfd"))
    if carried is not None:
        returned = returned.unionByName(carried.select("owner", c("fd").alias("dirfd")))
    possible = pending.join(returned.distinct(), ["owner", "dirfd"], "left_semi")
    if possible.isEmpty():
        return _without_base(opens, root)

    hopeless = _without_base(
        pending.join(returned.distinct(), ["owner", "dirfd"], "left_anti"), root)
    possible = materialize(possible, "relative")
    owners = possible.select("owner").distinct()

    def of_owners(df: DataFrame) -> DataFrame:
        return df.join(owners, "owner", "left_semi")

    seeds = None if carried is None else of_owners(carried)
    fixed, shut = of_owners(settled), of_owners(closes)
    names, key = opens.columns, ["owner", *_IN_OWNER]
    verdict = possible.withColumn("reason", F.lit(None).cast("string"))
    while True:
        trial = fixed.unionByName(verdict.select(*names)).withColumn(
            "our_fd", F.lit(0).cast("bigint"))
        sessions = build_sessions(_control(trial, shut, seeds, slices), slices)
        found = materialize(with_base(attach_sessions(
            possible.drop("our_fd"), sessions, slices), root), "relative")
        changed = (
            found.select(*key, "reason").join(
                verdict.select(*key, c("reason").alias("_before")), key)
            .where(c("reason").isNull() != c("_before").isNull())
        )
        if changed.isEmpty():
            return settled.unionByName(hopeless).unionByName(found.select(*names))
        nodes = inherit_failures(found.select(
            "owner", at_key().alias("at"), c("reason").isNotNull().alias("failed"),
            c("session_at").alias("above")), ["owner"], "at", "above")
        lost = nodes.where("failed").select("owner", "at.*", F.lit("dirfd_unregistered").alias("_lost"))
        verdict = found.join(lost, key, "left").withColumn(
            "reason", F.coalesce("reason", "_lost")).drop("_lost")


def _without_base(opens: DataFrame, root: str) -> DataFrame:
    """Opens of relative paths fail for want of their directory; others stay as they are."""
    unknown = opens.withColumn("session_path", F.lit(None).cast("string"))
    return with_base(unknown, root).drop("session_path")


def carry_over(sessions: DataFrame) -> DataFrame:
    """Sessions still open at the end, as the ``carried`` table of a later run.

    ``reachable`` says whether the path still finds the session, which an open or a
    close of the same path, or its own loss of the index, may have ended.
    """
    c = F.col
    newest = sessions.where(c("path") != "").groupBy("owner", "path").agg(
        F.max("open_at").alias("_newest"))
    return (
        sessions.where(c("fd_end").isNull()).join(newest, ["owner", "path"], "left")
        .select("owner", "open_at.*", "fd", "our_fd", "path",
                (c("path_end").isNull() & (c("open_at") == c("_newest"))).alias("reachable"))
        .withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    )


def residual(sessions: DataFrame) -> DataFrame:
    """Number of descriptors left open at the end."""
    return sessions.agg(
        F.coalesce(F.sum(F.col("fd_end").isNull().cast("bigint")), F.lit(0)).alias("residual"))


def change_log(sessions: DataFrame) -> DataFrame:
    """Net changes of the two lookup indices: ``owner, key, at, session_at``.

    ``session_at`` null means that the key finds nothing from there on. A key taken
    over by another session at the same row has only the take-over.
    """
    c = F.col
    keyed = sessions.select(
        "owner", F.concat(F.lit("fd:"), "fd").alias("key"), "open_at", c("fd_end").alias("end")
    ).unionByName(sessions.where(c("path") != "").select(
        "owner", F.concat(F.lit("p:"), "path").alias("key"), "open_at",
        c("path_end").alias("end")))
    return (
        keyed.select("owner", "key", F.explode(F.array(
            F.struct(c("open_at").alias("at"), c("open_at").alias("session_at")),
            F.struct(c("end").alias("at"), F.lit(None).cast(
                "struct<machine_ts:double,log_offset:bigint,sc:string>").alias("session_at")),
        )).alias("change")).select("owner", "key", "change.*")
        .where(c("at").isNotNull())
        .groupBy("owner", "key", "at").agg(F.max("session_at").alias("session_at"))
    )

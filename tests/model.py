"""A plain sequential reading of the descriptor rules, for comparison.

One list of open descriptors per process, newest last. An entry knows whether its
path still finds it.
"""

from __future__ import annotations

import posixpath
import re

FIELDS = {
    "machine_ts": "double", "log_offset": "bigint", "pid": "bigint", "comm": "string",
    "sc": "string", "ret": "string", "err": "string", "arg1": "string", "arg2": "string",
    "path": "string", "rename_src": "string", "rename_dst": "string",
    "canonical_path": "string", "mapped": "bigint", "side": "string",
}
OPEN = {"open", "openat", "openat2"}
IO = {"read", "write", "pread64", "pwrite64", "readv", "writev"}
META = {"stat", "newfstatat", "unlink", "mkdir", "renameat"}


def number(text: str | None, signed: bool = False) -> int:
    if not text:
        return 0
    if text[:2] in ("0x", "0X"):
        digits = re.match("[0-9a-fA-F]*", text[2:]).group()
        return int(digits, 16) if digits else 0
    found = re.match("-?[0-9]+" if signed else "[0-9]+", text)
    return int(found.group()) if found else 0


def normal(path: str) -> str:
    out = posixpath.normpath(path)
    return out[1:] if out.startswith("//") else out


def within(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def simulate(rows, root="/tmp/sandbox", signed=False, exits=False):
    """Outcome per row and the number of descriptors left, in trace order."""
    tables: dict[int, list[dict]] = {}
    results, next_fd = {}, 3
    for r in sorted(rows, key=lambda r: (r["machine_ts"], r["log_offset"])):
        table = tables.setdefault(r["pid"], [])
        here, sc = r["log_offset"], r["sc"]
        best = r.get("path") or ""
        if r.get("mapped") and r.get("canonical_path"):
            best = r["canonical_path"]
        marked = re.search("fd=([0-9]*)", best, re.S)
        number_in_path = int(marked.group(1)) if marked and marked.group(1) else None

        def by_fd(fd):
            return next((e for e in table if e["fd"] == fd), None)

        def find():
            if number_in_path is not None:
                return by_fd(number_in_path)
            return next((e for e in table if e["reach"] and e["path"] == best), None)

        def resolve():
            raw = r.get("rename_dst") or best
            if not raw:
                return None, "no_path"
            if raw.startswith("/"):
                target = raw[1:] if raw.startswith("//") else root.rstrip("/") + raw
            else:
                dirfd = number(r.get("arg1"), signed)
                if dirfd in (-100, 2**32 - 100):
                    target = root.rstrip("/") + "/" + raw
                else:
                    base = by_fd(dirfd)
                    if base is None:
                        return None, "dirfd_unregistered"
                    target = f"{base['path']}/{raw}" if base["path"] else raw
            target = normal(target)
            if target.startswith("/") and not within(target, root):
                return target, "traversal"
            return target, None

        def drop(entry):
            """Take an entry out by number: its path finds nothing from there on."""
            table.remove(entry)
            for e in table:
                if e["path"] == entry["path"]:
                    e["reach"] = False

        session = None
        if sc in OPEN:
            _, reason = resolve()
            if reason is None:
                fd = number(r.get("ret"), signed)
                if fd > 2**31 - 1:
                    reason = "fd_range"
                else:
                    if fd >= 0:
                        if by_fd(fd):
                            drop(by_fd(fd))
                        for e in table:
                            if e["path"] == best:
                                e["reach"] = False
                        table.append({"fd": fd, "path": best, "reach": bool(best), "at": here,
                                      "our": next_fd})
                    session = (here, next_fd)
                    next_fd += 1
            status = "failed" if reason else "ok"
        elif sc == "close" or sc in IO:
            entry = find()
            status, reason = ("ok", None) if entry else ("skipped", "fd_not_mapped")
            session = (entry["at"], entry["our"]) if entry else None
            if entry and sc == "close":
                if number_in_path is not None:
                    drop(entry)
                else:
                    table.remove(entry)
        elif sc in META:
            _, reason = resolve()
            status = "failed" if reason else "ok"
        else:
            status, reason = "skipped", "other_syscall"
            if exits and sc == "exit_group":
                table.clear()
        results[here] = (status, reason, session if sc not in META else None)
    return results, sum(len(t) for t in tables.values())

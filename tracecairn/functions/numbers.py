"""Numbers stored as text, and values derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracecairn.options import DEFAULT_MAX_IO_BYTES

# Linux open(2) bits and the mode of created files.
ACCESS_MASK, WRITE_ONLY, READ_WRITE = 0x3, 0x1, 0x2
FLAG_CREATE, FLAG_EXCL, FLAG_TRUNC, FLAG_APPEND = 0x40, 0x80, 0x200, 0x400
CREATE_MODE = 0o644
AT_FDCWD = -100

_INT32_MAX = 2**31 - 1


def parse_num(text: Column, signed: bool = False) -> Column:
    """Leading digits as decimal, or hex after ``0x``; 0 for anything else.

    Hex of up to 16 digits is read as a signed 64-bit value, so that unsigned text of a negative
    number comes back negative. Values beyond 64 bits give 0. ``signed`` accepts a leading minus sign.
    """
    hex_digits = F.regexp_extract(text, "^0[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(text, "^(-?[0-9]+)" if signed else "^([0-9]+)", 1)
    value = F.when(
        text.startswith("0x") | text.startswith("0X"),
        F.when(F.length(hex_digits) <= 16, F.conv(hex_digits, 16, -10).try_cast("bigint")),
    ).otherwise(decimal.try_cast("bigint"))
    # Most texts are plain digits, which a cast reads without any pattern.
    plain = F.when((text >= "0") & (text < ":"), text.try_cast("bigint"))
    return F.coalesce(plain, value, F.lit(0).cast("bigint"))


def wrap_int32(value: Column) -> Column:
    """The low 32 bits of a number as a signed 32-bit integer."""
    return F.shiftright(F.shiftleft(value, 32), 32).cast("int")


def as_fd(ret: Column) -> Column:
    """A return value as a descriptor number, null when it cannot be one."""
    return F.when((ret >= 0) & (ret <= _INT32_MAX), ret).cast("int")


def decode_open_flags(flags: Column) -> Column:
    def bit(mask: int) -> Column:
        return flags.bitwiseAND(F.lit(mask)) != 0

    access = flags.bitwiseAND(F.lit(ACCESS_MASK))
    return F.struct(
        F.when(access == WRITE_ONLY, "wronly").when(access == READ_WRITE, "rdwr")
        .otherwise("rdonly").alias("access"),
        bit(FLAG_CREATE).alias("create"),
        bit(FLAG_EXCL).alias("excl"),
        bit(FLAG_TRUNC).alias("trunc"),
        bit(FLAG_APPEND).alias("append"),
        F.lit(True).alias("cloexec"),
    )


def open_mode(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(F.lit(FLAG_CREATE)) != 0, CREATE_MODE).otherwise(0)


def moved_bytes(ret: Column) -> Column:
    """Bytes that an IO row moved; a failed one moved none."""
    return F.greatest(ret, F.lit(0).cast("bigint"))


def effective_length(ret: Column, max_io_bytes: int = DEFAULT_MAX_IO_BYTES) -> Column:
    """Bytes to issue for an IO row: what was moved, within the buffer of one operation."""
    return F.least(moved_bytes(ret), F.lit(max_io_bytes).cast("bigint"))

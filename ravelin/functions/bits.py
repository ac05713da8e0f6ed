"""Integer and address arithmetic as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """Bits needed to write x >= 0; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def floor_log2(x: Column) -> Column:
    """Null for x < 1."""
    return F.when(x >= 1, F.length(F.bin(x)) - 1)


def ceil_log2(x: Column) -> Column:
    """Null for x < 1; 0 for 1."""
    return F.when(x >= 1, bit_length(x - 1))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def div(x: Column, n: Column | int) -> Column:
    """x divided by n, cut off."""
    return F.call_function("div", x, n if isinstance(n, Column) else F.lit(n).cast("long"))


def div_ceil(x: Column, n: int) -> Column:
    return div(x + (n - 1), n)


def round_up(x: Column, align: int) -> Column:
    """To a multiple of a power of two."""
    return (x + (align - 1)).bitwiseAND(-align)


def round_down(x: Column, align: int) -> Column:
    return x.bitwiseAND(-align)


def bits_between(x: Column, low: int, high: int) -> Column:
    """Bits low to high, both inclusive."""
    return F.shiftrightunsigned(x, low).bitwiseAND((1 << (high - low + 1)) - 1)


def set_index(addr: Column, shift: int, sets: int) -> Column:
    return F.shiftrightunsigned(addr, shift).bitwiseAND(sets - 1)


def block_parts(lbn: Column, widths: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Parts of a block number: name -> (bits below it, how many there are)."""
    return {k: F.shiftrightunsigned(lbn, shift) % n for k, (shift, n) in widths.items()}


def chunks(start: Column, size: Column, chunk: int) -> Column:
    """The pieces (start, size) that chunk boundaries cut a region into; none for size 0, one for chunk 0."""
    if not chunk:
        return F.when(size > 0, F.array(F.struct(start.alias("start"), size.alias("size")))).otherwise(F.array())
    first, last = div(start, chunk), div(start + size - 1, chunk)
    piece = lambda k: F.struct(F.greatest(start, k * chunk).alias("start"), (F.least(start + size, (k + 1) * chunk) - F.greatest(start, k * chunk)).alias("size"))
    return F.when(size > 0, F.transform(F.sequence(first, last), piece))


def link_delay(size: Column, payload: int, overhead: int, picoseconds_per_byte: int) -> Column:
    """Time of a transfer that is cut into packets of `payload` bytes, each with `overhead` bytes more."""
    return (size + div_ceil(size, payload) * overhead) * picoseconds_per_byte

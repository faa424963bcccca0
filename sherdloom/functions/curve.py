"""Space-filling curve codes as column expressions on 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_DEPTH = 16  # fixed value: bits per axis the curve codes allow
CODE_BITS = 63
ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")

# Masks that double the gaps between bits, for codes of 3 x 21 bits.
_SPREAD = (
    (32, 0x001F00000000FFFF),
    (16, 0x001F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)
_LOW21 = 0x1FFFFF


def _long(c: Column) -> Column:
    return c.cast("long")


def _masked_steps(steps) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in steps])


def spread_bits(c: Column) -> Column:
    """Move bit i to bit 3i.

    Folded, so the input is named once: codes are built from codes and filtered on,
    and an expression that repeats its input would multiply each time.
    """
    return F.aggregate(
        _masked_steps(_SPREAD), _long(c).bitwiseAND(F.lit(_LOW21)),
        lambda acc, s: acc.bitwiseOR(F.call_function("shiftleft", acc, s["k"])).bitwiseAND(s["m"]),
    )


def gather_bits(c: Column) -> Column:
    """Move bit 3i to bit i."""
    shifts = [k for k, _ in reversed(_SPREAD)]
    masks = [m for _, m in reversed(_SPREAD)]
    return F.aggregate(
        _masked_steps(zip(shifts, [*masks[1:], _LOW21])), c.bitwiseAND(F.lit(masks[0])),
        lambda acc, s: acc.bitwiseOR(
            F.call_function("shiftrightunsigned", acc, s["k"])
        ).bitwiseAND(s["m"]),
    )


def z_encode(x: Column, y: Column, z: Column) -> Column:
    """Bit i of x, y, z goes to bit 3i+2, 3i+1, 3i."""
    return (
        F.shiftleft(spread_bits(x), 2)
        .bitwiseOR(F.shiftleft(spread_bits(y), 1))
        .bitwiseOR(spread_bits(z))
    )


def z_decode(code: Column) -> tuple[Column, Column, Column]:
    return (
        gather_bits(F.shiftrightunsigned(code, 2)),
        gather_bits(F.shiftrightunsigned(code, 1)),
        gather_bits(code),
    )


def binary_to_gray(c: Column) -> Column:
    return c.bitwiseXOR(F.shiftrightunsigned(c, 1))


def gray_to_binary(c: Column) -> Column:
    """Every bit becomes the parity of the bits from the top down to it."""
    shifts = F.array(*[F.lit(k) for k in (32, 16, 8, 4, 2, 1)])
    return F.aggregate(
        shifts, _long(c),
        lambda acc, k: acc.bitwiseXOR(F.call_function("shiftrightunsigned", acc, k)),
    )


def _exchange(cell: Column, bit: Column, axis: Column) -> Column:
    """One step of Skilling's transform on the bits below ``bit``.

    Where the axis has the bit set, the lower bits of the first axis are inverted;
    elsewhere the lower bits of the two axes are swapped.  The step is its own
    inverse.  The cell is a bound lambda variable, so naming it often is free.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    mark = F.call_function("shiftleft", one, bit)
    low = mark - 1
    first = cell["a0"]
    this = F.when(axis == 0, first).when(axis == 1, cell["a1"]).otherwise(cell["a2"])
    is_set = this.bitwiseAND(mark) != 0
    differing = first.bitwiseXOR(this).bitwiseAND(low)
    flip = F.when(is_set, low).otherwise(differing)
    swap = F.when(is_set, zero).otherwise(differing)
    return F.struct(
        first.bitwiseXOR(flip).alias("a0"),
        F.when(axis == 1, cell["a1"].bitwiseXOR(swap)).otherwise(cell["a1"]).alias("a1"),
        F.when(axis == 2, cell["a2"].bitwiseXOR(swap)).otherwise(cell["a2"]).alias("a2"),
    )


def _steps(depth: int) -> list[Column]:
    return [
        F.struct(F.lit(bit).alias("bit"), F.lit(axis).alias("axis"))
        for bit in range(depth - 1, 0, -1)
        for axis in range(3)
    ]


def _cell(x: Column, y: Column, z: Column) -> Column:
    return F.struct(_long(x).alias("a0"), _long(y).alias("a1"), _long(z).alias("a2"))


def _no_step() -> Column:
    return F.array().cast("array<struct<bit:int,axis:int>>")


def hilbert_encode(x: Column, y: Column, z: Column, depth: int) -> Column:
    """Hilbert index of a grid cell with ``depth`` bits per axis.

    The steps are folded inside one expression.  Written as a chain of columns, a
    filter on the result would be substituted through the chain and grow with every
    step.
    """
    steps = _steps(depth)
    folded = F.aggregate(
        F.array(*steps) if steps else _no_step(), _cell(x, y, z),
        lambda cell, s: _exchange(cell, s["bit"], s["axis"]),
        lambda cell: z_encode(cell["a0"], cell["a1"], cell["a2"]),
    )
    return gray_to_binary(folded)


def hilbert_decode(code: Column, depth: int) -> Column:
    """Struct a0, a1, a2 with the grid cell of a Hilbert index: the steps in reverse."""
    steps = _steps(depth)[::-1]
    start = F.transform(F.array(binary_to_gray(_long(code))), lambda g: _cell(*z_decode(g)))[0]
    return F.aggregate(
        F.array(*steps) if steps else _no_step(), start,
        lambda cell, s: _exchange(cell, s["bit"], s["axis"]),
    )


def check_depth(depth: int, batch_bits: int = 0) -> None:
    if depth > MAX_DEPTH or 3 * depth + batch_bits > CODE_BITS:
        raise ValueError(f"curve depth {depth} with {batch_bits} batch bits does not fit 63 bits")


def with_code(
    df: DataFrame, order: str, depth: int, grid=("gx", "gy", "gz"), batch: str | None = None,
    out: str = "code",
) -> DataFrame:
    """Curve code of a grid cell; ``-trans`` swaps x and y, the batch takes the high bits.

    A cell index outside ``[0, 2**depth)`` or a batch that does not fit above it is an
    error: its bits would run into its neighbours' and two cells share a code.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown curve order {order!r}")
    check_depth(depth)
    x, y, z = (grid[1], grid[0], grid[2]) if order.endswith("-trans") else grid
    if order.startswith("z"):
        df = df.withColumn(out, z_encode(F.col(x), F.col(y), F.col(z)))
    else:
        df = df.withColumn(out, hilbert_encode(F.col(x), F.col(y), F.col(z), depth))
    fits = F.lit(True)
    for c in grid:
        fits = fits & (F.col(c) >= 0) & (F.col(c) < 1 << depth)
    code = F.col(out)
    if batch is not None:
        code = F.shiftleft(_long(F.col(batch)), 3 * depth).bitwiseOR(code)
        fits = fits & (F.col(batch) >= 0) & (_long(F.col(batch)) < 1 << (CODE_BITS - 3 * depth))
    wrong = F.raise_error(F.lit(f"a cell or batch does not fit a curve of depth {depth}")).cast("long")
    return df.withColumn(out, F.when(~fits, wrong).otherwise(code))


def with_cell(
    df: DataFrame, order: str, depth: int, code: str = "code",
    out=("gx", "gy", "gz"), batch: str = "batch",
) -> DataFrame:
    """Grid cell and batch of a code (``z`` or ``hilbert``)."""
    df = df.withColumn(batch, F.shiftrightunsigned(code, 3 * depth)).withColumn(
        "_c", F.col(code).bitwiseAND(F.lit((1 << (3 * depth)) - 1))
    )
    if order == "z":
        df = df.withColumns(dict(zip(out, z_decode(F.col("_c")))))
    elif order == "hilbert":
        df = df.withColumn("_cell", hilbert_decode(F.col("_c"), depth)).withColumns(
            {o: F.col(f"_cell.a{i}") for i, o in enumerate(out)}
        ).drop("_cell")
    else:
        raise ValueError(f"cannot decode curve order {order!r}")
    return df.drop("_c")

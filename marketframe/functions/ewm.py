"""Exponentially weighted sums as plain window functions.

The recurrence ``s_t = d * s_(t-1) + g * x_t`` is evaluated without a fold over
rows. A series is cut into blocks of ``BLOCK`` rows. Inside a block the sum is a
running total of ``x * d**-k`` scaled back by ``d**k``; ``BLOCK`` is short
enough that no power overflows for ``d >= 1/3``. The last value of every earlier
block is then carried forward, one term per block, so the result is exact for
any series length.

All specs of one call share one window over (symbol, block) and one over symbol,
both ordered by (block, date): one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, SYMBOL
from .windows import drop_scratch, num, series, with_sql

BLOCK = 512
MIN_DECAY = 1.0 / 3.0


@dataclass(frozen=True)
class Decay:
    """One weighted sum of a SQL expression: ``seeded`` starts from the first
    value (an EMA), otherwise every value has weight one (the numerator of a
    weighted mean)."""

    out: str
    value: str
    d: float
    seeded: bool = True
    gain: str | None = None

    @classmethod
    def ema(cls, out: str, value: str, span: int) -> "Decay":
        return cls(out, value, 1.0 - 2.0 / (span + 1.0))


def add_blocks(df: DataFrame) -> DataFrame:
    """Row position ``_n``, block ``_b`` and offset in block ``_k`` per symbol."""
    if "_n" not in df.columns:
        df = df.withColumn("_n", F.row_number().over(series()) - 1)
    return with_sql(df, {"_b": f"CAST(_n DIV {BLOCK} AS INT)", "_k": f"CAST(_n % {BLOCK} AS INT)"})


# Order of the rows after a block sum, for windows that follow one.
BLOCK_ORDER = f"_b, {DATE}"


def decayed_sums(df: DataFrame, specs: list[Decay]) -> DataFrame:
    """Add one column per spec; needs the columns of :func:`add_blocks`."""
    for s in specs:
        if s.d and not MIN_DECAY - 1e-12 <= s.d < 1.0:
            raise ValueError(f"decay {s.d} of {s.out} is neither 0 nor in [1/3, 1)")
    inside = f"OVER (PARTITION BY {SYMBOL}, _b ORDER BY {DATE} ROWS UNBOUNDED PRECEDING)"
    before = (
        f"OVER (PARTITION BY {SYMBOL} ORDER BY {BLOCK_ORDER} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    local, out = {}, {}
    for s in specs:
        if not s.d:  # nothing of the past: the value itself
            out[s.out] = f"CAST({s.value} AS DOUBLE)"
            continue
        name, d = f"_l_{s.out}", num(s.d)
        first = s.gain or "_n = 0"
        gain = f"IF({first}, 1D, {num(1.0 - s.d)}) * " if s.seeded else ""
        local[name] = f"sum({gain}({s.value}) * power({d}, -_k)) {inside} * power({d}, _k)"
        # Fold over finished blocks: decay what came before, add the block's own sum.
        carry = f"aggregate(_ends, 0D, (acc, e) -> acc * {num(s.d**BLOCK)} + coalesce(e.{name}, 0D))"
        out[s.out] = f"{name} + IF(_b > 0, {carry} * power({d}, _k + 1), 0D)"
    keep = [f"`{c}`" for c in df.columns if c not in out]
    if not local:
        return df.selectExpr(*keep, *[f"{e} AS {name}" for name, e in out.items()])
    df = with_sql(df, local)
    ends = f"collect_list(IF(_k = {BLOCK - 1}, struct({', '.join(local)}), NULL))"
    df = df.withColumn("_ends", F.expr(f"{ends} {before}"))
    return df.selectExpr(*keep, *[f"{e} AS {name}" for name, e in out.items()])


def add_ema(df: DataFrame, value: str, spans: dict[str, int]) -> DataFrame:
    """EMAs of one column, ``{output name: span}``, seeded with its first known value.

    A row without a value keeps the average before it: the decayed weights of the
    known values are summed beside the values, and the average is their quotient.
    Rows before the first known value have none.
    """
    df = with_sql(add_blocks(df), {"_known": f"count({value}) OVER (PARTITION BY {SYMBOL} ORDER BY {DATE} ROWS UNBOUNDED PRECEDING)"})
    first = f"_known = 1 AND {value} IS NOT NULL"
    specs, out = [], {}
    for name, span in spans.items():
        d = Decay.ema(name, value, span).d
        if not d:
            out[name] = f"last({value}, true) OVER (PARTITION BY {SYMBOL} ORDER BY {DATE} ROWS UNBOUNDED PRECEDING)"
            continue
        specs.append(Decay(f"_s_{name}", f"coalesce({value}, 0D)", d, gain=first))
        specs.append(Decay(f"_w_{name}", f"IF({value} IS NULL, 0D, 1D)", d, gain=first))
        out[name] = f"_s_{name} / nullif(_w_{name}, 0D)"
    if specs:
        df = decayed_sums(df, specs)
    return drop_scratch(with_sql(df, out))

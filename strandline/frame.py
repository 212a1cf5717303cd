"""An ordered frame: a DataFrame whose row order, partitions and value columns are named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _names(x: str | Sequence[str] | None) -> tuple[str, ...]:
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


@dataclass(frozen=True)
class OrderedFrame:
    """``df`` with rows ordered by ``order_by`` within ``partition_by``.

    Together these must identify a row, or ordered results depend on chance.
    ``columns`` are the value columns; all others pass through unchanged.
    """

    df: DataFrame
    order_by: tuple[str, ...]
    partition_by: tuple[str, ...]
    columns: tuple[str, ...]

    # ------------------------------------------------------------- helpers
    @property
    def order(self) -> list[Column]:
        return [F.asc_nulls_first(c) for c in self.order_by]

    def window(self) -> WindowSpec:
        if not self.order_by:
            raise ValueError("this operator needs order_by")
        return W.partitionBy(*self.partition_by).orderBy(*self.order)

    def sofar(self) -> WindowSpec:
        return self.window().rowsBetween(W.unboundedPreceding, 0)

    def onwards(self) -> WindowSpec:
        """Each row and all behind it, nearest last: the order reversed, since the engine runs
        frames that grow in one pass, but starts anew at each row of those that shrink."""
        if not self.order_by:
            raise ValueError("this operator needs order_by")
        return W.partitionBy(*self.partition_by).orderBy(*[F.desc_nulls_last(c) for c in self.order_by]).rowsBetween(W.unboundedPreceding, 0)

    def mapped(self, make, keep: str | None = None) -> DataFrame:
        """All columns in place, value columns replaced by ``make(name)``, in one select."""
        wanted = set(self.columns)
        cols = [make(c).alias(c) if c in wanted else F.col(c) for c in self.df.columns]
        return self.df.select(*cols)

    def select(self, *columns: str) -> OrderedFrame:
        return replace(self, columns=tuple(columns))

    def validate_order(self) -> OrderedFrame:
        """Raise ValueError unless partition and order identify rows (runs a job)."""
        keys = [*self.partition_by, *self.order_by]
        if self.df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"rows are not identified by {keys}")
        return self

    # ----------------------------------------------------------- operators
    def rolling(self, window: int, min_periods: int | None = None, center: bool = False, closed: str | None = None, step: int = 1):
        from strandline.operators.windows import Rolling

        return Rolling(self, window, min_periods, center, closed, step)

    def expanding(self, min_periods: int = 1):
        from strandline.operators.windows import Expanding

        return Expanding(self, min_periods)

    def ewm(self, com=None, span=None, halflife=None, alpha=None, min_periods: int = 0, adjust: bool = True, ignore_na: bool = False):
        from strandline.operators.ewm import Ewm

        return Ewm(self, com, span, halflife, alpha, min_periods, adjust, ignore_na)


def ordered(df: DataFrame, order_by: str | Sequence[str] | None = None, partition_by: str | Sequence[str] | None = None, columns: str | Sequence[str] | None = None) -> OrderedFrame:
    """An ordered frame; ``columns`` default to all numeric columns that are not keys."""
    order, parts = _names(order_by), _names(partition_by)
    for c in (*order, *parts, *_names(columns)):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in {*order, *parts}]
    return OrderedFrame(df, order, parts, _names(columns))


def _attach() -> None:
    """Give ordered frames the operators of each module as methods."""
    from strandline.operators import cumulative, elementwise, missing, pairwise, rank, reduce, transform

    for module in (cumulative, elementwise, missing, pairwise, rank, reduce, transform):
        for name in module.METHODS:
            setattr(OrderedFrame, name, getattr(module, name))


_attach()

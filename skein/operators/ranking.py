"""Row numbers within groups that may hold most of the rows, and the best of blocks of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


#: Rows of the largest group that one task may sort.
LARGEST = 1_000_000


def row_number_of_few(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """The same for rows that are known to be at most ``LARGEST``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def spread_row_number(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", largest: int = LARGEST) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for groups of any size.

    Groups are counted first. Where none has more than ``largest`` rows this is the plain window. Otherwise rows are
    range-partitioned by key and order, so a large group lies in many partitions; each numbers its own rows and adds
    the rows of the group in the partitions before. ``order`` should be unique within a group.
    """
    df = cut(df)
    if (df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= largest:
        return row_number_of_few(df, keys, order, name)
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), before.alias("_b"))
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    numbered = parts.withColumn("_r", local).join(offs, on)
    return numbered.select(*df.columns, (F.col("_r") + F.col("_b")).alias(name))


class Best:
    """The ``k`` best of each of ``n`` queries, by score rounded to six digits and then id, over blocks of scores.

    Once ``k`` are known of a query, only scores that reach the least of them are looked at. Scores below ``floor``, and
    those that round to 0 where it is positive, are none.
    """

    def __init__(self, n: int, k: int, floor: float = -np.inf):
        self.n, self.k, self.floor = n, k, floor
        self.least = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.cut = 0

    def __len__(self) -> int:
        return self.held

    def add(self, s: np.ndarray, ids: np.ndarray, at: int = 0) -> None:
        """``s``: of the queries from ``at`` on, beside the documents ``ids``."""
        least = self.least[at : at + len(s)]
        reach = lambda: s >= np.maximum(least - 1e-6, self.floor)[:, None]
        hit = reach()
        if self.k < s.shape[1] and np.count_nonzero(hit) > 2 * self.k * len(s):
            np.maximum(least, np.round(np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k], 6), out=least)
            hit = reach()
        i, j = np.nonzero(hit)
        v = np.round(s[i, j], 6)
        keep = v >= least[i]
        if self.floor > 0:
            keep &= v > 0
        i, j, v = i[keep], j[keep], v[keep]
        self.parts.append(((i + at).astype(np.int32), ids[j], v))
        self.held += len(v)
        if self.held > self.cut + 500_000:
            self._reduce()

    def _reduce(self) -> None:
        i, ids, v = (np.concatenate(x) for x in zip(*self.parts))
        code = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((code, -v, i))
        i = i[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < self.k
        kth = nth == self.k - 1
        self.least[i[kth]] = np.maximum(self.least[i[kth]], v[order[kth]])
        self.parts = [(i[keep], ids[order[keep]], v[order[keep]])]
        self.held = self.cut = int(keep.sum())

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, id, score``: the number of the query, and its best so far."""
        if not self.parts:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)
        self._reduce()
        return self.parts[0]

"""Abnormal returns of factor models and cumulative returns after events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import with_quantiles
from tidemark.sources import stored

#: Codes that stand for a missing return.
SENTINELS = (-66.0, -77.0, -88.0, -99.0)


def drop_sentinels(df: DataFrame, ret: str) -> DataFrame:
    """Rows whose return is a number and no missing-value code; text is read as a number if it is one."""
    value = F.col(ret).try_cast("double")
    return df.withColumn(ret, value).where(value.isNotNull() & ~F.isnan(value) & ~value.isin(*SENTINELS))


def winsorized(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, into: str | None = None) -> DataFrame:
    """column clipped to its exact quantiles over all rows; nulls stay null. df is read several times,
    and so written first."""
    df = with_quantiles(stored(df), [], column, (low, high), "__b")
    x = F.col(column)
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("__b")[0]), F.col("__b")[1]))
    return df.withColumn(into or column, clipped).drop("__b")


def trailing_moments(daily: DataFrame, y: str, factors: Sequence[str], first: int = 257, last: int = 6, firm: str = "permno", day: str = "dt") -> DataFrame:
    """daily plus n_obs and m: the sums of products of (1, factors, y) over the rows first..last before
    each row, rows with a null left out. Sums come as differences of running sums, so the cost does
    not depend on the length of the window."""
    names = ["__one", *factors, y]
    complete = F.lit(True)
    for c in (*factors, y):
        complete = complete & F.col(c).isNotNull()
    df = daily.withColumn("__one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    running = Window.partitionBy(firm).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__sums", F.array(*[F.sum(F.when(complete, F.col(a) * F.col(b)).otherwise(0.0)).over(running) for a, b in pairs]))
    at = Window.partitionBy(firm).orderBy(day)
    df = df.withColumns({"__to": F.lag("__sums", last).over(at), "__from": F.lag("__sums", first + 1).over(at)})
    difference = F.when(F.col("__from").isNull(), F.col("__to")).otherwise(F.zip_with("__to", "__from", lambda a, b: a - b))
    return df.withColumn("m", difference).withColumn("n_obs", F.get("m", F.lit(0))).drop("__one", "__sums", "__to", "__from")


def abnormal_returns(matched: DataFrame, y: str, factors: Sequence[str], least_obs: int = 60, into: str = "ar") -> DataFrame:
    """matched (rows with m of trailing_moments) plus y minus its fit on (1, factors) of the row.

    Only rows with at least least_obs observations and a return are kept; a row that lacks a factor
    gets null. Windows of less than full rank take the least-squares solution of minimal norm.
    """
    k = len(factors) + 1
    upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    kept = matched.where((F.col("n_obs") >= least_obs) & F.col(y).isNotNull())

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sums = np.stack(pdf["m"].to_numpy())
                full = np.zeros((len(pdf), k + 1, k + 1))
                for at, (i, j) in enumerate(upper):
                    full[:, i, j] = full[:, j, i] = sums[:, at]
                xx, xy = full[:, :k, :k], full[:, :k, k]
                # columns on one scale, so that rank is judged on the factors and not on their size
                scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx / scale[:, :, None] / scale[:, None, :], rcond=1e-11, hermitian=True), xy / scale) / scale
                row = np.column_stack([np.ones(len(pdf)), pdf[list(factors)].to_numpy(float)])
                pdf[into] = pdf[y].to_numpy(float) - np.einsum("ni,ni->n", row, beta)
            else:
                pdf[into] = pd.Series(dtype=float)
            yield pdf.drop(columns="m")

    out = kept.drop("m").withColumn(into, F.lit(None).cast("double")).schema
    columns = [c for c in kept.columns if c != "m"]
    return kept.select(*columns, "m").mapInPandas(fit, out).withColumn(into, F.nanvl(into, F.lit(None)))


def forward_sums(daily: DataFrame, sums: dict[str, tuple[Column, int]], firm: str = "permno", day: str = "dt", share: float = 0.5) -> DataFrame:
    """daily plus, by name, the sum of a column over the next so many rows; null if less than the share
    of them are present. Each is a difference of running sums, so its cost does not depend on how many."""
    own = Window.partitionBy(firm).orderBy(day)
    whole = Window.partitionBy(firm)
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    kinds = list({str(x): x for x, _ in sums.values()}.items())
    at = {name: i for i, (name, _) in enumerate(kinds)}
    cells = [F.array(F.sum(F.coalesce(x, F.lit(0.0))).over(running), F.count(x).over(running).cast("double")) for _, x in kinds]
    df = daily.withColumn("__run", F.array(*cells))
    df = df.withColumn("__end", F.max_by("__run", day).over(whole))
    horizons = sorted({days for _, days in sums.values()})
    df = df.withColumns({f"__to{h}": F.coalesce(F.lead("__run", h).over(own), F.col("__end")) for h in horizons})

    def one(x: Column, days: int) -> Column:
        part = lambda c, i: F.col(c)[at[str(x)]][i]
        to = f"__to{days}"
        return F.when(part(to, 1) - part("__run", 1) >= share * days, part(to, 0) - part("__run", 0))

    return df.withColumns({name: one(x, days) for name, (x, days) in sums.items()}).drop("__run", "__end", *[f"__to{h}" for h in horizons])


def forward_compound(x: Column, days: int, firm: str = "permno", day: str = "dt") -> Column:
    """Product of (1 + x) over the next `days` rows, minus one; null without any row."""
    w = Window.partitionBy(firm).orderBy(day).rowsBetween(1, days)
    return F.when(F.count(x).over(w) > 0, F.product(F.lit(1.0) + x).over(w) - 1)

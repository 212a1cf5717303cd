"""Rows that every differential test looks at, and the comparison with pandas."""

import numpy as np
import pandas as pd


def edge_frame(n: int = 240) -> pd.DataFrame:
    """Gaps, a constant run, zeros, ties, one infinity, a column of gaps only; three partitions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=n) * 3
    x[rng.random(n) < 0.2] = np.nan
    x[50:86] = 2.0
    x[90:105] = 0
    x[120:140] = np.round(x[120:140])
    x[200] = np.inf
    y = rng.normal(size=n)
    y[rng.random(n) < 0.1] = np.nan
    y[:6] = np.nan
    return pd.DataFrame({"g": np.arange(n) % 3, "i": np.arange(n), "x": x, "y": y, "z": np.nan})


COLUMNS = ["x", "y", "z"]


def by_group(pdf: pd.DataFrame, make) -> pd.DataFrame:
    out = pdf.copy()
    for _, rows in pdf.groupby("g").groups.items():
        out.loc[rows, COLUMNS] = make(pdf.loc[rows, COLUMNS]).to_numpy(dtype=float)
    return out


def same(got, want: pd.DataFrame, columns=COLUMNS, rtol=1e-9) -> None:
    got = got.toPandas().sort_values("i").reset_index(drop=True)
    want = want.sort_values("i").reset_index(drop=True)
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=rtol, atol=1e-9, equal_nan=True, err_msg=c)

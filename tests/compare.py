"""Order-free comparison of a Spark result with a DuckDB one."""

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, list | tuple | np.ndarray):
        return "[" + ",".join(plain(y) for y in x) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if isinstance(x, float | np.floating):
        return "null" if x != x else repr(float(x))
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    return str(int(x)) if isinstance(x, int | np.integer) else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(x) for x in row) for row in df[columns].astype(object).itertuples(index=False))


def same(spark_df, duck_df):
    a, b = rows(spark_df.toPandas()), rows(duck_df)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]

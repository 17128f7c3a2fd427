"""Sums over grids without one row per grid point: rows x grid in numpy, one array per group and task."""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers (rows x width) worked on at once, and numbers a task holds for its groups before it sends them on.
AT_ONCE, HELD = 1 << 20, 1 << 22


def grouped_arrays(df: DataFrame, by, width: int, numbers: Callable[[dict], np.ndarray]) -> DataFrame:
    """``by``, ``i`` and ``v``: the element-wise sum, for each group, of the arrays that ``numbers`` gives for its rows.

    ``numbers(columns)`` maps float arrays by column name (null is NaN) to an array of rows x ``width``.  A task adds up its rows
    and sends one array per group; a task with very many groups sends them on in between.  So what is shuffled depends on
    tasks, groups and ``width``, not on rows.
    """
    by, names = list(by), [c for c in df.columns if c not in by]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "a array<double>"])
    step = max(1, AT_ONCE // width)

    def codes(batch):
        """Number of each row's group, and the rows that stand for the groups."""
        code = np.zeros(batch.num_rows, dtype=np.int64)
        for c in by:
            d = batch.column(c).dictionary_encode()
            own = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            code = np.unique(code * (len(d.dictionary) + 1) + own, return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1] if len(code) else code
        return code, first

    def sent(total):
        keys = list(total)
        cols = [pa.array([k[i] for k in keys], df_types[i]) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], [*by, "a"])

    from pyspark.sql.pandas.types import to_arrow_type
    df_types = [to_arrow_type(df.schema[c].dataType) for c in by]

    def run(batches):
        total: dict = {}
        for b in batches:
            code, first = codes(b)
            keys = [tuple(b.column(c)[int(i)].as_py() for c in by) for i in first]
            for low in range(0, b.num_rows, step):
                part = b.slice(low, step)
                a = numbers({c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names})
                own = code[low:low + step]
                order = np.argsort(own, kind="stable")
                cut = np.flatnonzero(np.diff(own[order], prepend=-1))
                for k, s in zip(own[order][cut], np.add.reduceat(a[order], cut, axis=0)):
                    key = keys[k]
                    total[key] = total[key] + s if key in total else s
            if len(total) * width > HELD:
                yield sent(total)
                total = {}
        if total:
            yield sent(total)

    parts = df.mapInArrow(run, schema)
    return parts.select(*by, F.posexplode("a").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))


def erf(x: np.ndarray) -> np.ndarray:
    """As ``columns.erf``, on arrays."""
    # fixed values: published polynomial coefficients
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + p * np.abs(x))
    return np.sign(x) * (1.0 - t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * np.exp(-x * x))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def log_normal_sf(z: np.ndarray) -> np.ndarray:
    """As ``columns.log_normal_sf``, on arrays."""
    far = np.maximum(z, 4.0)
    inv = 1.0 / (far * far)
    tail = -far * far / 2.0 - np.log(far * math.sqrt(2.0 * math.pi)) + np.log1p(-inv * (1.0 - 3.0 * inv * (1.0 - 5.0 * inv)))
    return np.where(z > 4.0, tail, np.log(np.maximum(1.0 - normal_cdf(z), 1e-300)))

"""The library's functions for SQL: register(spark), then call them by name."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import dsp

FLOATS = T.ArrayType(T.DoubleType())


#: A row per sample, with its time: an expression of Spark's own, no Python.
EXPLODE = """CREATE OR REPLACE TEMPORARY FUNCTION explode_samples(samples ARRAY<DOUBLE>, dt_ms DOUBLE)
RETURNS TABLE(sample_index INT, t_ms DOUBLE, amplitude DOUBLE)
RETURN SELECT p.pos, p.pos * dt_ms, p.col FROM LATERAL posexplode(samples) p"""


def _rows(f):
    """A kernel over a series of arrays: those of one length as one matrix. Nulls stay null."""

    def run(samples: pd.Series, *constants: pd.Series) -> pd.Series:
        fixed = [c.iloc[0] for c in constants]
        out = [None if s is None else [] for s in samples]
        sizes = np.array([0 if s is None else len(s) for s in samples])
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            for k, row in zip(at, f(np.stack([np.asarray(samples.iloc[k], float) for k in at]), *fixed), strict=True):
                out[k] = row
        return pd.Series(out, dtype=object)

    return run


@F.pandas_udf(FLOATS)
def sf_bandpass(samples: pd.Series, rate: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return _rows(dsp.bandpass)(samples, rate, low, high)


@F.pandas_udf(FLOATS)
def sf_dwt_denoise(samples: pd.Series) -> pd.Series:
    return _rows(dsp.dwt_denoise)(samples)


@F.pandas_udf(FLOATS)
def sf_spectrum(samples: pd.Series) -> pd.Series:
    return _rows(lambda x: np.abs(np.fft.rfft(x, axis=1)))(samples)


def register(spark: SparkSession) -> None:
    """Vectorised functions sf_bandpass(samples, rate, low, high), sf_dwt_denoise(samples), sf_spectrum(samples), and the table function explode_samples."""
    for f in (sf_bandpass, sf_dwt_denoise, sf_spectrum):
        spark.udf.register(f.__name__, f)
    spark.sql(EXPLODE)

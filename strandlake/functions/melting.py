"""Melting profiles of amplicons: the fraction of bases in a helix by temperature, and the peaks of its slope.

A base is in a helix or not. A step between two helix bases weighs exp(-dG / RT), a new helix SIGMA. The chain is read base by
base with three numbers for each temperature: the share r of the weight whose last base is in a helix, and the mean count of helix
bases so far, once for each of the two states (times its share). Small numpy helpers do that for all temperatures of some rows at
once, and read slopes, peaks and the melting temperature off the curves, which needn't leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parameters import GAS, ZERO, all_steps

SIGMA = 1e-5
#: Temperatures of a profile in Celsius, the least share of the highest peak that counts, and salt per unit of ln(monovalent).
LOW, HIGH, STEP, PEAK_SHARE, SALT = 50.0, 98.0, 0.25, 0.15, 0.368

_STEPS = all_steps()


def temperatures(low: float = LOW, high: float = HIGH, step: float = STEP) -> list[float]:
    return [low + step * k for k in range(int((high - low) / step + 1e-9) + 1)]


#: Rows whose curves are read together: their states stay in a core's cache.
ROWS = 32


def all_helix_fractions(seqs: Sequence[str], celsius: np.ndarray, monovalent: float = 0.050, sigma: float = SIGMA) -> np.ndarray:
    """The expected share of strict sequences' bases in a helix, by (sequence, temperature)."""
    kelvin = np.asarray(celsius, float) + ZERO
    salt = SALT * np.log(max(monovalent, 1e-6))
    # How much likelier a helix base goes on as one than not, as a share: w / (1 + w), by the 16 kinds of steps.
    kinds = list(_STEPS)
    on = np.array([1 / (1 + np.exp((dh - kelvin * (ds + salt) / 1000) / (GAS * kelvin / 1000))) for dh, ds in _STEPS.values()])
    off = 1 - on
    code = np.zeros(256, np.intp)
    code[[ord(x) for x in "ACGT"]] = range(4)
    place = np.zeros(16, np.intp)
    place[[4 * "ACGT".index(k[0]) + "ACGT".index(k[1]) for k in kinds]] = range(16)
    out = np.empty((len(seqs), len(kelvin)))
    longest_first = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
    for first in range(0, len(seqs), ROWS):
        rows = longest_first[first : first + ROWS]
        width = len(seqs[rows[0]])
        letters = code[np.frombuffer("".join(seqs[k].ljust(width, "A") for k in rows).encode(), np.uint8).reshape(len(rows), width)]
        steps = place[4 * letters[:, :-1] + letters[:, 1:]]
        sizes = np.array([len(seqs[k]) for k in rows])
        share = np.full((len(rows), len(kelvin)), sigma / (1 + sigma))
        helix, coil = share.copy(), np.zeros_like(share)
        for i in range(width - 1):
            n = int(np.count_nonzero(sizes > i + 1))  # the shorter ones have ended
            p, q = on[steps[:n, i]], off[steps[:n, i]]
            grown = p * (share[:n] + sigma * (1 - share[:n]))
            total = grown + q
            h, c = helix[:n], coil[:n]
            helix[:n], coil[:n] = (p * (h + sigma * c) + grown) / total, q * (h + c) / total
            share[:n] = grown / total
        out[rows] = (helix + coil) / sizes[:, None]
    return out


def helix_fractions(seq: str, celsius: np.ndarray, monovalent: float = 0.050, sigma: float = SIGMA) -> np.ndarray:
    """The expected share of a strict sequence's bases in a helix, at each temperature."""
    return all_helix_fractions([seq], celsius, monovalent, sigma)[0]


def _able(batch: pd.Series) -> np.ndarray:
    strict = set("ACGT")
    return np.array([isinstance(s, str) and len(s) > 1 and strict.issuperset(s) for s in batch], bool)


def theta_udf(monovalent: float = 0.050):
    """array<double>: helix_fractions() at temperatures(); null where a string isn't strict DNA of two bases or more."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = np.array(temperatures())
        for batch in batches:
            able = _able(batch)
            curves = iter(all_helix_fractions(batch[able].tolist(), at, monovalent))
            yield pd.Series([next(curves) if x else None for x in able], dtype=object)

    return run


def theta(seq: Column, monovalent: float = 0.050) -> Column:
    return theta_udf(monovalent)(seq)


PROFILE = "tm double, peaks array<double>, gap double"


def profiles_of(curves: np.ndarray) -> pd.DataFrame:
    """profile() of curves, by (row, temperature)."""
    c, t = curves, np.array(temperatures())
    slope = np.zeros_like(c)
    slope[:, 1:-1] = -(c[:, 2:] - c[:, :-2]) / (2 * STEP)
    tops = np.zeros(c.shape, bool)
    tops[:, 2:-2] = (slope[:, 2:-2] >= slope[:, 1:-3]) & (slope[:, 2:-2] > slope[:, 3:-1]) & (slope[:, 2:-2] > 0)
    high = tops & (slope >= PEAK_SHARE * np.where(tops, slope, 0.0).max(1, keepdims=True))
    falls = (c[:, :-1] >= 0.5) & (c[:, 1:] < 0.5)
    row, k = np.arange(len(c)), falls.argmax(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        tm = np.where(falls.any(1), t[k] + (c[row, k] - 0.5) / (c[row, k] - c[row, k + 1]) * STEP, np.nan)
    peaks = [t[x] for x in high]
    return pd.DataFrame({"tm": tm, "peaks": pd.Series(peaks, dtype=object), "gap": [np.diff(x).max(initial=0.0) for x in peaks]})


def profile(curve: Column) -> Column:
    """struct(tm, peaks, gap) of a column of theta().

    tm is where the curve first falls under one half, along the line between two temperatures; null where it never does. Peaks are
    temperatures at which the slope (by central differences) is as high as before and higher than behind, above 0 and at least
    PEAK_SHARE of the highest such; the outermost two places on both sides have none. gap is the widest between neighbours.
    """

    @F.pandas_udf(PROFILE)
    def run(batch: pd.Series) -> pd.DataFrame:
        return _spread(batch.notna().to_numpy(), profiles_of(np.array(batch.dropna().tolist()).reshape(-1, len(temperatures()))))

    return F.when(curve.isNotNull(), run(curve))


def melted(seq: Column, monovalent: float = 0.050) -> Column:
    """profile() of theta(), without the curve."""

    @F.pandas_udf(PROFILE)
    def run(batch: pd.Series) -> pd.DataFrame:
        able = _able(batch)
        return _spread(able, profiles_of(all_helix_fractions(batch[able].tolist(), np.array(temperatures()), monovalent)))

    return F.when(seq.rlike("^[ACGT]{2,}$"), run(seq))


def _spread(able: np.ndarray, found: pd.DataFrame) -> pd.DataFrame:
    """found at the rows that are able, nulls elsewhere."""
    return found if able.all() else found.set_index(np.flatnonzero(able)).reindex(range(len(able))).astype(object).replace({np.nan: None})

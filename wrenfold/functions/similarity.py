"""Jaro-Winkler (Arrow) and Soundex (Catalyst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .vocab import JW_THRESHOLD, NAME_MAX


def jaro_of(a: str, b: str) -> float:
    """DUP7: half the transposed matches count, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, mine = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (ch for ch, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """DUP8."""
    j, same = jaro_of(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * weight * (1 - j)


def jaro_winkler_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, weight: float = 0.1) -> np.ndarray:
    """DUP8 of many pairs at once: rows of code points, filled up with -1, and their lengths, none of them 0."""
    n, rows = len(la), np.arange(len(la))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    far, wide = int(reach.max(initial=0)), b.shape[1]
    free, mine = b >= 0, np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        lo, hi = max(0, i - far), min(wide, i + far + 1)
        if lo >= hi:
            break
        hit = (b[:, lo:hi] == a[:, i : i + 1]) & free[:, lo:hi] & (np.abs(np.arange(lo, hi) - i) <= reach[:, None])
        j = hit.argmax(1)
        some = hit[rows, j]
        free[rows[some], lo + j[some]] = False
        mine[:, i] = some
    m = mine.sum(1)
    # both sides have m matched letters, in their order, row after row
    moved = np.bincount(np.repeat(rows, m)[a[mine] != b[(b >= 0) & ~free]], minlength=n) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    return j + _prefix(a, b) * weight * (1 - j)


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first four code points are the same."""
    k = min(4, a.shape[1], b.shape[1])
    return np.cumprod((a[:, :k] == b[:, :k]) & (a[:, :k] >= 0), axis=1).sum(1)


#: Letters that names are counted by (code points that share a remainder count as one), and bytes of a step's arrays.
_LETTERS, _STEP = 32, 1 << 22


def alike(names: list[str], left: np.ndarray, right: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of an entry of left and one of right that score JW_THRESHOLD or more, and their scores, in steps.

    left, right: entries' names, as places in names. begins, counts: which entries of right each of left meets.
    Letters that two names share bound what matches, and with it the score, so most pairs are only counted.
    """
    size = np.fromiter(map(len, names), np.int64, len(names))
    code = np.full((len(names), int(size.max(initial=1))), -1, np.int32)
    for k, s in enumerate(names):
        code[k, : size[k]] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    bag = np.zeros((len(names), _LETTERS), np.int16)
    at, _ = np.nonzero(code >= 0)
    np.add.at(bag, (at, code[code >= 0] % _LETTERS), 1)
    total, few, step = np.cumsum(counts), max(1, _STEP // (2 * _LETTERS)), max(1, _STEP // (4 * code.shape[1]))
    k = 0
    while k < len(left):
        to = max(k + 1, int(np.searchsorted(total, total[k] - counts[k] + few, "right")))
        n = counts[k:to]
        i = np.repeat(np.arange(k, to), n)
        j = begins[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        k, u, v = to, left[i], right[j]
        most = np.minimum(bag[u], bag[v]).sum(1)
        bound = (most / size[u] + most / size[v] + 1) / 3
        bound += _prefix(code[u, :4], code[v, :4]) * 0.1 * (1 - bound)
        i, j, u, v = (x[(most > 0) & (bound >= JW_THRESHOLD - 1e-9)] for x in (i, j, u, v))
        for f in range(0, len(u), step):
            a, b = u[f : f + step], v[f : f + step]
            score = jaro_winkler_rows(code[a, : size[a].max()], size[a], code[b, : size[b].max()], size[b])
            good = score >= JW_THRESHOLD
            yield i[f : f + step][good], j[f : f + step][good], score[good]


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_names(a: Column, b: Column) -> Column:
    """DUP9: the score if it is 0.90 or more, of texts of 1 to 200 characters."""
    fine = lambda c: F.length(c).between(1, NAME_MAX)
    both = fine(a) & fine(b)
    score = jaro_winkler(F.when(both, F.lower(a)), F.when(both, F.lower(b)))
    return F.when(both & (score >= JW_THRESHOLD), score)


def soundex(c: Column) -> Column:
    """DUP10: vowels, h, w and y part equal codes; other letters than A-Z are code 0; null without letters."""
    u = F.regexp_replace(F.upper(c), r"[^\p{L}]", "")
    codes = F.regexp_replace(F.translate(u, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202"), r"[^0-9]", "0")
    tail = F.replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(F.length(u) > 0, F.rpad(F.concat(F.substring(u, 1, 1), tail), 4, "0"))

"""A portable integer hash.

Every intermediate stays below 2**63, so it evaluates without overflow under
ANSI mode and gives the same value in any SQL engine with BIGINT and XOR. It
is used where a random order must be the same on every retry of a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the hash
_MASK = 2**31
_MULT = 73244475
_FOLD = 40503
_ADD = 1013904223


def mix31(x: Column, salt: int | Column) -> Column:
    """31-bit hash of a non-negative BIGINT column."""
    x = x.cast("bigint")
    s = salt.cast("bigint") if isinstance(salt, Column) else F.lit(int(salt)).cast("bigint")
    high = (F.shiftright(x, 31) * _FOLD) % _MASK
    h = (x % _MASK).bitwiseXOR(high).bitwiseXOR(s)
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * _MULT) % _MASK
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * _MULT + _ADD) % _MASK
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix31_int(x: int, salt: int) -> int:
    """The same hash for a driver-side integer (deriving salts)."""
    h = (x % _MASK) ^ (((x // _MASK) * _FOLD) % _MASK) ^ salt
    h = ((h ^ (h >> 15)) * _MULT) % _MASK
    h = ((h ^ (h >> 13)) * _MULT + _ADD) % _MASK
    return h ^ (h >> 16)


def set_salts(seed: int, index: int) -> tuple[int, int]:
    """Two salts for the ``index``-th random order under ``seed``."""
    base = mix31_int(index + 1, mix31_int(seed, 1))
    return base, mix31_int(base, 7)


def rank_hash(x: Column, seed: int, index: int = 0) -> Column:
    """62-bit key; ordering rows by it is a pseudo-random permutation."""
    hi, lo = set_salts(seed, index)
    return mix31(x, hi) * _MASK + mix31(x, lo)


def _mix31_array(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x % _MASK) ^ ((x // _MASK) * _FOLD % _MASK) ^ salt
    h = ((h ^ (h >> 15)) * _MULT) % _MASK
    h = ((h ^ (h >> 13)) * _MULT + _ADD) % _MASK
    return h ^ (h >> 16)


def rank_hash_array(x: np.ndarray, hi: int, lo: int) -> np.ndarray:
    """``rank_hash`` of an id array inside a task, for given salts."""
    x = x.astype(np.int64)
    return _mix31_array(x, hi) * _MASK + _mix31_array(x, lo)

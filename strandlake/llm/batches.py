"""Settings that bound the memory of Python workers."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "16m"
PART_BYTES = 128 << 20


def bound_batches(spark: SparkSession, size: str = BATCH) -> None:
    """Arrow batches end at about ``size`` of data, so long texts make small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES, *, most: int = 100_000) -> int:
    """Partitions for a shuffle of about all of ``df``: the session's number, or more where a part would hold more than ``part_bytes``.

    The size is the optimizer's estimate (for files, theirs); an unknown size leaves the session's number.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own if size >= 1 << 60 else min(max(own, -(-size // part_bytes)), max(most, own))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) from a hash of columns: the same at every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), F.lit(1 << 30)) / float(1 << 30)


def drawn(df: DataFrame, seed: str, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows of ``df``, those of the least hashes of ``columns``.

    A count comes first, so that about 1.5 times as many rows reach the final sort, however many partitions there are.
    """
    share = min(1.0, (1.5 * most + 50) / max(df.count(), 1))
    return df.where(uniform(seed, *columns) < share).orderBy(uniform(seed, *columns), *columns).limit(most)


class Recent:
    """A bounded cache of two generations: entries in use move on to the new one when it begins.

    Entries of long keys and empty entries serve one call; ``empty`` has the keys of the latter.
    """

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest, self.empty, self._new, self._old, self._brief = size, longest, set(), {}, {}, []

    def known(self, keys: Collection[str], learn) -> dict[str, bytes]:
        """A dictionary that has all ``keys``, which differ, until the next call; ``learn`` makes those of a list that are new."""
        for k in self._brief:
            self._new.pop(k, None)
        if len(self._new) >= self.size:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        missing = [k for k in keys if k not in new]
        if old:
            new.update({k: old[k] for k in missing if k in old})
            missing = [k for k in missing if k not in old]
        made = learn(missing) if missing else {}
        self._new.update(made)
        self.empty = {k for k, v in made.items() if not v}
        self._brief = [k for k in made if len(k) > self.longest] + list(self.empty)
        return self._new

    def get(self, key: str) -> bytes | None:
        return self._new.get(key) or self._old.get(key)

    def __len__(self) -> int:
        return len(self._new) + len(self._old)

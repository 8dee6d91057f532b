"""Vector expressions over arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """A bag-of-words vector by hashing, for texts that come without embeddings: signed counts of ``size`` buckets."""
    # each word is hashed once, to its bucket and sign as one number; a batch of texts is then counted at once
    codes = F.transform(words, lambda w: (2 * F.pmod(F.xxhash64(w), F.lit(size)) + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("int"))

    @F.arrow_udf("array<float>")
    def counted(codes: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False))
        said = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.searchsorted(ends, np.arange(len(said)), side="right")
        sums = np.bincount(row * size + said // 2, weights=1.0 - 2.0 * (said % 2), minlength=len(codes) * size)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * size), pa.array(sums, pa.float32()), mask=pc.is_null(codes))

    return counted(codes)

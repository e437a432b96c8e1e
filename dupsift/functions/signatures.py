"""Signatures of token arrays: MD5, two SimHashes, MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# The FNV-1a parameters for 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Multipliers and addends of the MinHash permutations come from MD5 of their number; this prime is 2^31 - 1.
PRIME = 2147483647


def md5_word(text: Column) -> Column:
    """The first 16 hex digits of the MD5 as a signed 64-bit integer."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("bigint")


@F.arrow_udf(LongType())
def simhash_md5(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SimHash of token arrays: 64 bits of each token's MD5, votes by frequency, ties give 1; no tokens give all ones. Signed. A batch stays an Arrow array; the strings of one row at a time are made."""
    import hashlib

    for tokens in batches:
        out = []
        for row in tokens:
            own = row.as_py()
            if own is None or not len(own):
                out.append(-1)
                continue
            h = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in own), ">u8").astype("<u8")
            votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out.append(int(np.packbits(2 * votes >= len(h), bitorder="little").view("<i8")[0]))
        yield pa.array(out, pa.int64())


def _fnv(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def simhash_fnv(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash over the distinct tokens with their frequencies as weights: a set bit votes with the weight, a clear bit with 1 against; ties
    give 0. As a bit string, highest bit first."""
    known: dict[str, np.ndarray] = {}
    for tokens in batches:
        out = []
        for own in tokens:
            votes, counts = np.zeros(64, np.int64), {}
            for t in [] if own is None else own:
                counts[t] = counts.get(t, 0) + 1
            for t, n in counts.items():
                bits = known.get(t)
                if bits is None:
                    bits = np.unpackbits(np.array([_fnv(t.encode())], ">u8").view(np.uint8)).astype(bool)
                    if len(known) < 200_000:
                        known[t] = bits
                votes += np.where(bits, n, -1)
            out.append("".join("1" if v > 0 else "0" for v in votes))
        yield pd.Series(out, dtype="object")


def similarity_of_bits(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def minhash(tokens: Column, permutations: int = 16) -> Column:
    """For each permutation the least of (a h + b) mod p over the tokens' 31-bit hashes; -1 without tokens."""
    import hashlib

    word = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % PRIME
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME))
    least = lambda a, b: F.coalesce(F.array_min(F.transform(hashes, lambda h: (h * a + b) % PRIME)), F.lit(-1).cast("bigint"))
    return F.array(*[least(F.lit(max(1, word(f"a{i}"))).cast("bigint"), F.lit(word(f"b{i}")).cast("bigint")) for i in range(permutations)])


def minhash_parameters(permutations: int = 16) -> list[tuple[int, int]]:
    import hashlib

    word = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % PRIME
    return [(max(1, word(f"a{i}")), word(f"b{i}")) for i in range(permutations)]

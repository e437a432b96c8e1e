"""Column functions over vectors, sign codes and pairs of them. All are built from JVM functions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine01(a: Column, b: Column, zero: float = 0.5) -> Column:
    """(clipped cosine + 1) / 2; `zero` where a norm is 0 (0.5 is the batched rule, 0.0 that for a single pair)."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(zero)).otherwise((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)) + 1) / 2)


def sign_code(v: Column) -> Column:
    """1 where positive, else -1."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(-1))


def packed(code: Column, bits: int = 64) -> Column:
    """A sign code of at most 64 entries as one integer, the first entry in the highest place."""
    return F.aggregate(F.slice(code, 1, bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))


def band_keys(word: Column, bands: int, width: int) -> Column:
    """The bands of a packed 64-bit code, first band first, as integers."""
    return F.array(*[F.shiftrightunsigned(word, 64 - (i + 1) * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)])


def hamming_similarity(a: Column, b: Column) -> Column:
    """Share of equal entries."""
    return total(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))) / F.size(a)


def hamming_similarity_packed(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def equal_blocks(a: Column, b: Column, blocks: int, width: int) -> Column:
    """How many of the blocks of `width` entries are equal throughout."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.slice(a, i * width + 1, width) == F.slice(b, i * width + 1, width)))


def block_hamming(a: Column, b: Column, blocks: int, width: int) -> Column:
    return equal_blocks(a, b, blocks, width) / F.lit(float(blocks))


#: Share of groups that collide: the same count under its other name.
group_collision = block_hamming


def band_collision(a: Column, b: Column, bands: int, groups: int, width: int) -> Column:
    """Share of matching bands, a band being `groups` blocks of `width` entries."""
    return equal_blocks(a, b, bands, groups * width) / F.lit(float(bands))


def soft_block_hamming(a: Column, b: Column, blocks: int, width: int) -> Column:
    """1 - sum over blocks of the largest difference, scaled to [0, 1] for entries in [-1, 1]."""
    gap = lambda i: F.array_max(F.zip_with(F.slice(a, i * width + 1, width), F.slice(b, i * width + 1, width), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return 1 - F.aggregate(F.sequence(F.lit(0), F.lit(blocks - 1)), F.lit(0.0), lambda s, i: s + gap(i)) * width / (2 * blocks * width)


def manhattan_similarity(a: Column, b: Column) -> Column:
    return F.exp(-0.005 * total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def lsh_probability(s: Column, k: int | Column, bands: int | Column) -> Column:
    """1 - (1 - s^k)^bands, within [0, 1]."""
    k, bands = (F.lit(x) if isinstance(x, int) else x for x in (k, bands))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.pow(1 - F.pow(s, k), bands)))


def lsh_shapes(blocks: int) -> list[tuple[int, int]]:
    """(bands, blocks a band): (1, m), (2, m/2), (4, m/4), ... down to one block a band."""
    out, bands = [], 1
    while bands <= blocks:
        out.append((bands, blocks // bands))
        bands *= 2
    return out


def slot_keys(word: Column, slots: int, chosen: int, bits: int = 64) -> Column:
    """For every choice of slots of a packed code: (number of the choice, their bits)."""
    width = bits // slots
    slot = lambda i: F.shiftrightunsigned(word, bits - (i + 1) * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[F.struct(F.lit(n).alias("combo"), F.concat_ws("-", *[slot(i) for i in c]).alias("key")) for n, c in enumerate(combinations(range(slots), chosen))])


def pair_index(i: Column, j: Column, n: int | Column) -> Column:
    """Place of the pair i < j in the row-wise upper triangle of n rows."""
    n = F.lit(n) if isinstance(n, int) else n
    i, j = F.least(i, j), F.greatest(i, j)
    return (i * (2 * n - i - 1) / 2).cast("bigint") + j - i - 1


def pair_of_index(place: Column, n: int) -> tuple[Column, Column]:
    """The pair at a place: closed form, then exact correction by one."""
    b = 2 * n - 1
    guess = F.floor((b - F.sqrt(F.lit(float(b * b)) - 8 * place)) / 2)
    first = lambda i: (i * (2 * n - i - 1) / 2).cast("bigint")
    i = F.when(first(guess) > place, guess - 1).when(first(guess + 1) <= place, guess + 1).otherwise(guess)
    return i, place - first(i) + i + 1


def contrastive_loss(target: Column, predicted: Column, margin: float = 0.7) -> Column:
    d = 1 - predicted
    return target * 0.5 * d * d + (1 - target) * 0.5 * F.pow(F.greatest(F.lit(0.0), margin - d), 2)


def quantization_loss(v: Column) -> Column:
    """Mean squared distance of a vector's entries from -1 or 1."""
    return total(F.transform(v, lambda x: F.pow(F.abs(x.cast("double")) - 1, 2))) / F.size(v)

"""Perceptual hashes over numeric arrays, kept as 32-bit limbs, and their distance."""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_hash(values: Column, limbs: int = 2) -> list[Column]:
    """A bit for each value at or above the mean, least bit first, 32 bits to a limb."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(values)
    bits = F.transform(values, lambda v: F.when(v.cast("double") >= mean, 1).otherwise(0))
    return [_limb(bits, k) for k in range(limbs)]


def sign_hash(values: Column, limbs: int = 2) -> list[Column]:
    """A bit for each value above zero, least bit first, 32 bits to a limb."""
    bits = F.transform(values, lambda v: F.when(v > 0, 1).otherwise(0))
    return [_limb(bits, k) for k in range(limbs)]


def difference_hash(pixels: Column, size: int = 16) -> list[Column]:
    """A bit for each pixel above its right neighbour, from ``size`` rows of size + 1 grey values in one array, least bit
    first, 32 bits to a limb; null if the array has another length or a null."""
    n = size * (size + 1)
    whole = (F.size(pixels) == n) & ~F.exists(pixels, lambda v: v.isNull())
    at = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: k + F.floor(k / size).cast("int"))
    bits = F.transform(at, lambda i: F.when(F.get(pixels, i) > F.get(pixels, i + 1), 1).otherwise(0))
    return [F.when(whole, _limb(bits, k)) for k in range(size * size // 32)]


def _limb(bits: Column, k: int) -> Column:
    part = F.slice(bits, 32 * k + 1, 32)
    return F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def hamming(left: list[Column], right: list[Column]) -> Column:
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


class Piece(NamedTuple):
    """Bits low .. high - 1 of a hash, in which hashes within the whole distance differ by at most ``radius`` in one piece at least."""

    low: int
    high: int
    radius: int

    @property
    def half(self) -> int:
        """Bits of the piece's lower half."""
        return (self.high - self.low) // 2

    def share(self) -> float:
        """Of pairs of random hashes, those within the radius."""
        width = self.high - self.low
        return sum(comb(width, k) for k in range(self.radius + 1)) / 2**width

    def flips(self, upper: bool) -> list[int]:
        """What one side flips in its own half, with both halves' numbers of flips in the high bits: every own choice meets the
        other side's once, so pairs within the radius have one key in common and others none."""
        width, own = self.high - self.low, range(self.half, self.high - self.low) if upper else range(self.half)
        rest = self.half if upper else width - self.half
        out = []
        for n in range(min(self.radius, len(own)) + 1):
            for chosen in combinations(own, n):
                for other in range(min(self.radius - n, rest) + 1):
                    low, high = (other, n) if upper else (n, other)
                    out.append((low * 32 + high) << 32 | sum(1 << b for b in chosen))
        return out


def pieces(distance: int, bits: int = 64, share: float = 0.01, rows: int = 4096) -> list[Piece]:
    """The cut into the most pieces by which at most ``share`` of the pairs of random hashes are looked at, with at most ``rows`` keys for
    a hash; if there is none, the cut of the least share. Radii and pieces add up to distance + 1, so no pair is missed; a radius of
    -1 asks nothing of its piece."""
    best: list[Piece] = []
    least = -(-bits // 32)  # a piece's value has 32 bits at most
    for n in range(max(distance + 1, least), least - 1, -1):
        each, more = divmod(distance + 1, n)
        cut = [Piece(bits * k // n, bits * (k + 1) // n, each - 1 + (k < more)) for k in range(n)]
        keys = max(sum(sum(comb(h, i) * (p.radius - i + 1) for i in range(p.radius + 1)) for p in cut for h in [p.half if side else p.high - p.low - p.half]) for side in (0, 1))
        if best and keys > rows:
            continue
        if not best or sum(p.share() for p in cut) < sum(p.share() for p in best):
            best = cut
        if sum(p.share() for p in best) <= share:
            break
    return best


def piece_value(limbs: list[Column], piece: Piece, width: int = 32) -> Column:
    out = F.lit(0).cast("long")
    for i, limb in enumerate(limbs):
        a, b = max(piece.low, width * i), min(piece.high, width * (i + 1))
        if a < b:
            part = F.shiftright(limb, a - width * i).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(part, a - piece.low))
    return out


def probes(limbs: list[Column], cut: list[Piece], upper: bool) -> Column:
    """The keys of a hash on one side; two hashes of different sides within the distance share one at least."""

    def keys(k: int, piece: Piece) -> Column:
        value = piece_value(limbs, piece)
        flips = ",".join(str(k << 42 | f) for f in piece.flips(upper))
        return F.transform(F.split(F.lit(flips), ",").cast("array<long>"), lambda f: f.bitwiseXOR(value))

    return F.concat(*[keys(k, p) for k, p in enumerate(cut) if p.radius >= 0])

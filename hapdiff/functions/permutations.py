"""Label permutations for the null, by their ranks: none is listed but those that are taken."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence


def available(n: int, k: int) -> int:
    """How many other labellings there are: k in the smaller group of n. Small groups drawn only from the larger observed
    one don't count, and in balanced plans a labelling and its complement are one."""
    return math.comb(n, k) // 2 - 1 if 2 * k == n else math.comb(n, k) - 1 - math.comb(n - k, k)


def subset(rank: int, members: Sequence[int], size: int) -> list[int]:
    """The subset of that size at place `rank`, from 0, of all in lexicographic order."""
    out, at = [], 0
    while size:
        with_next = math.comb(len(members) - at - 1, size - 1)
        if rank < with_next:
            out.append(members[at])
            size -= 1
        else:
            rank -= with_next
        at += 1
    return out


def tiers(k: int, rest: int) -> list[list[tuple[int, int, bool]]]:
    """Kinds of small groups, the most even mixtures first; kinds that are equally even are one tier.

    A kind is how many of the k come from the observed small group, how many such groups there are, and whether the first
    observed member must be one of them, which picks one of a labelling and its complement.
    """
    out: dict[int, list] = {}
    for own in range(1, k):
        if k == rest and 2 * own < k:
            continue  # the complement has k - own of them
        halved = k == rest and 2 * own == k
        ways = math.comb(k - 1, own - 1) if halved else math.comb(k, own)
        out.setdefault(max(own, k - own), []).append((own, ways * math.comb(rest, k - own), halved))
    return [out[evenness] for evenness in sorted(out)]


def plan(groups: Sequence[int], wanted: int, seed: int = 0) -> tuple[list[list[int]], int]:
    """Up to `wanted` different permuted labellings (1 or 2 for each sample) and how many are available.

    Tiers whose small group mixes the observed groups most evenly come first; of the last tier that is needed as many as are
    missing are drawn by `seed`, each labelling of the tier alike, however many there are.
    """
    if wanted < 1 or wanted != int(wanted):
        raise ValueError("the number of permutations must be a positive whole number")
    if sorted(set(groups)) != [1, 2]:
        raise ValueError("exactly two groups are needed")
    n, ones = len(groups), sum(g == 1 for g in groups)
    small = 1 if 2 * ones <= n else 2
    inside, outside = ([i for i, g in enumerate(groups) if (g == small) == of] for of in (True, False))
    k, rng, out = len(inside), random.Random(seed), []
    for tier in tiers(k, len(outside)):
        total, missing = sum(count for _, count, _ in tier), int(wanted) - len(out)
        for rank in range(total) if total <= missing else sorted(rng.sample(range(total), missing)):
            for own, count, halved in tier:
                if rank < count:
                    break
                rank -= count
            one, two = divmod(rank, math.comb(len(outside), k - own))
            chosen = [inside[0], *subset(one, inside[1:], own - 1)] if halved else subset(one, inside, own)
            chosen = {*chosen, *subset(two, outside, k - own)}
            out.append([small if i in chosen else 3 - small for i in range(n)])
        if len(out) == wanted:
            break
    return out, available(n, k)

"""Demultiplexing by many pairs of adapters at once, with errors.

An adapter that stands in a read with k edits at most, cut into k + 1 pieces, has one of them in the read unchanged. All pieces of all
adapters go into one Aho-Corasick automaton, which finds them in a single pass over a read; only where a piece is found, its
adapter is aligned with the few bases around it. So the work hardly grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_match(text: str, adapter: str, most: int) -> tuple[int, int, int] | None:
    """(edits, end, start) of the adapter in a text with `most` edits at most: the fewest, then the first end, then the first start."""
    cost, origin = list(range(len(adapter) + 1)), [0] * (len(adapter) + 1)
    best = None
    for j, base in enumerate(text):
        above, came = cost[0], origin[0]
        cost[0], origin[0] = 0, j + 1
        for i, wanted in enumerate(adapter, 1):
            old, old_origin = cost[i], origin[i]
            cost[i], origin[i] = min((above + (base != wanted), came), (old + 1, old_origin), (cost[i - 1] + 1, origin[i - 1]))
            above, came = old, old_origin
        if cost[-1] <= most:
            found = (cost[-1], j + 1, origin[-1])
            best = found if best is None else min(best, found)
    return best


class Adapters:
    """An index of adapters: find(read) gives the best match of each that is there."""

    def __init__(self, adapters: list[str], error_rate: float) -> None:
        import ahocorasick

        self.adapters = adapters
        self.most = [int(error_rate * len(a)) for a in adapters]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (a, most) in enumerate(zip(adapters, self.most, strict=True)):
            if most >= len(a):
                raise ValueError(f"an adapter may not be all errors: {a!r}")
            cuts = [len(a) * i // (most + 1) for i in range(most + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(a[lo:hi], []).append((k, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, read: str) -> dict[int, tuple[int, int, int]]:
        """{adapter: (edits, end, start)}"""
        found: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (length, owners) in self.automaton.iter(read):
            for k, offset in owners:
                at, most = last + 1 - length - offset, self.most[k]
                if (k, at) in seen:
                    continue
                seen.add((k, at))
                lo = max(0, at - most)
                match = best_match(read[lo : at + len(self.adapters[k]) + most], self.adapters[k], most)
                if match:
                    match = (match[0], match[1] + lo, match[2] + lo)
                    found[k] = min(found.get(k, match), match)
        return found


def assign_pair(read: str, five: dict[int, tuple[int, int, int]], three: dict[int, tuple[int, int, int]], pairs: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(pair, begin, end, edits) of the pair of fewest edits, the first if equal, whose second adapter begins behind the first."""
    best = None
    for k, (a, b) in enumerate(pairs):
        if a in five and b in three and three[b][2] >= five[a][1]:
            found = (five[a][0] + three[b][0], k, five[a][1], three[b][2])
            best = found if best is None else min(best, found)
    return best and (best[1], best[2], best[3], best[0])


def demultiplex_pairs(reads: DataFrame, pairs: list[tuple[str, str, str]], error_rate: float = 0.1, shortest: int = 0, longest: int = 1 << 30) -> DataFrame:
    """The reads that hold one of the pairs (name, 5' adapter, 3' adapter), with pair (its name), part (what stands between) and edits.
    Whole adapters only. Distinct sequences are looked at once."""
    fives, threes = (list(dict.fromkeys(p[k] for p in pairs)) for k in (1, 2))
    known = [(fives.index(a), threes.index(b)) for _, a, b in pairs]
    names = [p[0] for p in pairs]

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = Adapters(fives, error_rate), Adapters(threes, error_rate)
        for df in frames:
            hits = [assign_pair(s, first.find(s), second.find(s), known) for s in df["seq"]]
            there = [h is not None for h in hits]
            some = [h for h in hits if h is not None]
            out = df[there].reset_index(drop=True)
            yield out.assign(pair=[names[h[0]] for h in some], part=[s[h[1] : h[2]] for s, h in zip(out["seq"], some, strict=True)], edits=[h[3] for h in some])

    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = reads.where("seq IS NOT NULL").select("seq").distinct().repartition(tasks, "seq").mapInPandas(found, "seq string, pair string, part string, edits int")
    return reads.join(cut, "seq").where(F.length("part").between(shortest, longest))

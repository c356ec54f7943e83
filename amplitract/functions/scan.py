"""scan_tracts as a table function for SQL: SELECT ... FROM reads, LATERAL scan_tracts(seq).

A second argument names the columns that are wanted ('cag,ccg'), all if it isn't given. DataFrames use operators.tracts, which stays in the
JVM; the function gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from amplitract.operators.tracts import MASKS, TRACT

COLUMNS = {"cag": T.IntegerType(), "ccg": T.IntegerType(), "cct": T.IntegerType(), "intervening": T.StringType(), "five": T.StringType(), "three": T.StringType()}
_TRACT, _RUN = re.compile(TRACT), re.compile("1+")


def _flags(triplets: list[str], mask: str) -> str:
    return "".join("1" if t == mask else "0" for t in triplets)


def _longest(found: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(n, start) of the longest run; of equal ones, that of the first mask."""
    n, _, start = max(found)
    return n, start


def structure(seq: str) -> tuple | None:
    """(cag, ccg, cct, intervening, five, three) of a read, None if it lacks a tract."""
    t = [seq[k : k + 3] for k in range(0, len(seq) - len(seq) % 3, 3)]

    def best(masks: tuple[str, ...]) -> tuple[int, int]:
        found = []
        for k, mask in enumerate(masks):
            flags = _flags(t, mask)
            m = _TRACT.search(flags)
            found.append((len(m[0]), -k, flags.find("111")) if m else (0, -k, -1))
        return _longest(found)

    (a, a_start), (c, c_start) = best(MASKS["cag"]), best(MASKS["ccg"])
    if not a or not c:
        return None
    after, found = c_start + c, []
    for k, mask in enumerate(MASKS["cct"]):
        m = _RUN.search(_flags(t[after:], mask))
        found.append((len(m[0]), -k, after + m.start()) if m else (0, -k, after - 1))
    n, start = _longest(found)
    if not n:
        return None
    return a, c, n, "".join(t[a_start + a : c_start]), "".join(t[: max(a_start - 1, 0)]), "".join(t[start + n :])


class ScanTracts:
    @staticmethod
    def analyze(seq: AnalyzeArgument, wanted: AnalyzeArgument | None = None) -> AnalyzeResult:
        if seq.isTable or not isinstance(seq.dataType, (T.StringType, T.NullType)):
            raise ValueError("scan_tracts asks for a string")
        names = list(COLUMNS) if wanted is None else [n.strip() for n in str(wanted.value).split(",")]
        if odd := [n for n in names if n not in COLUMNS]:
            raise ValueError(f"scan_tracts has no column {odd[0]}")
        return AnalyzeResult(T.StructType([T.StructField(n, COLUMNS[n]) for n in names]))

    def eval(self, seq: str | None, wanted: str | None = None) -> Iterator[tuple]:
        found = structure(seq or "")
        if found:
            names = list(COLUMNS) if wanted is None else [n.strip() for n in wanted.split(",")]
            yield tuple(dict(zip(COLUMNS, found, strict=True))[n] for n in names)


def register_scan(spark: SparkSession) -> None:
    spark.udtf.register("scan_tracts", udtf(ScanTracts, useArrow=True))

"""Run configuration: XML elements and attributes to a checked dataclass."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, fields

from amplitract.operators.rescoring import Scoring

#: Where an adapter is looked for: 3' end, 5' end, either; the first two at the very end only, if anchored.
ADAPTER_FLAGS = ("-a", "-g", "-a$", "-g^", "-b")
POSITIONS = ("5P", "3P")
#: Elements whose attributes are told apart from others of the same name by a prefix.
PREFIXES = {"demultiplexflags": "demultiplex"}


@dataclass(frozen=True)
class Config:
    demultiplex: bool = False
    quality_control: bool = True
    alignment: bool = True
    atypical_realignment: bool = True
    genotyping: bool = True
    snp_calling: bool = True
    demultiplex_forward_adapter: str = ""
    demultiplex_forward_position: str = "5P"
    demultiplex_reverse_adapter: str = ""
    demultiplex_reverse_position: str = "3P"
    demultiplex_error_rate: float = 0.0
    demultiplex_min_overlap: int = 10
    demultiplex_min_length: int = 0
    demultiplex_max_length: int = 1 << 30
    trim_type: str = "Both"
    quality_threshold: int = 5
    adapter_flag: str = "-a"
    forward_adapter: str = ""
    reverse_adapter: str = ""
    error_tolerance: float = 0.1
    #: Bins by alignment scores rather than by tract sizes.
    rescoring: bool = False
    band_width: int = 100
    seq_match_score: int = 1
    mismatch_penalty: int = 4
    indel_penalty: tuple[int, int] = (6, 6)
    gap_extend_penalty: tuple[int, int] = (4, 4)
    prime_clipping_penalty: tuple[int, int] = (5, 5)
    snp_cutoff: float = 1.0
    snp_observations: int = 2
    training_data: str = ""

    def __post_init__(self) -> None:
        wrong = []

        def check(good: bool, what: str) -> None:
            if not good:
                wrong.append(what)

        check(self.trim_type in ("Quality", "Adapter", "Both"), "trim_type must be Quality, Adapter or Both")
        check(0 <= self.quality_threshold <= 38, "quality_threshold must be 0 to 38")
        check(self.adapter_flag in ADAPTER_FLAGS, f"adapter_flag must be one of {' '.join(ADAPTER_FLAGS)}")
        check(0 <= self.error_tolerance <= 1, "error_tolerance must be 0 to 1")
        check(1 <= self.snp_observations <= 5, "snp_observations must be 1 to 5")
        check(self.snp_cutoff >= 0, "snp_cutoff may not be negative")
        for name in ("forward_adapter", "reverse_adapter", "demultiplex_forward_adapter", "demultiplex_reverse_adapter"):
            check(not re.search("[^ACGT]", getattr(self, name)), f"an adapter may hold A, C, G and T only: {getattr(self, name)}")
        for name in ("band_width", "seq_match_score", "mismatch_penalty"):
            check(getattr(self, name) >= (0 if name == "mismatch_penalty" else 1), f"{name} is too small")
        for name in ("indel_penalty", "gap_extend_penalty", "prime_clipping_penalty"):
            check(all(x >= 0 for x in getattr(self, name)), f"{name} may not be negative")
        check(not self.genotyping or self.alignment, "genotyping needs alignment")
        if self.demultiplex:
            check(bool(self.demultiplex_forward_adapter and self.demultiplex_reverse_adapter), "demultiplexing needs both adapters")
            check({self.demultiplex_forward_position, self.demultiplex_reverse_position} == set(POSITIONS), "one demultiplexing adapter must be at 5P and one at 3P")
            check(0 <= self.demultiplex_error_rate < 1, "demultiplex error_rate must be 0 to below 1")
            check(0 <= self.demultiplex_min_length <= self.demultiplex_max_length, "demultiplex min_length must be 0 to max_length")
            check(self.demultiplex_min_overlap >= 1, "demultiplex min_overlap must be 1 at least")
        if wrong:
            raise ValueError("; ".join(wrong))

    def scoring(self) -> Scoring:
        """A band is as wide to either side of the diagonal as indels that keep an alignment's score above the floor can be."""
        return Scoring(self.seq_match_score, self.mismatch_penalty, self.indel_penalty, self.gap_extend_penalty, self.prime_clipping_penalty, min(self.band_width, 60))

    def ends(self) -> tuple[str, str]:
        """The demultiplexing adapters at the 5' and at the 3' end."""
        both = (self.demultiplex_forward_adapter, self.demultiplex_reverse_adapter)
        return both if self.demultiplex_forward_position == "5P" else both[::-1]


def read_config(xml: str) -> Config:
    """Attributes and element texts whose names, without regard to case and marks, are those of fields; empty ones and others are ignored."""
    plain = lambda s: re.sub("[^a-z]", "", s.lower())
    known = {plain(f.name): f for f in fields(Config)}
    found: dict = {}
    for element in ET.fromstring(xml).iter():
        prefix = PREFIXES.get(plain(element.tag), "")
        for name, value in [*element.attrib.items(), (element.tag, element.text or "")]:
            f = known.get(plain(prefix + name)) if prefix else known.get(plain(name))
            if f and value.strip():
                found[f.name] = _typed(f.type, value.strip(), f.name)
    return Config(**found)


def _typed(kind: str, value: str, name: str) -> object:
    try:
        if kind == "bool":
            return {"true": True, "false": False}[value.lower()]
        if kind.startswith("tuple"):
            first, *second = (int(x) for x in value.split(","))
            return (first, second[0] if second else first)
        return {"int": int, "float": float, "str": str}[kind](value)
    except (KeyError, ValueError):
        raise ValueError(f"{name} can't be {value}") from None

"""Fixed code values of the data model, and the scalar expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Copy-number state -> SV type, and state -> genotype.
STATE_TYPE = {0: "UNKNOWN", 1: "DEL", 2: "DEL", 3: "NEUTRAL", 4: "LOH", 5: "DUP", 6: "DUP"}
STATE_GENOTYPE = {0: "./.", 1: "1/1", 2: "0/1", 3: "0/0", 4: "1/1", 5: "0/1", 6: "1/1"}
# Evidence names in bit order.
EVIDENCE = ("CIGARINS", "CIGARDEL", "CIGARCLIP", "SPLIT", "SPLITDIST1", "SPLITDIST2", "SPLITINV", "SUPPINV", "HMM", "UNKNOWN")
# Ambiguous nucleotide codes, both cases.
AMBIGUOUS = "RYKMSWBDHVrykmswbdhv"
# SAM flag bits.
UNMAPPED, REVERSE, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x200, 0x400, 0x800


def lookup(col: str, table: dict) -> Column:
    """Value of a small literal table; an unknown key gives null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(col))


def evidence_names(mask: str) -> Column:
    """Names of the set bits, in bit order, comma-joined."""
    return F.concat_ws(",", *(F.when(F.col(mask).bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(EVIDENCE)))


def plain_bases(col: str) -> Column:
    """Ambiguous codes as N."""
    return F.translate(F.col(col), AMBIGUOUS, "N" * len(AMBIGUOUS))


def valid_update(old: Column, new: Column) -> Column:
    """Whether a predicted type may replace a CIGAR type: DEL stays DEL, INS becomes DUP."""
    return (new != "UNKNOWN") & (((old == "DEL") & (new == "DEL")) | ((old == "INS") & (new == "DUP")))

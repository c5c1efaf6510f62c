"""Column-name handling: quoting, families, suffixes, feature classes.

Feature names carry ``%`` and ``-``, and the role of a column follows from the
shape of its name.  Everything here touches schema metadata or builds Column
expressions; no data moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One name pattern per feature family.
FAMILY_PATTERNS = {
    "nucleotide_content": r"^(GC|AT)cont$",
    "dinucleotide_bias": r"^[ATGCU]p[ATGCU]$",
    "dinucleotide_percent": r"^[ATGCU]{2}%$",
    "bridge_dinucleotide": r"^br[ATGCU]p[ATGCU]$",
    "non_bridge_dinucleotide": r"^NonBr[ATGCU]p[ATGCU]$",
    "amino_acid_bias": r"^[A-Za-z]-Bias$",
    "codon_bias": r"^[ATGCU]{3}-Bias$",
}

# Which families each kind of input file contributes.
PART_ONE_FAMILIES = ("nucleotide_content", "dinucleotide_bias", "dinucleotide_percent")
PART_TWO_FAMILIES = (
    "bridge_dinucleotide",
    "non_bridge_dinucleotide",
    "amino_acid_bias",
    "codon_bias",
)

# The four spellings that differ between the two naming schemes.
URACIL_ALIASES = {"ApU": "ApT", "CpU": "CpT", "GpU": "GpT", "UpU": "UpT"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col(quoted(name))


def sanitised(df: DataFrame) -> DataFrame:
    """Replace every character that is not a letter, digit or underscore."""
    return df.toDF(*[re.sub(r"[^A-Za-z0-9_]", "_", c) for c in df.columns])


def check_case_collisions(columns: Sequence[str]) -> None:
    """Spark resolves names without case; refuse names that differ only by it."""
    seen: dict[str, str] = {}
    for name in columns:
        other = seen.setdefault(name.lower(), name)
        if other != name:
            raise ValueError(f"columns {other!r} and {name!r} differ only by case")


def family_columns(columns: Iterable[str], families: Iterable[str]) -> list[str]:
    patterns = [re.compile(FAMILY_PATTERNS[f]) for f in families]
    return [c for c in columns if any(p.search(c) for p in patterns)]


def select_families(df: DataFrame, keys: Sequence[str], families: Iterable[str]) -> DataFrame:
    """Keep the key columns and the columns of the named families, in source order."""
    wanted = set(keys) | set(family_columns(df.columns, families))
    return df.select(*[col(c) for c in df.columns if c in wanted])


def add_suffix(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Suffix every non-key column in one projection."""
    return df.select(*[col(c) if c in keys else col(c).alias(c + suffix) for c in df.columns])


def harmonise(df: DataFrame, aliases: dict[str, str] = URACIL_ALIASES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})


def drop_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if not c.startswith(prefixes)])


def containing(columns: Iterable[str], *parts: str) -> list[str]:
    """Columns whose name contains any of the parts, without regard to case."""
    low = [p.lower() for p in parts]
    return [c for c in columns if any(p in c.lower() for p in low)]


def feature_class(feature: Column, u_to_t: bool = False) -> Column:
    """The class a feature belongs to: source suffix and bridge prefix removed,
    ``XY%`` spelled ``XpY``.  Applying it twice changes nothing."""
    out = F.regexp_replace(feature, "_[A-Za-z0-9]+$", "")
    out = F.regexp_replace(out, "^(br|NonBr)", "")
    out = F.regexp_replace(out, "^([A-Z])([A-Z])%$", "$1p$2")
    if u_to_t:
        dinucleotide = out.rlike("^[ATGCU]p[ATGCU]$")
        out = F.when(dinucleotide, F.translate(out, "U", "T")).otherwise(out)
    return out

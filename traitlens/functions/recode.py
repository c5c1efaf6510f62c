"""Closed vocabularies, ordered categories, labels and null handling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin species names and the host names used for them.
SPECIES_TO_HOST = {
    "Bos taurus": "cow",
    "Canis familiaris": "dog",
    "Equus caballus": "horse",
    "Gallus gallus": "chicken",
    "Homo sapiens": "human",
    "Myotis lucifugus": "microbat",
    "Ovis aries": "sheep",
    "Pteropus vampyrus": "megabat",
    "Rattus norvegicus": "rat",
    "Sus scrofa": "pig",
}

# Expression terms and the classes used for them.
EXPRESSION_TO_CLASS = {
    "up_regulated": "Stimulated",
    "down_regulated": "Repressed",
    "not_differentially_expressed": "NonDE",
}


class UnmappedValues(ValueError):
    """A closed vocabulary met a value outside it."""


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    """Value through a literal map; NULL when absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, value)


def recode(df: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Map each named column through its vocabulary in one projection."""
    return df.withColumns({c: lookup(F.col(c), m) for c, m in mappings.items()})


def unmapped(df: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Values outside their vocabulary, with counts; one pass over the data."""
    bad = [
        F.when(lookup(F.col(c), m).isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("value")))
        for c, m in mappings.items()
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*bad))).alias("bad"))
        .groupBy("bad.field", "bad.value")
        .agg(F.count("*").alias("n"))
    )


def recode_strict(df: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Recode, and fail while the job runs if a value is outside its vocabulary.

    The check is a filter on the rows, so it runs whichever columns are read
    later, in the same pass; use :func:`unmapped` for a report instead of a
    failure.
    """
    checked, mapped = {}, F.lit(True)
    for name, mapping in mappings.items():
        value = lookup(F.col(name), mapping)
        message = F.concat(F.lit(f"{name} has no mapping for "), F.coalesce(F.col(name), F.lit("NULL")))
        mapped = mapped & F.when(value.isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        checked[name] = value
    return df.where(mapped).withColumns(checked)


def ordinal(value: Column, levels: Sequence[str]) -> Column:
    """Position of the value in an explicit level order, from 1; NULL outside it."""
    out = F.lit(None).cast("long")
    for position, level in reversed(list(enumerate(levels, start=1))):
        out = F.when(value == level, F.lit(position).cast("long")).otherwise(out)
    return out


def restricted(value: Column, levels: Sequence[str]) -> Column:
    """The value where it is one of the levels, else NULL."""
    return F.when(value.isin(list(levels)), value)


def null_tokens(value: Column, tokens: Sequence[str] = ("NA", "-", "")) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def numeric_or_null(value: Column, tokens: Sequence[str] = ("NA", "-", "")) -> Column:
    return null_tokens(value, tokens).try_cast("double")


def selected_class(label: Column, strict: bool = False) -> Column:
    """Class of a selected-list label: Random, ISG, and anything else.

    With ``strict`` an unknown label stops the job instead of becoming Repressed.
    """
    other = F.lit("Repressed")
    if strict:
        unknown = F.concat(F.lit("unknown class label "), F.coalesce(label, F.lit("NULL")))
        other = F.when(label == "IRG", "Repressed").otherwise(F.raise_error(unknown).cast("string"))
    return F.when(label.isNull(), F.lit(None)).when(label == "Random", "NonDE").when(label == "ISG", "Stimulated").otherwise(other)


def labelled_treatment(category: Column, treatment: Column) -> Column:
    """``category (treatment)``; a missing category prints as NA."""
    return F.format_string("%s (%s)", F.coalesce(category, F.lit("NA")), F.coalesce(treatment, F.lit("NA")))


def hash_order(*parts: Column | str, seed: int | str) -> Column:
    """A reproducible pseudo-random order: md5 over the parts and a seed."""
    return F.md5(F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed))))

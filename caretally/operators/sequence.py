"""Order of a patient's visits and where the conversions fall in it.

A conversion is a visit that was checked out. Its ordinal is its place among all
the patient's visits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretally.operators.aggs import count_if
from caretally.operators.dedup import keep_values_on_edges
from caretally.operators.skew import number_rows


def visit_sequence(
    visits: DataFrame, keys: Sequence[str], order_by: Sequence[str], converted: Column, **size
) -> DataFrame:
    """Adds ``rn``, ``is_converted``, ``converted_rn`` (rn on conversions, else
    null) and ``conversions_so_far``."""
    hit = F.when(converted, 1).otherwise(0)
    numbered = number_rows(
        visits, keys, order_by, name="rn", running={"conversions_so_far": hit.cast("long")}, **size
    )
    return numbered.withColumns({"is_converted": hit, "converted_rn": F.when(converted, F.col("rn"))})


def masked_conversions(
    sequence: DataFrame, keys: Sequence[str], order_by: Sequence[str], **size
) -> DataFrame:
    """The conversions; the ordinal only on a key's first one and the count so
    far only on its last one. The keys may be coarser than the sequence's."""
    rows = sequence.where(F.col("is_converted") == 1).drop("is_converted")
    return keep_values_on_edges(
        rows, keys, order_by, on_first=["converted_rn"], on_last=["conversions_so_far"], **size
    )


def ordinal_mix(masked: DataFrame) -> DataFrame:
    """How many first conversions were the 1st, 2nd, 3rd, 4th visit. ``later`` is
    the sum of 2 to 4; ``ord_5_plus`` tells what that sum leaves out."""
    ordinal = F.col("converted_rn")
    counts = {f"ord_{k}": count_if(ordinal == k) for k in (1, 2, 3, 4)}
    return masked.agg(
        *[c.alias(n) for n, c in counts.items()],
        count_if(ordinal.between(2, 4)).alias("later"),
        count_if(ordinal >= 5).alias("ord_5_plus"),
        F.countDistinct(F.when(ordinal == 1, F.col("patient_id"))).alias("first_visit_users"),
        F.avg(ordinal).alias("mean_ordinal"),
    )

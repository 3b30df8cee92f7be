"""Lists per key.

The entries of a list are a table of their own: key, position and value, one row per
entry, whatever the size of the key. Beside it stands a summary with one row per key:
the number of entries, columns of the first one, and the list as text: whole
(``whole_summary``), or, of lists with at most ``page_rows`` entries only
(``list_summary``), longer ones being null there and whole in the entries. A text that no
cell can hold (2 GB) fails the former; ``list_pages`` prints lists of any size in pages.

Sets of distinct values (``set_summary``) follow the same rule with ``SET_VALUES``. Values
are made distinct by key and value before any key is gathered, and of a key no more than
one beyond the limit leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caretally.operators.skew import OrderBy, number_rows

PAGE_ROWS = 10_000
# With one more Spark still limits the rows of a window before it shuffles them
# (spark.sql.optimizer.windowGroupLimitThreshold).
SET_VALUES = 999


def list_entries(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], order_by: OrderBy, *, first: Sequence[str] = (), **size
) -> DataFrame:
    """key, position (from 1), the columns of ``first`` and the values, as text, of
    every row. Nulls keep their position."""
    entries = df.withColumns({f"_v_{k}": v.cast("string") for k, v in values.items()})
    numbered = number_rows(entries, list(keys), order_by, name="position", **size)
    return numbered.select(*keys, "position", *first, *[F.col(f"_v_{k}").alias(k) for k in values])


def distinct_entries(df: DataFrame, keys: Sequence[str], value: Column, name: str, **size) -> DataFrame:
    """key, position and each distinct known value once, in the order of their text."""
    values = df.select(*keys, value.cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
    return list_entries(values, keys, {name: F.col(name)}, [name], **size)


def list_summary(
    entries: DataFrame,
    keys: Sequence[str],
    lists: Sequence[str],
    *,
    first: Sequence[str] = (),
    count: str = "n",
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """One row per key of the entries: the columns of ``first`` from position 1, the
    number of entries, and each list as text if it has at most ``page_rows`` entries."""
    page_rows = int(page_rows)
    known = {k: F.expr(f"listagg(CASE WHEN position <= {page_rows} THEN `{k}` END, ',') WITHIN GROUP (ORDER BY position)") for k in lists}
    shown = F.any_value(F.when(F.col("position") == 1, F.struct(*first)), True).alias("_first")
    whole = entries.groupBy(*keys).agg(F.max("position").alias(count), *([shown] if first else []), *[c.alias(k) for k, c in known.items()])
    texts = [F.when(F.col(count) <= page_rows, F.col(k)).alias(k) for k in lists]
    return whole.select(*keys, *[F.col("_first")[c].alias(c) for c in first], count, *texts)


def whole_summary(
    entries: DataFrame,
    keys: Sequence[str],
    lists: Sequence[str],
    *,
    first: Sequence[str] = (),
    count: str = "n",
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Like ``list_summary``, with the whole list as text whatever its length. A key's
    entries are put in order and joined a page at a time, by as many tasks as there are
    pages, and only the texts of its pages meet; ``page_rows`` is no limit."""
    page = F.expr(f"(position - 1) div {int(page_rows)}").alias("_page")
    shown = F.any_value(F.when(F.col("position") == 1, F.struct(*first)), True).alias("_first")
    texts = [F.expr(f"listagg(`{k}`, ',') WITHIN GROUP (ORDER BY position)").alias(k) for k in lists]
    pages = entries.groupBy(*keys, page).agg(F.max("position").alias(count), *([shown] if first else []), *texts)
    merged = [F.any_value("_first", True).alias("_first")] if first else []
    joined = [F.expr(f"listagg(`{k}`, ',') WITHIN GROUP (ORDER BY _page)").alias(k) for k in lists]
    whole = pages.groupBy(*keys).agg(F.max(count).alias(count), *merged, *joined)
    return whole.select(*keys, *[F.col("_first")[c].alias(c) for c in first], count, *lists)


def list_pages(entries: DataFrame, keys: Sequence[str], lists: Sequence[str], *, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The lists as text, for reports: key, page (from 0) and ``page_rows`` entries a page."""
    paged = entries.withColumn("page", F.expr(f"(position - 1) div {int(page_rows)}"))
    texts = [F.expr(f"listagg(`{k}`, ',') WITHIN GROUP (ORDER BY position)").alias(k) for k in lists]
    return paged.groupBy(*keys, "page").agg(*texts)


def ordered_list(
    df: DataFrame,
    keys: Sequence[str],
    lists: dict[str, Column],
    order_by: OrderBy,
    *,
    first: Sequence[str] = (),
    count: str = "n",
    page_rows: int = PAGE_ROWS,
    **size,
) -> DataFrame:
    """One comma list per entry of ``lists``, in the given order, in pages, and the
    number of the key's rows. Null entries are skipped; a list of nulls is null.

    ``first`` names columns to show from the key's first row.
    """
    keys = list(keys)
    entries = df.withColumns({f"_v_{k}": v.cast("string") for k, v in lists.items()})
    numbered = number_rows(entries, keys, order_by, name="_rn", **size)
    shown = {"_first": F.any_value(F.when(F.col("_rn") == 1, F.struct(*first)), True)} if first else {}
    pages = W.partitionBy(*keys)
    paged = (
        numbered.withColumn("page", F.expr(f"(_rn - 1) div {int(page_rows)}"))
        .groupBy(*keys, "page")
        .agg(
            F.count("*").alias("_rows"),
            *[F.expr(f"listagg(`_v_{k}`, ',') WITHIN GROUP (ORDER BY _rn)").alias(k) for k in lists],
            *[c.alias(n) for n, c in shown.items()],
        )
        .withColumns({count: F.sum("_rows").over(pages)} | {n: F.any_value(n, True).over(pages) for n in shown})
    )
    return paged.select(*keys, "page", *[F.col("_first")[c].alias(c) for c in first], count, *lists)


def distinct_list(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, *, page_rows: int = PAGE_ROWS, **size
) -> DataFrame:
    """The distinct values per key as a sorted comma list, paged likewise. The
    values are made distinct before any key is gathered."""
    keys = list(keys)
    values = df.select(*keys, value.cast("string").alias("_value")).distinct()
    return ordered_list(values, keys, {name: F.col("_value")}, ["_value"], page_rows=page_rows, **size).drop("n")


def distinct_values(df: DataFrame, keys: Sequence[str], lists: dict[str, Column]) -> DataFrame:
    """key, list and value: every distinct known value of each list, whole at any size."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), c.cast("string").alias("value")) for n, c in lists.items()]))
    named = df.select(*keys, pairs.alias("_pair")).select(*keys, "_pair.list", "_pair.value")
    return named.where(F.col("value").isNotNull()).distinct()


def set_summary(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, tuple[Column, Callable[[Column], Column]]],
    lists: dict[str, Column],
    *,
    by: Column | None = None,
    parts: dict[str, Column] | None = None,
    set_values: int = SET_VALUES,
) -> DataFrame:
    """One row per key (null is a key too): the measures, and the distinct known values
    of each list as sorted text if there are at most ``set_values``, else null.

    ``measures``: name -> (value of a row, ``F.sum``, ``F.min`` or ``F.max``). With ``by``
    the rows are also told apart by its value, and ``parts`` are further aggregates, over
    the columns ``_by`` (null on rows of lists) and the measures.
    """
    keys = list(keys)
    by = F.lit(None).cast("string") if by is None else by.cast("string")
    numbers = [c.alias(n) for n, (c, _) in measures.items()]
    nothing = [F.when(F.lit(False), c).alias(n) for n, (c, _) in measures.items()]
    rows = [F.struct(F.lit("").alias("_list"), by.alias("_value"), *numbers)]
    rows += [F.struct(F.lit(n).alias("_list"), c.cast("string").alias("_value"), *nothing) for n, c in lists.items()]
    merged = [merge(F.col(n)).alias(n) for n, (_, merge) in measures.items()]
    each = df.select(*keys, F.explode(F.array(*rows)).alias("_row")).select(*keys, "_row.*")
    distinct = each.where((F.col("_list") == "") | F.col("_value").isNotNull()).groupBy(*keys, "_list", "_value").agg(*merged)
    # Spark drops what lies beyond the limit before the shuffle, too.
    place = F.row_number().over(W.partitionBy(*keys, "_list").orderBy("_value"))
    few = distinct.withColumn("_place", place).where(F.col("_place") <= int(set_values) + 1)
    few = few.withColumn("_by", F.when(F.col("_list") == "", F.col("_value")))
    texts, sizes = [], []
    for n in lists:
        own = f"CASE WHEN _list = '{n}' THEN _value END"
        texts.append(F.expr(f"listagg({own}, ',') WITHIN GROUP (ORDER BY _place)").alias(n))
        sizes.append(F.expr(f"count({own})").alias(f"_n_{n}"))
    found = few.groupBy(*keys).agg(*merged, *[c.alias(n) for n, c in (parts or {}).items()], *texts, *sizes)
    shown = [F.when(F.col(f"_n_{n}") <= int(set_values), F.col(n)).alias(n) for n in lists]
    return found.select(*keys, *measures, *(parts or {}), *shown)

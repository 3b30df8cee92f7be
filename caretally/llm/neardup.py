"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles (A-Z folded; with fewer words the whole sequence is the one shingle), as
64-bit hashes. Two documents are linked if 100 * intersection >= 75 * union; components are what links reach.

1. Documents with equal sets form a class, represented by its smallest doc_id; only representatives go on.
2. A sketch is the `K` smallest hashes of a set. Two sets with the needed similarity share `REQUIRED` percent of their sketch values
   (but for odds of about one in a million at the very threshold; sketches of sets up to `K` are exact). So of each sketch only the
   rarest values are posted in the inverted lists, as many as leave fewer than the required number behind. A document most of whose
   values nobody shares needs no posting at all, and values of common passages come last.
3. Star rounds: each list proposes its hub (a least member) with every other member, which is linear in the list. Pairs pass a size
   filter, then the similarity estimated from the sketch of the union, then the exact similarity of the full sets. Linked
   documents are merged into components.
4. The rest: members of lists that hold more than one component meet by their whole sets, rarest values first, as far as the
   similarity allows (`remaining`); only pairs of different components are verified. Lists within one component are left
   out, as they can add nothing. Documents meet only those whose sizes the values left to both still allow, so that pages of one
   template that are less similar than that do not meet at all. So no link that would join two components is missed, and a group of
   copies never expands into all its pairs.

Rows: null, empty and blank texts have n_shingles 0 and are linked with nothing. Rows with equal doc_id and set are one member; a null
doc_id follows its class, and with no other member its component is null and it is kept. Only doc_id and text are read.
`deduplicated` keeps one row of each kept member (any one of rows that are equal in doc_id and set), other texts under its doc_id, one row
of a set that only rows without doc_id have, and every row without words. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretally.llm.blocks import distinct_by_row, list_array, mix, shingle_hashes, text_blocks, word_hashes
from caretally.llm.store import table

THRESHOLD = 75
#: Values in a sketch.
K = 40
#: Percent of a sketch's values that similar documents share; also the least estimate, in percent, that is verified exactly.
REQUIRED = 40
STAR_ROUNDS = 2
#: Neighbouring size classes differ by this factor.
SIZE_STEP = 1.04


DIGEST = ["n_shingles", "d1", "d2"]


def digests(values: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """DIGEST of each set: its size, and 128 bits of its values."""
    totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.view(np.uint64) ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x51ED270B, 0xA24BAED4)]
    return [pa.array(np.diff(cuts)), *(pa.array(np.diff(total[cuts].view(np.int64))) for total in totals)]


def measured(documents: DataFrame, whole: bool) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its smallest values (all of them if `whole`), ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, "text"):
                words, rows, _, _ = word_hashes(data, offsets)
                values, cuts = distinct_by_row(*shingle_hashes(words, rows), j - i)
                found = digests(values, cuts)
                if not whole:
                    kept = np.minimum(np.diff(cuts), K)
                    cuts_kept = np.concatenate([[0], np.cumsum(kept)])
                    values = values[np.repeat(cuts[:-1] - cuts_kept[:-1], kept) + np.arange(cuts_kept[-1])]
                    cuts = cuts_kept
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *found, list_array(values, cuts)], ["doc_id", *DIGEST, "hashes"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, d1 long, d2 long, hashes array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """(value, doc_id, n_shingles): the inverted lists of the rarest sketch values that more than one class has."""
    each = classes.select("doc_id", "n_shingles", F.explode("hashes").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    size = F.least(F.col("n_shingles"), F.lit(K))
    needed = F.floor((size * REQUIRED + 99) / 100)
    alone = size - F.size("values")
    take = F.greatest(F.lit(0), size - needed + 1 - alone).cast("int")
    ranked = each.join(shared, "value").groupBy("doc_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("lists", "value"))).alias("values"))  # at most K each
    return ranked.where(take > 0).select("doc_id", "n_shingles", F.explode(F.slice("values", F.lit(1), take)).alias("v")).select("v.value", "doc_id", "n_shingles")


def similar_sizes(a, b):
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough: first estimated by the union's sketch, then exactly."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a"))
    union = F.slice(F.array_sort(F.array_union(F.slice("ha", 1, K), F.slice("hb", 1, K))), 1, K)
    estimated = both.withColumn("u", union).where(100 * F.size(F.array_intersect(F.array_intersect("u", "ha"), "hb")) >= REQUIRED * F.size("u"))
    common = F.size(F.array_intersect("ha", "hb"))
    return estimated.withColumn("common", common).where(100 * F.col("common") >= THRESHOLD * (F.size("ha") + F.size("hb") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest doc_id that links reach, for each linked document. Least labels spread over the
    links and jump along themselves until nothing changes."""
    edges = table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = table(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        spread = labels.join(near, "u", "left").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = table(spread.join(labels.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c", "left").select("u", "old", F.least("c", "cc").alias("c")))
        labels = jumped.select("u", "c")
        if not jumped.where("old != c").limit(1).count():
            return labels.select(F.col("u").alias("doc_id"), F.col("c").alias("component"))


def remaining(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that may be similar, by their whole sets, without loss.

    Values are ranked per document from the rarest to the most frequent. Similar sets meet in the first quarter of their
    ranks, and where they first meet, enough values have to be left in both for the overlap that the similarity needs."""
    each = rest.join(sets, "doc_id").select("doc_id", "n_shingles", "component", F.explode("hashes").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1")
    ranked = each.join(shared, "value").groupBy("doc_id", "n_shingles", "component").agg(F.sort_array(F.collect_list(F.struct("lists", "value"))).alias("values"))  # at most one set each
    alone = F.col("n_shingles") - F.size("values")
    first = F.greatest(F.lit(0), F.floor(F.col("n_shingles") * (100 - THRESHOLD) / 100) + 1 - alone).cast("int")
    listed = table(ranked.withColumn("alone", alone).where(first > 0).select("doc_id", "n_shingles", "component", "alone", F.posexplode(F.slice("values", F.lit(1), first)).alias("at", "v"))
                   .select(F.col("v.value").alias("value"), "doc_id", "n_shingles", "component", (F.col("n_shingles") - F.col("alone") - F.col("at")).alias("left")))
    # Sizes that a partner can have: similar enough, and so small that the values left here are overlap enough.
    n, left = F.col("n_shingles"), F.col("left")
    least = F.ceil(n * THRESHOLD / 100)
    most = F.least(F.floor(n * 100 / THRESHOLD), F.floor(left * (100 + THRESHOLD) / THRESHOLD) - n)
    sized = listed.withColumns({"least": least, "most": most}).where("least <= most").withColumns({"own": size_class(n), "other": F.explode(F.sequence(size_class("least"), size_class("most")))})
    meets = (f"x.value = y.value AND x.own = y.other AND x.other = y.own AND x.component < y.component "
             f"AND 100 * least(x.n_shingles, y.n_shingles) >= {THRESHOLD} * greatest(x.n_shingles, y.n_shingles) "
             f"AND {100 + THRESHOLD} * least(x.left, y.left) >= {THRESHOLD} * (x.n_shingles + y.n_shingles)")
    return sized.alias("x").join(sized.alias("y"), F.expr(meets)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def size_class(n):
    return F.floor(F.log(n) / math.log(SIZE_STEP))


def all_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, component) of every document with a link."""
    links, now = None, lists.withColumn("component", F.col("doc_id"))
    for r in range(STAR_ROUNDS + 1):
        order = (F.col("doc_id") if r == 0 else F.xxhash64("doc_id", F.lit(r))).alias("order")
        hub = F.min(F.struct(order, "doc_id", "n_shingles", "component")).alias("hub")
        spread = now.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most"), hub).where("least < most")
        if r < STAR_ROUNDS:
            pairs = (now.join(spread, "value").where((F.col("component") != F.col("hub.component")) & similar_sizes(F.col("n_shingles"), F.col("hub.n_shingles")))
                     .select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")))
        else:
            rest = table(now.join(spread.select("value"), "value").select("doc_id", "n_shingles", "component").distinct())
            pairs = remaining(rest, sets)
        found = table(linked(pairs.distinct(), sets))
        links = found if links is None else links.unionByName(found)
        grouped = components(links)
        now = table(lists.join(grouped, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    return grouped


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return grouped_rows(documents).select("doc_id", "n_shingles", "component_id", "kept")


def grouped_rows(documents: DataFrame) -> DataFrame:
    """doc_id, DIGEST, component_id and kept of every row."""
    texts = documents.select("doc_id", "text")
    rows = table(measured(texts, whole=False))
    key = DIGEST
    classes = table(rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("first"), F.first("hashes").alias("hashes")))
    lists = table(postings(classes.where("first IS NOT NULL").withColumnRenamed("first", "doc_id")))
    posted = lists.select("doc_id").distinct()
    sets = table(measured(texts.join(posted, "doc_id", "left_semi"), whole=True).select("doc_id", "hashes"))
    # A doc_id may stand on rows with other texts; the set of the class is the one that counts.
    grouped = all_links(lists, sets)
    found = classes.join(grouped.withColumnRenamed("doc_id", "first"), "first", "left").select(*key, F.coalesce("component", "first").alias("component_id"))
    out = rows.join(found, key, "left").select("doc_id", *DIGEST, F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def with_digests(documents: DataFrame, names: list[str]) -> DataFrame:
    """The documents with DIGEST, and a number that is new for each row without doc_id and words and 0 for the others, by these names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() << 33) + 1
        for batch in batches:
            missing = batch.column(batch.schema.get_field_index("doc_id")).is_null().to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_blocks(batch, "text"):
                words, rows, _, _ = word_hashes(data, offsets)
                values, cuts = distinct_by_row(*shingle_hashes(words, rows), j - i)
                alone = np.where(missing[i:j] & (np.diff(cuts) == 0), at + np.arange(j - i), 0)
                at += j - i
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *digests(values, cuts), pa.array(alone)], [*batch.schema.names, *names])

    return documents.mapInArrow(work, T.StructType([*documents.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents without near copies, with their columns: of each component the member whose doc_id names it."""
    mark = uuid.uuid4().hex[:8]
    digest, alone, key, none = [f"_{mark}_{c}" for c in DIGEST], f"_{mark}_alone", f"_{mark}_key", f"_{mark}_none"
    known = {key: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull()}
    rows = with_digests(documents, [*digest, alone]).withColumns(known)
    kept = grouped_rows(documents).where("kept").withColumns(known)
    kept = kept.select(key, none, *[F.col(c).alias(name) for c, name in zip(DIGEST, digest, strict=True)]).distinct()
    # The join deals rows by the same keys as the last step, so that texts are shuffled once.
    found = rows.join(kept, [key, none, *digest], "left_semi")
    return found.dropDuplicates([key, none, *digest, alone]).select(*documents.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
g AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d JOIN g ON d.doc_id = g.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

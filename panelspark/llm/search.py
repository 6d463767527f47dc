"""Ranked lexical search of a set of items over all documents, with bag deduplication.

Every document is restricted to the items' vocabulary and becomes a vector of term
frequencies and a length figure m. Documents with the same vector and m score alike for
every item, so they are one class: classes are keyed by a hash and verified by the vector
itself, each class is scored once, and its members are listed by ascending doc_id.
Items are dealt into blocks of bounded size that meet all classes; a task returns the best
classes of what it has read, never the scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import checkpoint, shared_folder, slices, texts_of

#: ASCII digits and letters (lower-cased) and all bytes of other characters make terms; the rest is space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bits of the vocabulary filter: 1 MB whatever the vocabulary. Terms that pass by chance split classes but score nothing.
FILTER_BITS = 1 << 23
#: A block of items has about this many (item, term) pairs and items; more items take more blocks, one after another.
BLOCK_PAIRS, BLOCK_ITEMS = 1 << 18, 1 << 12
#: Cells of the table of scores (documents of a batch x items of a block) that a task holds.
CELLS = 1 << 22
NO_ID = (1 << 63) - 1


def bag(text: bytes) -> Counter[bytes]:
    """Term frequencies of a UTF-8 text."""
    return Counter(text.translate(_TERM_BYTES).split())


def place(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) % FILTER_BITS


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, place) once per item row and distinct term; `item` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [sorted(bag(t)) for t in texts_of(batch)]
            rows = np.repeat(np.arange(batch.num_rows), [len(b) for b in bags])
            terms = [t for b in bags for t in b]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(rows), batch.column("item_id").take(rows), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([place(t) for t in terms], pa.int64())],
                ["item", "item_id", "term", "place"],
            )

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    return checkpoint(rows.mapInArrow(run, rows.select("item", "item_id").schema.add("term", "string").add("place", "long")))


def vocabulary_filter(terms: DataFrame) -> np.ndarray:
    """The places of all terms as a bit map of FILTER_BITS bits."""
    at = F.col("place") + 1
    found = terms.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    marks = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for row in found.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
        marks[(row.bucket - 1) << 12 : row.bucket << 12] = np.frombuffer(row.bits, dtype=np.uint8)
    return marks


def vectors(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) per document: its number of terms, and those of the vocabulary with their frequencies, by term."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value, {}

        def wanted(term: bytes) -> bool:
            found = known.get(term)
            if found is None:
                at = place(term)
                found = bool(bits[at >> 3] >> (at & 7) & 1)
                if len(known) < 1 << 20:
                    known[term] = found
            return found

        for batch in slices(batches):
            n, terms, tfs, ends = [], [], [], [0]
            for text in texts_of(batch):
                counts = bag(text)
                n.append(counts.total())
                own = sorted(filter(wanted, counts))
                terms += own
                tfs += [counts[t] for t in own]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<long>")


def classes(bags: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """(m, terms, tfs, members) per class of documents with equal vectors and m; members are its k smallest doc_ids, null last.

    No item's best k hold more than the first k of a class, so the others need no place. Spark keeps k rows a
    class before it shuffles, so a class with a third of all rows is no hot key.
    """
    scored = bags.where(F.size("terms") > 0)
    m = F.expr(f"10 + cast((90 * n * {documents}) div {max(length, 1)} as bigint)")
    keyed = scored.select(m.alias("m"), "terms", "tfs", F.struct("doc_id").alias("member")).withColumn("key", F.xxhash64("m", "terms", "tfs"))
    same = ["key", "m", "terms", "tfs"]  # the hash leads, the vector verifies
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("member.doc_id").asc_nulls_last()))
    first = keyed.withColumn("rank", rank).where(F.col("rank") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("rank", "member"))), lambda x: x["member"])
    return first.groupBy(*same).agg(members.alias("members")).drop("key")


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best of each item: highest score, then smallest first member."""
    order = np.lexsort((first, -score, item))
    item = item[order]
    start = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
    return order[rank < k]


def best_classes(found: DataFrame, pairs: list, k: int) -> DataFrame:
    """(item, score, members) of each task's k best classes per item of a block; `pairs` has (item, term, weight) of the block."""
    items = np.array(sorted({p.item for p in pairs}), dtype=np.int64)
    terms = sorted({p.term for p in pairs})
    at = {t: i for i, t in enumerate(terms)}
    pairs = sorted((at[p.term], int(np.searchsorted(items, p.item)), p.weight) for p in pairs)
    of, col, weight = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    cells = CELLS
    held = found.sparkSession.sparkContext.broadcast((items, pa.array(terms, pa.string()), np.searchsorted(of, np.arange(len(terms) + 1)), col, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, edge, col, weight = held.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64())]))
        kept = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "members": pa.array([], kind)})
        least = np.ones(len(items), dtype=np.int64)  # a class below it is not among the best k of the item
        for batch in slices(batches, max(1, min(4096, cells // len(items)))):
            held_terms = batch.column("terms")
            sizes = held_terms.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            words = held_terms.flatten().dictionary_encode()
            term = pa.compute.index_in(words.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
            tf, m = batch.column("tfs").flatten().to_numpy(), batch.column("m").to_numpy()
            gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            order = np.argsort(term, kind="stable")
            order = order[np.searchsorted(term[order], 0) :]
            term, row, gain = term[order], row[order], gain[order]
            cut = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
            score = np.zeros((batch.num_rows, len(items)), dtype=np.int64)
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(term)).tolist()):
                own = slice(edge[term[a]], edge[term[a] + 1])
                score[row[a:b, None], col[own]] += gain[a:b, None] * weight[own]
            if batch.num_rows > k:
                least = np.maximum(least, np.partition(score, -k, axis=0)[-k])
            hit, which = np.nonzero(score >= least)
            members = batch.column("members")
            first = pa.compute.struct_field(pa.compute.list_element(members, 0), "doc_id").fill_null(NO_ID).to_numpy()
            new = pa.table({"item": items[which], "score": score[hit, which], "first": first[hit], "members": members.take(pa.array(hit)).cast(kind)})
            kept = pa.concat_tables([kept, new])
            kept = kept.take(_best(*(kept.column(c).to_numpy() for c in ("item", "score", "first")), k)).combine_chunks()
            count = np.bincount(np.searchsorted(items, kept.column("item").to_numpy()), minlength=len(items))
            lowest = np.full(len(items), NO_ID)
            np.minimum.at(lowest, np.searchsorted(items, kept.column("item").to_numpy()), kept.column("score").to_numpy())
            least = np.where(count >= k, np.maximum(least, lowest), least)
        yield from kept.select(["item", "score", "members"]).to_batches()

    return found.mapInArrow(run, "item long, score long, members array<struct<doc_id: long>>")


def weighted(terms: DataFrame, bags: DataFrame, documents: int) -> DataFrame:
    """(item, term, weight, block) per item and term that any document holds, dealt into blocks of bounded size."""
    df = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    found = terms.join(df, "term").select("item", "term", weight.alias("weight"))
    size = terms.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("item").alias("items")).first()
    blocks = max(1, -(-size.pairs // BLOCK_PAIRS), -(-size.items // BLOCK_ITEMS))
    return checkpoint(found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest score above 0, equal scores by ascending doc_id.

    Terms are maximal runs of ASCII digits and letters and of all other characters beyond
    ASCII, A-Z lower-cased; the score is an integer form of BM25 whose weights come from all documents. Null and
    empty texts have no terms: such documents are never found, such items (and those
    without a common term) have no rows. Repeated document rows are documents of their own and null
    doc_ids come last among equals; repeated item rows are ranked each for itself. Empty tables give no rows;
    other columns are ignored.
    """
    terms = item_terms(items)
    bags = checkpoint(vectors(docs, vocabulary_filter(terms)))
    whole = bags.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    pairs, blocks = weighted(terms, bags, whole.documents)
    found = classes(bags, whole.documents, whole.length or 0, k)
    if blocks > 1:
        found = checkpoint(found)
    out, spark = shared_folder(docs.sparkSession, "best"), docs.sparkSession
    for block in range(blocks):  # one block's pairs are on the driver at a time
        held = pairs.where(F.col("block") == block).collect()
        if held:
            best_classes(found, held, k).write.mode("append").parquet(out)
    if not pairs.where("weight is not null").isEmpty():
        best = spark.read.parquet(out)
    else:
        best = spark.createDataFrame([], "item long, score long, members array<struct<doc_id: long>>")
    # Every class before another gives a document before it, so the k best classes hold the k best documents.
    leader = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("members")[0]["doc_id"].asc_nulls_last()))
    best = best.withColumn("leader", leader).where(F.col("leader") <= k)
    rows = best.select("item", "score", F.explode("members").alias("member")).select("item", "score", "member.doc_id")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = terms.select("item", "item_id").distinct()
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")

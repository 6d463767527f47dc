"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: neither
common words nor rare ones. A document's distinct lexicon terms, sorted, are hashed once per
randomised subset of the lexicon; the hashes together are its fingerprint. Subsets of
several densities are used, so that texts of a few words and of many both have subsets in which a
small edit changes nothing. The likeness of two fingerprints is the share of the subsets
with a term in either document whose hashes agree.

Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: The band, as shares of documents that have a term. A lexicon has at most (mean distinct terms per document) / BAND[0] terms.
BAND = (0.005, 0.3)
#: (one in so many lexicon terms, number of such subsets): sparse subsets resist edits of long texts, denser ones serve short texts.
SUBSETS = ((16, 4), (64, 16), (256, 20), (1024, 8))
SEPARATOR = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """Hashes of all terms of a text: lower-case runs of letters and digits."""
    return F.transform(F.split(F.lower(text), SEPARATOR), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Sorted hashes of the terms in the band, from the document frequencies of all documents.

    A term needs two documents at least. The size is bounded by the band, not by the corpus.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.count()
    terms = docs.select(F.explode(F.array_distinct(term_hashes(text))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    empty = F.xxhash64(F.lit(""))
    kept = counts.where((F.col("n") >= max(2, band[0] * total)) & (F.col("n") <= max(2, band[1] * total)) & (F.col("term") != empty))
    return sorted(r.term for r in kept.collect())


def fingerprint(text: Column, words: list[int], scope: DataFrame, name: str) -> DataFrame:
    """`scope` with column `name`: one 32-bit hash per subset, 0 where the document has none of its terms."""
    held = f"__{name}"
    listed = ",".join(f"{w}L" if w != -(1 << 63) else "(-9223372036854775807L - 1L)" for w in words) or "null"
    terms = scope.withColumn(held, term_hashes(text))
    terms = terms.withColumn(held, F.expr(f"array_sort(array_distinct(filter({held}, h -> h in ({listed}))))"))

    def signature(k: int, one_in: int) -> Column:
        def member(h: Column) -> Column:
            return F.pmod(F.xxhash64(h, F.lit(k)), F.lit(one_in)) == 0

        own = F.filter(held, member)
        return F.when(F.size(own) > 0, F.xxhash64(own, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))).otherwise(F.lit(0))

    hashes = [signature(k, one_in) for k, one_in in enumerate(one_in for one_in, number in SUBSETS for _ in range(number))]
    return terms.withColumn(name, F.array(*hashes)).drop(held)


def likeness(a: str, b: str) -> Column:
    """0 to 1; 1 for equal fingerprints, also if neither has a lexicon term."""
    def share(state: Column, x: Column) -> Column:
        used = (x["a"] != 0) | (x["b"] != 0)
        return F.struct((state["same"] + (used & (x["a"] == x["b"])).cast("int")).alias("same"), (state["used"] + used.cast("int")).alias("used"))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    zero = F.struct(F.lit(0).alias("same"), F.lit(0).alias("used"))
    return F.aggregate(pairs, zero, share, lambda s: F.when(s["used"] > 0, s["same"] / s["used"]).otherwise(1.0))


def hexadecimal(prints: str) -> Column:
    """A fingerprint as lowercase hex, eight digits per subset."""
    return F.lower(F.array_join(F.transform(prints, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def fingerprints(docs: DataFrame, words: list[int] | None = None, name: str = "fingerprint") -> DataFrame:
    """`docs` with an array of subset hashes of their texts (null texts are empty); `words` defaults to their own lexicon."""
    words = lexicon(docs) if words is None else words
    return fingerprint(F.coalesce(F.col("text").cast("string"), F.lit("")), words, docs, name)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` (doc_id, __tie and `columns`) with next_<column> of the next document in descending doc_id, the first after the last.

    Null ids come last; equal ids follow the tie column. The id axis is cut into pieces that
    are ordered in tasks of their own; the first document of each piece is dealt to the piece
    before it too, so no row is sought across pieces. One document is next to itself.
    """
    spark = docs.sparkSession
    pieces = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("v")).approxQuantile("v", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))), reverse=True)
    # Piece 0 has the largest ids; nulls fall in the last piece.
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c > F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))))
    placed = docs.withColumn("piece", piece)
    order = F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("down"), F.col("__tie"))
    # One row per piece: its first document, and the piece before it (the first follows the last).
    heads = placed.groupBy("piece").agg(F.min(order).alias("head"))
    by_piece = W.orderBy("piece")
    heads = heads.withColumn("__to", F.coalesce(F.lag("piece").over(by_piece), F.max("piece").over(W.partitionBy())))
    heads = heads.select(F.col("piece").alias("__piece"), "head", "__to")
    dealt = placed.withColumn("__order", order)
    dealt = dealt.join(F.broadcast(heads), (F.col("piece") == F.col("__piece")) & (F.col("__order") == F.col("head")), "left")
    own, guest = F.struct(F.col("piece").alias("p"), F.lit(False).alias("guest")), F.struct(F.col("__to").alias("p"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    along = W.partitionBy("cell.p").orderBy("cell.guest", F.col("doc_id").desc_nulls_last(), "__tie")
    out = dealt.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in columns], F.lead(F.lit(1)).over(along).alias("__has"))
    return out.where(~F.col("cell.guest") & F.col("__has").isNotNull()).drop("piece", "cell", "__to", "__has", "__piece", "head", "__order")


def edited(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of an edited text, and likenesses.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (arrays), near_edited
    and near_next. The edited text has its last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document's. Null texts are empty; repeated rows and null
    ids keep their places in the order; equal texts have equal fingerprints; a text without
    lexicon terms has fingerprint zero. An empty table gives an empty one.
    """
    words = lexicon(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = fingerprints(slim, words).withColumn("__tie", F.xxhash64("text"))
    paired = with_next(slim, ["text", "fingerprint"])
    n = F.length("text")
    swapped = F.floor(n / 3).cast("int")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - swapped), F.substring("next_text", F.lit(1), swapped)))
    paired = fingerprint(F.col("edited_text"), words, paired, "edited_fingerprint")
    return paired.select("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))

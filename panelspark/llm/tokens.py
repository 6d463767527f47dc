"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A rollup is a folder of batches. Each batch holds signed sums per group - inserts count
+1, deletes -1, revisions both - so totals are plain sums over the committed batches and
no document is counted again. A batch is committed by creating its entry in the log,
which is refused if the entry exists: committing a batch twice, or after a failure, changes
nothing, and data files without an entry are never read.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


GROUP = ["source", "lang", "version"]
SUMS = ["docs", "chars", "tokens"]
#: Characters encoded at once; a longer text is cut before white space that follows a letter or digit, where tokens never join.
PIECE = 1 << 18
#: The vocabulary used by default, a file of the public tokenizers' package.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_file(name: str = VOCABULARY) -> str:
    """Path of a vocabulary of the installed package of public tokenizers, or under $TOKENIZERS."""
    folder = os.environ.get("TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


#: Fixed value: the splitting pattern published with byte-level BPE ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Parts of a text whose token counts add up to that of the whole."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        # A single space between two letters or digits always starts a token of its own part.
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def counted(docs: DataFrame, keep: list[str], *, path: str | None = None, version: str = VOCABULARY) -> DataFrame:
    """Columns `keep` with version, chars and tokens of every document.

    Whole texts are counted; null texts are empty. `path` names the file of ranks on every
    worker (by default the installed package's); the encoder is loaded once per task.
    """
    slim = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = slim.drop("__text").schema.add("version", "string").add("chars", "long").add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_file()).encode_ordinary
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            sizes = [sum(len(encode(p)) for p in pieces(t)) for t in texts]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([version] * len(texts), pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], [*keep, "version", "chars", "tokens"])

    return slim.mapInArrow(run, schema)


class Rollup:
    """Totals under `folder`, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Committed batches and where their data are."""
        log = self._path(f"{self.folder}/log")
        if not self._files.exists(log):
            return {}
        names = [status.getPath().getName() for status in self._files.listStatus(log)]
        lines = self.spark.read.text([f"{self.folder}/log/{n}" for n in names]) if names else None
        # One short line per batch.
        return dict(row.value.split(" ") for row in lines.collect()) if lines is not None else {}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add signed `deltas` (GROUP and SUMS columns) as `batch`; False if that batch is committed already.

        Rows are summed per group before the shuffle. The entry names one data folder, so a
        batch counts once however often it is tried; two writers of one batch at the same
        moment leave the entry of one of them.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        entry = self._path(f"{self.folder}/log/{batch}")
        if self._files.exists(entry):
            return False
        name = f"{batch}-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        sums.write.parquet(f"{self.folder}/data/{name}")
        # The whole entry is staged first and moved in one step, so a reader sees all of it or nothing.
        staged = self._path(f"{self.folder}/staged/{name}")
        self.spark.createDataFrame([(f"{batch} {name}",)], "value string").coalesce(1).write.text(staged.toString())
        part = next(s.getPath() for s in self._files.listStatus(staged) if s.getPath().getName().startswith("part-"))
        self._files.mkdirs(entry.getParent())
        return not self._files.exists(entry) and bool(self._files.rename(part, entry))

    def totals(self) -> DataFrame:
        """One row per group with the sums over all committed batches; groups whose sums are all zero are gone."""
        schema = "source string, lang string, version string, docs long, chars long, tokens long"
        found = sorted(f"{self.folder}/data/{name}" for name in self.batches().values())
        rows = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows of added documents."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), "chars", "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows of removed documents."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("chars")).alias("chars"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows of documents counted anew: their old counts leave, their new ones enter."""
    return deletes(before).unionByName(inserts(after))

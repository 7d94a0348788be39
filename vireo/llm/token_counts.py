"""Token counts of flat token files by a separator scan.

A token file is a bare sequence of ids of fixed width, each document ended by one separator id; there is no index.
Files are cut into blocks of ``BLOCK_BYTES``. Each block is read as one byte range and searched for separators at
once (a vectorised comparison); it yields the places of its separators, their number and its last one. A prefix
scan over the blocks of a file (running count, running last place) numbers the documents and finds where each begins, in
whichever block that is, so a document may span any number of blocks and a block may hold any number of documents.

:func:`write_token_files` makes such files from texts with a public tokenizer's vocabulary, whose path is a
parameter; ordinary text never encodes to the separator.

Long runs of white space, on which the tokenizer's pattern engine gives up, are pieces of their own by the pattern's
rules, so they are cut out and merged without it: a run at the end is one piece, any other gives its last character
to what follows.

Defined cases: a null or empty text is a document of 0 tokens; a very long text is encoded whole by one task, its
tokens are scanned in blocks; repeated rows are documents of their own; an empty table gives no rows; tokens behind a file's last separator are a last
document with ``complete`` false; an empty file has no documents; a size that isn't a multiple of the width is an
error; ids may be null or repeated (a row each); extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, ensure_importable, fresh_path, materialize, n_partitions, open_store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before this vocabulary's merges, and its free id as separator.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50_256
WIDTH = "uint16"
BLOCK_BYTES = 4 << 20
FILE_BYTES = 256 << 20
LONG_RUN = 4096  # characters of white space
#: The characters that the pattern's \\s stands for.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(coder, text: str) -> list[int]:
    """The ids of a whole text; long runs of white space are merged past the pattern engine."""
    out, at = [], 0
    for run in re.finditer(f"[{SPACES}]{{{LONG_RUN},}}", text):
        end = run.end() - (run.end() < len(text))
        out += coder.encode_ordinary(text[at : run.start()])
        out += coder._encode_single_piece(text[run.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:])


def encode(text: str | None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> np.ndarray:
    return np.array(encode_text(tokenizer(vocabulary, pattern), text or ""), dtype=np.int64)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, separator: int = SEPARATOR, width: str = WIDTH) -> tuple[DataFrame, DataFrame, str]:
    """(files: file, bytes), (order: file, doc_no, doc id), folder. The order table is not part of the files."""
    spark = docs.sparkSession
    ensure_importable(spark)
    base = fresh_path(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = ddl(rows.schema["id"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, pattern)
        files, root = open_store(base)
        out, name, at, number = None, "", 0, 0
        try:
            for b in batches:
                names, numbers, sizes = [], [], []
                for text in b.column("text"):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.create_dir(root, recursive=True)
                        name, at, number = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    data = np.array([*encode_text(coder, text.as_py() or ""), separator], dtype=width).tobytes()
                    out.write(data)
                    at += len(data)
                    names.append(name)
                    numbers.append(number)
                    sizes.append(at)
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), b.column("id")], names=["file", "doc_no", "upto", "id"])
        finally:
            if out is not None:
                out.close()

    order = materialize(rows.mapInArrow(apply, f"file string, doc_no long, upto long, id {id_type}"), "token-order")
    return order.groupBy("file").agg(F.max("upto").alias("bytes")), order.select("file", "doc_no", "id"), base


def find_separators(ids: np.ndarray, separator: int, first: int = 0) -> np.ndarray:
    """Places of the separator in a block whose first token is the file's token number ``first``."""
    return np.flatnonzero(ids == separator) + first


def scan_token_files(files: DataFrame, base: str, separator: int = SEPARATOR, width: str = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files(file, bytes) -> file, doc_no, first_token, n_tokens, complete: a row for each document."""
    spark = files.sparkSession
    ensure_importable(spark)
    size = np.dtype(width).itemsize
    if block_bytes % size:
        raise ValueError("a block holds whole tokens")
    per_block = block_bytes // size
    whole = files.select("file", F.when(F.col("bytes") % size == 0, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("not whole tokens: "), "file"))).cast("long").alias("bytes"))
    blocks = whole.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes).cast("long"))).alias("block")).repartition(n_partitions(spark), "file", "block")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(base)
        for b in batches:
            for name, total, block in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "block"))):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, total - block * block_bytes), block * block_bytes), dtype=width)
                found = find_separators(ids, separator, block * per_block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([total // size]), pa.array([block]), pa.array([len(found)]), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    names=["file", "tokens", "block", "n", "last", "places"],
                )

    scanned = materialize(blocks.mapInArrow(apply, "file string, tokens long, block long, n long, last long, places array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "tokens", "block", "n", "last").select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_before"),
    )
    stitched = scanned.select("file", "block", "places").join(carried, ["file", "block"])
    begins = F.concat(F.array("last_before"), F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))))
    pairs = F.arrays_zip(begins.alias("a"), F.col("places").alias("b"))
    ended = stitched.filter(F.size("places") > 0).select("file", "docs_before", F.posexplode(pairs).alias("k", "p")).select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), (F.col("p.a") + 1).alias("first_token"), (F.col("p.b") - F.col("p.a") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = scanned.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("doc_no"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = ends.filter("tokens - 1 > last").select("file", "doc_no", (F.col("last") + 1).alias("first_token"), (F.col("tokens") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("complete"))
    return ended.unionByName(rest)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, file, doc_no, first_token, n_tokens for every row, by way of token files and their scan."""
    files, order, base = write_token_files(docs, id_col=id_col, **options)
    counted = scan_token_files(files, base)
    return counted.join(order, ["file", "doc_no"]).select(F.col("id").alias("doc_id"), "n_tokens", "first_token", "doc_no", "file")

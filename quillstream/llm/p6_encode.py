"""Problem 6: encoding a corpus with a public byte-level BPE through a table of its distinct words.

Method: split texts into the tokenizer's words in Spark, encode each distinct word once, and join the ids back by
position. Each text is read and split once, where it lies: documents in blocks of bounded size become positions in the
list of their block's distinct words. So what is shuffled for the join is the word lists of the blocks and not the
occurrences, no frequent word becomes a hot key, and the documents follow as two bytes a word. The lookup by position is
one Arrow kernel per block; a partition holds many blocks.

Defined results: a null and an empty text have no ids (an empty list); rows equal in id and text count once;
names of special tokens in a text are ordinary text; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.sizes import small_side
from quillstream.session import Scratch

TOKENIZERS = os.environ.get("QUILLSTREAM_TOKENIZERS", "/opt/tokenizers")
BLOCK_CHARS = 4_000_000
# Coded bytes of a partition of blocks, and the most partitions that a shuffle gets.
PART_BYTES = 64_000_000
MAX_PARTS = 20_000

# White space of the pattern, and the pattern of byte-level BPE words.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + "]+"
)
# Code points that the JVM has no category for.
UNKNOWN = r"\p{Cn}"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _pretokens(path: str):
    """Splits texts in which the JVM's character tables may be older than the tokenizer's."""

    @F.pandas_udf("array<string>")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pre = _tokenizer(path).pre_tokenizer
        for batch in texts:
            yield batch.map(lambda t: None if t is None else [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)])

    return split


def _word_ids(path: str):
    @F.pandas_udf("array<int>")
    def encode(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for batch in words:
            yield pd.Series([e.ids for e in t.encode_batch(batch.tolist(), add_special_tokens=False)])

    return encode


def jvm_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def words_of(text: Column, tokenizer_path: str) -> Column:
    """The words of a text, in order; together they are the text.

    The JVM splits every text of assigned characters. A text with a code point that the JVM does not know goes
    to the tokenizer's own splitter; the others reach Python as nulls only.
    """
    unknown = text.rlike(UNKNOWN)
    return F.coalesce(_pretokens(tokenizer_path)(F.when(unknown, text)), F.when(~unknown, jvm_words(text)))


def _lists(batch: pa.RecordBatch, path: str) -> pa.ListArray:
    """The words of each document of a batch; texts that the JVM left whole are split here."""
    lists, odd = batch.column("_words"), batch.column("_odd")
    if odd.null_count == len(odd):
        return lists
    pre = _tokenizer(path).pre_tokenizer
    split = [None if t is None else [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)] for t in odd.to_pylist()]
    return pa.array([o if o is not None else w for o, w in zip(split, lists.to_pylist())], pa.list_(pa.string()))


def _width(words: int) -> type:
    """Positions in a block's word list take two bytes where they fit."""
    return np.uint16 if words <= 1 << 16 else np.uint32


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    offsets = (ends * flat.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _coded(path: str, block_chars: int, kept: list[str]):
    """Documents with their words to blocks: a document becomes the positions of its words in the list of the block's
    distinct words, and that list is one more row of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            chars = np.cumsum(batch.column("_chars").to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(chars // block_chars)) + 1 if len(chars) else []
            bounds = [0, *map(int, cuts), batch.num_rows]
            for part in (batch.slice(i, j - i) for i, j in zip(bounds, bounds[1:]) if i < j):
                lists = _lists(part, path)
                found = lists.flatten().dictionary_encode()
                codes = found.indices.to_numpy(zero_copy_only=False).astype(_width(len(found.dictionary)))
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                n = part.num_rows
                fields = [part.column(c) for c in kept]
                whole = lambda c: pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, pa.nulls(1, c.type)])
                cols = [pa.array(np.full(n + 1, block)), pa.array([*range(n), None], pa.int32()), *map(whole, fields), whole(part.column("_h")), whole(_binary(codes, ends))]
                seen = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n + 1), len(found.dictionary)].astype(np.int32)), found.dictionary.cast(pa.string()))
                cols.append(pc.if_else(pa.array(np.arange(n + 1) == n), seen, pa.nulls(n + 1, seen.type)))
                yield pa.RecordBatch.from_arrays(cols, names=["_block", "_no", *kept, "_h", "_codes", "_dictionary"])
                block += 1

    return run


def _looked_up(docs: pa.Table, table: pa.Table) -> tuple[pa.ListArray, np.ndarray]:
    """The ids of each word of a block, by position, and where each document's words begin and end."""
    ids = table["_ids"].combine_chunks().take(pa.array(np.argsort(table["_pos"].to_numpy())))
    coded = docs["_codes"].combine_chunks()
    width = _width(len(ids))
    ends = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1]
    data = coded.buffers()[2]
    flat = np.frombuffer(data, width, (ends[-1] - ends[0]) // width().itemsize, int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, width)
    return ids.take(pa.array(flat.astype(np.int32))), (ends - ends[0]) // width().itemsize


def _assembled(made: str):
    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        ids, at = _looked_up(docs, table)
        bounds = ids.offsets.to_numpy()[at] if len(ids) else np.zeros(len(at), "int32")
        values = pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), ids.values) if made == "ids" else pa.array(np.diff(bounds).astype("int64"))
        return docs.select([c for c in docs.column_names if c == "_id" or c.startswith("_keep")]).append_column(made, values)

    return run


def _in_blocks(docs: DataFrame, id_col: str, text_col: str, keep: list[str], path: str, block_chars: int, made: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "p6")
    text = F.col("_text")
    named = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    kept = named.columns[:-1]
    odd = text.rlike(UNKNOWN)
    split = named.select(*kept, F.xxhash64(text).alias("_h"), F.coalesce(F.length(text), F.lit(0)).alias("_chars"),
                         F.when(~odd, jvm_words(text)).alias("_words"), F.when(odd, text).alias("_odd"))
    types = "".join(f"{c} {named.schema[c].dataType.simpleString()}, " for c in kept)
    coded = split.mapInArrow(_coded(path, block_chars, kept), f"_block bigint, _no int, {types}_h bigint, _codes binary, _dictionary array<string>")
    # Texts are read and split once; what follows reads the coded documents, or the word lists of the blocks.
    size = Observation()
    coded = scratch.cut(coded.observe(size, F.sum(F.octet_length("_codes")).alias("bytes"), F.count("_codes").alias("docs")), "coded")
    rows = coded.filter("_codes is not null").drop("_dictionary")
    first = rows.groupBy("_id", "_h").agg(F.min(F.struct("_block", "_no")).alias("_first"), F.count("*").alias("_n"))
    again = scratch.cut(first.filter("_n > 1").drop("_n").coalesce(1), "repeated")
    if not again.isEmpty():
        own = rows.alias("r").join(small_side(again).alias("a"), F.expr("r._id <=> a._id and r._h <=> a._h"), "left")
        rows = own.filter("a._first is null or a._first = struct(r._block, r._no)").select("r.*")
    lists = spark.read.schema(coded.schema).parquet(coded._scratch_path)
    words = lists.filter("_dictionary is not null").select("_block", F.posexplode("_dictionary").alias("_pos", "_word"))
    table = words.select("_word").distinct().select("_word", _word_ids(path)("_word").alias("_ids"))
    per_block = words.join(table, "_word").select("_block", "_pos", "_ids")
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(default, (size.get["bytes"] or 0) // PART_BYTES), MAX_PARTS)
    if parts > default:
        rows, per_block = rows.repartition(parts, "_block"), per_block.repartition(parts, "_block")
    schema = f"{types}{made} {kind}"
    out = rows.select("_block", *kept, "_codes").groupBy("_block").cogroup(per_block.groupBy("_block")).applyInArrow(_assembled(made), schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], made)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                  tokenizer: str = "byte_bpe_50k.json", tokenizer_dir: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id_col, *keep, ids)`` of every document, without special tokens.

    block_chars: characters that a block holds on average; one block is looked up at a time.
    """
    return _in_blocks(docs, id_col, text_col, list(keep), f"{tokenizer_dir}/{tokenizer}", block_chars, "ids", "array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                 tokenizer: str = "byte_bpe_50k.json", tokenizer_dir: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id_col, *keep, n_tokens)``: the length of each document's ids, without building the lists."""
    return _in_blocks(docs, id_col, text_col, list(keep), f"{tokenizer_dir}/{tokenizer}", block_chars, "n_tokens", "bigint")


def piece_table(spark: SparkSession, ranks: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZERS) -> DataFrame:
    """``(id, piece)``: the bytes of every id, from the vocabulary file (about 50,000 rows, fixed by the tokenizer)."""
    with open(f"{tokenizer_dir}/{ranks}", "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in (line.split() for line in f if line.strip())]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_dir: str = TOKENIZERS) -> DataFrame:
    """``(id_col, text)`` from lists of ids, through a join with the pieces; an empty list gives an empty text.

    One row per value of id_col. Bytes are joined in hexadecimal, as strings of pieces may end inside a character.
    """
    pieces = piece_table(encoded.sparkSession, tokenizer_dir=tokenizer_dir).select("id", F.hex("piece").alias("hx"))
    at = encoded.select(F.col(id_col).alias("_id"), F.posexplode_outer(ids_col).alias("_pos", "id"))
    found = at.join(F.broadcast(pieces), "id", "left")
    joined = found.groupBy("_id").agg(F.array_sort(F.collect_list(F.when(F.col("hx").isNotNull(), F.struct("_pos", "hx")))).alias("a"))
    return joined.select(F.col("_id").alias(id_col), F.decode(F.unhex(F.array_join(F.transform("a", lambda s: s["hx"]), "")), "UTF-8").alias("text"))

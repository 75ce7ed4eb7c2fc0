"""Encoding of the whole corpus with a public tokenizer.

Pre-tokens ("words") repeat without end while their number of kinds grows
slowly, so each kind is encoded once.  Documents are read in chunks of bounded
size; a chunk explodes into its kinds of word, numbered within the chunk, and
for every document the positions as those numbers.  Only the kinds of word go
through the global distinct-word shuffle, are encoded, and are joined back to
their chunks, where the positions are replaced by the ids.  A word is in a
chunk's list once however often it occurs, so no word is a hot key.

Decoding joins the ids with the table of the tokens' bytes (as long as the
vocabulary, which is fixed) and puts the bytes together by position.

Defined cases: null and empty texts have an empty list of ids, which decodes to
an empty text; strings that look like special tokens are ordinary text; a
document id that occurs twice is encoded twice; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import default_parallelism, materialise

#: Characters and documents at which a chunk is closed.
CHUNK_CHARS, CHUNK_DOCUMENTS = 4_000_000, 20_000
#: The public vocabulary; any other byte-level file of the same library may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _explode(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds: a document with its word numbers, and a word of a chunk with its number."""
    kind = documents.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", id_type), ("numbers", pa.list_(pa.int32())), ("number", pa.int32()), ("word", pa.string()), ("is_word", pa.int32())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split = regex.compile(PATTERN).findall
        task, closed = TaskContext.get().partitionId(), 0
        seen: dict[str, int] = {}
        ids: list = []
        flat: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal closed, seen, ids, flat, size
            chunk = (task << 32) | closed
            n, w = len(ids), len(seen)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if n else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(ids, id_type), numbers, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32))], schema=schema)
            if w:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(w, chunk)), pa.nulls(w, id_type), pa.nulls(w, pa.list_(pa.int32())), pa.array(np.arange(w, dtype=np.int32)), pa.array(list(seen), pa.string()), pa.array(np.ones(w, np.int32))], schema=schema)
            closed, seen, ids, flat, size = closed + 1, {}, [], [], 0

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = split(value) if value else ()
                flat.append(np.fromiter((seen.setdefault(x, len(seen)) for x in found), np.int32, len(found)))
                ids.append(doc)
                size += len(value or "")
                if size >= CHUNK_CHARS or len(ids) >= CHUNK_DOCUMENTS:
                    yield from close()
        if ids:
            yield from close()

    spark_schema = f"chunk long, doc_id {kind.simpleString()}, numbers array<int>, number int, word string, is_word int"
    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(explode, spark_schema)


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    kind = documents.schema[doc_id].dataType.simpleString()
    exploded = materialise(_explode(documents, doc_id, text), "tokens-exploded", "is_word")
    chunk_words = exploded.filter(F.col("is_word") == 1).select("chunk", "number", "word")
    chunk_docs = exploded.filter(F.col("is_word") == 0).select(F.col("chunk").alias("doc_chunk"), "doc_id", "numbers")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            got = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.ids for x in got], pa.list_(pa.int32()))], ["word", "word_ids"])

    encoded = chunk_words.select("word").distinct().mapInArrow(encode_words, "word string, word_ids array<int>")
    back = chunk_words.join(encoded, "word").select("chunk", "number", "word_ids")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(documents.schema[doc_id].dataType)

    def reassemble(docs: pa.Table, table: pa.Table) -> pa.Table:
        """Positions of a chunk's documents replaced by ids, as flat arrays."""
        docs, table = docs.combine_chunks(), table.combine_chunks()
        numbers = docs["numbers"].combine_chunks()
        place = numbers.flatten().to_numpy()
        per_doc = np.diff(numbers.offsets.to_numpy())
        size = table.num_rows
        ids = table["word_ids"].combine_chunks()
        order = np.empty(size, np.int64)
        order[table["number"].to_numpy()] = np.arange(size)
        starts, lengths = ids.offsets.to_numpy()[:-1].astype(np.int64), np.diff(ids.offsets.to_numpy())
        base = ids.offsets[0].as_py() if size else 0
        pool = ids.flatten().to_numpy() if size else np.zeros(0, np.int32)
        row = order[place] if size else np.zeros(0, np.int64)
        count = lengths[row] if size else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(starts[row] - base if size else row, count)
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_doc)))]
        out = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(pool[at].astype(np.int32)))
        return pa.table({"doc_id": docs["doc_id"].cast(id_type), "ids": out})

    return chunk_docs.groupBy("doc_chunk").cogroup(back.groupBy("chunk")).applyInArrow(reassemble, f"doc_id {kind}, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, hex): the bytes of each token.  As many rows as the vocabulary has entries."""
    from tokenizers import pre_tokenizers

    tokenizer = _tokenizer(vocabulary)
    # the byte-level alphabet is the printable Latin-1 characters as themselves and the other bytes from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
    rows = [(i, bytes(byte_of[c] for c in token).hex()) for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in token)]
    return spark.createDataFrame(rows, "id int, hex string")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    spark = encoded.sparkSession
    table = token_bytes(spark, vocabulary)
    rows = encoded.withColumn("_row", F.monotonically_increasing_id())
    places = rows.select("_row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    # the table is as long as the fixed vocabulary: about 2 MB
    joined = places.join(F.broadcast(table), "id", "left")
    piece = F.struct("pos", F.coalesce("hex", F.lit("")).alias("hex"))
    grouped = joined.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return grouped.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("pieces", lambda x: x["hex"]), "")), "UTF-8").alias("text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf}/documents.parquet"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text after encoding and decoding."""
    ids = materialise(encode(spark.read.parquet(f"{sf}/documents.parquet")), "tokens-encoded")
    return decode(ids.repartition(default_parallelism(spark)))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
SQL = {"p7_decoded": "select doc_id, coalesce(text, '') as text from documents"}

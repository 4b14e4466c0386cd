"""Writes the token ids of all documents as compressed binary files, and reads them back."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, remove
from .rans import Coder, frequencies
from .tokens import encode_words

_RAW = "shard int, block int, docs binary, lengths binary, ids binary, tokens long, first_null long"
_BLOCKS = _RAW.replace("ids", "payload")


def token_counts(raw: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each of size ids occurs in raw blocks; size rows reach the driver."""

    def count(it):
        total = np.zeros(size, np.int64)
        for pdf in it:
            for ids in pdf["ids"]:
                total += np.bincount(np.frombuffer(ids, kind), minlength=size)
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "n": total[ids]})

    got = raw.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write_tokens(docs: DataFrame, tokenizer: str, size: int = 49_408, end: int = 2, block: int = 1 << 18, path: str | None = None) -> str:
    """Encodes docs (doc_id, text) in ascending doc_id order (nulls first; equal ids by text),
    each followed by the id ``end``, and writes them below path: tables ``blocks`` (a row per
    block: shard, block, the documents' ids and lengths, the compressed ids) and ``frequencies``.
    Returns path, by default a new folder in the shared one, which goes when the session ends.

    A null or empty text is its end id alone; repeated rows are written again; other columns are
    ignored; an empty table writes no blocks. Texts are dealt by ranges of doc_id, so a shard is
    one range, and each is tokenized once as it streams by; a block closes at the first document
    that brings it to ``block`` ids, so only one long document exceeds it. Uncompressed blocks go to
    a scratch table, for the frequencies are those of all documents; it is removed at the end."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    kind = "<u2" if size <= 1 << 16 else "<u4"
    last = np.array([end], "<u4").tobytes()

    def tokenize(it):
        names: list[int] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        nulls = total = number = shard = 0

        def close():
            nonlocal names, lengths, ids, nulls, total, number
            small = np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes()
            row = pd.DataFrame([(shard, number, np.array(names, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), small, total, nulls)], columns=["shard", "block", "docs", "lengths", "ids", "tokens", "first_null"])
            names, lengths, ids, nulls, total, number = [], [], [], 0, 0, number + 1
            return row

        for pdf in it:
            for part, missing, doc, text in zip(pdf["part"], pdf["missing"], pdf["doc_id"], pdf["text"], strict=True):
                shard = part
                got = encode_words(tokenizer, text) + last
                names.append(doc)
                ids.append(got)
                lengths.append(len(got) // 4)
                nulls += bool(missing)
                total += len(got) // 4
                if total >= block:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    rows.mapInPandas(tokenize, _RAW).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{path}/raw")
    freq = frequencies(token_counts(raw, size, kind))
    table = freq.tolist()

    def encode(it):
        coder = Coder(np.array(table, np.int64))
        for pdf in it:
            for k in range(len(pdf)):
                one = pdf.iloc[k : k + 1]
                yield one.assign(payload=[coder.encode(np.frombuffer(one["ids"].iloc[0], kind).astype("<u4"))]).drop(columns="ids")

    raw.mapInPandas(encode, _BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame(pd.DataFrame({"id": np.arange(size), "frequency": freq})).coalesce(1).write.parquet(f"{path}/frequencies")
    remove(spark, f"{path}/raw")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of write_tokens' files: doc_id, start, n_tokens, ids_crc32 (and ids,
    with_ids). Blocks decode apart; only their token counts are summed up in order."""
    table = spark.read.parquet(f"{path}/frequencies").toPandas().sort_values("id")["frequency"].tolist()  # a row per vocabulary entry
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))  # a row per shard
    base = shards.select("shard", F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = blocks.select("shard", "block", "tokens").withColumn("block_start", F.coalesce(F.sum("tokens").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = inside.join(base, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(it):
        coder = Coder(np.array(table, np.int64))
        for pdf in it:
            for r in pdf.itertuples():
                ids = coder.decode(r.payload).tobytes()
                names, lengths = np.frombuffer(r.docs, "<i8"), np.frombuffer(r.lengths, "<i8")
                begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                each = [ids[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
                doc = pd.array(names, "Int64")
                doc[: r.first_null] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": begin + r.start, "n_tokens": lengths, "ids_crc32": [zlib.crc32(x) for x in each]} | ({"ids": each} if with_ids else {}))

    return blocks.join(starts, ["shard", "block"]).select("docs", "lengths", "payload", "first_null", "start").mapInPandas(decode, schema)

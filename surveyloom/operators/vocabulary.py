"""Exact numbers for tokens: a distributed vocabulary in place of hashing.

Tokens are counted with a map-side combine and numbered without a gap through their
digests' buckets. Rows get their numbers from a vocabulary that is sent to the tasks,
where it is small, or by a join, so the driver never holds more than SENT_BYTES of
tokens, and no two tokens share a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from surveyloom.operators.ranks import hash_rank
from surveyloom.sources.scratch import materialise, scratch_path

SENT_BYTES = 32 << 20  # of a vocabulary that is sent to the tasks
SPARSE = 0  # how a stored vector says that it lists its non-zero places


def token_vocabulary(rows: DataFrame, tokens: Column, seed: str = "42", min_rows: int = 1) -> DataFrame:
    """(token, number, rows): every token of at least `min_rows` rows, numbered 0, 1, ... in digest order.

    A token counts once per row, however often the row repeats it.
    """
    seen = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).where(F.col("token").isNotNull())
    counts = seen.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_rows)
    return hash_rank(materialise(counts, "tokens"), ["token"], f"{seed}:vocabulary", "number").select("token", "number", "rows")


def token_numbers(rows: DataFrame, tokens: Column, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, numbers): a row's token numbers in the order of its list; -1 for a token that is not in the vocabulary.

    Every row keeps its place, also one without tokens. Keys must be unique. A
    vocabulary of at most SENT_BYTES is sent to the tasks and rows stay whole; a larger
    one is joined, token by token.
    """
    size = F.sum(F.octet_length("token") + 16)
    if (vocabulary.agg(size).first()[0] or 0) <= SENT_BYTES:
        return _looked_up(rows, tokens, vocabulary, keys)
    placed = rows.select(*keys, F.posexplode_outer(tokens).alias("_place", "token"))
    found = placed.join(vocabulary.select("token", "number"), "token", "left")
    entry = F.struct("_place", F.coalesce("number", F.lit(-1).cast("bigint")).cast("int").alias("number"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), entry)))
    return found.groupBy(*keys).agg(F.transform(listed, lambda e: e["number"]).alias("numbers"))


def _looked_up(rows: DataFrame, tokens: Column, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary.select("token", "number").toArrow().combine_chunks())

    def run(batches):
        words = sent.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            number = pc.take(words["number"], pc.index_in(lists.flatten(), value_set=words["token"]))
            if isinstance(number, pa.ChunkedArray):
                number = number.combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(ends), pc.fill_null(number, -1).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], numbers], names=[*batch.schema.names[:-1], "_numbers"])

    listed = rows.select(*keys, F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
    schema = StructType([*listed.schema.fields[:-1], StructField("_numbers", ArrayType(IntegerType()))])
    lists = F.collect_list("_numbers")
    # rows that share their keys are one, in the order of places
    placed = F.transform(lists, lambda one: F.transform(one, lambda n, i: F.struct(i.alias("place"), n.alias("number"))))
    merged = F.transform(F.array_sort(F.flatten(placed)), lambda e: e["number"])
    return listed.mapInArrow(run, schema).groupBy(*keys).agg(
        F.when(F.size(lists) == 1, F.get(lists, F.lit(0))).otherwise(merged).alias("numbers")
    )


def with_exact_vectors(
    rows: DataFrame, tokens: Column, vocabulary: DataFrame, keys: list[str], name: str = "features"
) -> DataFrame:
    """`rows` with a sparse 0/1 vector of their tokens, as MLlib takes it; unknown tokens are left out.

    The vector is stored as the plain columns it consists of and read again as a vector,
    so neither Python nor the driver touches a row.
    """
    size = vocabulary.count()
    numbers = token_numbers(rows, tokens, vocabulary, keys)
    places = F.array_sort(F.array_distinct(F.filter("numbers", lambda n: n >= 0)))
    plain = numbers.select(
        *keys,
        F.struct(
            F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), places.alias("indices"),
            F.transform(places, lambda _: F.lit(1.0)).alias("values"),
        ).alias(name),
    )
    joined = rows.join(plain, keys)
    path = scratch_path(rows.sparkSession, "vectors")
    joined.write.parquet(path)
    kept = [f for f in joined.schema.fields if f.name != name]
    return rows.sparkSession.read.schema(StructType([*kept, StructField(name, VectorUDT())])).parquet(path)

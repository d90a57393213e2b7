"""Filling containers of fixed capacity with items."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm.tokens import TOKENIZER, count_tokens
from loreline.session import cut


class Windows:
    """Bounded-space best fit: at most `most` containers are open; an item goes where it leaves least room.

    If it fits nowhere and no more may be opened, the fullest is closed to make room for a new one.
    """

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (room, number), sorted
        self.items: dict[int, list] = {}
        self.number = 0

    def place(self, size: int, item: object) -> Iterator[tuple[int, int, list]]:
        """Puts the item in; gives (number, fill, items) of each container that is closed by it."""
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, k = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                room, k = self.open.pop(0)
                yield k, self.capacity - room, self.items.pop(k)
            room, k = self.capacity, self.number
            self.number += 1
            self.items[k] = []
        self.items[k].append(item)
        if room == size:
            yield k, self.capacity, self.items.pop(k)
        else:
            insort(self.open, (room - size, k))

    def rest(self) -> Iterator[tuple[int, int, list]]:
        for room, k in self.open:
            yield k, self.capacity - room, self.items.pop(k)
        self.open = []


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, windows: int = 256, merge_rows: int = 20_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, id, part, start, tokens): every text's tokens [start, start + tokens) in a container of capacity tokens.

    A text is divided only if it alone exceeds the capacity; then all its parts but the last fill a container each. The
    first pass packs every partition by itself, in the order it is read, with at most `windows` open containers; what
    stays open at a partition's end is packed again, container by container, by one task for every merge_rows of
    them. Containers are numbered by pass, task and order. A task keeps `windows` containers and no more, whatever
    its partition's size; passes are written to the shared folder, so a lost executor changes nothing.

    Texts without tokens stand in no container (null) with 0 tokens; null texts and null ids give no rows. A
    repeated row is packed each time. An empty table gives no rows.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("capacity and windows are at least 1")
    id_type = docs.schema[id_col].dataType
    item = T.StructType([T.StructField("id", id_type), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType())])
    box = T.StructType([T.StructField("number", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("closed", T.BooleanType()), T.StructField("items", T.ArrayType(item))])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows(capacity, windows)
        for batch in batches:
            out = []
            for i, n in zip(batch["id"].tolist(), batch["tokens"].tolist(), strict=True):
                if n == 0:
                    out.append((-1, 0, True, [(i, 0, 0, 0)]))
                for part, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    out += [(k, fill, True, items) for k, fill, items in w.place(size, (i, part, start, size))]
            yield pd.DataFrame(out, columns=["number", "fill", "closed", "items"], dtype=object)
        yield pd.DataFrame([(k, fill, False, items) for k, fill, items in w.rest()], columns=["number", "fill", "closed", "items"], dtype=object)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Windows(capacity, 1 << 62)
        for batch in batches:
            for fill, items in zip(batch["fill"].tolist(), batch["items"].tolist(), strict=True):
                for k, f, boxes in w.place(fill, items):
                    yield _joined(k, f, boxes)
        for k, f, boxes in w.rest():
            yield _joined(k, f, boxes)

    def _joined(k: int, fill: int, boxes: list) -> pd.DataFrame:
        return pd.DataFrame([(k, fill, True, [tuple(x[c] for c in ("id", "part", "start", "tokens")) if isinstance(x, dict) else tuple(x) for b in boxes for x in b])], columns=["number", "fill", "closed", "items"], dtype=object)

    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), count_tokens(F.col(text_col), tokenizer).alias("tokens"))
    boxes = cut(rows.mapInPandas(first, box).withColumn("task", F.spark_partition_id()))
    left = boxes.filter(~F.col("closed"))
    tasks = max(1, -(-left.count() // merge_rows))
    by = F.pmod(F.xxhash64("task", "number"), F.lit(tasks)).cast("int")
    order = left.withColumn("by", by).repartition(tasks, "by").sortWithinPartitions("by", F.desc("fill"), "task", "number").select("number", "fill", "closed", "items")
    merged = cut(order.mapInPandas(again, box).withColumn("task", F.spark_partition_id()))
    name = lambda p: F.when(F.col("number") >= 0, F.concat_ws("-", F.lit(p), F.col("task").cast("string"), F.col("number").cast("string")))
    done = boxes.filter("closed").select(name("a").alias("container"), "items").unionByName(merged.select(name("b").alias("container"), "items"))
    return done.select("container", F.explode("items").alias("i")).select("container", F.col("i.id").alias(id_col), "i.part", "i.start", "i.tokens")

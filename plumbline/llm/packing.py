"""Sequence packing by shortest-pack-first over the length histogram.

Documents become token ids and are cut every ``size`` ids, so only the last piece of a document is shorter. The
histogram of piece lengths (at most ``size`` numbers) comes to the driver, which places lengths longest first, each into
the packs that are shortest so far, and keeps counts of packing patterns, never single packs. Every slot of a pattern
then stands for a run of ranks among the pieces of one length; the pieces look up their slot by rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Workspace, cut, gathered

SIZE, END_ID = 2048, 1
#: Rows, about, of the groups in which the pieces of one length are ranked.
RANKED_ROWS = 1000


class Encoder:
    """Token ids as the tokenizer file gives them. The same vocabulary as ranks, if given, encodes faster; texts that
    hold a special token's string go through the tokenizer itself."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def public_encoder() -> Encoder:
    """The byte-level vocabulary of the public tokenizers, looked up on the machine that encodes."""
    import public_tokenizers as public

    return Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@lru_cache(maxsize=4)
def _made(encoder):
    """One encoder for a worker process, whatever the number of its tasks."""
    return encoder()


def pieces(docs: DataFrame, encoder=public_encoder, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens and, on demand, ids (array<int>).

    A document's ids are those of its whole text and then END_ID; a null text has END_ID alone. ``encoder`` makes a
    callable from text to ids; it is called once in every worker process.
    """
    frame = docs.select(id_col, text_col)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _made(encoder)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                row, start, length, check, total, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    got = np.array([*encode(text or ""), END_ID], "<u4")
                    for a in range(0, len(got), size):
                        piece = got[a : a + size]
                        row.append(i)
                        start.append(a)
                        length.append(len(piece))
                        check.append(zlib.crc32(piece.tobytes()))
                        total.append(len(got))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, check, total))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)

    schema = T.StructType([frame.schema[id_col], *(T.StructField(n, T.LongType()) for n in names[1:5]), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return frame.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many packs) by shortest-pack-first: the longest lengths first, each into the emptiest packs."""
    heap: list[tuple[int, int]] = []  # (-room, place in groups)
    groups: list[tuple[tuple | None, int]] = []  # (linked list of lengths, packs)

    def add(room: int, lengths: tuple, packs: int) -> None:
        groups.append((lengths, packs))
        heapq.heappush(heap, (-room, len(groups) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, at = heapq.heappop(heap)
                lengths, packs = groups[at]
                used = min(left, packs)
                if packs > used:
                    groups[at] = (lengths, packs - used)
                    heapq.heappush(heap, (room, at))
                else:
                    groups[at] = (None, 0)
                add(-room - length, (length, lengths), used)
                left -= used
            else:
                # A new pack has most room, so it takes pieces of this length until the next one does not fit.
                each = size // length
                for n, packs in ((each, left // each), (left % each, 1)):
                    if n and packs:
                        lengths = None
                        for _ in range(n):
                            lengths = (length, lengths)
                        add(size - n * length, lengths, packs)
                left = 0
    out = []
    for lengths, packs in groups:
        if packs:
            flat = []
            while lengths is not None:
                flat.append(lengths[0])
                lengths = lengths[1]
            out.append((tuple(reversed(flat)), packs))
    return out


def _slots(made: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """Runs of ranks: first rank (counted over all lengths in order), first sequence and offset of each run, and the
    first rank of every length."""
    length, packs, sequence, offset, base = [], [], [], [], 0
    for lengths, n in made:
        at = 0
        for x in lengths:
            length.append(x)
            packs.append(n)
            sequence.append(base)
            offset.append(at)
            at += x
        base += n
    length, packs, sequence, offset = (np.array(x, np.int64) for x in (length, packs, sequence, offset))
    order = np.argsort(length, kind="stable")
    length, packs, sequence, offset = length[order], packs[order], sequence[order], offset[order]
    first = np.cumsum(packs) - packs
    totals = np.bincount(length, packs, size + 1).astype(np.int64)
    return first, sequence, offset, np.cumsum(totals) - totals


def pack(parts: DataFrame, size: int = SIZE, rows: int = RANKED_ROWS) -> DataFrame:
    """``parts`` (with a column length) with sequence_id and offset: pieces of a sequence lie gapless from offset 0.

    Every row gets a number when the pieces are written, and any order of rows, ids and copies will do. A full piece is
    a sequence by itself and needs no rank, only its number. The others of one length are ranked inside groups of about
    ``rows`` rows dealt by hash of the number, as many as their count asks for, and a group's ranks begin behind those
    of the groups before it, so no length is gathered in one task and no rows are dealt unevenly.
    """
    parts = parts.drop("sequence_id", "offset")
    names = parts.columns
    # Columns go by place inside, so no name can clash.
    inner = [f"c{i}" for i in range(len(names))]
    length = inner[names.index("length")]
    with Workspace(parts.sparkSession) as work:
        numbered = cut(parts.toDF(*inner).withColumn("row", F.monotonically_increasing_id()))
        histogram = {r["n"]: r["count"] for r in numbered.groupBy(F.col(length).alias("n")).count().collect()}
        made = patterns({n: k for n, k in histogram.items() if n < size}, size)
        slots = parts.sparkSession.sparkContext.broadcast(_slots(made, size))
        whole = numbered.where(F.col(length) == size)
        rest = numbered.where(F.col(length) < size)
        groups = {n: -(-k // rows) for n, k in histogram.items() if n < size}
        deal = F.lit(0)
        if groups:
            deal = F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for n, k in sorted(groups.items()) for x in (n, k)]), F.col(length)))
        salted = rest.withColumn("salt", deal.cast("long"))
        counts = work.cut(salted.groupBy(F.col(length).alias("n"), "salt").agg(F.count("*").alias("k")), few=True)
        before = cut(counts.select("n", "salt", (F.sum("k").over(Window.partitionBy("n").orderBy("salt")) - F.col("k")).alias("before")), few=True)
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy(length, "salt").orderBy("row")))
    ranked = gathered(ranked.join(before, (ranked[length] == before["n"]) & (ranked["salt"] == before["salt"])).select((F.col("before") + F.col("nth") - 1).alias("rank"), *inner))
    at = inner.index(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset, begin = slots.value
        for batch in batches:
            rank = batch.column(0).to_numpy() + begin[batch.column(at).to_numpy()]
            run_ = np.searchsorted(first, rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence[run_] + rank - first[run_]), pa.array(offset[run_])], [*inner, "sequence_id", "offset"])

    kinds = [T.StructField(c, f.dataType) for c, f in zip(inner, parts.schema.fields, strict=True)]
    placed = ranked.mapInArrow(run, T.StructType([*kinds, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    # Behind the sequences of several pieces.
    alone = whole.select(*inner, (F.col("row") + sum(n for _, n in made)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(alone).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, encoder=public_encoder, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document, with its sequence: see ``pieces`` and ``pack``.

    Null texts count as empty; empty texts, repeated rows and null ids are packed like others; an empty table gives no
    rows; other columns are not looked at.
    """
    return pack(pieces(docs, encoder, size, with_ids, id_col, text_col), size)

"""Best-fit packing by hierarchical residual packing.

Every document becomes token ids and an end id; longer ones are cut into full
sequences and one rest, which comes last or, with ``rest_first``, first.  Each
partition packs its pieces best-fit in falling order of length and emits its nearly full bins; the underfull bins then meet as items of the next
round's best-fit, dealt out anew by another hash each round, until one task held all that are
left or a round saves less than ``LEAST_SAVING`` of them.  A round has as many tasks as its
bins need: each holds about ``ITEMS`` of them, whatever the input is.

Ids are those of the tokenizer file; they are computed with the library that reads
the same vocabulary as ranks, several times faster, and by the tokenizer itself for
texts that hold its special token or a run of white space too long for that library.

Defined cases: null counts as empty and gives the end id alone; very long texts are
tokenised whole; repeated rows are packed each; a null id stays null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from idlecost.llm.common import full_text, stored, table

LENGTH = 1024
END_ID = 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Longer runs of white space go through the tokenizer: the library of ranks fails from a million characters on.
LONGEST_BLANK = 500_000
#: Bins with at most this much room are emitted, not packed again.
NEARLY_FULL = 2
#: Underfull bins that one task of a round packs.
ITEMS = 50_000
#: A round that saves a smaller share of the bins is the last.
LEAST_SAVING = 0.002
#: What the numbers of bins have room for; each round saves its share, so fewer are made.
MOST_ROUNDS = 255


@functools.cache
def _by_ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _by_file(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _long_blank(text: str) -> bool:
    return len(text) > LONGEST_BLANK and any(run.end() - run.start() > LONGEST_BLANK for run in re.finditer(r"\s+", text))


def token_ids(text: str, tokenizer: str, ranks: str) -> np.ndarray:
    """The tokenizer's ids of a whole text, without added special tokens."""
    if SPECIAL in text or _long_blank(text):
        return np.array(_by_file(tokenizer).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(_by_ranks(ranks).encode_ordinary(text), dtype="<u4")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place in it, used room of each bin), items in falling order of length.

    The bins of each room left are kept together and a bit set tells which rooms
    occur, so the fullest bin that still fits is found in constant time.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, used = 0, []
    to, place = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = present >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            b = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(used)
            used.append(0)
        to[i], place[i] = b, used[b]
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            present |= 1 << (room - n)
    return to, place, np.array(used, dtype=np.int64)


def _pieces(length: int, end_id: int, tokenizer: str, ranks: str, with_ids: bool, rest_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, n, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                own = np.append(token_ids(text, tokenizer, ranks), np.uint32(end_id)).astype("<u4")
                head = (len(own) - 1) % length + 1 if rest_first else length
                cuts = [0, *range(head, len(own), length), len(own)]
                for k, (at, end) in enumerate(itertools.pairwise(cuts)):
                    part = own[at:end]
                    row.append(r), piece.append(k), start.append(at), n.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                 "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))
    return run


def _packed_locally(capacity: int):
    """Adds to the pieces of a partition their bin, place and, on a bin's first piece, its used room."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        all_rows = pa.Table.from_batches(rows).combine_chunks()
        to, place, used = best_fit(all_rows.column("length").to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 40
        yield from all_rows.append_column("bin", pa.array(to + base)).append_column("place", pa.array(place)).append_column(
            "used", pa.array(np.where(place == 0, used[to], 0))).to_batches(max_chunksize=50_000)
    return run


def _packed_again(capacity: int, level: int):
    """Bins as items: (bin, used) -> (bin, to, shift, to_used), one partition's bins together.

    Bins are numbered by round, partition and place, above those of the first packing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        all_rows = pa.Table.from_batches(rows)
        to, place, used = best_fit(all_rows.column("used").to_numpy(), capacity)
        first = (1 << 60) + (level << 52) + (TaskContext.get().partitionId() << 24)
        yield pa.RecordBatch.from_pydict({
            "bin": all_rows.column("bin").combine_chunks(), "to": pa.array(to + first), "shift": pa.array(place),
            "to_used": pa.array(np.where(place == 0, used[to], 0))})
    return run


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False, rest_first: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every row of ``docs``.

    The pieces of a cut document are full but for its last one or, with ``rest_first``, its first.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    ranks = ranks or public_tokenizers.path(RANKS)
    texts = docs.select(F.col(id_col).alias("doc_id"), full_text(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_pieces(length, end_id, tokenizer, ranks, with_ids, rest_first),
                            f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``items`` with sequence_id and offset; a row's ``length`` is the room it needs."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    local = stored(items.mapInArrow(_packed_locally(length), f"{fields}, bin long, place long, used long"), "packed")
    bins = local.where(F.col("used") > 0).select("bin", "used")
    moves = None  # where each bin that was packed again is now
    open_bins = bins.where(F.col("used") < length - NEARLY_FULL)
    n, level = open_bins.count(), 1
    while n > 1:
        parts = max(1, -(-n // ITEMS))
        # Dealt out by a hash of the bin, so that each task gets all kinds of room.
        dealt = open_bins.repartition(parts, F.xxhash64("bin", F.lit(level)))
        again = stored(dealt.mapInArrow(_packed_again(length, level), "bin long, to long, shift long, to_used long"), f"round-{level}")
        if moves is None:
            moves = again.select("bin", F.col("to").alias("now"), "shift")
        else:
            moves = stored(moves.join(again.select(F.col("bin").alias("now"), "to", F.col("shift").alias("_more")), "now", "left").select(
                "bin", F.coalesce("to", "now").alias("now"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")), f"moves-{level}")
        after = again.where(F.col("to_used") > 0).select(F.col("to").alias("bin"), F.col("to_used").alias("used"))
        made = after.count()
        saved = n - made
        open_bins = after.where(F.col("used") < length - NEARLY_FULL)
        n, level = open_bins.count(), level + 1
        if parts == 1 or saved < LEAST_SAVING * made or level == MOST_ROUNDS:
            break
    if moves is None:
        return local.select(*items.columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    placed = local.join(moves.withColumnRenamed("shift", "_shift"), "bin", "left")
    return placed.select(*items.columns, F.coalesce("now", "bin").alias("sequence_id"),
                         (F.col("place") + F.coalesce("_shift", F.lit(0))).alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), rest_first=True))

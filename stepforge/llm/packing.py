"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are cut at multiples of max_len, so all pieces but the last are full. The histogram of piece lengths (max_len
rows at most) goes to the driver, where lengths are placed longest first, each into the packs with most room left; packs
of equal content are one pattern with a count. A pattern holds (length, repeats) entries, so patterns and entries are
bounded by max_len, not by the data. Patterns go back to pieces by rank: a piece's rank among the pieces of its length is
its rank within its task plus the counts of earlier tasks, a prefix sum over (task, length) counts.

Defined cases: null or empty text yields the end token alone; a long text fills many packs; null ids are packed as they
are, ids are whole at any size; repeated rows are packed each; pieces of equal length are interchangeable; an empty table
gives no rows; extra columns are not read.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stepforge.llm import tokenization
from stepforge.llm.storage import bounded_batches, bounded_broadcast, bounded_reads, map_frames, materialize, whole

MAX_LEN = 2048
END_ID = 1
#: Rows of (task, length) counts that are broadcast at most.
MOST_BASES = 200_000


def pattern_plan(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, repeats), ...]) of packs, by placing lengths longest first into the emptiest packs."""
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, count: int, items: tuple) -> None:
        if room not in groups:
            groups[room] = []
            heapq.heappush(rooms, -room)
        groups[room].append((count, items))

    def grown(items: tuple, length: int, repeats: int) -> tuple:
        if items and items[-1][0] == length:
            return (*items[:-1], (length, items[-1][1] + repeats))
        return (*items, (length, repeats))

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, items = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    heapq.heappop(rooms)
                used = min(count, left)
                put(room - length, used, grown(items, length, 1))
                if count > used:
                    put(room, count - used, items)
                left -= used
            else:
                repeats = max_len // length
                packs, rest = divmod(left, repeats)
                if packs:
                    put(max_len - repeats * length, packs, ((length, repeats),))
                if rest:
                    put(max_len - rest * length, 1, ((length, rest),))
                left = 0
    return [(count, list(items)) for room in sorted(groups) for count, items in groups[room]]


class RankTable:
    """Sorted ranges of ranks for each length: where the piece with a given rank goes."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        rows, first = [], 0
        used: dict[int, int] = {}
        for count, items in plan:
            offset = 0
            for length, repeats in items:
                lo = used.get(length, 0)
                rows.append((length, lo, repeats, first, offset))
                used[length] = lo + count * repeats
                offset += length * repeats
            first += count
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.lo, self.repeats, self.first, self.offset = table.T.copy()
        self.start = {int(v): int(np.searchsorted(self.length, v)) for v in np.unique(self.length)}
        self.stop = {int(v): int(np.searchsorted(self.length, v, "right")) for v in np.unique(self.length)}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for idx in np.split(order, cuts):
            if len(idx):
                s, e = self.start[int(length[idx[0]])], self.stop[int(length[idx[0]])]
                at[idx] = s + np.searchsorted(self.lo[s:e], rank[idx], "right") - 1
        inside = rank - self.lo[at]
        return self.first[at] + inside // self.repeats[at], self.offset[at] + inside % self.repeats[at] * length


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), part and nth (its place among the
    pieces of its length that its task made)."""

    def cut(frames):
        tok = tokenization.tokenizer(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for pdf in frames:
            docs_, starts, lengths, totals, ids, nth = [], [], [], [], [], []

            def frame():
                return pd.DataFrame({"doc_id": pd.array(docs_, "Int64"), "start": starts, "length": lengths, "doc_tokens": totals, "ids": ids, "part": part, "nth": nth})

            size = 0
            for doc, text in zip(whole(pdf["doc_id"]), pdf["text"], strict=True):
                data = tok.encode(text if isinstance(text, str) else "") + end
                n = len(data) // 4
                for s in range(0, n, max_len):
                    k = min(max_len, n - s)
                    docs_.append(doc)
                    starts.append(s)
                    lengths.append(k)
                    totals.append(n)
                    ids.append(data[4 * s : 4 * (s + k)])
                    nth.append(int(seen[k]))
                    seen[k] += 1
                size += len(data)
                if size > 8 << 20:
                    yield frame()
                    docs_, starts, lengths, totals, ids, nth = [], [], [], [], [], []
                    size = 0
            if docs_:
                yield frame()

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, nth long"
    return map_frames(bounded_batches(bounded_reads(docs)).select("doc_id", "text"), cut, schema)


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """pieces (part, nth, length and any payload) with sequence_id and offset; offsets are gapless from 0."""
    pieces = materialize(pieces, "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("__n")), "piece-counts")
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("part")) - F.col("__n")
    bases = counts.select("part", "length", before.alias("__base"))
    rows = counts.count()  # at most tasks times lengths: broadcast while few, else both sides are dealt by (part, length)
    bases = bounded_broadcast(bases, rows) if rows <= MOST_BASES else bases.hint("shuffle_hash")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # max_len rows at most
    if not histogram:
        return pieces.drop("part", "nth").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    table = RankTable(pattern_plan(histogram, max_len))
    where = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.pandas_udf(where)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = table.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = pieces.join(bases, ["part", "length"]).withColumn("__at", place("length", F.col("__base") + F.col("nth")))
    return ranked.withColumns({"sequence_id": F.col("__at.sequence_id"), "offset": F.col("__at.offset")}).drop("__at", "__base", "part", "nth")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Packed pieces of docs with their token ids."""
    return pack(token_pieces(docs, tokenizer, max_len, end_id), max_len)

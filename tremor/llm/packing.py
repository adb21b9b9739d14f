"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents longer than the largest are cut into pieces. Pieces are taken from the longest
down; each goes to the open bin that it leaves least room in. If none has room, a bin opens with the capacity of least cost for
the piece: its padding if nothing else came, against the larger capacity's chance to be filled by the shorter pieces that
are still to come. At the end each bin shrinks to the smallest capacity that holds its contents.

Pieces are dealt to groups by a hash; the number of groups follows the number of tokens, so each group is small and groups
pack side by side. Only lengths are moved, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import staged

CAPACITIES = (512, 1024, 2048, 4096)
TOKENS_PER_GROUP = 1 << 21
SCHEMA = "doc_id long, mark long, piece long, start long, length long, bin string, place long, capacity long"


def open_size(length: int, pending: Callable[[int], int], capacities: tuple[int, ...]) -> int:
    """Capacity for a new bin: least expected padding for each token held. ``pending(r)``: tokens in the pieces still to come that fit into r."""
    best, cost = capacities[-1], float("inf")
    for c in capacities:
        if c >= length:
            held = length + min(pending(c - length), c - length)
            if (c - held) / held < cost - 1e-12:
                best, cost = c, (c - held) / held
    return best


def best_fit(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, place in the bin, final capacity of each bin); ``lengths`` must not rise."""
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    bins, places, used, cap = [], [], [], []
    rising = lengths[::-1]
    total = [0, *accumulate(rising)]
    left = len(lengths)
    for n in lengths:
        left -= 1
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(cap)
            cap.append(open_size(n, lambda r: total[min(bisect_right(rising, r), left)], capacities))
            used.append(0)
            free = cap[b]
        bins.append(b)
        places.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, places, [min(c for c in capacities if c >= u) for u in used]


def pack(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokens_per_group: int = TOKENS_PER_GROUP) -> DataFrame:
    """(doc_id, piece, start, length, bin, place, capacity): where each piece of each document lies.

    Tokens are the words of ``text`` (split at space and 0x09 to 0x0D). A document of n tokens has its pieces 0, 1, ... at start 0,
    max capacity, ...; one without tokens, or null, has one piece of length 0 and no bin. Rows alike in doc_id and text are
    packed each for itself. Other columns are ignored. An empty table gives an empty result.
    """
    caps = tuple(sorted(set(capacities)))
    top = caps[-1]
    text = F.coalesce("text", F.lit(""))
    words = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x"), r"[\x20\x09-\x0D]++", ""))
    sized = staged(documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), words.cast("long").alias("tokens")), "sized")
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, -(-total // tokens_per_group))
    pieces = (sized.where("tokens > 0").select("doc_id", "mark", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(top).cast("long"))).alias("piece", "start"), "tokens")
              .select("doc_id", "mark", F.col("piece").cast("long").alias("piece"), "start", F.least(F.lit(top).cast("long"), F.col("tokens") - F.col("start")).alias("length")))
    # a hash of the piece with a random part for rows alike in all: no group grows with a document or its copies
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "mark", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "mark", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, places, final = best_fit(pdf["length"].tolist(), caps)
        g = pdf["group"].iloc[0] if len(pdf) else 0
        return pdf.drop(columns="group").assign(bin=[f"{g}-{b}" for b in bins], place=places, capacity=[final[b] for b in bins])

    packed = grouped.groupBy("group").applyInPandas(one, SCHEMA)
    none = sized.where("tokens = 0").select("doc_id", "mark", *(F.lit(0).cast("long").alias(c) for c in ("piece", "start", "length")), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("capacity"))
    return packed.unionByName(none).drop("mark")

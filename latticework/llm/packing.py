"""Best-fit packing by minimum bin slack.

Only the number of pieces of each length matters for packing, and there are at most
``capacity`` lengths; so the plan is made on the driver from that histogram, whatever the size
of the corpus. Per bin the longest piece left is placed, then subset-sum dynamic programming
over the available lengths (sums as bits of an integer) finds the fullest feasible
combination, which is removed, as often as it can be. Pieces then take their places by their
rank among the pieces of equal length. Ranks come from counts by (length, bucket) and an order
within each bucket. A length has as many buckets as its pieces need at BUCKET_PIECES each, so no
length is ranked in one task, and the table of counts has a row for some thousands of pieces.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import common as C

CAPACITY = 1024
END_ID = 2
BUCKET_PIECES = 8_192
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to ids, the ids of the ``tokenizers`` file at path; made once per process.

    Byte-level BPE files are run by tiktoken with the file's own vocabulary, merges and split
    pattern (same ids, some four times faster); texts that hold a special token's string, and
    other kinds of files, are run by tokenizers itself.
    """
    from tokenizers import Tokenizer

    whole: list = []  # loaded when a text first needs it

    def plain(text: str) -> list[int]:
        if not whole:
            whole.append(Tokenizer.from_file(path))
        return whole[0].encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    simple = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not (simple and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")):
        return plain
    import public_tokenizers
    import tiktoken

    # bytes behind the printable stand-ins of byte-level BPE
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ids = {bytes(stand_in[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    singles = sorted((i, b) for b, i in ids.items() if len(b) == 1)
    pairs = [bytes(stand_in[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    in_order = [b for _, b in singles] + pairs
    # tiktoken merges by rank and returns ranks: ids must rise in the order of merges
    if [ids.get(b) for b in in_order] != sorted(ids.values()):
        return plain
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: ids[b] for b in in_order}, special_tokens={})
    odd = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(text: str) -> list[int]:
        return plain(text) if odd and odd.search(text) else fast.encode_ordinary(text)

    return encode


def _tokenized(path: str, capacity: int, with_ids: bool):
    def run(batches):
        encode = encoder(path)  # by reference: a worker's later tasks find it made
        for batch in batches:
            for part in C.slices(batch, "text", 1_000_000, 10_000):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    first = len(ids) % capacity or capacity
                    for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                        own = ids[a : first if not k else a + capacity]
                        out.append((doc, k, a, len(own), zlib.crc32(own.tobytes()), *([own.astype("i4")] if with_ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])

    return run


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The available lengths with the largest sum up to ``room``: [(length, how many)]."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in map(int, np.flatnonzero(counts[: room + 1])[::-1]):
        left, many = min(int(counts[length]), room // length), 1
        while left:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, many = left - take, many * 2
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + take
            total -= length * take
    return list(found.items())


def _fill(histogram: dict[int, int], capacity: int, share: int) -> list[tuple[int, list[tuple[int, int]]]]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = []
    while (lengths := np.flatnonzero(counts)).size:
        longest = int(lengths[-1])
        counts[longest] -= 1
        inside = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = max(1, min(int(counts[length]) // n for length, n in inside.items()) // share)
        for length, n in inside.items():
            counts[length] -= n * times
        bins.append((times, sorted(inside.items(), reverse=True)))
    return bins


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, pieces of it in each)]).

    A combination is removed as often as it can be, or half or an eighth as often; the plan with
    the fewest bins is returned.
    """
    plans = [_fill(histogram, capacity, share) for share in (1, 2, 8)]
    return min(plans, key=lambda bins: sum(times for times, _ in bins))


def _places(bins, capacity: int):
    """For each length: the first rank of every kind of bin, pieces per bin, first bin, offset in it."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first = {}, 0
    for times, inside in bins:
        offset = 0
        for length, n in inside:
            places.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    places = {length: np.array(p, np.int64) for length, p in places.items()}

    def run(batches):
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            where, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length):
                own = np.flatnonzero(length == one)
                p = places[int(one)]
                k = np.searchsorted(p[:, 0], rank[own], side="right") - 1
                r = rank[own] - p[k, 0]
                where[own], offset[own] = p[k, 2] + r // p[k, 1], p[k, 3] + r % p[k, 1] * one
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(where), pa.array(offset)], [*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked).

    A document is the ids of its text (null: none) and the end id. Longer ones than the capacity
    are cut into full pieces, the first one taking the remainder. Every piece has its own place;
    sequences have no gaps. Repeated documents are packed as often as they occur; other columns
    are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = C.stage(C.need(docs, "doc_id", "text").mapInArrow(C.tidy(_tokenized(tokenizer, capacity, with_ids)), schema), "pack-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row per length
    buckets = F.array(*[F.lit(max(1, -(-histogram.get(length, 0) // BUCKET_PIECES))) for length in range(capacity + 1)])
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.get(buckets, F.col("length").cast("int"))).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    run = _places(minimum_bin_slack(histogram, capacity), capacity)
    return ranked.select(*columns, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")

"""Packing token ids into windows by minimum bin slack.

Every document is tokenized once, where it lies.  Each full window of 2048 ids is a sequence of its own; what is left of a
document, 1 to 2047 ids, is a remainder.  A histogram of remainder lengths (at most 2047 rows, whatever the input) goes to
the driver, which plans patterns: a bitset subset-sum picks the multiset of lengths that fills a window closest to its
capacity, counts are backtracked, and the pattern is repeated as often as the histogram allows.  Remainders then find
their places by their rank within their length.  A sequence at a power of two needs no padding, so a window counts as full
there as well once 2048 is out of reach.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, reach_workers, with_ids, written

CAPACITY = 2048
END_ID = 1
_CACHE_WORDS = 600_000
_TEXTS = 256
_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizers library's.

    A space splits a text into words that the vocabulary's pattern never merges over, as long as no two white-space
    characters stand together; the ids of a word are then kept and used again, and the new words of many texts are encoded
    in one call.  Other texts are encoded whole, those that name a special token by the tokenizers library itself.  The
    memory of words is bounded and starts afresh when full.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        byte_of = _byte_of()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in ranks.items():
            self.opens[i] = token[:1] == b" "
        self.odd = re.compile(r"\s\s|\s\Z|[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        words = [None if self.odd.search(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        new = [w for w in set().union(*(p[1:] for p in words if p)) if w not in known]
        if new:
            ids = np.array(self.fast("x " + " ".join(new)), dtype="<u4")
            at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            for w, a, b in zip(new, at[:-1], at[1:], strict=True):
                known[w] = raw[4 * a : 4 * b]
        return [
            self._whole(t) if p is None else self._whole(p[0]) + b"".join([known[w] for w in p[1:]])
            for t, p in zip(texts, words, strict=True)
        ]


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cut(path: str, capacity: int):
    """Pieces of each row; n counts the task's pieces of a length, from 0, and task names where it counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.uint32(END_ID).tobytes()
        for pdf in batches:
            out = []
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            encoded = (ids for i in range(0, len(texts), _TEXTS) for ids in encode.many(texts[i : i + _TEXTS]))
            for doc_id, ids in zip(pdf["doc_id"], encoded, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    n = len(piece) // 4
                    out.append((doc_id, start, n, zlib.crc32(piece), total, task, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "n"])

    return run


def fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Lengths and multiplicities whose sum is the largest one up to capacity, or a power of two where that wastes less.

    Subset sums are bits of one integer; lengths enter longest first, each as often as its count and the capacity allow
    (in binary parts), and the parts that reach the best sum are traced back.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        left, part = min(int(counts[length]), capacity // length), 1
        while left > 0:
            take = min(part, left)
            before, reach = reach, (reach | reach << (take * length)) & mask
            if reach != before:
                steps.append((length, take, before))
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    if best < capacity:  # a full smaller power of two has no padding at all
        exact = [p for p in (1 << i for i in range(capacity.bit_length())) if p <= capacity and reach >> p & 1]
        best = max(exact, default=best)
    got: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            got[length] = got.get(length, 0) + take
    return sorted(got.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, first, count, each, sequence, offset): the pieces of that length ranked first .. first + count - 1
    go `each` to a sequence, into sequences from `sequence` on, at `offset` and after each other."""
    counts, used = np.zeros(capacity + 1, dtype=np.int64), np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rows, sequence = [], 0
    while counts.any():
        # the longest length that is left always goes in, so that hard lengths are not put off to the end
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        room = capacity - longest
        chosen = dict(fill(counts, room)) if room else {}
        counts[longest] += 1
        if sum(a * b for a, b in chosen.items()) != room:  # capacity is out of reach: any full power of two will do
            free = dict(fill(counts, capacity))
            total = sum(a * b for a, b in free.items())
            if total & (total - 1) == 0:
                chosen, longest = free, 0
        if longest:
            chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(int(counts[a]) // b for a, b in chosen.items()), 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.append((length, int(used[length]), each * times, each, sequence, offset))
            used[length] += each * times
            counts[length] -= each * times
            offset += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "count", "each", "sequence", "offset"])


def placed(table: pd.DataFrame, capacity: int):
    """Sequence and offset of ranked pieces; a full piece gets an odd id of its own, patterns get even ids."""
    by = {k: g.sort_values("first") for k, g in table.groupby("length")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for k in np.unique(length):
                own = length == k
                r = rank[own]
                if k == capacity:
                    sequence[own] = 2 * r + 1
                    continue
                g = by[k]
                at = np.searchsorted(g["first"].to_numpy(), r, side="right") - 1
                i = r - g["first"].to_numpy()[at]
                sequence[own] = 2 * (g["sequence"].to_numpy()[at] + i // g["each"].to_numpy()[at])
                offset[own] = g["offset"].to_numpy()[at] + i % g["each"].to_numpy()[at] * k
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    - null or empty text: the end id alone; a null doc_id is packed like any other
    - repeated rows: each is packed
    - very long texts: cut at every 2048 ids
    - empty table: no rows; other columns are not read and may have any names
    """
    spark = docs.sparkSession
    reach_workers(spark)
    path = vocabulary or default_vocabulary()
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, task long, n long"
    pieces = written(docs.select(id_text(), "text").mapInPandas(cut(path, capacity), schema), "pieces")
    totals = pieces.groupBy("task", "length").agg(F.count("*").alias("c"))
    histogram = {r["length"]: r["c"] for r in totals.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most 2048 rows
    before = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(totals.select("task", "length", before.alias("base")), ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("n")).alias("rank")
    )
    table = plan({k: v for k, v in histogram.items() if k != capacity}, capacity)
    out = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return with_ids(ranked.mapInPandas(placed(table, capacity), out))

"""Removal of bytes covered by a 50-byte string that a document with a smaller id also holds, by suffix sorting.

Windows of 50 bytes are dealt by content: a window's mark is the least hash of the 24-byte strings in it, so equal windows
have equal marks, and neighbours mostly share theirs.  Marks of only one document need no sorting.  A batch of documents
sends each of its marks once, with the document that has it or a sign for several, and is told which ones are shared.
The stretches under those are sorted, a task at a time, by deep-shallow suffix sorting: multikey quicksort over 8-byte words
to a shallow depth, and blind tries for the groups of suffixes that still share their prefix there.

A batch of documents sends each stretch once, with the smallest id that holds it; the places where it stands stay behind.
What sorting finds out (the smallest id of each window, in runs) goes back to the batches, so a passage that a third of all
documents hold makes one short row for a batch and no task sees all its places.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, parts, reach_workers, with_ids, written
from .shingles import _power, mix

LENGTH = 50
GRAM = 24
SHALLOW = 3  # words of 8 bytes
_BATCH = 1024
_FINE = 8  # parts of a bucket of stretches, sorted one after another
_BITS = 1 << 24
NO_ID = (1 << 63) - 1
SEVERAL = -1 << 63  # stands for a key


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each stretch of `width` numbers."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def marks(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(mark, first window) of each run of windows with one mark."""
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.frombuffer(raw, np.uint8)
    up, down = _power(len(a) + 1)
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])))
    n = len(a) - gram + 1
    m = _least(mix((s[gram:] - s[:n]) * down[:n]), length - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    return m[first], first


def _tags(mark: np.ndarray) -> np.ndarray:
    """32 bits of each mark.  Marks that share a bucket and a tag by chance only add stretches to sort."""
    return (mix(mark, 7) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _marks(buckets: int, length: int, gram: int):
    """Blobs of the marks of each batch of documents: for a bucket each tag once, with the key of the document that has it
    or SEVERAL; and a row of bucket -1 with the batch's keys and all their tags, document by document.

    The number of a batch is random: the blobs are to be written before they are used twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), _BATCH):
                part = pdf.iloc[i : i + _BATCH]
                found = [np.unique(_tags(marks(t.encode("utf-8", "replace"), length, gram)[0])) for t in part["text"]]
                keys, counts = part["key"].to_numpy("<i8"), np.array([len(f) for f in found], dtype="<u4")
                tag, batch = np.concatenate(found), uuid.uuid4().int >> 65
                rows = [(-1, batch, tag.tobytes(), keys.tobytes(), counts.tobytes())]
                own = np.repeat(keys, counts)
                order = np.lexsort((tag, tag % np.uint32(buckets)))
                tag, own = tag[order], own[order]
                start = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
                tag, own = tag[start], np.where(np.minimum.reduceat(own, start) == np.maximum.reduceat(own, start), own[start], SEVERAL)
                bucket = tag % np.uint32(buckets)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    x, y = cuts[b], cuts[b + 1]
                    rows.append((b, batch, tag[x:y].tobytes(), own[x:y].tobytes(), None))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "tags", "keys", "counts"])

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each blob of a bucket its tags that several documents have: as many rows as came in."""
    batch, size, tag, keys = [], [], [], []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            batch.append(r.batch)
            tag.append(np.frombuffer(r.tags, "<u4"))
            keys.append(np.frombuffer(r.keys, "<i8"))
            size.append(len(tag[-1]))
    if not tag:
        return
    tag, keys = np.concatenate(tag), np.concatenate(keys)
    order = np.argsort(tag, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], tag[order][1:] != tag[order][:-1])))
    least = np.minimum.reduceat(keys[order], start)
    many = (least == SEVERAL) | (least != np.maximum.reduceat(keys[order], start))
    keep = np.empty(len(tag), dtype=bool)
    keep[order] = np.repeat(many, np.diff(np.append(start, len(tag))))
    cuts = np.cumsum(size)[:-1]
    yield pd.DataFrame({"batch": batch, "tags": [t[k].tobytes() for t, k in zip(np.split(tag, cuts), np.split(keep, cuts), strict=True)]})


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, tags) of each document that shares a tag, from rows that come batch by batch."""

    def told(home, shared: list[bytes]) -> Iterator[pd.DataFrame]:
        tags, keys, counts = (np.frombuffer(x, t) for x, t in zip(home, ("<u4", "<i8", "<u4"), strict=True))
        keep = np.isin(tags, np.frombuffer(b"".join(shared), "<u4"))
        parts_ = [t[k] for t, k in zip(np.split(tags, np.cumsum(counts)[:-1]), np.split(keep, np.cumsum(counts)[:-1]), strict=True)]
        rows = [(k, t.tobytes()) for k, t in zip(keys.tolist(), parts_, strict=True) if len(t)]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "tags"])

    batch, home, shared = None, None, []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.batch != batch:
                if home and shared:
                    yield from told(home, shared)
                batch, home, shared = r.batch, None, []
            if r.keys is not None:
                home = r.tags, r.keys, r.counts
            elif r.tags:
                shared.append(r.tags)
    if home and shared:
        yield from told(home, shared)


def _stretches(buckets: int, length: int, gram: int):
    """Blobs of the text under shared marks: each stretch once for a batch, with its smallest id and the places where it
    stands (document of the batch, byte); and a row of bucket -1 with the ids and keys of the batch's documents.

    The number of a batch is random: the blobs are to be written before they are used twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), _BATCH):
                part = pdf.iloc[i : i + _BATCH]
                ids, keys = part["id"].to_numpy("<i8"), part["key"].to_numpy("<i8")
                held: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
                for j, (text, tags) in enumerate(zip(part["text"], part["tags"], strict=True)):
                    raw = text.encode("utf-8", "replace")
                    mark, first = marks(raw, length, gram)
                    last = np.append(first[1:], len(raw) - length + 1)
                    wanted = np.isin(_tags(mark), np.frombuffer(tags, "<u4"))
                    for m, a, b in zip((mark[wanted] % np.uint64(buckets * _FINE)).tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                        held.setdefault(m, {}).setdefault(raw[a : b - 1 + length], []).append((j, a))
                batch = uuid.uuid4().int >> 65
                rows = [(-1, batch, None, None, None, None, None, None, None, ids.tobytes(), keys.tobytes())]
                for b in sorted({m % buckets for m in held}):
                    shares = [held.get(b + k * buckets, {}) for k in range(_FINE)]
                    found = [x for share in shares for x in share.items()]
                    places = np.array([p for _, ps in found for p in ps])
                    counts = np.array([len(ps) for _, ps in found])
                    least = np.minimum.reduceat(ids[places[:, 0]], np.cumsum(counts) - counts)
                    sizes = np.array([len(t) for t, _ in found], "<u4")
                    fine = np.array([len(share) for share in shares], "<u4")
                    rows.append((b, batch, b"".join(t for t, _ in found), fine.tobytes(), sizes.tobytes(), least.tobytes(), counts.astype("<u4").tobytes(),
                                 places[:, 0].astype("<u2").tobytes(), places[:, 1].astype("<u4").tobytes(), None, None))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "texts", "fine", "sizes", "least", "counts", "own", "at", "ids", "keys"])

    return run


class BlindTrie:
    """Orders equally long byte strings: inner nodes hold only the position of the first differing byte."""

    def __init__(self):
        self.root = None  # a leaf is [string, items]; an inner node is (position, {byte: node})

    def add(self, string: bytes, item) -> None:
        if self.root is None:
            self.root = [string, [item]]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent: any leaf below tells the common prefix
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == string:
            node[1].append(item)
            return
        differs = next(i for i, (x, y) in enumerate(zip(other, string, strict=True)) if x != y)
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < differs:
            parent, node = node, node[1][string[node[0]]]
        leaf = [string, [item]]
        if isinstance(node, tuple) and node[0] == differs:
            node[1][string[differs]] = leaf
            return
        new = (differs, {other[differs]: node, string[differs]: leaf})
        if parent is None:
            self.root = new
        else:
            parent[1][string[parent[0]]] = new

    def groups(self) -> Iterator[list]:
        """Items of equal strings, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def equal_groups(buffer: bytes, at: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """A number for each suffix at these places: equal for equal first `length` bytes.

    Multikey quicksort with words for characters: a round sorts the suffixes of each group by their next word, and the next
    round goes on within the groups of two or more that are still equal.  Blind tries order what is equal at the shallow
    depth; a trie that would have one leaf alone is compared whole, many at a time.
    """
    raw = np.ndarray(max(0, len(buffer) - 7), dtype=">u8", buffer=buffer, strides=(1,)) if length >= 8 else None
    depth = max(0, min(shallow, length // 8))
    order = np.arange(len(at))
    new = np.zeros(len(at), dtype=bool)  # where a group starts
    new[:1] = True
    for k in range(depth):
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)  # whole groups, one after another
        if not len(open_):
            break
        word = raw[at[order[open_]] + 8 * k].astype(np.uint64)  # big-endian, so that numbers sort as bytes do
        sort = np.argsort(word, kind="quicksort") if k == 0 else np.lexsort((word, group[open_]))
        order[open_], word = order[open_][sort], word[sort]
        differs = word[1:] != word[:-1]
        new[open_[1:][differs]] = True
    # what is left of the suffixes against the first one of their group; most groups are one string
    head = at[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    differs = np.zeros(len(at), dtype=bool)
    for j in sorted({*range(8 * depth, length - 7, 8), max(0, length - 8)}) if raw is not None else ():
        differs |= raw[at[order] + j] != raw[head + j]
    if raw is None:
        differs[:] = True
    group = np.cumsum(new) - 1
    out = np.empty(len(at), dtype=np.int64)
    out[order] = group
    extra = len(at)
    for g in np.unique(group[differs]).tolist():
        trie = BlindTrie()
        for i in order[np.searchsorted(group, g) : np.searchsorted(group, g, side="right")].tolist():
            trie.add(buffer[at[i] : at[i] + length], i)
        for items in trie.groups():
            out[items] = extra
            extra += 1
    return out


def _slices(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of several slices, one after another."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _ranked(rows: list, length: int) -> pd.DataFrame:
    """(bucket, batch, runs, ends, lowest) of one bucket's blobs: for each stretch the number of its runs of windows with
    one smallest id, and for each run its end and that id."""
    out = [(r.bucket, r.batch, [], [], []) for r in rows]
    cuts = [np.concatenate(([0], np.cumsum(np.frombuffer(r.fine, "<u4")))).astype(np.int64).tolist() for r in rows]
    ends = [np.concatenate(([0], np.cumsum(np.frombuffer(r.sizes, "<u4")))).astype(np.int64).tolist() for r in rows]
    for k in range(_FINE):
        texts = [[r.texts[a:b] for a, b in zip(e[c[k] : c[k + 1]], e[c[k] + 1 : c[k + 1] + 1], strict=True)] for r, c, e in zip(rows, cuts, ends, strict=True)]
        if any(texts):
            least = [np.frombuffer(r.least, "<i8")[c[k] : c[k + 1]] for r, c in zip(rows, cuts, strict=True)]
            for o, found in zip(out, _runs(texts, least, length), strict=True):
                for have, new in zip(o[2:], found, strict=True):
                    have.append(new)
    return pd.DataFrame([(b, n, *map(b"".join, lists)) for b, n, *lists in out], columns=["bucket", "batch", "runs", "ends", "lowest"])


def _runs(texts: list[list[bytes]], least: list[np.ndarray], length: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    """For each blob the numbers, ends and smallest ids of its stretches' runs, from suffixes of all the blobs."""
    known: dict[bytes, int] = {}
    which = [np.array([known.setdefault(t, len(known)) for t in own], dtype=np.int64) for own in texts]
    sizes = np.array([len(t) for t in known], dtype=np.int64)
    lowest = np.full(len(known), NO_ID)
    np.minimum.at(lowest, np.concatenate(which), np.concatenate(least))
    base, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    first = np.cumsum(windows) - windows
    stretch = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(windows.sum()) - first[stretch]
    group = equal_groups(b"".join(known), base[stretch] + offset, length)
    smallest = np.full(int(group.max()) + 1, NO_ID)
    np.minimum.at(smallest, group, lowest[stretch])
    smallest = smallest[group]
    new = np.concatenate(([True], (smallest[1:] != smallest[:-1]) | (offset[1:] == 0)))
    begin = np.flatnonzero(new)
    runs = np.bincount(stretch[begin], minlength=len(sizes))
    end = (offset[np.append(begin[1:], len(new)) - 1] + 1).astype("<u4")
    start = np.cumsum(runs) - runs
    for own in which:
        at = _slices(start[own], runs[own])
        yield runs[own].astype("<u4").tobytes(), end[at].tobytes(), smallest[begin[at]].astype("<i8").tobytes()


def _sorted(length: int):
    """What sorting finds for each blob; rows come bucket by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = [], None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if held and r.bucket != bucket:
                    yield _ranked(held, length)
                    held = []
                bucket = r.bucket
                held.append(r)
        if held:
            yield _ranked(held, length)

    return run


def _merged(docs, places: dict, ranks: dict, length: int) -> pd.DataFrame:
    """(id, key, spans) of the documents of one batch: the bytes at their places whose windows a smaller id also has."""
    ids, keys = (np.frombuffer(x, "<i8") for x in docs)
    owns, begins, closes = [], [], []
    for bucket, (counts, own, at) in places.items():
        runs, ends, lowest = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(ranks[bucket], ("<u4", "<u4", "<i8"), strict=True))
        opens = np.concatenate(([0], ends[:-1]))
        opens[np.cumsum(runs) - runs] = 0
        of = np.repeat(np.arange(len(runs)), np.frombuffer(counts, "<u4"))
        run, place = _slices((np.cumsum(runs) - runs)[of], runs[of]), np.repeat(np.arange(len(of)), runs[of])
        own, at = np.frombuffer(own, "<u2").astype(np.int64)[place], np.frombuffer(at, "<u4").astype(np.int64)[place]
        gone = lowest[run] < ids[own]
        owns.append(own[gone])
        begins.append((at + opens[run])[gone])
        closes.append((at + ends[run] - 1 + length)[gone])
    own, begin, close = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owns, begins, closes))
    own = own << 40  # documents one after another
    order = np.argsort(own + begin)
    own, begin, close = own[order], (own + begin)[order], np.maximum.accumulate((own + close)[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > close[:-1]))) if len(own) else np.zeros(0, np.int64)
    doc = own[new] >> 40
    spans = np.c_[begin[new] - own[new], close[np.append(new[1:], len(own)) - 1] - own[new]].astype("<i8") if len(new) else np.zeros((0, 2), "<i8")
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return pd.DataFrame({"id": ids[doc[start]], "key": keys[doc[start]], "spans": [x.tobytes() for x in np.split(spans, start[1:])] if len(start) else []})


def _spans(length: int):
    """(id, key, spans) of each document with something to remove; rows come batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, docs, places, ranks = None, None, {}, {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.batch != batch:
                    if docs:
                        yield _merged(docs, places, ranks, length)
                    batch, docs, places, ranks = r.batch, None, {}, {}
                if r.bucket < 0:
                    docs = r.ids, r.keys
                elif r.runs is None:
                    places[r.bucket] = r.counts, r.own, r.at
                else:
                    ranks[r.bucket] = r.runs, r.ends, r.lowest
        if docs:
            yield _merged(docs, places, ranks, length)

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, spans in zip(pdf.pop("text"), pdf.pop("spans"), strict=True):
            raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
            step = np.zeros(len(raw) + 1, dtype=np.int64)
            if spans:
                s = np.frombuffer(spans, "<i8").reshape(-1, 2)
                np.add.at(step, s[:, 0], 1)
                np.add.at(step, s[:, 1], -1)
            gone = np.cumsum(step)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            runs = np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) > 0)
            out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        yield pd.concat((pdf.reset_index(drop=True), got), axis=1)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) for each row.

    - null or empty text: no bytes
    - a null doc_id counts as larger than any id; rows that repeat an id have no smaller one among them, and stay
    - very long texts are read whole; empty table: no rows; other columns are not read and may have any names
    """
    spark = docs.sparkSession
    reach_workers(spark)
    n, gram = parts(spark), min(GRAM, length)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text")
    long_ = rows.where(F.octet_length("text") >= length)
    blobs = long_.select("key", "text").mapInPandas(_marks(n, length, gram), "bucket int, batch long, tags binary, keys binary, counts binary")
    blobs = written(blobs, "marks")
    met = blobs.where("bucket >= 0").select("bucket", "batch", "tags", "keys").repartition(n, "bucket").mapInPandas(_shared, "batch long, tags binary")
    told = blobs.where("bucket < 0").select("batch", "tags", "keys", "counts").unionByName(met, allowMissingColumns=True)
    shared = written(told.repartition(n, "batch").sortWithinPartitions("batch").mapInPandas(_own, "key long, tags binary"), "shared")
    discard(blobs)
    spot, bit = F.shiftright(F.pmod("key", F.lit(_BITS)), 6), F.expr("shiftleft(1L, cast(pmod(key, 64) AS INT))")
    # at most _BITS / 64 rows, whatever the input: most documents without a shared mark are told apart without a shuffle
    bits = F.broadcast(shared.select(spot.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")))
    maybe = rows.join(bits, spot == F.col("w"), "left").withColumn("hit", F.coalesce(F.col("b").bitwiseAND(bit) != 0, F.lit(False)))
    own = shared.groupBy("key").agg(F.max("tags").alias("tags"))  # rows that repeat id and text have the same ones
    hits = maybe.where("hit").select("doc_id", "id", "key", "text")
    found = hits.select("id", "key", "text").join(own, "key").select("id", "key", "text", "tags").mapInPandas(
        _stretches(n, length, gram),
        "bucket int, batch long, texts binary, fine binary, sizes binary, least binary, counts binary, own binary, at binary, ids binary, keys binary")
    found = written(found, "stretches")
    dealt = found.where("bucket >= 0").select("bucket", "batch", "texts", "fine", "sizes", "least").repartition(n, "bucket").sortWithinPartitions("bucket")
    ranked = dealt.mapInPandas(_sorted(length), "bucket int, batch long, runs binary, ends binary, lowest binary")
    home = found.select("bucket", "batch", "counts", "own", "at", "ids", "keys").unionByName(ranked, allowMissingColumns=True)
    spans = written(home.repartition(n, "batch").sortWithinPartitions("batch").mapInPandas(_spans(length), "id long, key long, spans binary"), "spans")
    discard(found)
    spans = spans.groupBy("id", "key").agg(F.max("spans").alias("spans"))
    whole = maybe.where("NOT hit").select("doc_id", "text", F.lit(None).cast("binary").alias("spans")).unionByName(
        hits.join(spans, ["id", "key"], "left").select("doc_id", "text", "spans"))
    return with_ids(whole.withColumn("doc_id", id_text()).mapInPandas(_cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))

"""N-gram Jaccard self-join with prefix filters under several global token orders.

Documents with equal shingle sets form one class and are joined once.  Two sets of similarity t or more share a token among
the first n - ceil(t n) + 1 of either, in any global order.  Order 1 puts tokens that a fixed-size count sketch finds
frequent last, so passages that many documents share rarely enter a prefix; orders 2 and 3 are two independent hashes.
A pair is a candidate only if its prefixes meet under all three: the token of order 1 brings classes together, and whole
sets are made only for pairs whose prefixes of orders 2 and 3 meet as well.  Sizes, the token's places and small parity maps
rule pairs out before they leave a bucket, larger maps after: tokens outside the intersection alone tell two maps apart, so
maps that differ in more bits than a linked pair has such tokens rule the link out, and lose none.

A bucket of a token does not emit all its pairs.  Every class first meets the least class with the same first token of
order 2 or 3; what that links is merged, and only classes of a bucket that still lie in different components are compared
with each other, which loses no component.  A large bucket is dealt out once more by the tokens of order 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_text, parts, reach_workers, sieved, with_ids, written
from .shingles import class_of, mix, sets

SKETCH = 1 << 20
CHUNK = 1 << 14
#: The order by frequency, and those by a hash alone.
FREQUENCY, HASHED = 1, (2, 3)
_TEXTS = 256
_MEMBERS = 256
_BITS = 1 << 24
_MAP = 256
_MAPS = [f"m{i}" for i in range(_MAP // 64)]


def enough(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in order 1, in that order: rare before frequent by the sketch, then by a hash."""
    n = len(s)
    k = prefix_length(n, percent)
    key = np.minimum(mix(s, FREQUENCY) >> np.uint64(6), np.uint64((1 << 58) - 1)) | (sketch[(s >> np.uint64(20)) & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(58))
    head = np.argpartition(key, k - 1)[:k] if k < n else np.arange(n)
    return s[head[np.argsort(key[head])]]


def hashed_prefix(s: np.ndarray, order: int, percent: int) -> tuple[int, np.ndarray]:
    """The first token of a set in an order by hash, and 32 bits of each token of the prefix, sorted."""
    h, k = mix(s, order), prefix_length(len(s), percent)
    if k < len(h):
        h = np.partition(h, k - 1)[:k]
    return int(h.min().view(np.int64)), np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def parity(s: np.ndarray) -> np.ndarray:
    """_MAP bits or more, a power of two with two bits for each token, as signed 64-bit numbers; each token turns one over."""
    size = max(_MAP, 2 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s, 9) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def folded(bits: np.ndarray) -> np.ndarray:
    """The map laid over itself, _MAP bits long."""
    return np.bitwise_xor.reduce(bits.reshape(-1, _MAP // 64), axis=0)


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, empty = np.zeros(SKETCH, dtype=np.uint32), True
        for pdf in batches:
            got, texts = [], pdf["text"].tolist()
            for i in range(0, len(texts), _TEXTS):
                for s in sets(texts[i : i + _TEXTS], width):
                    if len(s):
                        firsts, heads = zip(*(hashed_prefix(s, o, percent) for o in HASHED), strict=True)
                        bits = parity(s)
                        got.append((len(s), class_of(s), firsts, *heads, folded(bits), bits))
                    else:
                        got.append((0, *(None,) * 6))
                    np.add.at(counts, (s >> np.uint64(20)) & np.uint64(SKETCH - 1), 1)
            empty = False
            n, cls, firsts, second, third, small, bits = zip(*got, strict=True) if got else ([],) * 7
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "n": n, "cls": pd.array(cls, dtype="Int64"), "firsts": firsts, "second": second, "third": third,
                                "map": small, "bits": bits, "chunk": pd.array([None] * len(n), dtype="Int32"), "counts": None})
        if not empty:
            for c in range(0, SKETCH, CHUNK):
                none = pd.array([None], dtype="Int64")
                yield pd.DataFrame({"doc_id": [None], "key": none, "n": [0], "cls": none, "firsts": [None], "second": [None], "third": [None],
                                    "map": [None], "bits": [None], "chunk": pd.array([c // CHUNK], dtype="Int32"), "counts": [counts[c : c + CHUNK].tobytes()]})

    return run


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got: dict[int, np.ndarray] = {}
    for pdf in batches:
        for c, raw in zip(pdf["chunk"], pdf["counts"], strict=True):
            got[c] = got.get(c, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
    yield pd.DataFrame({"chunk": list(got), "counts": [v.tobytes() for v in got.values()]})


def sketch_of(signatures: DataFrame) -> np.ndarray:
    """Levels of the fixed-size count sketch (one byte each, SKETCH in all): 0 up to what chance puts into a cell beside
    its like, then logarithms of the excess."""
    rows = signatures.where("chunk IS NOT NULL").repartition(SKETCH // CHUNK, "chunk").select("chunk", "counts").mapInPandas(_add_up, "chunk int, counts binary").collect()
    total = np.zeros(SKETCH, dtype=np.int64)
    for r in rows:  # SKETCH / CHUNK rows, 8 MB
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    usual = float(np.median(total))
    return np.minimum(63, np.ceil(2 * np.log2(np.maximum(1, (total - usual) / (4 + 3 * usual**0.5))))).astype(np.uint8)


def _emit(width: int, percent: int, buckets: int, sketch):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i in range(0, len(texts), 2048):
                known: dict[int, tuple[int, np.ndarray]] = {}
                for j in range(i, min(len(texts), i + 2048), _TEXTS):
                    for s in sets(texts[j : min(j + _TEXTS, i + 2048)], width):
                        if len(s) and (c := class_of(s)) not in known:
                            known[c] = len(s), prefix(s, sketch.value, percent)
                if not known:
                    continue
                token = np.concatenate([p for _, p in known.values()])
                own = np.repeat(np.arange(len(known), dtype=np.uint16), [len(p) for _, p in known.values()])
                place = np.concatenate([np.minimum(np.arange(len(p)), 65535) for _, p in known.values()]).astype("<u2")
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                cls, n = np.array(list(known), dtype="<i8"), np.array([k for k, _ in known.values()], dtype="<u4")
                rows = []
                for b in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[b] : cuts[b + 1]]
                    used, local = np.unique(own[at], return_inverse=True)
                    rows.append((int(b), token[at].tobytes(), local.astype("<u2").tobytes(), place[at].tobytes(), cls[used].tobytes(), n[used].tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "tokens", "own", "place", "cls", "n"])

    return run


def _meet():
    """(token, cls, n, place) of the tokens that two classes or more have in their prefixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, cls, n, place = [], [], [], []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own = np.frombuffer(r.own, "<u2")
                token.append(np.frombuffer(r.tokens, "<u8"))
                cls.append(np.frombuffer(r.cls, "<i8")[own])
                n.append(np.frombuffer(r.n, "<u4")[own])
                place.append(np.frombuffer(r.place, "<u2"))
        if not token:
            return
        token, cls, n, place = (np.concatenate(x) for x in (token, cls, n, place))
        order = np.lexsort((cls, token))
        token, cls, n, place = token[order], cls[order], n[order].astype(np.int64), place[order].astype(np.int64)
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        token, cls, n, place = token[new], cls[new], n[new], place[new]
        same = token[1:] == token[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        token, cls, n, place = token[keep], cls[keep], n[keep], place[keep]
        for i in range(0, len(token), 100_000):
            yield pd.DataFrame({"token": token[i : i + 100_000].view("<i8"), "cls": cls[i : i + 100_000], "n": n[i : i + 100_000], "place": place[i : i + 100_000]})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i in range(0, len(texts), _TEXTS):
                got = [(class_of(s), s.tobytes()) for s in sets(texts[i : i + _TEXTS], width) if len(s)]
                yield pd.DataFrame(got, columns=["cls", "tokens"])

    return run


def _verify(percent: int):
    """Links (a, b) from rows that are sorted by (pivot, salt) with the pivot's own set first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = None, None
        for pdf in batches:
            links = []
            for pivot, member, head, raw in zip(pdf["pivot"], pdf["member"], pdf["head"], pdf["tokens"], strict=True):
                s = np.frombuffer(raw, "<u8")
                if head:
                    at, mine = pivot, s
                elif at == pivot:
                    common = int((mine[np.minimum(np.searchsorted(mine, s), len(mine) - 1)] == s).sum())
                    if enough(common, len(mine), len(s), percent):
                        links.append((pivot, member))
            yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes of orders 2 and 3 meet, and whose parity maps differ in no more bits than linked sets of their
    sizes have tokens apart."""

    def side(end: str) -> DataFrame:
        return classes.select(F.col("cls").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", "second", "third", "bits")))

    def laid(own: str, other: str) -> str:
        """The map laid over itself, so that it is as long as the other one."""
        halves = f"zip_with(slice({own}, 1, size({other})), slice({own}, size({other}) + 1, size({other})), (x, y) -> x ^ y)"
        return f"IF(size({own}) > size({other}), {halves}, {own})"

    differ = f"aggregate(zip_with({laid('pivot_bits', 'member_bits')}, {laid('member_bits', 'pivot_bits')}, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"
    far = "greatest(size(pivot_bits), size(member_bits)) > 2 * least(size(pivot_bits), size(member_bits))"  # only below 50 percent
    both = pairs.join(side("pivot"), "pivot").join(side("member"), "member")
    both = both.where("arrays_overlap(pivot_second, member_second) AND arrays_overlap(pivot_third, member_third)")
    return both.where(f"{far} OR {100 + percent} * {differ} <= {100 - percent} * (pivot_n + member_n)").select("pivot", "member")


def _held(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cls, tokens) of the classes, once each, and of texts that pass for theirs by chance."""
    spot = F.pmod(F.xxhash64("key"), F.lit(_BITS))
    bit = "shiftleft(1L, cast(pmod(xxhash64(key), 64) AS INT))"
    # at most _BITS / 64 rows of 16 bytes, whatever the input
    bits = classes.select(F.shiftright(spot, 6).alias("w"), F.expr(bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    some = docs.join(F.broadcast(bits), F.shiftright(spot, 6) == F.col("w")).where(f"b & {bit} <> 0").dropDuplicates(["key"])  # rows that repeat id and text
    return written(some.select("text").mapInPandas(_sets(width), "cls long, tokens binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (pivot, member) that link, as a written table.  A pivot with many members is copied to several tasks."""
    n = parts(pairs.sparkSession)
    pairs = written(_likely(pairs, classes, percent), "likely")
    ends = pairs.select(F.explode(F.array("pivot", "member")).alias("cls")).distinct()
    held = _held(docs, classes.join(ends, "cls", "left_semi"), width)
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / _MEMBERS).alias("salts"))
    members = pairs.join(many, "pivot").select("pivot", F.pmod(F.xxhash64("member"), "salts").alias("salt"), "member", F.lit(False).alias("head")).join(held.withColumnRenamed("cls", "member"), "member")
    heads = many.join(held.withColumnRenamed("cls", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("member"), F.lit(True).alias("head"), "tokens")
    rows = heads.unionByName(members.select(*heads.columns)).repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("head"))
    out = written(rows.mapInPandas(_verify(percent), "a long, b long"), "links")
    discard(pairs, held)
    return out


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for every end of a link: comp is the smallest class that links reach.  Minimum labels with pointer jumping."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "cls", "left").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        hooked = written(hooked, "labels")
        jump = hooked.select(F.col("cls").alias("comp"), F.col("comp").alias("root"))
        out = written(hooked.join(jump, "comp", "left").select("cls", "was", F.coalesce("root", "comp").alias("comp")), "labels")
        discard(labels, hooked)
        labels = out
        if not labels.where("was <> comp").limit(1).count():
            discard(edges)
            return labels.select("cls", "comp")


_LONG = 512
#: Buckets of more open rows are dealt out by the tokens of order 2.
_SPLIT = 1 << 12


def _tried(start: np.ndarray, length: np.ndarray, comp: np.ndarray, reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each bucket: all of different components, those at most `reach` apart, or (0) those with the first."""
    rows = int(length.sum())
    if reach == 0:
        yield np.repeat(start, length - 1), np.delete(np.arange(rows), start)
        return
    loop = (length <= _LONG) if reach is None else (length > 0)
    short, left = np.repeat(loop, length), np.repeat(start + length, length) - np.arange(rows)  # rows of the bucket from here on
    for k in range(1, min(int(length[loop].max(initial=0)), (reach or _LONG) + 1)):
        a = np.flatnonzero(short & (left > k))
        yield a, a + k
    for s, c in zip(start[~loop], length[~loop], strict=True):
        _, which, size = np.unique(comp[s : s + c], return_inverse=True, return_counts=True)
        for i in np.argsort(size, kind="stable"):  # classes of the smaller components against all later ones
            later = s + np.flatnonzero((size[which] > size[i]) | ((size[which] == size[i]) & (which > i)))
            for j in s + np.flatnonzero(which == i):
                yield np.full(len(later), j), later


def _candidates(percent: int, reach: int | None):
    """Pairs of a bucket that lie in different components and whose sizes, maps and places of this token allow a link."""

    def each(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        token, cls, comp, n, place = (pdf[c].to_numpy() for c in ("token", "cls", "comp", "n", "place"))
        maps = [pdf[c].to_numpy().view(np.uint64) for c in _MAPS]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        rest, out = n - place, set()
        for a, b in _tried(start, np.diff(np.append(start, len(token))), comp, reach):
            ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            # If this is the sets' first common token, at most what stands from it on is common; for any later common
            # token less is, so a pair that links passes at its first one.
            ok &= np.minimum(rest[a], rest[b]) * (100 + percent) >= percent * (n[a] + n[b])
            a, b = a[ok], b[ok]
            differ = sum(np.bitwise_count(m[a] ^ m[b]).astype(np.int64) for m in maps)
            ok = (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])
            a, b = cls[a[ok]], cls[b[ok]]
            out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
        if out:
            yield pd.DataFrame(sorted(out), columns=["pivot", "member"])

    return _by_token(each)


def _by_token(each):
    """Runs `each` on whole buckets of rows that come token by token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat((left, pdf), ignore_index=True)
            if len(pdf):
                whole = pdf["token"].to_numpy() != pdf["token"].iloc[-1]
                left = pdf[~whole]
                if whole.any():
                    yield from each(pdf[whole])
        if left is not None and len(left):
            yield from each(left)

    return run


def _open(shared: DataFrame, merged: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the buckets that hold classes of several components, bucket by bucket: with comp, the size of the bucket and
    the class's small map."""
    at = shared.join(merged, "cls", "left").join(classes.select("cls", *_maps()), "cls").withColumn("comp", F.coalesce("comp", "cls"))
    own = Window.partitionBy("token")
    ends = {"lo": F.min("comp").over(own), "hi": F.max("comp").over(own), "size": F.count("*").over(own)}
    return at.withColumns(ends).where("lo <> hi").select("token", "cls", "comp", "n", "place", "size", *_MAPS)


def _maps() -> list[Column]:
    return [F.col("map")[i].alias(c) for i, c in enumerate(_MAPS)]


def _met(rows: DataFrame, classes: DataFrame, percent: int, reach: int | None) -> DataFrame:
    """Candidates (pivot, member) of rows that come bucket by bucket.  A large bucket is dealt out by the tokens of order 2:
    a pair that links has one of them in common too."""
    schema = "pivot long, member long"
    small = rows if reach is not None else rows.where(F.col("size") <= _SPLIT)
    pairs = small.sortWithinPartitions("token", *(["cls"] if reach == 0 else ["n", "cls"])).mapInPandas(_candidates(percent, reach), schema)
    if reach is None:
        large = rows.where(F.col("size") > _SPLIT).join(classes.select("cls", "second"), "cls").withColumn("other", F.explode("second"))
        large = large.withColumn("token", F.xxhash64("token", "other")).drop("second", "other")
        large = large.repartition(parts(rows.sparkSession), "token").sortWithinPartitions("token", "n", "cls")
        pairs = pairs.unionByName(large.mapInPandas(_candidates(percent, None), schema))
    return pairs.distinct()


def join(docs: DataFrame, percent: int = 80, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has a row for each row of docs (doc_id, n_shingles, cls, component_id, key, first), links
    pairs of classes (a, b) whose links make up the components.  key is the row's hash of doc_id and text; first marks the
    rows of the component's smallest (doc_id, key), null ids last.

    - null text, or one without words: an empty set, linked with nothing, its own component
    - repeated rows and equal sets share a class; a null doc_id takes part, and names no component unless all ids are null
    - very long texts are hashed whole; hashes have 64 bits
    - empty table: no rows; other columns are not read and may have any names
    """
    spark = docs.sparkSession
    reach_workers(spark)
    n_parts = parts(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("key"))
    schema = "doc_id string, key long, n long, cls long, firsts array<long>, second array<int>, third array<int>, map array<long>, bits array<long>, chunk int, counts binary"
    signatures = written(docs.withColumn("doc_id", id_text()).mapInPandas(_signatures(width, percent), schema), "signatures")
    sketch = spark.sparkContext.broadcast(sketch_of(signatures))  # SKETCH bytes
    members = with_ids(signatures.where("chunk IS NULL")).select("doc_id", F.col("n").alias("n_shingles"), "cls", "key")

    blobs = docs.where("text IS NOT NULL").mapInPandas(_emit(width, percent, n_parts, sketch), "bucket int, tokens binary, own binary, place binary, cls binary, n binary")
    shared = written(blobs.repartition(n_parts, "bucket").mapInPandas(_meet(), "token long, cls long, n long, place long"), "prefixes")
    one = signatures.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("key", "n", "firsts", "second", "third", "map", "bits")).alias("m")).select("cls", "m.*")
    classes = written(one.join(shared.select("cls").distinct(), "cls", "left_semi"), "classes")

    # near copies mostly share the first token of some order: each class meets the least class that does
    first = classes.select("cls", F.col("cls").alias("comp"), "n", F.lit(0).cast("long").alias("place"), *_maps(), F.posexplode("firsts").alias("o", "first"))
    first = first.withColumn("token", F.xxhash64("o", "first")).drop("o", "first").repartition(n_parts, "token")
    tried = written(_met(first, classes, percent, 0), "star")
    links = _verified(tried, docs, classes, percent, width)
    merged = components(links)
    for reach in (4, None):  # neighbours by size merge loose groups of copies; then whatever is still apart
        cross = _met(_open(shared, merged, classes), classes, percent, reach)
        cross = written(cross.join(tried, ["pivot", "member"], "left_anti"), "cross")
        new = _verified(cross, docs, classes, percent, width)
        links, tried = links.unionByName(new), tried.unionByName(cross)
        if new.limit(1).count():
            merged = components(links)

    discard(shared, classes)
    placed = members.join(merged, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(rank).alias("least"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    out = placed.where("comp IS NOT NULL").join(least, "comp").select("doc_id", "n_shingles", "cls", "component_id", "key", first.alias("first"))
    return out.unionByName(placed.where("comp IS NULL").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"), "key", F.lit(True).alias("first"))), links


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the smallest (doc_id, hash of id and text), null ids last.

    - other texts with the id of a dropped row stay, unless they are copies themselves
    - rows that repeat an id and text: one stays
    - null texts and ones without words are copies of nothing; of those without an id, every row stays
    """
    members, _ = join(docs)
    fate = members.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.bool_and("first").alias("first"), F.max("n_shingles").alias("n"))
    fate = written(fate.where("NOT first OR (rows > 1 AND (doc_id IS NOT NULL OR n > 0))").select(F.col("doc_id").alias("at_id"), F.col("key").alias("at_key"), "first"), "fate")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = sieved(rows, "key", fate, "at_key")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("key") == F.col("at_key"))
    hits = rows.where("hit")
    once = rows.where("NOT hit").select("row.*").unionByName(hits.join(fate, same, "left_anti").select("row.*"))
    repeats = fate.where("first")
    if not repeats.limit(1).count():
        return once
    return once.unionByName(hits.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"]).select("row.*"))

"""N-gram Jaccard join by chosen paths.

Documents with equal shingle sets are one class. A class's signature holds one least shingle under each of many hash
functions. From the root of each run, a path chooses a function or two at random and goes on to the node that its shared
token names; nodes with few classes are compared by brute force, larger ones recurse. As choices depend on run and path
only, each class finds its nodes alone; only counts of nodes decide where to stop. Runs are repeated until a pair at the
threshold meets with the target recall. Pairs that may be similar form groups, inside which exact similarities are taken
from the whole sets, in blocks, so that no task holds a group and pairs are counted but never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, grams, keep_rows, materialize, mix, slices, small_enough, text_of


def shingles(words: list[bytes], n: int, hashes: WordHash) -> np.ndarray:
    """Distinct hashes of the runs of n words, ascending; a shorter text is one shingle of all its words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(grams(h, min(n, len(h))) + np.uint64(min(n, len(h))))


def recall(similarity: float, extra: float, depth: int) -> float:
    """Chance that a pair meets in a node at that depth of one run; each node goes on by one function, or two with chance extra."""
    miss = 0.0
    for _ in range(depth):
        x = 1 - similarity * (1 - miss)
        miss = (1 - extra) * x + extra * x * x
    return 1 - miss


def signatures(docs: DataFrame, shingle: int, size: int, seed: int) -> DataFrame:
    """doc_id, mark, rid, n (shingles), key (of the set), sig (least hashes, 16 bits kept for comparing and paths), body (packed text)."""
    a = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)
    schema = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = WordHash(), zstandard.ZstdCompressor(3)
        for batch in slices(batches):
            n, keys, sigs, bodies = [], [], [], []
            for text in as_bytes(batch.column("t")):
                s = shingles(text.split(), shingle, hashes)
                least = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(s), 2048):
                    least = np.minimum(least, (s[at : at + 2048, None] * a ^ (s[at : at + 2048, None] >> np.uint64(32))).min(axis=0))
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((mix(least) >> np.uint64(33)).astype(np.int32))
                bodies.append(pack.compress(text))
            flat = pa.array(np.concatenate(sigs)) if sigs else pa.array([], pa.int32())
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("rid"), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), sig, pa.array(bodies, pa.binary())], ["doc_id", "mark", "rid", "n", "key", "sig", "body"])

    return docs.mapInArrow(sign, f"doc_id {schema}, mark long, rid long, n int, key binary, sig array<int>, body binary")


def children(node: str, extra: float, size: int, seed: int) -> Column:
    """The nodes below a node for a class with signature sig."""
    pick = lambda salt: F.pmod(F.xxhash64(F.col(node), F.lit(salt)), F.lit(size)).cast("int")
    child = lambda salt: F.xxhash64(F.col(node), pick(salt), F.get(F.col("sig"), pick(salt)))
    two = F.pmod(F.xxhash64(F.col(node), F.lit(seed)), F.lit(10_000)) < int(extra * 10_000)
    return F.when(two & (pick(seed + 1) != pick(seed + 2)), F.array(child(seed + 1), child(seed + 2))).otherwise(F.array(child(seed + 1)))


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of all rows with one value, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(column).to_numpy()
        cut = np.append(np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))), len(v))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and held[0].column(column)[0].as_py() != v[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Root (least member) of each of n items after linking i with each of the others given with it."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i, others in pairs:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64) if n else root


def candidate_edges(members: DataFrame, sigs: DataFrame, threshold: float, size: int) -> DataFrame:
    """members (node, rid) of nodes to compare -> (a, b) rids that link all pairs of each node whose signatures allow the threshold.

    A pair is ruled out if its sizes do, or if fewer signature places agree than five standard errors below the threshold.
    """
    least = threshold * size - 5 * math.sqrt(size * threshold * (1 - threshold))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in runs_of(batches, "node"):
            rid, n = node.column("rid").to_numpy(), node.column("n").to_numpy().astype(float)
            sig = node.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rid), size)

            def near(sig: np.ndarray = sig, n: np.ndarray = n) -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(n) - 1):
                    ratio = np.minimum(n[i], n[i + 1 :]) / np.maximum(n[i], n[i + 1 :])
                    ok = np.flatnonzero(ratio >= threshold - 1e-9)
                    if len(ok):
                        ok = ok[(sig[i + 1 + ok] == sig[i]).sum(axis=1) >= least]
                    yield i, ok + i + 1

            root = forest(len(rid), near())
            at = np.flatnonzero(root != np.arange(len(rid)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(rid[root[at]])], ["a", "b"])

    rows = members.join(sigs.select("rid", "n", "sig"), "rid").select("node", "rid", "n", "sig")
    return rows.repartition("node").sortWithinPartitions("node", "rid").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) -> (rid, comp): the least rid that each one is linked with. Labels spread and jump until none changes; each step is written."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = materialize(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name)
    while True:
        theirs = both.join(labels.withColumnRenamed("rid", "b"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("comp").alias("low"))
        new = labels.join(theirs, "rid").select("rid", F.least("comp", "low").alias("low"), "comp")
        roots = new.select(F.col("rid").alias("at"), F.col("low").alias("up"))
        new = new.join(roots, F.col("low") == F.col("at"), "left").select("rid", F.least("low", F.coalesce("up", "low")).alias("comp"), F.col("comp").alias("was"))
        new = materialize(new, name)
        labels = new.select("rid", "comp")
        if new.where("comp != was").isEmpty():
            return labels


def verify_blocks(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """rows (pair, side, rid, n, copies, body), all of a pair of blocks together -> exact links of the pair's classes.

    For each class of a block pair (rid): links (documents of the linked classes) and low (the least rid it is linked
    with here). side 0 and 1 are the two blocks; a block paired with itself has side 2. The overlaps of a class with all
    others are counted through the list of classes that hold each shingle.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHash(), zstandard.ZstdDecompressor()
        for group in runs_of(batches, "pair"):
            group = group.sort_by("rid")
            rid, side, n, copies = (group.column(c).to_numpy() for c in ("rid", "side", "n", "copies"))
            if len(rid) < 2:
                continue
            sets = [shingles(unpack.decompress(x).split(), shingle, hashes) for x in group.column("body").to_pylist()]
            values, token = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(rid)), [len(s) for s in sets])
            shared = np.bincount(token, minlength=len(values)) > 1
            live = shared[token]
            order = np.argsort(token[live], kind="stable")
            posting, token_of = owner[live][order], token[live][order]
            begin = np.searchsorted(token_of, np.arange(len(values) + 1))
            mine = np.split(token[live], np.searchsorted(owner[live], np.arange(1, len(rid))))
            count = np.zeros(len(rid), np.int64)
            root = np.arange(len(rid))
            todo = np.arange(len(rid)) if side[0] == 2 else np.flatnonzero(side == 0)

            def near() -> Iterator[tuple[int, np.ndarray]]:
                for i in todo.tolist():  # noqa: B023
                    t = mine[i]  # noqa: B023
                    size = begin[t + 1] - begin[t]  # noqa: B023
                    at = np.repeat(begin[t] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))  # noqa: B023
                    both = np.bincount(posting[at], minlength=len(rid))  # noqa: B023
                    ok = both >= threshold * (n[i] + n - both) - 1e-9  # noqa: B023
                    ok &= (both > 0) & ((side == 2) | (side == 1))  # noqa: B023
                    ok[i] = False
                    if side[0] == 2:  # noqa: B023
                        ok[: i + 1] = False
                    found = np.flatnonzero(ok)
                    if len(found):
                        count[i] += int(copies[found].sum())  # noqa: B023
                        count[found] += copies[i]  # noqa: B023
                    yield i, found

            root = forest(len(rid), near())
            at = np.flatnonzero(count)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(count[at]), pa.array(rid[root[at]])], ["rid", "links", "low"])

    rows = rows.select("pair", F.col("side").cast("long").alias("side"), "rid", F.col("n").cast("long").alias("n"), "copies", "body")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(links, "rid long, links long, low long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8, target: float = 0.999, depth: int = 4, extra: float = 0.25, small: int = 128, brute: int = 4096, size: int = 64, block: int = 1024, seed: int = 13, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, class_id, rep_id, n_links, n_shingles; class_row, mark and rid tell class and row apart where ids don't.

    Shingles are runs of shingle words (between ASCII blanks, unchanged); a shorter text is one shingle. rep_id: the
    least id with the same shingle set; class_id: the least id of all that similarity of threshold or more connects,
    directly or through others; n_links: the other rows that it is itself that similar to. Copies are counted, not
    expanded. Null and blank texts have no shingles and are linked with nothing. A null id sorts last; repeated rows are
    rows of their own. Other columns are ignored; an empty table gives no rows.

    target: the recall at the threshold; runs are added until it is reached (pairs that are more alike meet more surely).
    small: classes of a node compared by brute force; larger nodes recurse down to depth, where nodes up to brute are
    compared still and larger ones are one group as they are. block: classes of a group that are compared at a time.
    broadcast_bytes: the list of the groups' members is broadcast up to that size, beyond it the join is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(text_of(text_col)).alias("mark"), F.monotonically_increasing_id().alias("rid"))
    signed = materialize(signatures(rows, shingle, size, seed), "join-signed")
    classes = signed.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("doc_id").alias("rep_id"))
    classes = materialize(classes, "join-classes")
    reps = materialize(signed.join(classes.select("rid", "copies"), "rid").select("rid", "n", "sig", "copies"), "join-reps")
    runs = max(1, math.ceil(math.log(1 - target) / math.log(1 - recall(threshold, extra, depth))))
    roots = F.array(*[F.xxhash64(F.lit(f"run {r}"), F.lit(seed)) for r in range(runs)])
    level = reps.select("rid", "sig", F.explode(roots).alias("up")).select("rid", F.explode(children("up", extra, size, seed)).alias("node"))
    compared, whole = [], None
    for d in range(1, depth + 1):
        level = materialize(level.distinct(), "join-level")
        counts = level.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        most = small if d < depth else brute
        compared.append(level.join(counts.where(F.col("c") <= most).select("node"), "node"))
        large = level.join(counts.where(F.col("c") > most).select("node"), "node")
        if d < depth:
            level = large.join(reps.select("rid", "sig"), "rid").select("rid", F.explode(children("node", extra, size, seed + 10 * d)).alias("node"))
        else:
            whole = large
    members = compared[0]
    for more in compared[1:]:
        members = members.unionByName(more)
    stars = whole.join(whole.groupBy("node").agg(F.min("rid").alias("b")), "node").where("rid != b").select(F.col("rid").alias("a"), "b")
    edges = candidate_edges(members, reps, threshold, size).unionByName(stars)
    groups = components(edges, "join-groups")
    # blocks: the classes of a group in order of set size, so that blocks whose sizes rule similarity out are not paired
    sized = groups.join(reps.select("rid", "n", "copies"), "rid")
    many = sized.groupBy("comp", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("comp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    many = many.withColumn("before", F.coalesce(before, F.lit(0)))
    # within a size the place is by hash: even on average, exact places are not needed
    spot = F.col("before") + F.floor((F.xxhash64("rid") / F.lit(2.0**64) + 0.5) * F.col("c"))
    placed = sized.join(many, ["comp", "n"]).withColumn("block", F.floor(spot / block).cast("long"))
    placed = materialize(placed.select("rid", "comp", "n", "copies", "block"), "join-placed")
    spans = placed.groupBy("comp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    spans = materialize(spans, "join-spans")
    x, y = spans.alias("x"), spans.alias("y")
    fits = (F.col("x.comp") == F.col("y.comp")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.hi") >= F.lit(threshold) * F.col("y.lo"))
    pairs = x.join(y, fits).select(F.col("x.comp").alias("comp"), F.col("x.block").alias("p"), F.col("y.block").alias("q"), F.xxhash64("x.comp", "x.block", "y.block").alias("pair"))
    side = pairs.select("comp", "pair", F.col("p").alias("block"), F.when(F.col("p") == F.col("q"), 2).otherwise(0).alias("side"))
    side = side.unionByName(pairs.where("p < q").select("comp", "pair", F.col("q").alias("block"), F.lit(1).alias("side")))
    # texts move only for members of groups, where their list is small enough to be sent to the texts
    bodies = signed.select("rid", "body").join(small_enough(placed, 64, broadcast_bytes), "rid")
    exact = materialize(verify_blocks(bodies.join(side, ["comp", "block"]), shingle, threshold), "join-exact")
    links = exact.groupBy("rid").agg(F.sum("links").alias("links"))
    linked = components(exact.select(F.col("rid").alias("a"), F.col("low").alias("b")), "join-links")
    of = classes.join(links, "rid", "left").join(linked, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = of.groupBy("comp").agg(F.min("rep_id").alias("class_id"))
    of = of.join(least, "comp").select("key", "comp", "class_id", "rep_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "mark", "rid", "n", "key").join(of, "key", "left")
    blank = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(blank, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.when(blank, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("comp", "rid").alias("class_row"),
        "mark",
        "rid",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of ``jaccard_join``, that with the least id (then hash of the text); all columns stay."""
    found = materialize(jaccard_join(docs, id_col, text_col), "join-found")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "mark", "rid")).alias("best")
    kept = found.join(found.groupBy("class_row").agg(best), "class_row").select(F.col("doc_id").alias("id"), "mark", (F.col("rid") == F.col("best.rid")).alias("kept"))
    return keep_rows(docs, materialize(kept, "join-kept"), id_col, F.xxhash64(text_of(text_col)), 8)

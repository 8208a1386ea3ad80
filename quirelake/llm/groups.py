"""Groups of documents that exchange lists with owners of hash ranges.

Documents are packed, as tokens, to groups of bounded bytes, one row each. A group sends every owner one sorted list of
what it asks (hashes, counts, texts); the owner merges the lists of all groups and answers each in the order of its list.
So no model or index has to fit anywhere as a whole, nothing passes through the driver, and a frequent value reaches its
owner once per group at most.

Groups and owners grow with the square root of the input, so that a list has a few kilobytes on average: the number of
lists, groups times owners, then grows as the input does. The groups' table is bucketed: answers come to the groups, and
the groups never move.
"""

from __future__ import annotations

import gc
import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, scratch, slices

#: Lists for owners; a group's own body stands with the owner STATE.
ROWS = "gid long, owner int, body binary"
STATE = -1
ANSWERS = "gid long, round int, owner int, body binary"
#: A marker in place of a round, for what owners report about themselves.
REPORT = -1


def dumps(x: object) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 3)


def loads(data: bytes) -> object:
    return pickle.loads(zstandard.decompress(data))


def planes(x: np.ndarray) -> tuple[str, bytes]:
    """An array byte plane by byte plane: the high bytes of sorted or small values compress away."""
    return x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(data: tuple[str, bytes], begin: int = 0, end: int | None = None) -> np.ndarray:
    """The array's values from begin to end."""
    kind, raw = data
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)[:, begin:end].T).view(kind).ravel()


class Places(dict):
    """Words by the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Packed:
    """A group's documents: ``ids`` (None: null), ``marks`` (a boolean each), ``lens`` in tokens; ``at`` points into ``words``, the distinct tokens."""

    def __init__(self, body: bytes):
        self.ids, self.marks, lens, words, n, at = loads(body)
        self.lens, self.at = unplanes(lens).astype(np.int64), unplanes(at).astype(np.int64)
        self.words: list[bytes] = words.split(b" ") if n else []
        self.begin = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)

    @staticmethod
    def pack(docs: list[tuple], lower: bool, end: bool) -> bytes:
        """docs: (id, mark, text). end: an empty token closes each text."""
        places, parts, lens = Places(), [], []
        for _, _, text in docs:
            words = (text.lower() if lower else text).split()  # bytes: A-Z and ASCII blanks only
            if end:
                words.append(b"")
            parts.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            lens.append(len(words))
        at = np.concatenate(parts)
        return dumps(([d[0] for d in docs], [bool(d[1]) for d in docs], planes(np.array(lens, np.uint32)), b" ".join(places), len(places), planes(at)))


class Groups:
    def __init__(self, docs: DataFrame, group_bytes: int, owner_bytes: int, name: str, *, list_bytes: int = 4096, lower: bool = False, end: bool = False):
        """docs: columns doc_id (integer), mark, t. group_bytes, owner_bytes: text for a group and for each owner, at least; list_bytes: the mean list that they grow for."""
        total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        unit = math.isqrt(total * list_bytes)
        most, self.owners, self.name = max(group_bytes, unit), max(8, math.ceil(total / max(owner_bytes, unit))), name
        self.buckets = max(8, math.ceil(total / most / 2))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([part << 33 | n], pa.int64()), pa.array([STATE], pa.int32()), pa.array([Packed.pack(held, lower, end)], pa.binary())], ["gid", "owner", "body"])

            for batch in slices(batches):
                for doc in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), as_bytes(batch.column("t")), strict=True):
                    if held and size + len(doc[2]) > most:
                        yield row()
                        n, held, size = n + 1, [], 0
                    held.append(doc)
                    size += len(doc[2])
            if held:
                yield row()

        self.table, self.given = self.write(docs.mapInArrow(pack, ROWS)), []

    def write(self, rows: DataFrame) -> DataFrame:
        """rows, written to the shared folder in buckets of gid: what is joined with them by gid moves, they don't."""
        spark, path, table = rows.sparkSession, scratch(rows.sparkSession, self.name), f"{self.name}_{uuid.uuid4().hex[:12]}"
        rows.write.bucketBy(self.buckets, "gid").option("path", path).saveAsTable(table)
        out = spark.table(table)
        out.schema  # noqa: B018  resolves the plan; the files stay when the name goes
        spark.sql(f"DROP TABLE {table}")
        self.path = path
        return out

    def _with(self, answers: DataFrame, f: Callable[[int, bytes, dict], pd.DataFrame], schema: str) -> DataFrame:
        def one(state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return f(int(state.gid.iloc[0]), state.body.iloc[0], by_round(rows))

        return self.table.where(F.col("owner") == STATE).groupBy("gid").cogroup(answers.where(F.col("round") > REPORT).groupBy("gid")).applyInPandas(one, schema)

    def ask(self, answers: DataFrame | None, asks: Callable[[bytes, dict[int, dict]], dict[int, object] | Iterator[tuple[int, object]]]) -> DataFrame:
        """What asks(a group's body, answers by round in the order of owners) gives for each owner, as lists."""
        if answers is not None:
            return self._with(answers, lambda gid, body, got: as_rows(gid, asks(body, got)), ROWS)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                yield pa.RecordBatch.from_pandas(as_rows(batch.column("gid")[0].as_py(), asks(batch.column("body")[0].as_py(), {})), preserve_index=False)

        return self.table.mapInArrow(first, ROWS)

    def advance(self, answers: DataFrame, asks: Callable[[bytes, dict[int, dict]], dict[int, object] | Iterator[tuple[int, object]]]) -> DataFrame:
        """As ask; what asks gives for the owner STATE takes the place of the groups' bodies, and both are written. The former bodies and all answers given so far are deleted."""
        old, table = [self.path, *self.given], self.write(self.ask(answers, asks))
        self.table, self.given = table, []
        for path in old:
            release(table.sparkSession, path)
        return table.where(F.col("owner") != STATE)

    def answer(self, lists: DataFrame, number: int, answers: Callable[[list, int], tuple[list, object]]) -> tuple[DataFrame, list]:
        """What answers(lists by gid, owner) gives for each list, written, so each owner works once; and what each owner reports beside (a bounded row)."""

        def own(rows: pd.DataFrame) -> pd.DataFrame:
            rows, owner = rows.sort_values("gid"), int(rows.owner.iloc[0])
            bodies, report = answers([loads(x) for x in rows.body], owner)
            out = pd.DataFrame({"gid": rows.gid, "round": np.int32(number), "owner": rows.owner, "body": [dumps(x) for x in bodies]})
            return out if report is None else pd.concat([out, pd.DataFrame({"gid": [-1], "round": np.int32([REPORT]), "owner": np.int32([owner]), "body": [dumps(report)]})])

        spark, path = lists.sparkSession, scratch(lists.sparkSession, f"{self.name}-{number}")
        lists.groupBy("owner").applyInPandas(own, ANSWERS).write.parquet(path)
        given = spark.read.schema(ANSWERS).parquet(path)
        self.given.append(path)
        reports = [loads(r.body) for r in given.where(F.col("round") == REPORT).select("body").collect()]
        tidy(given)  # after the small job: Spark holds on to the last one's shuffle files
        return given, reports

    def finish(self, answers: DataFrame, rows: Callable[[bytes, dict[int, dict]], pd.DataFrame], schema: str) -> DataFrame:
        return self._with(answers, lambda gid, body, got: rows(body, got), schema)


def as_rows(gid: int, lists: dict[int, object] | Iterator[tuple[int, object]]) -> pd.DataFrame:
    """lists, by owner: if they come one by one, each is packed before the next is made."""
    told = [(o, dumps(x)) for o, x in (lists.items() if isinstance(lists, dict) else lists)]
    return pd.DataFrame({"gid": np.full(len(told), gid), "owner": np.array([o for o, _ in told], np.int32), "body": [x for _, x in told]})


def tidy(df: DataFrame) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that are over: it acts when the driver's JVM collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def release(spark: SparkSession, path: str) -> None:
    """Deletes the files of a written table that no one reads any more."""
    spark.range(0).write.mode("overwrite").parquet(path)


def by_round(rows: pd.DataFrame) -> dict[int, dict[int, object]]:
    """Answers by round, then owner in order."""
    out: dict[int, dict[int, object]] = {}
    for number, owner, body in sorted(zip(rows["round"], rows["owner"], rows["body"], strict=True), key=lambda x: x[:2]):
        out.setdefault(int(number), {})[int(owner)] = loads(body)
    return out


def cuts(hashes: np.ndarray, owners: int, bits: int = 64) -> np.ndarray:
    """Where each owner's part of ascending hashes begins, and the end."""
    width = (1 << bits) // owners + 1
    inner = np.searchsorted(hashes, np.array([o * width for o in range(1, owners)], np.uint64))
    return np.concatenate(([0], inner, [len(hashes)])).astype(np.int64)

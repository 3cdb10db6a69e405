"""Tables as versioned snapshots below one log: keyed upserts by bucket, commits of several tables, and the outbox."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from lawloom.session import discard, materialize

#: Buckets of a keyed table by default, commits that are kept, and attempts at one when others come in between.
BUCKETS, KEEP, ATTEMPTS = 16, 20, 20
_BUCKET = "_bucket"


def _keys(key: str | Iterable[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def upserted(current: DataFrame, rows: DataFrame, key: str | Iterable[str]) -> DataFrame:
    """``current`` with ``rows`` inserted or in place of those with their key; a key in ``rows`` must be there once."""
    keys = _keys(key)
    return current.join(rows.select(*keys), keys, "left_anti").select(*current.columns).unionByName(rows, allowMissingColumns=True)


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that ``rows`` has more than once, with their number; a null key counts as one."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Staged:
    """New data of a table, written but in no commit yet: its entry for the log, and what it was made from."""

    entry: dict
    based_on: dict | None
    rows: int = 0


class Store:
    """Tables below a root folder.

    A commit is one file of the log, ``_log/<number>.json``, which names the files of every table. It is renamed into its
    place, and only if there is none of its number: so readers see all of a commit or nothing, a writer that dies leaves
    the last commit, and of two writers one has to try again. A keyed table is cut into buckets by a hash of its key; an
    upsert writes the buckets that its rows fall in and leaves the others where they are.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self.recover()

    # -- the log

    def _numbers(self) -> list[int]:
        log = self._path(f"{self.root}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def _log(self, number: int | None = None) -> tuple[int, dict]:
        """The number and content of a commit, by default of the last."""
        numbers = self._numbers()
        if not numbers:
            return 0, {"tables": {}, "outbox": []}
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.root}/_log/{number:010d}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_log(self, number: int, content: dict) -> None:
        temporary, final = (self._path(f"{self.root}/_log/{n}") for n in (f"{uuid.uuid4().hex}.tmp", f"{number:010d}.json"))
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        try:
            self._files.rename(temporary, final, self._once)
        except Exception as e:
            self._fs.delete(temporary, False)
            if number in self._numbers():
                raise Conflict(f"commit {number} is taken") from e
            raise

    def commit(self, staged: dict[str, Staged], outbox: Iterable[str] = ()) -> int:
        """Put new data of several tables, and folders of messages, into one commit; its number.

        All of it becomes visible, or nothing. If another writer has changed one of these tables since they were staged,
        it is a conflict: what was staged is not based on the table any more. Changes of other tables don't matter.
        """
        for _ in range(ATTEMPTS):
            number, log = self._log()
            for name, s in staged.items():
                if log["tables"].get(name) != s.based_on:
                    raise Conflict(f"{name} has changed")
            tables = log["tables"] | {n: s.entry | {"version": (log["tables"].get(n) or {"version": -1})["version"] + 1} for n, s in staged.items()}
            try:
                self._write_log(number + 1, {"tables": tables, "outbox": [*log["outbox"], *outbox]})
            except Conflict:
                continue
            if outbox:
                self.recover()
            return number + 1
        raise Conflict("others keep committing")

    def _retried(self, stage: Callable[[], dict[str, Staged]]) -> dict[str, Staged]:
        for n in range(ATTEMPTS):
            staged = stage()
            try:
                if any(s.entry != s.based_on for s in staged.values()):
                    self.commit(staged)
                return staged
            except Conflict:
                if n == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = KEEP) -> int:
        """Forget all but the last ``keep`` commits, and remove the files that none of these names; their number.

        Not while a writer is at work: what it has staged is in no commit yet.
        """
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{n:010d}.json"), False)
        used = {f for n in numbers[-keep:] for t in self._log(n)[1]["tables"].values() for f in t["folders"].values()}
        removed = 0
        data = self._path(f"{self.root}/_data")
        if self._fs.exists(data):
            for s in self._fs.listStatus(data):
                name = s.getPath().getName()
                if not any(u == name or u.startswith(f"{name}/") for u in used):
                    removed += bool(self._fs.delete(s.getPath(), True))
                elif name not in used:  # some of its buckets are in use
                    for b in self._fs.listStatus(s.getPath()):
                        if b.isDirectory() and f"{name}/{b.getPath().getName()}" not in used:
                            removed += bool(self._fs.delete(b.getPath(), True))
        return removed

    # -- reading

    def _entry(self, name: str) -> dict | None:
        return self._log()[1]["tables"].get(name)

    def exists(self, name: str) -> bool:
        return self._entry(name) is not None

    def version(self, name: str) -> int:
        return (self._entry(name) or {"version": -1})["version"]

    def _frame(self, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = sorted(f"{self.root}/_data/{f}" for b, f in entry["folders"].items() if wanted is None or b in wanted)
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        entry = self._entry(name)
        if entry is None:
            raise LookupError(f"no such table: {name}")
        return self._frame(entry)

    def get(self, name: str, key: str, value: str) -> DataFrame:
        """The rows with one value of a column; of the key, from its bucket alone."""
        entry = self._entry(name)
        if entry is None:
            raise LookupError(f"no such table: {name}")
        buckets = None
        if entry["key"] == [key]:
            buckets = [self.spark.range(1).select(self._bucket(F.lit(value), entry["buckets"]).alias("b")).first()["b"]]
        return self._frame(entry, buckets).where(F.col(key) == F.lit(value))

    # -- writing

    @staticmethod
    def _bucket(key: Column | list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*(key if isinstance(key, list) else [key])), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, key: list[str] | None, buckets: int) -> dict[str, str]:
        """Write data and return the folder of each bucket (one for a table without a key)."""
        name = uuid.uuid4().hex
        if key is None:
            df.write.parquet(f"{self.root}/_data/{name}")
            return {"0": name}
        df.withColumn(_BUCKET, self._bucket(key, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/_data/{name}")
        found = self._fs.listStatus(self._path(f"{self.root}/_data/{name}"))
        names = [s.getPath().getName() for s in found]
        return {n.split("=")[1]: f"{name}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def stage(self, name: str, df: DataFrame, key: str | Iterable[str] | None = None, buckets: int = BUCKETS) -> Staged:
        """Write the whole of a table."""
        old = self._entry(name)
        key = None if key is None else _keys(key)
        if key is None and old is not None:
            key, buckets = old["key"], old["buckets"]
        entry = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": self._write(df, key, buckets)}
        return Staged(entry, old)

    def stage_upsert(self, name: str, rows: DataFrame, key: str | Iterable[str], buckets: int = BUCKETS) -> Staged:
        """Write the buckets that change when ``rows`` are inserted or take the place of those with their key.

        A repeated or null key in ``rows`` is an error: reduce them first.
        """
        key, old = _keys(key), self._entry(name)
        entry = old if old is not None and old["key"] == key else None
        buckets = entry["buckets"] if entry else buckets
        staged = materialize(rows, "upsert")
        held = staged.groupBy(*key).agg(F.count("*").alias("n")).select("n", self._bucket(key, buckets).alias("b"), F.concat(*[F.col(k).cast("string") for k in key]).isNull().alias("null"))
        counts = held.groupBy("b").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("null").alias("null")).collect()  # one row a bucket
        n = sum(r["n"] for r in counts)
        if any(r["most"] > 1 or r["null"] for r in counts):
            raise ValueError(f"repeated or null keys in rows for {name}")
        if old is None:
            new = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": self._write(staged, key, buckets)}
        elif entry is None or set(rows.columns) - set(StructType.fromJson(old["schema"]).names):
            every = upserted(self._frame(old), staged, key)
            new = {"key": key, "buckets": buckets, "schema": every.schema.jsonValue(), "folders": self._write(every, key, buckets)}
        elif not n:
            new = old
        else:
            touched = self._frame(old, [r["b"] for r in counts])
            new = old | {"folders": old["folders"] | self._write(upserted(touched, staged, key).select(*touched.columns), key, buckets)}
        discard(staged)
        return Staged(new, old, n)

    def publish(self, name: str, df: DataFrame, key: str | Iterable[str] | None = None) -> None:
        """Replace a table."""
        self._retried(lambda: {name: self.stage(name, df, key)})

    def create(self, name: str, schema: str, key: str | Iterable[str] | None = None, buckets: int = BUCKETS) -> None:
        """Create an empty table if there is none."""
        if self.exists(name):
            return
        entry = {"key": None if key is None else _keys(key), "buckets": buckets, "schema": _parse_datatype_string(schema).jsonValue(), "folders": {}}
        try:
            self.commit({name: Staged(entry, None)})
        except Conflict:
            if not self.exists(name):
                raise

    def upsert(self, name: str, rows: DataFrame, key: str | Iterable[str]) -> int:
        """Insert rows or replace those with their key; the number of rows."""
        return self._retried(lambda: {name: self.stage_upsert(name, rows, key)})[name].rows

    def insert(self, name: str, row: DataFrame, key: str | Iterable[str]) -> int:
        """Append rows whose key must be new."""
        if self.exists(name) and self.read(name).join(row.select(*_keys(key)), _keys(key), "left_semi").count():
            raise ValueError(f"the key is there already in {name}")
        return self.upsert(name, row, key)

    def wipe(self, *names: str, confirm: bool = False) -> None:
        """Empty tables, and with ``outbox`` the messages, in one commit; needs ``confirm=True``."""
        if not confirm:
            raise ValueError("wiping needs confirm=True")
        tables = self._log()[1]["tables"]
        self._retried(lambda: {n: Staged(e | {"folders": {}}, e) for n in names if (e := self._entry(n)) is not None} if tables else {})
        for name in names:
            if name not in tables:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # -- the outbox: a folder of files that a stream reads as they come

    def stage_messages(self, rows: DataFrame) -> str:
        """Write messages where the stream does not look yet; the folder, for :meth:`commit`."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/_staged/{name}")
        return name

    def append(self, name: str, rows: DataFrame) -> None:
        """Append files of a log-like table that a stream reads."""
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def recover(self) -> None:
        """Hand over the messages of commits to the stream: also those that a writer has committed but died before."""
        for folder in self._log()[1]["outbox"]:
            source = self._path(f"{self.root}/_staged/{folder}")
            if not self._fs.exists(source):
                continue
            self._fs.mkdirs(self._path(f"{self.root}/outbox"))
            for s in self._fs.listStatus(source):
                if s.getPath().getName().endswith(".parquet"):
                    self._fs.rename(s.getPath(), self._path(f"{self.root}/outbox/{folder}-{s.getPath().getName()}"))
            self._fs.delete(source, True)

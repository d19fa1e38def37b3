"""The warehouse: four Parquet tables in one folder, upserts, checks and counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

_S, _D = T.StringType(), T.DoubleType()


def _schema(keys: str, rest: str, kinds: dict | None = None) -> T.StructType:
    return T.StructType([T.StructField(k, _S, False) for k in keys.split()] + [T.StructField(c, (kinds or {}).get(c, _D), True) for c in rest.split()])


SCHEMAS = {
    "daily_bar": _schema("ts_code trade_date", "open high low close pre_close vol amount adj_factor adj_close"),
    "financial_pit": _schema("ts_code ann_date end_date", "roe net_profit revenue ttm_net_profit roe_ttm"),
    "stock_basic": _schema("ts_code", "name industry list_date is_st market_board", {"name": _S, "industry": _S, "list_date": _S, "is_st": T.IntegerType(), "market_board": _S}),
    "factor_metrics": _schema("trade_date ts_code factor_name", "raw_val clean_val"),
}
KEYS = {"daily_bar": ["ts_code", "trade_date"], "financial_pit": ["ts_code", "ann_date", "end_date"], "stock_basic": ["ts_code"], "factor_metrics": ["trade_date", "ts_code", "factor_name"]}
DEFAULTS = {"daily_bar": {"adj_factor": 1.0}, "stock_basic": {"is_st": 0, "market_board": "Main"}}


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last by the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of new replace those of old with the same key. Of new rows that share a key the last by
    the order wins; without an order, the largest by the other columns. A table has no row order of
    its own to go by."""
    rest = order or [c for c in new.columns if c not in keys]
    new = last_wins(new, keys, rest)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


#: Parts of a table by its key: the column and how many of its first characters name the part.
PARTS = {"daily_bar": ("trade_date", 6), "factor_metrics": ("trade_date", 6), "financial_pit": ("ann_date", 4), "stock_basic": ("ts_code", 0)}


class ConcurrentWrite(RuntimeError):
    """Another writer committed first."""


class Warehouse:
    """Four tables, each a folder of parts (months of bars and factors, years of disclosures).

    A write rewrites only the parts that it touches, into a new folder, and then commits a log entry
    that names the folder of every part. Readers follow the newest entry, so they see all of a write or
    nothing. An entry's number can be taken once: of two writers one starts over from what the other
    left. ``vacuum`` removes folders that no kept entry names. The driver holds the names of parts,
    which grow with the months of history, never rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _entries(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}/_log")
        found = (s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else ()
        return sorted(int(f.removesuffix(".json")) for f in found if f.endswith(".json") and not f.startswith("."))

    def _entry(self, name: str, n: int) -> dict[str, str]:
        fs, p = self._fs(f"{self.root}/{name}/_log/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _state(self, name: str) -> tuple[int, dict[str, str]]:
        """The newest entry's number (-1: none) and its parts."""
        found = self._entries(name)
        return (found[-1], self._entry(name, found[-1])) if found else (-1, {})

    def _commit(self, name: str, n: int, parts: dict[str, str]) -> None:
        """Take number n: the entry is written aside and moved to its name, which must be free. The
        move is atomic where the file system's is; a local one checks first and then moves."""
        fs, p = self._fs(f"{self.root}/{name}/_log/{n:012d}.json")
        _, aside = self._fs(f"{self.root}/{name}/_log/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        plain = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(aside, p, plain)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(p):
                raise ConcurrentWrite(name) from e
            raise

    def init(self) -> None:
        """Create the tables that are missing, empty."""
        for name in SCHEMAS:
            if self._state(name)[0] < 0:
                try:
                    self._commit(name, 0, {})
                except ConcurrentWrite:
                    pass  # another made it

    def read(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """The table, or its rows from start to end by its part column: other parts aren't opened."""
        column, k = PARTS[name]
        df = self._of(name, [f for p, f in self._state(name)[1].items() if (not start or p >= start[:k]) and (not end or p <= end[:k])])
        df = df.filter(F.col(column) >= start) if start else df
        return df.filter(F.col(column) <= end) if end else df

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{name}/{f}" for f in sorted(folders)]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _filled(self, name: str, df: DataFrame) -> DataFrame:
        for c, v in DEFAULTS.get(name, {}).items():
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in df.columns else df.withColumn(c, F.lit(v))
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])

    def _write(self, name: str, df: DataFrame, merge, tries: int = 5) -> int:
        """merge: (old rows of the touched parts, new) -> rows. Returns the number of rows of df."""
        column, k = PARTS[name]
        new = written(self._filled(name, df), f"new_{name}")
        touched = {r[0]: r[1] for r in new.groupBy(F.substring(column, 1, k).alias("p")).agg(F.count("*")).collect()}  # a row per part
        if not touched:
            return 0
        for _ in range(tries):
            n, parts = self._state(name)
            rows = merge(self._of(name, [parts[p] for p in touched if p in parts]), new)
            folder = f"data-{uuid.uuid4().hex}"
            # parts are named in full, so that a part is a folder whatever its name; a part is one task's or, if large, several tasks' files
            rows.withColumn("_part", F.concat(F.lit("p"), F.substring(column, 1, k))).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{name}/{folder}")
            try:
                self._commit(name, n + 1, parts | {p: f"{folder}/_part=p{p}" for p in touched})
                return sum(touched.values())
            except ConcurrentWrite:
                continue
        raise ConcurrentWrite(name)

    def insert(self, name: str, df: DataFrame) -> int:
        """Append; a key that is there already, or twice in df, is an error and nothing is written."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new)
            if violations(both.select(*KEYS[name]), KEYS[name]).head(1):
                raise ValueError(f"duplicate key in {name}")
            return both

        return self._write(name, df, merge)

    def upsert(self, name: str, df: DataFrame, order: list | None = None) -> int:
        """Replace by key; order decides among rows of df that share one (see ``upsert``). Returns
        the number of rows of df."""
        return self._write(name, df, lambda old, new: upsert(old, new, KEYS[name], order))

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the newest keep entries names, and older entries; the number
        of folders removed. Run it when no write is under way."""
        gone = 0
        for name in SCHEMAS:
            found = self._entries(name)
            used = {f for n in found[-keep:] for f in self._entry(name, n).values()}
            fs, p = self._fs(f"{self.root}/{name}")
            for top in fs.listStatus(p) if fs.exists(p) else ():
                if not (folder := top.getPath().getName()).startswith("data-"):
                    continue
                for part in fs.listStatus(top.getPath()):
                    if part.isDirectory() and f"{folder}/{part.getPath().getName()}" not in used:
                        gone += bool(fs.delete(part.getPath(), True))
                if not any(f.startswith(f"{folder}/") for f in used):
                    fs.delete(top.getPath(), True)
            for n in found[:-keep]:
                fs.delete(self._fs(f"{self.root}/{name}/_log/{n:012d}.json")[1], False)
        return gone

    def archive(self, path: str) -> None:
        """Write all tables as compressed text, one folder each."""
        for name in self.tables():
            self.read(name).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")

    def restore(self, path: str) -> bool:
        """Fill the warehouse from an archive if it has no rows and the archive exists."""
        self.init()
        fs, p = self._fs(path)
        if any(self.read(n).head(1) for n in SCHEMAS) or not fs.exists(p):
            return False
        for name, schema in SCHEMAS.items():
            if fs.exists(self._fs(f"{path}/{name}")[1]):
                self.insert(name, self.spark.read.schema(schema).json(f"{path}/{name}"))
        return True

    def counts(self) -> DataFrame:
        return count_rows({n: self.read(n) for n in SCHEMAS})

    def tables(self) -> list[str]:
        return [n for n in SCHEMAS if self._state(n)[0] >= 0]


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        c = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out

"""Keyed stores: insert if absent, delete, resume and cached responses, as anti joins on content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(rows: DataFrame, content: str, prefix: str) -> DataFrame:
    """Adds ``hash_id``: the prefix and the MD5 of the content."""
    return rows.withColumn("hash_id", F.concat(F.lit(prefix), F.md5(F.col(content))))


def missing(new: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of ``new`` whose key the store lacks, each key once."""
    return new.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: str = "hash_id") -> DataFrame:
    """The store with the rows it lacked; rows that it has stay as they are."""
    return store.unionByName(missing(new, store, key).select(*store.columns))


def delete(store: DataFrame, keys: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def orphans(links: DataFrame, owner: str, part: str, deleted: DataFrame) -> DataFrame:
    """Parts that only deleted owners hold; they go with them."""
    gone = links.join(deleted.select(owner, F.lit(True).alias("gone")).distinct(), owner, "left")
    return gone.groupBy(part).agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("all_gone")).where("all_gone").select(part)


def resume(todo: DataFrame, done: DataFrame, keys: list[str], response: str | None = None) -> DataFrame:
    """What is left to do: keys without a result, or whose result is an error."""
    good = done.where(F.col(response) != "Error") if response else done
    return todo.join(good.select(*keys).distinct(), keys, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answered, open) requests by the SHA-256 of what they consist of."""
    asked = requests.withColumn("request_key", F.sha2(F.to_json(F.struct(*columns)), 256))
    return asked.join(cache, "request_key"), asked.join(cache, "request_key", "left_anti")


class Collection:
    """A keyed collection of documents in a folder: opened or created, filled without repeats, searched, emptied.

    Every change writes a new version beside the old one and then names it the current, so that readers never see half a change and a
    repeated task overwrites only itself.
    """

    def __init__(self, spark, path: str, schema: str, key: str = "hash_id") -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        if self._versions() == []:
            self._write(spark.createDataFrame([], schema))

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        # a version counts once its job has committed
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _write(self, rows: DataFrame) -> None:
        at = (self._versions() or [-1])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{at:09d}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self._versions()[-1]:09d}")

    def head(self, n: int) -> DataFrame:
        return self.rows().orderBy(self.key).limit(n)

    def insert(self, new: DataFrame) -> None:
        """Adds the rows whose key is not there."""
        self._write(upsert(self.rows(), new, self.key))

    def delete(self, keys: DataFrame) -> None:
        self._write(delete(self.rows(), keys, self.key))

    def truncate(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, whether one or many."""
        return self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def purge(self, text: str, meta: str) -> None:
        """Drops documents without text or without metadata (a map)."""
        self._write(self.rows().where(f"trim(coalesce({text}, '')) <> '' AND size({meta}) > 0"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by type, so that a reader of one kind reads only its folder."""
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def load_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")

"""State that batches are merged into: a part per batch, added up when it is read.

Parts are numbered by the caller's batch.  A part counts once its marker is
written, after its tables; writing a batch again replaces it, so a batch that
was lost half way, or comes twice, changes nothing.  A compacted part names
the last batch it holds; later parts come on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewise.session import state_root


class Parts:
    """The parts of one name under the shared state root; a subclass names its tables and how they are merged."""

    kind: str
    tables: tuple[str, ...]

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{state_root(spark)}/{self.kind}/{name}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = lambda *x: path("/".join([self.root, *x]))

    def merged(self, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """One row per key of parts that were put below one another."""
        raise NotImplementedError

    def packed(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The merged tables as ``compact`` stores them."""
        return tables

    def _marked(self, kind: str) -> list[int]:
        if not self._fs.exists(self._path("done")):
            return []
        names = [st.getPath().getName().split("=") for st in self._fs.listStatus(self._path("done"))]
        return sorted(int(x[1]) for x in names if x[0] == kind)

    def parts(self) -> list[str]:
        """Folders that make up the state: the last compacted one and the batches after it."""
        base = self._marked("base")[-1:]
        return [f"base={b}" for b in base] + [f"part={b}" for b in self._marked("part") if not base or b > base[0]]

    def _write(self, folder: str, tables: dict[str, DataFrame]) -> None:
        for t in self.tables:
            tables[t].write.mode("overwrite").parquet(f"{self.root}/{t}/{folder}")
        self._fs.create(self._path("done", folder), True).close()

    def put(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Write the part of batch number ``batch``."""
        if (base := self._marked("base")) and batch <= base[-1]:
            return  # it was compacted: it comes again
        self._write(f"part={batch}", tables)

    def read(self) -> dict[str, DataFrame]:
        """The merged tables."""
        folders = self.parts()
        if not folders:
            raise FileNotFoundError(f"{self.root} has no part")
        return self.merged({t: self.spark.read.parquet(*[f"{self.root}/{t}/{x}" for x in folders]) for t in self.tables})

    def compact(self) -> None:
        """Write the merged parts as one and delete what it holds."""
        old = self.parts()
        if not old or old[-1].startswith("base="):
            return  # nothing came since
        new = old[-1].replace("part=", "base=")
        self._write(new, self.packed(self.read()))
        for folder in old:
            self._fs.delete(self._path("done", folder), True)
            for t in self.tables:
                self._fs.delete(self._path(t, folder), True)

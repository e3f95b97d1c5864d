"""Stages whose outputs are kept, checked and taken up again (EX08, EX10), and pixels processed tile by tile (EX09)."""

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.changes import MAX_RETRIES, PASSING
from quadrille.sources.io import _deleted
from quadrille.sources.stores import _checksum


class Stages:
    """EX08, EX10: named stages in a shared folder, each a Parquet table and a JSON line with its rows and checksum.

    A stage whose table is complete and still sums up is taken up again, any other is made anew. An error that may pass
    is tried again up to ``retries`` times. ``progress`` is called with (name, state, rows).
    """

    def __init__(self, spark: SparkSession, folder: str, *, retries: int = MAX_RETRIES, wait: float = 0.0, progress: Callable[[str, str, int], None] | None = None):
        self.spark, self.folder, self.retries, self.wait, self.progress = spark, folder.rstrip("/"), retries, wait, progress or (lambda *x: None)

    def _note(self, name: str) -> dict | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.note/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        line = self.spark.read.text(f"{self.folder}/{name}.note").first()
        return json.loads(line[0]) if line else None

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path, note = f"{self.folder}/{name}", self._note(name)
        if note is not None:
            kept = self.spark.read.parquet(path)
            if _checksum(kept) == (note["rows"], note["checksum"]):
                self.progress(name, "taken up", note["rows"])
                return kept
        for attempt in range(self.retries + 1):
            try:
                make().write.mode("overwrite").parquet(path)
                break
            except Exception as error:
                if attempt == self.retries or not any(word in str(error).lower() for word in PASSING):
                    self.progress(name, "failed", 0)
                    raise
                self.progress(name, "again", 0)
                time.sleep(self.wait * 2**attempt)
        made = self.spark.read.parquet(path)
        rows, checksum = _checksum(made)
        self.spark.range(1).select(F.lit(json.dumps({"rows": rows, "checksum": checksum})).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}.note")
        self.progress(name, "made", rows)
        return made

    def clear(self, *names: str) -> None:
        """EX10: the outputs of stages that aren't needed any more."""
        for name in names:
            _deleted(self.spark, f"{self.folder}/{name}.note")
            _deleted(self.spark, f"{self.folder}/{name}")


def tiled(pixels: DataFrame, size: int, halo: int, kernel: Callable, shape: tuple[int, int]) -> DataFrame:
    """EX09: ``kernel(array)`` of each tile of ``size`` pixels and ``halo`` more on each side; the halo's results go, so tiles fit together.

    The kernel takes and gives an array of the tile's shape, NaN where there is no pixel. A pixel is sent to its own
    tile and to those whose halo it is in. Results without a value have no row.
    """
    import numpy as np
    import pyarrow as pa

    near = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)), F.least(F.floor((F.col(c) + halo) / size), F.lit((n - 1) // size))))
    dealt = pixels.select("row_idx", "col_idx", F.col("value").cast("double").alias("value")).withColumn("ty", near("row_idx", shape[0])).withColumn("tx", near("col_idx", shape[1]))

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        top, left = max(0, ty * size - halo), max(0, tx * size - halo)
        bottom, right = min(shape[0], (ty + 1) * size + halo), min(shape[1], (tx + 1) * size + halo)
        grid = np.full((bottom - top, right - left), np.nan)
        grid[table.column("row_idx").to_numpy() - top, table.column("col_idx").to_numpy() - left] = table.column("value").to_numpy(zero_copy_only=False)
        made = np.asarray(kernel(grid), float)
        r, c = np.nonzero(~np.isnan(made))
        own = (r + top) // size == ty
        own &= (c + left) // size == tx
        return pa.table([pa.array((r[own] + top).astype(np.int32)), pa.array((c[own] + left).astype(np.int32)), pa.array(made[r[own], c[own]])], names=["row_idx", "col_idx", "value"])

    return dealt.groupBy("ty", "tx").applyInArrow(run, "row_idx int, col_idx int, value double")

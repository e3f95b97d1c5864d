"""Adding a computed column to a DataFrame in one Arrow pass, whatever its other columns are called."""

import functools
import inspect
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def with_kernel(df: DataFrame, text: str, out: str, kind: T.DataType, start: Callable[[], Callable[[pa.Array], list]], keep: Iterable[str] | None = None) -> DataFrame:
    """``df[keep]`` (default: all) and the column ``out``, which a kernel makes from the column ``text``.

    ``start()`` runs once in a task and returns the kernel: Arrow column to values or Arrow array. A column of the
    input that has the name ``out`` is replaced.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c != out]
    # By place, not by name: a column may be called as anything here.
    source = df.select(*[df[f"`{c}`"] for c in names], df[f"`{text}`"].cast("string")).toDF(*(f"in_{i}" for i in range(len(names) + 1)))
    arrow = to_arrow_type(kind)
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, kind)])

    def run(batches):
        kernel = start()
        for batch in batches:
            made = kernel(batch.column(len(names)))
            if not isinstance(made, pa.Array):
                made = pa.array(made, arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), made], [*names, out])

    return source.mapInArrow(run, schema)


def shielded(*parameters: str):
    """A decorator of operators that add a column ``out`` to a DataFrame, their first argument: its columns go by other names inside.

    So columns may have the names that the operator uses itself, or names that differ in case alone. ``parameters`` are
    those that name a column. Kept are the columns ``keep`` (default: all) but one that is named as ``out``.
    """

    def wrap(f):
        signature = inspect.signature(f)
        first = next(iter(signature.parameters))

        @functools.wraps(f)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            given = bound.arguments
            df, out, columns = given[first], given["out"], given[first].columns
            lowered = [c.lower() for c in columns]

            def place(name: str) -> int:
                if name not in columns and name.lower() not in lowered:
                    raise ValueError(f"no column {name!r}; there are {', '.join(columns)}")
                return columns.index(name) if name in columns else lowered.index(name.lower())

            kept = [place(c) for c in given["keep"]] if given.get("keep") is not None else range(len(columns))
            kept = [i for i in kept if lowered[i] != out.lower()]
            given[first] = df.toDF(*(f"kept_{i}" for i in range(len(columns))))
            for name in parameters:
                given[name] = f"kept_{place(given[name])}"
            if "keep" in signature.parameters:
                given["keep"] = [f"kept_{i}" for i in kept]
            given["out"] = "made"
            made = f(*bound.args, **bound.kwargs)
            return made.select(*(F.col(f"kept_{i}").alias(columns[i]) for i in kept), F.col("made").alias(out))

        return run

    return wrap

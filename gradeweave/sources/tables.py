"""Parquet tables in and out."""

import sys
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as fx
from ..schemas import GENERATED, columns
from .files import opened

# Send this module's functions with the job: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GENERATED_GLOB = "train-*.parquet"
#: A file without one of these gives no groups.
REQUIRED = ("prompt", fx.OUTPUTS, fx.PASS_RATES)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet file or directory; no data there is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_generated(spark: SparkSession, folder: str) -> DataFrame:
    """The columns grouping needs, of the folder's `train-*.parquet` only.

    A file that lacks one of them gives nulls for it (the schema is fixed, so no footer
    is merged), and `valid_candidates` then drops its rows; without `canonical_id`, or
    the numbers of problem and parts, the rows stay, as whole problems.
    """
    numbers = ("problem_id", "part", "n_parts", "first_sample")
    schema = columns(GENERATED, *numbers, "canonical_id", *REQUIRED)
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{GENERATED_GLOB}")


def unusable_rows(generated: DataFrame) -> DataFrame:
    """One row: how many rows lack the prompt, the outputs or the pass rates."""
    return generated.agg(
        *[
            F.count_if(F.col(name).isNull()).alias(f"without_{short}")
            for name, short in (
                ("prompt", "prompt"),
                (fx.OUTPUTS, "outputs"),
                (fx.PASS_RATES, "pass_rates"),
            )
        ]
    )


def missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    """(file, column, rows): the columns grouping needs that a file lacks, and the file's rows.

    Files are listed as `read_generated` finds them; their footers are read in tasks, and
    nothing else of them.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    files = listed.load(f"{folder.rstrip('/')}/{GENERATED_GLOB}").select("path")
    tasks = 4 * spark.sparkContext.defaultParallelism
    return files.repartition(tasks, "path").mapInArrow(footer_batches, "file string, column string, rows bigint")


def footer_batches(batches):
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            store, place = opened(path)
            with store.open_input_file(place) as file:
                footer = pq.ParquetFile(file)
                names = set(footer.schema_arrow.names)
                found += [(path, name, footer.metadata.num_rows) for name in REQUIRED if name not in names]
        columns = zip(*found) if found else ((), (), ())
        kinds = (pa.string(), pa.string(), pa.int64())
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["file", "column", "rows"])


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Have `write` fill a folder beside the path, then put it in the path's place.

    A write that fails leaves what was there before; a retry, or a rerun, replaces it whole.
    Names that begin with `_` are passed over by whoever reads the folder meanwhile.
    """
    parent, name = path.rstrip("/").rsplit("/", 1)
    staged, replaced = (f"{parent}/_{kind}-{uuid.uuid4().hex}" for kind in ("staged", "replaced"))
    write(f"{staged}/{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    target = place(path)
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(target) and not store.rename(target, place(replaced)):
        raise OSError(f"cannot replace {path}")
    if not store.rename(place(f"{staged}/{name}"), target):
        raise OSError(f"cannot publish {path}")
    for left in (staged, replaced):
        store.delete(place(left), True)
    return path


def write_generated(generated: DataFrame, folder: str, part: int = 0) -> str:
    """Write as shard `train-NNN.parquet` below the folder, where `read_generated` looks.

    Other shards are left alone; the same shard, as of a retry, is replaced. A problem's text is
    in several columns, so files are packed tighter than by default.
    """
    path = f"{folder.rstrip('/')}/train-{part:03d}.parquet"
    return publish(generated.sparkSession, path, generated.write.option("compression", "zstd").parquet)


def write_groups(groups: DataFrame, folder: str, group_size: int = fx.GROUP_SIZE) -> str:
    path = f"{folder.rstrip('/')}/processed_train_n{group_size}.parquet"
    return publish(groups.sparkSession, path, groups.write.parquet)


def write_split(records: DataFrame, folder: str) -> str:
    """Write labelled records by side, as they are dealt (see `records.dealt_with_index`).

    They are stored in the order of the shuffle key, file after file.
    """
    path = f"{folder.rstrip('/')}/records"
    # The writer wants rows sorted by side; sorting by both keeps the order within one.
    ordered = records.sortWithinPartitions("split", "shuffle_key").drop("shuffle_key")
    return publish(records.sparkSession, path, ordered.write.partitionBy("split").parquet)

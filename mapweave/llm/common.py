"""What the operators of this subpackage share: tables, written intermediate results, tokenizer files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
WORD_BREAKS = "\\x20\\x09-\\x0D"
#: Unicode white space, as the tokenizer libraries take it.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it names none (tests), a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="mapweave-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the session's Python ends."""
    path = f"{shared_dir(spark)}/mapweave-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(release, spark, path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; harmless if the session or the path is gone."""
    try:
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # noqa: BLE001  the session has ended: nothing left to tidy
        return


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder (in folders by the columns `by`): cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # nothing reads this write's shuffles again, so Spark may remove their files as soon as it ends
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*(by or [])).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    release(df.sparkSession, df.written_path)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions from one batch to one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first `keys` columns, dealt out anew so that no group of equal keys is cut."""
    held: list[list] = []  # the last group may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = np.logical_and.reduce([c == c[-1] for c in columns[:keys]])
        if held and last.all() and all(held[0][i][0] == columns[i][0] for i in range(keys)):
            held.append(columns)
            continue
        whole = [np.concatenate([*(h[i] for h in held), c[~last]]) for i, c in enumerate(columns)]
        if len(whole[0]):
            yield whole
        held = [[c[last] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def group_numbers(keys: list[np.ndarray]) -> np.ndarray:
    """0, 1, ... for each run of equal keys."""
    return np.cumsum(np.concatenate([[False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte: printable Latin-1 stays, the rest is moved up from 256 on."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(stays)))}
    return [moved.get(b, chr(b)) for b in range(256)]


@cache
def to_byte_chars() -> Callable[[str], str]:
    spelling = dict(enumerate(byte_chars()))
    return lambda s: s.encode("utf-8").decode("latin-1").translate(spelling)


def doc_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shingles(text: str | bytes | None, words: int) -> list[bytes]:
    """Runs of so many words, repeats included; the whole sequence if there are fewer words, nothing if there are none."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    tokens = raw.lower().split()  # bytes: A-Z only, and the six white-space characters
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return [line] if tokens else []
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [line[i:j] for i, j in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]

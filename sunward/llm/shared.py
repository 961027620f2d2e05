"""What the operators share: stored tables, text scanning and hashing of words."""

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as bytes.split() and the WORD pattern see it.
SPACE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Only where the session sets none and runs in one process (tests) a folder of this machine
    is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='sunward-llm-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_OPEN_STEPS: list = []


@contextmanager
def step_tables():
    """The list of all tables that are stored within, so that they can be released when the step's own result is stored."""
    made: list = []
    _OPEN_STEPS.append(made)
    try:
        yield made
    finally:
        _OPEN_STEPS.remove(made)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here.

    A lost executor costs nothing that was stored, and what reads the table twice does not
    compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _OPEN_STEPS:
        made.append(out)
    return out


def shuffles_cleaned(step):
    """A step (its first argument a DataFrame) whose shuffle files Spark deletes as each of its jobs ends, not when the driver collects its garbage.

    For steps that store what they read twice: nothing asks for the files again. The setting is
    put back afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(step)
    def run(df, *args, **named):
        conf = df.sparkSession.conf
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            return step(df, *args, **named)
        finally:
            conf.unset(key) if before is None else conf.set(key, before)

    return run


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path is not None:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once an application.

    Where the package's folder is on PYTHONPATH, as on a cluster with it installed, there is
    nothing to do; else Spark itself distributes it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    target = Path(tempfile.mkdtemp(prefix="sunward-ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def arrow_pass(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def free_names(taken, stem: str, n: int = 1) -> list[str]:
    """``n`` column names that no column in ``taken`` has (Spark does not tell case apart)."""
    used, out, k = {c.lower() for c in taken}, [], 0
    while len(out) < n:
        if f"{stem}_{k}" not in used:
            out.append(f"{stem}_{k}")
        k += 1
    return out


def lower_ascii(c):
    """Lower-case A-Z and nothing else; texts that are all ASCII take the quick path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c, separator: str):
    """The words between runs of ``separator``; NULL and empty texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), separator), lambda w: w != "")


def n_words(c):
    """Number of WORD runs in a text (NULL: 0)."""
    return F.coalesce(F.size(words_of(c, SPACE)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.BOUND:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs; a text of fewer words, but not none, is one run."""
    n = min(n, len(ids))
    if n == 0:
        return ids
    out = ids[:len(ids) - n + 1].copy()
    for i in range(1, n):
        out *= _MIX
        out += ids[i:len(ids) - n + 1 + i]
    return mixed(out + np.uint64(n))


def gram_sets(texts: list, words: "WordHashes", n: int) -> list[np.ndarray]:
    """For each text (bytes or None) its distinct n-word runs as ascending hashes; A-Z are lower-cased.

    The texts of a batch are hashed as one long row of words, whose runs over a text's end are left out.
    """
    rows = [text.translate(LOWER_BYTES).split() if text else [] for text in texts]
    ids = words.of([w for row in rows for w in row])
    every = gram_hashes(ids, n) if len(ids) >= n else ids[:0]
    out, at = [], 0
    for row in rows:
        k = len(row)
        out.append(np.unique(every[at:at + k - n + 1]) if k >= n else gram_hashes(ids[at:at + k], n))
        at += k
    return out

"""Readers and sinks with fixed schemas; nothing is inferred."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.sources import png

GLYPH = "font STRING, letter STRING, case STRING, path STRING, source STRING"
FAMILY_TAGS = "family STRING, na STRING, tags STRING, weight STRING"

#: The store's tables and their columns.
TABLES = {
    "fonts": "id BIGINT, embedding ARRAY<FLOAT>",
    "fontsMeta": "id BIGINT, name STRING, location STRING, file STRING, paid BOOLEAN",
    "registry": "id BIGINT, name STRING, location STRING, file STRING, paid BOOLEAN",
    "users": "id BIGINT, publicID STRING, username STRING, hash STRING, admin BOOLEAN",
    "descriptions": "fontID BIGINT, description STRING, userID BIGINT, created TIMESTAMP",
    "approvals": "fontID BIGINT, query STRING, userID BIGINT, created TIMESTAMP",
    "ratings": "fontID BIGINT, rating INT, userID BIGINT, created TIMESTAMP",
}


#: Folders whose names go to every task.
FOLDERS = 10_000


def _stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\.[^./\\]*$", 1)


def _file_order() -> Column:
    """Ascends with the files by path, their byte ranges, and the rows of a range."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def glyph_files(spark: SparkSession, directory: str, source: str, suffix: str = "bmp", market: bool = False) -> DataFrame:
    """The glyph table of a folder's image files; only paths are read. Market sets have their own naming."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(directory).select("path")
    s = files.withColumn("stem", _stem())
    if market:
        parts = (X.market_font("stem"), X.market_letter("stem"), X.market_case("stem"))
    else:
        parts = (X.family_of_stem("stem"), F.lower(X.letter_of_stem("stem")), F.right("stem", F.lit(1)))
    return s.select(*(c.alias(n) for n, c in zip(("font", "letter", "case"), parts, strict=True)), "path", F.lit(source).alias("source"))


def _decode(raw: bytes) -> tuple[int, int, list[float]] | None:
    """Grey values 0..1 of a PNG, an uncompressed BMP (8, 24 or 32 bits) or a raw array file; None if it can't be read."""
    try:
        if raw.startswith(png.SIGNATURE):
            a = png.grey(raw)
            return *a.shape, a.ravel().tolist()
        if raw[:6] == b"\x93NUMPY":
            import io

            a = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
            return a.shape[0], a.shape[1], a.ravel().tolist()
        if raw[:2] != b"BM":
            return None
        at, w, h, bits = (int.from_bytes(raw[a:b], "little", signed=True) for a, b in ((10, 14), (18, 22), (22, 26), (28, 30)))
        row, k = (abs(w) * bits + 31) // 32 * 4, bits // 8
        a = np.frombuffer(raw, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * k].reshape(abs(h), w, k)
        grey = a[:, :, 0].astype(float) if k == 1 else a[:, :, 2] * 0.299 + a[:, :, 1] * 0.587 + a[:, :, 0] * 0.114
        grey = (grey[::-1] if h > 0 else grey) / 255
        return abs(h), w, grey.ravel().tolist()
    except (ValueError, IndexError, OSError):
        return None


def decode_images(raw: DataFrame) -> DataFrame:
    """(path, h, w, pixels) of raw (path, content): decoded images; what can't be read, or is null, has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(_decode(bytes(c)) if c is not None else None) or (None, None, None) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "h": pd.array([g[0] for g in got], "Int32"), "w": pd.array([g[1] for g in got], "Int32"), "pixels": [g[2] for g in got]})

    return raw.select("path", "content").mapInPandas(run, "path string, h int, w int, pixels array<double>")


def load_images(spark: SparkSession, directory: str, suffix: str = "bmp") -> DataFrame:
    """(path, h, w, pixels) of a folder's image files."""
    return decode_images(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(directory))


def converted(spark: SparkSession, directory: str, out: str, suffix: str = "png") -> DataFrame:
    """The decoded images of a folder of market files, written as Parquet once; later calls read that."""
    return cached(spark, out, lambda: market_normalised(load_images(spark, directory, suffix)))


def signed_distance(images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """images with sdf: distance to the set pixels less distance to the others, over the side."""

    def one(h: int, w: int, pixels: list[float]) -> list[float]:
        bits = np.asarray(pixels).reshape(h, w) > threshold
        far = float(h + w)

        def away(mask: np.ndarray) -> np.ndarray:
            if not mask.any():
                return np.full((h, w), float(max(h, w)))
            place = np.arange(h)[:, None]
            above = np.maximum.accumulate(np.where(mask, place, -far), 0)
            below = np.minimum.accumulate(np.where(mask, place, h + far)[::-1], 0)[::-1]
            column = np.minimum(place - above, below - place) ** 2  # squared distance within the column
            x = np.arange(w)
            return np.sqrt((column[:, None, :] + (x[:, None] - x[None, :]) ** 2).min(-1))

        return ((away(bits) - away(~bits)) / max(h, w)).ravel().tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sdf=[one(int(h), int(w), p) if p is not None else None for h, w, p in zip(b["h"], b["w"], b["pixels"], strict=True)])

    return images.mapInPandas(run, f"{', '.join(f'{n} {t}' for n, t in images.dtypes)}, sdf array<double>")


def market_normalised(images: DataFrame, side: int = 48, padding: int = 8, least: float = 0.05) -> DataFrame:
    """(path, h, w, pixels) inverted, trimmed to what is set, fitted to a square with padding, centred."""

    def one(h: int, w: int, pixels: list[float]) -> list[float] | None:
        a = 1 - np.asarray(pixels).reshape(h, w)
        rows, cols = np.flatnonzero((a > least).any(1)), np.flatnonzero((a > least).any(0))
        if not len(rows):
            return None
        a = a[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
        k = (side - 2 * padding) / max(a.shape)
        m, n = (max(1, round(s * k)) for s in a.shape)
        a = a[np.minimum((np.arange(m) / k).astype(int), a.shape[0] - 1)][:, np.minimum((np.arange(n) / k).astype(int), a.shape[1] - 1)]
        out = np.zeros((side, side))
        y, x = (side - m) // 2, (side - n) // 2
        out[y : y + m, x : x + n] = a
        return out.ravel().tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = [one(int(h), int(w), p) if p is not None else None for h, w, p in zip(b["h"], b["w"], b["pixels"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "h": side, "w": side, "pixels": px})

    return images.mapInPandas(run, "path string, h int, w int, pixels array<double>")


def tag_files(spark: SparkSession, directory: str) -> DataFrame:
    """(font, adjectives): one text file a font, words apart by white space."""
    t = spark.read.text(directory, wholetext=True).select(F.input_file_name().alias("path"), "value")
    words = F.filter(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda w: w != "")
    return t.select(F.url_decode(_stem("path")).alias("font"), words.alias("adjectives"))


def category_csv(spark: SparkSession, path: str) -> DataFrame:
    """(key, adjectives) of CSV files with a header; malformed lines are left out, the last row of a key counts.

    The order of rows is that of the files by path, and that within each file.
    """
    rows = spark.read.schema("base_font_name STRING, category STRING, theme STRING").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    rows = rows.withColumn("_seq", _file_order())
    last = rows.groupBy("base_font_name").agg(F.max_by(F.array("category", "theme"), "_seq").alias("adjectives"))
    return last.select(F.col("base_font_name").alias("key"), "adjectives")


def family_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(family, tag, weight, seq): tags lose their path, weights are over 100; weights that aren't numbers drop the row.

    seq ascends with the files by path, and within each file.
    """
    rows = spark.read.schema(FAMILY_TAGS).option("header", header).csv(path).withColumn("seq", _file_order())
    return rows.select("family", X.last_path_part("tags").alias("tag"), (F.col("weight").try_cast("double") / 100).alias("weight"), "seq").where("weight IS NOT NULL")


def articles(spark: SparkSession, directory: str, marker: str = "METADATA.pb", files: str = "*.html", whole: bool = False) -> DataFrame:
    """(folder, text): the last HTML file of each folder that holds a marker file (not an empty one, which scans skip). For whole see page_text.

    Files are chosen by their names. Only those are read on, in lines, which meet by folder in order; a page is put together
    and its text taken before the next one comes, so only the text is ever one value of a row.
    """
    listed = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directory).select(F.col("_metadata.file_path").alias("file"))
    folder = F.regexp_extract(F.url_decode("file"), r"^[a-z0-9]*:?/*(.*)/[^/]*$", 1).alias("folder")
    marked = listed("*").where(F.url_decode("file").endswith(marker)).select(folder).distinct()
    last = listed(files).select("file", folder).join(marked, "folder", "left_semi").groupBy("folder").agg(F.max("file").alias("file"))
    if last.count() <= FOLDERS:
        last = F.broadcast(last)
    at = ("_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).option("lineSep", "\n").text(directory)
    lines = lines.select(*(F.col(c).alias(n) for c, n in zip(at, ("file", "block"))), F.monotonically_increasing_id().alias("row"), "value")

    def text(folder: str | None, parts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([X.page_text("\n".join(parts), whole)], pa.string())], ["folder", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            names = b["folder"].to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()] if len(names) else []
            for k, z in zip(starts, [*starts[1:], len(names)]):
                if parts and names[k] != now:
                    yield text(now, parts)
                    parts = []
                now = names[k]
                parts.append("\n".join(b["value"].slice(k, z - k).to_pylist()))
        if parts:
            yield text(now, parts)

    met = lines.join(last, "file").repartition("folder").sortWithinPartitions("folder", "block", "row")
    return met.select("folder", "value").mapInArrow(run, "folder string, text string")


def json_lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, items) of JSON objects of lists of numbers or of strings, one object a file; a key without a list has null.

    A file is read in byte ranges, cut behind each list: a piece holds a whole entry, unless a string holds a bracket.
    Pieces with half a string are put together again, by the quotes before them; only files that have such pieces pay
    for that. Entries of other types, and what isn't JSON, have no rows.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    pieces = spark.read.option("lineSep", "]").text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("at"))
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', ""))
    pieces = pieces.withColumn("odd", quotes % 2)
    if not pieces.where("odd = 1").isEmpty():
        pieces = _whole_entries(pieces)
    body = F.regexp_replace("value", r"^\s*[{,]?", "")
    closed = body.rlike(r"}\s*$")  # what follows the last list
    entry = F.concat(F.lit("{"), body, F.when(closed, "").otherwise("]}"))
    return pieces.select(F.explode(F.from_json(entry, f"map<string,array<{kind}>>")).alias("key", "items"))


def _whole_entries(pieces: DataFrame) -> DataFrame:
    """Pieces joined up to the next one behind which no string is open: quotes and ends are counted by block, and over a file's blocks."""
    inside, before = Window.partitionBy("file", "at.block").orderBy("at"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lambda df, c: df.groupBy("file", F.col("at.block").alias("block")).agg(F.sum(c).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))

    def counted(df: DataFrame, c: str, out: str) -> DataFrame:
        so_far = blocks(df, c).withColumnsRenamed({"block": "_block", "file": "_file"})
        joined = df.join(so_far, (F.col("file") == F.col("_file")) & (F.col("at.block") == F.col("_block"))).drop("_file", "_block")
        return joined.withColumn(out, F.col("n") + F.sum(c).over(inside)).drop("n")

    open_after = counted(pieces, "odd", "quotes").withColumn("ends", (F.col("quotes") % 2 == 0).cast("int"))
    entry = counted(open_after, "ends", "ended").withColumn("entry", F.col("ended") - F.col("ends"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "]")
    return entry.groupBy("file", "entry").agg(whole.alias("value"))


def query_json(spark: SparkSession, path: str) -> DataFrame:
    """(font, query) of a JSON object of lists."""
    return json_lists(spark, path, "string").select(F.col("key").alias("font"), F.explode("items").alias("query"))


def vector_json(spark: SparkSession, path: str) -> DataFrame:
    """(font, v) of a JSON object of number lists."""
    return json_lists(spark, path, "double").select(F.col("key").alias("font"), F.col("items").alias("v"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path; made and written first if it isn't there yet."""
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def missing_parts(rows: DataFrame, path: str, parts: list[str]) -> DataFrame:
    """The store at the path, by parts, after the parts of rows that it lacks are appended; finished ones stay as they are.

    Rows of a finished part aren't computed again if the plan can tell by the parts' columns alone.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(path)
    done = spark.read.schema(schema).parquet(path).select(*parts).distinct()  # a row for each part
    rows.join(done, parts, "left_anti").write.mode("append").partitionBy(*parts).parquet(path)
    return spark.read.schema(schema).parquet(path)


def path_file(spark: SparkSession, path: str) -> DataFrame:
    """(path_id, pos, font): a path on each line, names apart by " -> "."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("path_id"), "value").where(F.length("value") > 0)
    return lines.select("path_id", F.posexplode(F.split("value", " -> ")).alias("pos", "font"))


def score_csv(scores: DataFrame, path: str) -> None:
    """Writes a score table as one CSV with a header; NaN is an empty cell."""
    clean = scores.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes))
    clean.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_score_csv(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(["name STRING", *(f"`{m}` DOUBLE" for m in models)])).option("header", True).csv(path)


def create_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables as Parquet folders; those that exist stay as they are."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()}


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def committed(spark: SparkSession, root: str) -> str | None:
    """The folder of the last committed version, None if there is none."""
    path, fs = _files(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    versions = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
    return f"{root}/v{max(versions)}" if versions else None


def transaction(spark: SparkSession, root: str, work: Callable[[str | None], dict[str, DataFrame]]) -> str:
    """Commits the tables that work makes of the last version's folder, all or none; the new version's folder.

    They are written to a folder of their own, which one rename publishes; if anything fails before that, the folder goes
    and the last version stays. If another writer has published the version meanwhile, the rename fails and so does this.
    """
    last = committed(spark, root)
    new, staged = f"{root}/v{int(last.rsplit('/v', 1)[1]) + 1 if last else 0}", f"{root}/_staged-{uuid.uuid4().hex}"
    (source, fs), (target, _) = _files(spark, staged), _files(spark, new)
    try:
        for name, df in work(last).items():
            df.write.parquet(f"{staged}/{name}")
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"{new} exists already")
    finally:
        if fs.exists(source):
            fs.delete(source, True)
    return new


def save_twice(df: DataFrame, root: str, stamp: str) -> None:
    """One copy under the stamp, which stays, and one as latest."""
    if not re.fullmatch(r"[\w. -]+", stamp):
        raise ValueError(f"not a folder name: {stamp}")
    df.write.mode("errorifexists").parquet(f"{root}/{stamp}")
    df.sparkSession.read.parquet(f"{root}/{stamp}").write.mode("overwrite").parquet(f"{root}/latest")

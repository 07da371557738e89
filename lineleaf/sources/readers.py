"""Sources and sinks: image files, bundles, job output, Markdown, catalogue snapshots.

Files are read by Spark's own readers, so any store that Spark can open will do; decoding works on their bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.logs import layer_bytes
from ..operators.kernels import PAGES
from ..runtime import ship_package

DEFAULT_DPI = 120.0


def png_bytes(a: np.ndarray, dpi: float | None = None) -> bytes:
    """A gray, bitonal (1 bit) or RGB page as PNG."""
    h, w = a.shape[:2]
    bits = a.ndim == 2 and a.size > 0 and set(np.unique(a)) <= {0, 255}
    rows = np.packbits(a > 0, axis=1) if bits else a.reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 1 if bits else 8, 2 if a.ndim == 3 else 0, 0, 0, 0))
    if dpi:
        out += chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1))
    return out + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels of a gray or RGB PNG of 1 or 8 bits without interlace."""
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    if interlace or color not in (0, 2) or depth not in (1, 8):
        raise ValueError("a PNG of another kind")
    step = 3 if color == 2 else 1
    line = (w * step * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, line + 1)
    out = np.zeros((h, line), np.uint8)
    for y in range(h):
        row, kind = raw[y, 1:].astype(int), raw[y, 0]
        up = out[y - 1].astype(int) if y else np.zeros(line, int)
        if kind == 2:
            row = row + up
        elif kind in (1, 3, 4):
            for x in range(line):
                left, corner = (row[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 4:
                    p = left + up[x] - corner
                    near = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                row[x] = (row[x] + (left if kind == 1 else (left + up[x]) // 2 if kind == 3 else near)) & 255
        out[y] = row & 255
    if depth == 1:
        return np.unpackbits(out, axis=1)[:, :w] * np.uint8(255)
    return out.reshape(h, w, 3) if color == 2 else out


def embedded_dpi(data: bytes) -> float | None:
    """Resolution from a PNG's pHYs, a JPEG's JFIF head or a TIFF's tag 282; nothing for 0 and less."""
    dpi = None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        i = data.find(b"pHYs", 8, 4096)
        if i > 0:
            x, _, unit = struct.unpack(">IIB", data[i + 4 : i + 13])
            dpi = x * 0.0254 if unit == 1 else None
    elif data[:2] == b"\xff\xd8":
        i = data.find(b"JFIF\0", 0, 64)
        if i > 0:
            unit, x, _ = struct.unpack(">BHH", data[i + 7 : i + 12])
            dpi = x if unit == 1 else x * 2.54 if unit == 2 else None
    elif data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack(e + "I", data[4:8])
        (n,) = struct.unpack(e + "H", data[at : at + 2])
        unit, value = 2, None
        for k in range(n):
            tag, _, _, v = struct.unpack(e + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag == 282:
                a, b = struct.unpack(e + "II", data[v : v + 8])
                value = a / b if b else None
            elif tag == 296:
                unit = struct.unpack(e + "H", data[at + 10 + 12 * k : at + 12 + 12 * k])[0]
        dpi = value * 2.54 if value and unit == 3 else value
    return float(dpi) if dpi and dpi > 0 else None


def tiff_strip(data: bytes) -> bytes:
    """The first strip of a TIFF by its tags 273 and 279."""
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(e + "I", data[4:8])
    (n,) = struct.unpack(e + "H", data[at : at + 2])
    found = {}
    for k in range(n):
        tag, kind, _, v = struct.unpack(e + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        found[tag] = struct.unpack(e + "H", data[at + 10 + 12 * k : at + 12 + 12 * k])[0] if kind == 3 else v
    return data[found[273] : found[273] + found[279]]


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with their place from 0 in the order; sorted by ranges, so that no task sees all of them.

    The sorted rows are checkpointed: a range that is computed again must not be cut elsewhere.
    """
    from ..operators.relational import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    x = df.sort(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33).alias("_part")
    counts = x.groupBy(part).agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return x.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")


def image_files(spark: SparkSession, path: str, default_dpi: float = DEFAULT_DPI, force: bool = False) -> DataFrame:
    """Files of a folder with their resolution, numbered by name in small letters, then path; the bytes stay undecoded."""
    ship_package(spark)
    dpi = F.pandas_udf(lambda s: s.map(embedded_dpi), "double")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    chosen = F.lit(default_dpi) if force else F.coalesce(dpi("content"), F.lit(default_dpi))
    numbers = numbered(files.select("path", name.alias("name")), ["name", "path"])
    return files.select("path", "length", chosen.alias("dpi"), "content").join(numbers, "path").select("number", "path", "name", "length", "dpi", "content")


def pages_of(files: DataFrame) -> DataFrame:
    """Decoded PNG pages by number; files that are no PNG or broken are left out, ``undecoded`` names them."""
    ship_package(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                if isinstance(a := png_or_reason(r.content), np.ndarray):
                    rows.append((r.number, "", a.tobytes(), *a.shape[:2], 1 if a.ndim == 2 else 3, r.dpi, "{}"))
            yield pd.DataFrame(rows, columns=["page", "branch", "pixels", "height", "width", "channels", "dpi", "meta"])

    return files.select("number", "dpi", "content").mapInPandas(run, PAGES)


def png_or_reason(content: bytes) -> np.ndarray | str:
    try:
        return png_pixels(content)
    except (ValueError, zlib.error, struct.error, TypeError) as error:
        return str(error) or type(error).__name__


def undecoded(files: DataFrame) -> DataFrame:
    """Files that ``pages_of`` leaves out, and why."""
    ship_package(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = f.assign(reason=f["content"].map(lambda c: None if isinstance(x := png_or_reason(c), np.ndarray) else x))
            yield found.loc[found["reason"].notna(), ["number", "path", "reason"]]

    return files.select("number", "path", "content").mapInPandas(run, "number long, path string, reason string")


def decoded_images(spark: SparkSession, path: str, default_dpi: float = DEFAULT_DPI, force: bool = False) -> DataFrame:
    """Pages of all formats that Spark's image source reads (PNG, JPEG, GIF, BMP), numbered like ``image_files``."""
    files = image_files(spark, path, default_dpi, force).select("number", "dpi", F.regexp_replace("path", "^file:/+", "file:/").alias("_path"))
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path).select("image.*")
    found = images.withColumn("_path", F.regexp_replace("origin", "^file:/+", "file:/")).join(files, "_path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = a[:, :, 0] if r.nChannels == 1 else a[:, :, 2::-1]  # blue comes first, opacity goes
                rows.append((r.number, "", a.tobytes(), *a.shape[:2], 1 if a.ndim == 2 else 3, r.dpi, "{}"))
            yield pd.DataFrame(rows, columns=["page", "branch", "pixels", "height", "width", "channels", "dpi", "meta"])

    return found.select("number", "dpi", "height", "width", "nChannels", "data").mapInPandas(run, PAGES)


PAGE_ROWS = "index int, file string, w int, h int"


def read_bundle(spark: SparkSession, folder: str, version: int = 1) -> DataFrame:
    """Pages of a bundle (manifest.json, pages.jsonl, images) in order; another version, a bad line or a missing file fails."""
    manifest = spark.read.schema("format_version int, project string, device string, dpi double").option("multiLine", "true").json(f"{folder}/manifest.json").first()
    if manifest is None or manifest["format_version"] != version:
        raise ValueError("a bundle of another version")
    rows = spark.read.schema(PAGE_ROWS).option("mode", "FAILFAST").json(f"{folder}/pages.jsonl").where("file is not null")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content")
    joined = rows.withColumn("_name", F.element_at(F.split("file", "/"), -1)).join(files, "_name", "left")
    if not joined.where("content is null").isEmpty():
        raise ValueError("a page's image is missing")
    return joined.select("index", "file", "w", "h", F.lit(manifest["dpi"]).alias("dpi"), "content").orderBy("index")


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """Pages (job, place, markdown, header, footer) of JSON lines; blank lines are skipped, plain pages are Markdown."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    body = F.coalesce(F.get_json_object("value", "$.response.body.pages"), F.get_json_object("value", "$.pages"))
    raw = F.from_json(body, "array<string>")
    x = lines.select(F.get_json_object("value", "$.custom_id").alias("job"), F.posexplode(raw).alias("place", "p"))
    get = lambda k: F.get_json_object(F.when(F.col("p").startswith("{"), F.col("p")), f"$.{k}")
    markdown = F.when(F.col("p").startswith("{"), get("markdown")).otherwise(F.col("p"))
    return x.select("job", "place", markdown.alias("markdown"), get("header").alias("header"), get("footer").alias("footer"))


def write_markdown(documents: DataFrame, path: str, key: str, text: str = "markdown") -> None:
    """One text file a document, in a folder by key; nothing is gathered."""
    documents.select(F.col(key).alias("document"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """A slim catalogue: each table beside the others; rows written by table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return {name: df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count() for name, df in tables.items()}


def write_slim(nodes: DataFrame, keep: DataFrame, images: DataFrame, others: dict[str, DataFrame], folder: str) -> dict[str, tuple[int, int]]:
    """A catalogue with only the kept nodes (id, parent_id, root_id, image_id) and the images they use; rows before and after.

    Written to a folder of its own: to slim a catalogue in place, put the folder where the old one was.
    """
    from ..operators.relational import prune

    kept = prune(nodes, keep, "id", "parent_id", "root_id")
    used = images.join(kept.select("image_id").distinct(), "image_id", "left_semi")
    after = write_snapshot({"nodes": kept, "images": used, **others}, folder)
    return {name: (df.count(), after[name]) for name, df in {"nodes": nodes, "images": images, **others}.items()}


def pdf_text_lines(lines: DataFrame, page_h: Column, dpi: Column) -> DataFrame:
    """The hidden text layer of each line: font size, baseline in points from the page's foot, and the string's bytes."""
    pt = F.lit(72.0) / dpi
    height = F.col("y1") - F.col("y0")
    safe = F.regexp_replace(F.col("line"), r"([\\()])", r"\\$1")
    return lines.select("*", F.greatest(F.lit(2.0), height * pt * 0.85).alias("size"), (F.col("x0") * pt).alias("x"), ((page_h - F.col("y1")) * pt).alias("y"), safe.alias("escaped"), layer_bytes(F.col("line")).alias("layer"))

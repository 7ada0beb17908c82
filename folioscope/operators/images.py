"""Pixel work on raw images (width, height, RGB bytes) as batch functions, with stand-ins where no image library is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import let

IMAGE = "path string, width int, height int, pixels binary"


def decoded(content: bytes | None) -> tuple[int, int, bytes] | None:
    """(width, height, RGB bytes) of a binary portable pixmap (P6, 255 values); None if it is none."""
    head = (content or b"").split(maxsplit=4)
    if len(head) != 5 or head[0] != b"P6" or not all(x.isdigit() for x in head[1:4]) or head[3] != b"255":
        return None
    w, h = int(head[1]), int(head[2])
    body = content[len(content) - w * h * 3 :]
    return (w, h, body) if w and h and len(body) == w * h * 3 else None


def images(spark, path: str) -> DataFrame:
    """path, width, height, pixels of every image file under a path that can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *d) for p, c in zip(pdf["path"], pdf["content"]) if (d := decoded(c))]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, IMAGE)


def raster(boxes: np.ndarray, width: float, height: float, dpi: int = 72) -> tuple[int, int, bytes]:
    """Stand-in for drawing a page: white, its boxes (x0, y0, x1, y1 in points) black, at dpi / 72 pixels a point."""
    k = dpi / 72
    out = np.full((max(1, round(height * k)), max(1, round(width * k)), 3), 255, np.uint8)
    for x0, y0, x1, y1 in np.asarray(boxes, float) * k:
        out[max(0, int(y0)) : max(0, int(y1)), max(0, int(x0)) : max(0, int(x1))] = 0
    return out.shape[1], out.shape[0], out.tobytes()


def _grid(width: int, height: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def _around(g: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Mean colour (cut to whole numbers) of the eight corners and edge middles three pixels outside a box."""
    h, w = g.shape[:2]
    xs, ys = (max(0, x0 - 3), max(0, (x0 + x1) // 2), min(w - 1, x1 + 3)), (max(0, y0 - 3), max(0, (y0 + y1) // 2), min(h - 1, y1 + 3))
    at = [(y, x) for j, y in enumerate(ys) for i, x in enumerate(xs) if (i, j) != (1, 1)]
    return np.array([g[min(y, h - 1), min(x, w - 1)] for y, x in at], int).sum(0) // len(at)


def _inside(g: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Colour of the text in a box: mean of the third of its sampled pixels that differ most from what is around."""
    h, w = g.shape[:2]
    bg = _around(g, x0, y0, x1, y1)
    x0, y0, x1, y1 = max(0, x0), max(0, y0), min(w - 1, x1), min(h - 1, y1)
    if x1 <= x0 or y1 <= y0:
        return np.zeros(3, int)
    p = g[y0 : y1 + 1 : max(1, (y1 - y0) // 10), x0 : x1 + 1 : max(1, (x1 - x0) // 10)].reshape(-1, 3).astype(int)
    d = np.abs(p - bg).sum(1)
    top = np.argsort(-d, kind="stable")[: max(3, len(p) // 3)]
    if d[top].mean() < 24:
        return np.zeros(3, int) if bg.mean() > 140 else np.full(3, 245)
    return p[top].sum(0) // len(top)


def colors(df: DataFrame) -> DataFrame:
    """df (width, height, pixels, x0, y0, x1, y1) with background and ink: packed RGB colours around and inside each box; null without an image."""

    @F.pandas_udf("struct<background:int,ink:int>")
    def of(w: pd.Series, h: pd.Series, p: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, *box in zip(w, h, p, x0, y0, x1, y1):
            if c is None or any(v is None or v != v for v in box):
                out.append((None, None))
                continue
            g, box = _grid(int(a), int(b), c), [int(v) for v in box]
            out.append(tuple(int(x[0]) << 16 | int(x[1]) << 8 | int(x[2]) for x in (_around(g, *box), _inside(g, *box))))
        return pd.DataFrame(out, columns=["background", "ink"]).astype("Int32")

    return df.withColumn("c", of("width", "height", "pixels", "x0", "y0", "x1", "y1")).select("*", "c.background", "c.ink").drop("c")


def erased(width: int, height: int, pixels: bytes, boxes: list[tuple[int, int, int, int]]) -> bytes:
    """Stand-in for repainting: every box filled with the colour around it."""
    g = _grid(width, height, pixels).copy()
    for x0, y0, x1, y1 in boxes:
        g[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1] = _around(g, x0, y0, x1, y1)
    return g.tobytes()


def drawn_size(lines: Column, width: Column, height: Column, size: Column) -> Column:
    """Stand-in for drawing: the largest size from `size` down to 6 at which lines of letters half as wide as high fit a box; 6 if none does."""
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    fits = lambda s: (longest * s * 0.5 <= width) & (F.size(lines) * s * 1.2 <= height)
    tries = F.sequence(F.greatest(size.cast("int"), F.lit(6)), F.lit(6), F.lit(-1))
    return let(tries, lambda ts: F.coalesce(F.get(F.filter(ts, fits), 0), F.lit(6)))


Engine = Callable[[bytes], list[tuple[list[tuple[float, float]], str]]]


def recognised(df: DataFrame, make: Callable[[bool], Engine]) -> DataFrame:
    """path, points, text of the texts that an engine reads in images (path, content).

    make(True) gives an engine on a graphics card; if that fails, once per partition, make(False) gives one without.
    An image that can't be read has no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            engine = make(True)
        except Exception:
            engine = make(False)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = engine(content)
                except Exception:
                    found = []
                rows += [(path, [{"x": float(x), "y": float(y)} for x, y in pts], text) for pts, text in found]
            yield pd.DataFrame(rows, columns=["path", "points", "text"])

    return df.select("path", "content").mapInPandas(run, "path string, points array<struct<x:double,y:double>>, text string")

"""One consistent form for texts that look alike (problem 3).

Arrow text is copied to one array of code points per batch. Lookup tables say, for every code point, how many code
points replace it and where they lie (expansion offsets); marks are put into canonical order and composed by searching
a sorted table of pairs. No string function runs per row.

The form: canonical and width/ligature/font compositions are undone, invisible characters dropped, every space is ' ',
every hyphen is '-', letters of other scripts that are drawn like a Latin letter become that letter, marks are composed.
Case, accents, digits and raised or lowered digits stay.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed

# Letters drawn like a Latin letter, by script.
LOOKALIKES = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝѵ", "ABESIJKMHOPCTXYaesijopcxyhdqwv")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳν", "ABEZHIKMNOPTYXojv")),
    "Armenian": dict(zip("օսցհոՕՍ", "oughnOU")),
    "Latin": {"ɑ": "a", "ɡ": "g", "ı": "i", "ǀ": "l"},
}
# Hyphens; dashes of other lengths are other signs.
HYPHENS = "‐‑﹣－-"
# Compatibility tags that don't change the look.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _invisible(cp: int, ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" and ch not in "؀؁؂؃۝܏" or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E) or 0xE0100 <= cp <= 0xE01EF


def _expansion(cp: int, alike: dict[str, str]) -> str:
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if _invisible(cp, ch):
        return ""
    if cat == "Zs" or ch in "\t\n\r\x0b\x0c\x85  ":
        return " "
    if ch in HYPHENS:
        return "-"
    d = unicodedata.decomposition(ch)
    if not d or 0xAC00 <= cp <= 0xD7A3:
        return alike.get(ch, ch)
    tag, parts = (d.split(" ", 1) if d[0] == "<" else ("", d))
    inner = [int(x, 16) for x in parts.split()]
    if tag in ("", *SAME_LOOK) or tag == "<compat>" and cat in ("Lu", "Ll", "Lt") and len(inner) > 1:
        return "".join(_expansion(x, alike) for x in inner)
    return alike.get(ch, ch)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, ...]:
    """(length of each expansion, its offset, all expansions, combining classes, pair keys sorted, their composites)."""
    alike = {a: b for t in LOOKALIKES.values() for a, b in t.items()}
    n = sys.maxunicode + 1
    size, at, ccc = np.ones(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    at[:] = -1
    for cp in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xE000 <= cp < 0xF900:
            continue
        ch = chr(cp)
        if c := unicodedata.combining(ch):
            ccc[cp] = c
        e = _expansion(cp, alike)
        if e != ch:
            size[cp], at[cp] = len(e), len(flat)
            flat += map(ord, e)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = cp
    for s in range(0xAC00, 0xD7A4):
        k = s - 0xAC00
        if k % 28:
            pairs[(s - k % 28) << 21 | (0x11A7 + k % 28)] = s
        else:
            pairs[(0x1100 + k // 588) << 21 | (0x1161 + k // 28 % 21)] = s
    keys = np.array(sorted(pairs), np.int64)
    return size, at, np.array(flat, np.uint32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, row starts): a copy of the Arrow text; null rows have no code points."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = b"" if col.buffers()[2] is None else memoryview(col.buffers()[2])[offsets[0] : offsets[-1]]
    byte = np.frombuffer(raw, np.uint8)
    heads = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])
    return np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets - offsets[0]]


def arrow_text(cps: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends[starts].astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())


def _regroup(keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(keep)])[starts]


def canonical_points(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, at, flat, ccc, keys, composed = tables()
    n = size[cps]
    if (at[cps] >= 0).any():
        ends = np.cumsum(n)
        src = np.repeat(np.arange(len(cps)), n)
        within = np.arange(len(src)) - np.repeat(ends - n, n)
        where = at[cps][src]
        out = np.where(where >= 0, flat[np.maximum(where, 0) + within] if len(flat) else 0, cps[src]).astype(np.uint32)
        starts = np.concatenate([[0], ends])[starts]
        cps = out
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for _ in range(len(cps)):  # canonical order of marks: adjacent exchanges until none is left
        c = ccc[cps]
        swap = np.flatnonzero((c[:-1] > c[1:]) & (c[1:] > 0) & (row[:-1] == row[1:]))
        swap = swap[np.concatenate([[True], np.diff(swap) > 1])] if len(swap) else swap
        if not len(swap):
            break
        cps[swap], cps[swap + 1] = cps[swap + 1], cps[swap].copy()
    while len(cps) > 1:
        key = cps[:-1].astype(np.int64) << 21 | cps[1:]
        pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero((keys[pos] == key) & (row[:-1] == row[1:]))
        if not len(hit):
            break
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        cps = cps.copy()
        cps[hit] = composed[pos[hit]]
        keep = np.ones(len(cps), bool)
        keep[hit + 1] = False
        starts, cps, row = _regroup(keep, starts), cps[keep], row[keep]
    blank = cps == 0x20  # runs of blanks become one, and none is left at either end of a row
    if blank.any():
        first = np.zeros(len(cps), bool)
        first[starts[:-1][starts[:-1] < len(cps)]] = True
        before = np.concatenate([[True], blank[:-1]]) | first
        keep = ~(blank & before)
        starts, cps = _regroup(keep, starts), cps[keep]
        full = np.diff(starts) > 0
        tail = starts[1:][full] - 1
        keep = np.ones(len(cps), bool)
        keep[tail[cps[tail] == 0x20]] = False
        starts, cps = _regroup(keep, starts), cps[keep]
    return cps, starts


def canonical_array(col: pa.Array) -> pa.Array:
    """Canonical form of each text; nulls stay null."""
    out = arrow_text(*canonical_points(*code_points(col)))
    return pa.compute.if_else(pa.compute.is_null(col), pa.scalar(None, pa.string()), out)


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with a column `out`: the canonical form of `text`. Null stays null, empty stays empty; an existing `out` is replaced."""
    names = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*[F.col(f"`{n}`") for n in names]).dtypes) + f", `{out}` string"

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, canonical_array(b.column(names.index(text)))], [*names, out])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def alike_pairs(rows: DataFrame, row_id: str, tbl: str, text: str = "text") -> DataFrame:
    """tbl, id_a, id_b (a < b): rows of one doc_id whose texts have one canonical form but aren't the same characters.

    Re-delivered rows count once; rows with a null text or a null doc_id look like none. Only ids and digests are
    shuffled, and only groups that hold more than one writing are joined with themselves.
    """
    r = rows.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), "doc_id", F.col(text).alias("text"))
    keyed = checkpointed(
        with_canonical(r).select("id", "doc_id", F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("writing")).distinct()
    )
    mixed = keyed.groupBy("doc_id", "look").agg(F.min("writing").alias("a"), F.max("writing").alias("b")).where("a <> b").select("doc_id", "look")
    some = keyed.join(mixed, ["doc_id", "look"], "left_semi")
    a, b = some.alias("a"), some.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.writing") != F.col("b.writing"))
    return a.join(b, on).select(F.lit(tbl).alias("tbl"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def found(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """alike_pairs of line_entry and of text_block; equal pairs once."""
    return alike_pairs(lines, "line_id", "line_entry").unionByName(alike_pairs(blocks, "block_id", "text_block")).distinct()

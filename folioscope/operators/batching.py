"""Requests for an external translator: greedy batches, cache misses, prompts, layout of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import collapse, let, rewrapped, should_translate


def greedy_batches(lengths: Column, most: int, chars: int) -> Column:
    """Batch numbers (from 1) for an ordered array of lengths: a new batch where the next item passes either limit.

    Items count as one character at least; an item over the limit stands alone; null lengths count as one.
    """

    def add(s: Column, n: Column) -> Column:
        n = F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long")
        new = (s["k"] >= most) | (s["k"] > 0) & (s["used"] + n > chars)
        return F.struct(
            F.when(new, F.lit(1)).otherwise(s["k"] + 1).alias("k"), F.when(new, n).otherwise(s["used"] + n).alias("used"),
            (s["b"] + F.when(new | (s["b"] == 0), 1).otherwise(0)).alias("b"),
            F.concat(s["out"], F.array((s["b"] + F.when(new | (s["b"] == 0), 1).otherwise(0)).cast("int"))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("b"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, add, lambda s: s["out"])


def page_batches(bs: DataFrame, most: int = 10, chars: int = 2200) -> DataFrame:
    """block_id, batch_no: the blocks of each page of the `orig` side in order. A page bounds the array that is folded.

    A batch takes one block and 400 characters at least, whatever the limits.
    """
    most, chars = max(1, most), max(400, chars)
    g = bs.where("side = 'orig'").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", "block_id", F.length("text").alias("len")))).alias("xs"))
    nos = greedy_batches(F.transform("xs", lambda x: x["len"]), most, chars)
    return g.select("doc_id", "page", F.explode(F.arrays_zip(F.col("xs").alias("x"), nos.alias("b"))).alias("z")).select("doc_id", "page", "z.x.block_id", F.col("z.b").alias("batch_no"))


def cache_misses(requests: DataFrame, memory: DataFrame, model: str = "default") -> DataFrame:
    """Distinct translatable texts that the memory of a model hasn't: text. Both sides are compared without blanks around."""
    want = requests.where(should_translate(F.col("text"))).select(F.trim("text").alias("text")).distinct()
    known = memory.where(F.col("model") == model).select(F.trim("source_text").alias("text"))
    return want.join(known, "text", "left_anti")


def looked_up(requests: DataFrame, memory: DataFrame, model: str = "default") -> DataFrame:
    """requests with `translated`: what the memory of a model has for them, or the stripped text where it has nothing."""
    m = memory.where(F.col("model") == model).select(F.trim("source_text").alias("key"), "target_text").groupBy("key").agg(F.min("target_text").alias("target_text"))
    return requests.join(m, F.trim("text") == F.col("key"), "left").withColumn("translated", F.coalesce("target_text", F.trim("text"))).drop("key", "target_text")


def answered(requests: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """requests (key, ordinal from 1, text) with `translated`: the reply part of the same ordinal, or the text itself.

    replies: key, parts (array of texts, null if a reply couldn't be read). Requests of null keys keep their text.
    """
    r = replies.select(*key, F.posexplode("parts").alias("at", "part")).withColumn("ordinal", F.col("at") + 1).groupBy(*key, "ordinal").agg(F.max("part").alias("part"))
    return requests.join(r, [*key, "ordinal"], "left").withColumn("translated", F.coalesce("part", "text")).drop("part")


def adapted_layout(translated: Column, original: Column, lengths: Column, table: Column, mode: str) -> Column:
    """A translation in the layout of its block: `lengths` of its lines, tables line for line, otherwise by mode."""
    t = collapse(F.coalesce(translated, F.lit("")))
    n = F.size(lengths)
    flow = {"structural": t, "char_count": rewrapped(t, lengths, n, 1.05, False)}.get(mode, rewrapped(t, lengths, n, 1.25, True))
    return F.when(t == "", original).when(table, rewrapped(t, lengths, n, 1.08, True)).otherwise(flow)


def fit_variants(text: Column, lengths: Column, table: Column, mode: str) -> Column:
    """Distinct ways to write a text that may fit its box, the least changed first."""
    base = F.trim(text)
    compact = F.trim(F.replace(F.replace(collapse(base), F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit(".")))
    out = [base, compact]
    if mode in ("hybrid", "char_count"):
        average = F.greatest(F.lit(8), F.floor(F.aggregate(lengths, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(lengths), F.lit(1))).cast("int"))
        for more in (0, 1, 2):
            room = F.concat(lengths, F.array_repeat(average, more)) if more else lengths
            out.append(F.when(~table, F.trim(rewrapped(compact, room, F.size(lengths) + more, 1.02 if mode == "char_count" else 1.10, mode == "hybrid"))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull() & (x != "")))


def line_heights(ratio: Column, mode: str) -> Column:
    """Line heights to try: the ratio and smaller ones within 0.75 and 1.6, each once."""
    if mode != "hybrid":
        return F.array(F.lit(None).cast("double"))
    tries = F.array(*map(F.lit, (1.0, 0.96, 0.92, 0.88, 0.84, 0.8, 0.76)))
    return F.array_distinct(F.transform(tries, lambda f: F.greatest(F.lit(0.75), F.least(F.lit(1.6), ratio * f))))


def smallest_size(size: Column, table: Column, mode: str, ratio: float = 0.6, least: float = 5.0) -> tuple[Column, Column]:
    """(smallest font size, hard limit below it) of a block."""
    floor = {"structural": max(ratio, 0.76), "char_count": min(ratio, 0.62), "hybrid": min(ratio, 0.58)}.get(mode, ratio)
    cap = {"char_count": 0.62, "hybrid": 0.58}.get(mode, 9.0)
    share = F.when(table, F.lit(min(max(ratio, 0.78), cap))).otherwise(F.lit(floor))
    small = F.greatest(F.lit(4.0), F.lit(least), size * share)
    return small, F.greatest(F.lit(2.2), F.least(small, size * 0.22))


def batch_prompt(texts: Column, target: str) -> Column:
    """One request for an ordered array of texts, numbered from 1."""
    numbered = F.transform(texts, lambda t, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), t))
    return F.concat(F.lit(f"Translate each numbered text to {target}. Keep the numbers.\n"), F.array_join(numbered, "\n"))


def system_prompt(source: str, target: str) -> str:
    """Instruction for a single text."""
    return f"Translate from {source} to {target}. Answer with the translation alone, whole, without comments or quotation marks. Keep names, codes and numbering."


def batch_system_prompt(source: str, target: str) -> str:
    """Instruction for numbered texts."""
    return f"Translate each numbered text from {source} to {target}. Answer with the same numbers in brackets, as many texts as were given, each whole, without comments."


def title_prompt(title: Column, source: str, target: str) -> Column:
    """Request for the title of a book."""
    return F.concat(F.lit(f"Translate this book title from {source} to {target}; keep names. Answer with the title alone:\n"), title)


def image_mode(mode: Column, scanned: Column, selectable_only: bool = True) -> Column:
    """How image text is redrawn: 'ai_rebuild' only if asked for and (with selectable_only) the page isn't scanned, else 'legacy'."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit("legacy"))))
    known = F.when(m.isin("legacy", "ai_rebuild"), m).otherwise("legacy")
    return F.when(scanned, "legacy").otherwise(known) if selectable_only else known


def layout_mode(mode: Column) -> Column:
    """A layout mode as written; unknown ones and null are 'structural'."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit("structural"))))
    return F.when(m.isin("structural", "char_count", "hybrid"), m).otherwise("structural")


def image_lines(text: Column, width: Column, lines: Column, hybrid: bool) -> Column:
    """Words of an image text in lines of at most `width` (times 1.02) characters.

    With hybrid, surplus lines are joined to the one before, and missing ones come from halving the longest line (of
    equals the first) by words until `lines` are there or it is one word.
    """
    ws = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    room = width * F.lit(1.02)

    def put(s: Column, w: Column) -> Column:
        last = F.element_at(s, -1)
        fits = F.length(last) + 1 + F.length(w) <= room
        return F.when(F.size(s) == 0, F.array(w)).when(fits, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(s, F.array(w)))

    wrapped = F.when(F.size(ws) == 0, F.array(text)).otherwise(F.aggregate(F.slice(ws, 2, F.size(ws)), F.slice(ws, 1, 1), put))
    if not hybrid:
        return wrapped
    n = F.greatest(lines, F.lit(1))

    def halved(s: Column, _: Column) -> Column:
        at = F.array_position(F.transform(s, lambda x: F.length(x)), F.array_max(F.transform(s, lambda x: F.length(x)))).cast("int")
        parts = F.split(F.element_at(s, at), " ")
        cut = F.floor(F.size(parts) / 2).cast("int")
        more = F.concat(F.slice(s, 1, at - 1), F.array(F.array_join(F.slice(parts, 1, cut), " "), F.array_join(F.slice(parts, cut + 1, F.size(parts)), " ")), F.slice(s, at + 1, F.size(s)))
        return F.when((F.size(s) >= n) | (F.size(parts) < 2), s).otherwise(more)

    def shaped(s: Column) -> Column:
        joined = F.concat(F.slice(s, 1, n - 1), F.array(F.array_join(F.slice(s, n, F.size(s)), " ")))
        return F.when(F.size(s) > n, joined).otherwise(F.aggregate(F.sequence(F.lit(1), n), s, halved))

    return let(wrapped, shaped)


def first_fit(size: Column, least: Column, step: Column, fits) -> Column:
    """The largest of size, size - step, ... not under `least` for which fits(size) holds; null if none does."""
    tries = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - least) / step + 1e-9), F.lit(0)).cast("int")), lambda k: size - k * step)
    return F.get(F.filter(tries, lambda x: (x >= least - 1e-9) & fits(x)), 0)


def fitted_text(variants: Column, heights: Column, size: Column, least: Column, step: Column, width: Column, height: Column) -> Column:
    """struct(text, line_height, size): the first of text variant x line height x falling size that fits a box.

    A letter is taken to be half a size wide; a text fits if its lines do. If nothing fits, the last variant at the
    smallest size is taken.
    """

    def need(t: Column, lh: Column, s: Column) -> Column:
        per = F.greatest(F.floor(width / (s * 0.5)), F.lit(1.0))
        rows = F.aggregate(F.split(t, "\n"), F.lit(0.0), lambda n, x: n + F.greatest(F.ceil(F.length(x) / per), F.lit(1)).cast("double"))
        return rows * s * F.coalesce(lh, F.lit(1.2))

    def tried(t: Column) -> Column:
        return F.transform(heights, lambda lh: F.struct(t.alias("text"), lh.alias("line_height"), first_fit(size, least, step, lambda s: need(t, lh, s) <= height).alias("size")))

    every = F.filter(F.flatten(F.transform(variants, tried)), lambda x: x["size"].isNotNull())
    rest = F.struct(F.element_at(variants, -1).alias("text"), F.element_at(heights, -1).alias("line_height"), least.alias("size"))
    return F.coalesce(F.get(every, 0), F.when(F.size(variants) > 0, rest))


def best_font(fonts: Column, text: Column, width: Column, height: Column) -> Column:
    """Name of the font (array of struct(name, wide, high) per letter of size 1) whose proportions fit a box best; of equals the first."""
    probe = F.least(F.greatest(F.length(text), F.lit(1)), F.lit(24))
    size = F.greatest(F.lit(10), F.floor(F.least(height, F.lit(64.0)) * 0.7))

    def score(f: Column) -> Column:
        w, h = F.greatest(F.lit(1.0), f["wide"] * size * probe), F.greatest(F.lit(1.0), f["high"] * size)
        return F.abs(width / w - height / h) + F.abs(w / h - probe / 2.2)

    scored = F.transform(fonts, lambda f, k: F.struct(score(f).alias("score"), k.alias("k"), f["name"].alias("name")))
    return F.array_min(scored)["name"]

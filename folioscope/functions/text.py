"""Text predicates and clean-ups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that tell an untranslated block.
ENGLISH = (
    "the of and to a in is that for it with as was on are be this have from or an at by not but what all were when can "
    "there their which each she he do has his her its they you your if will may must should"
)
# Name parts of books already in the target language, for the queue and for new file names.
QUEUE_MARKS = ("traduzido", "portugu", "personagem", "talentos", "pt-br", "pt_br", "traducao")
NAME_MARKS = ("traduzido", "portugu", "personagem", "monstro")
SPACES = r"(?U)[\s\x1c-\x1f]+"


def collapse(x: Column) -> Column:
    """Runs of any white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def stripped(x: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def comparable(x: Column) -> Column:
    """Collapsed and lower-cased; null is ''."""
    return F.lower(collapse(F.coalesce(x, F.lit(""))))


def words(x: Column) -> Column:
    return F.filter(F.split(collapse(F.coalesce(x, F.lit(""))), " "), lambda w: w != "")


def should_translate(x: Column, least: int = 3, unicode_letters: bool = False) -> Column:
    """Whether a text has anything to translate; with unicode_letters letters of every script count, else Latin-1 ones."""
    t = collapse(F.coalesce(x, F.lit("")))
    letters = F.size(F.regexp_extract_all(t, F.lit(r"\p{L}" if unicode_letters else r"[A-Za-zÀ-ÖØ-öø-ÿ]"), F.lit(0)))
    signs = t.rlike(r"^[\d\s\-–—.,:;!?()\[\]{}/|@#$%^&*+=<>~`'\"]+$")
    return (t != "") & ~signs & (letters >= 1) & ~((letters == 1) & (F.length(t) < least))


def unchanged(source: Column, target: Column, fold_case: bool = False) -> Column:
    """Same text of 18 characters and three words at least; fold_case is the validator's variant."""
    f = comparable if fold_case else (lambda x: collapse(F.coalesce(x, F.lit(""))))
    return (f(source) == f(target)) & (F.length(f(source)) >= 18) & (F.size(words(source)) >= 3)


def likely_english(x: Column, listed: str = ENGLISH) -> Column:
    """Four words at least, more than a quarter of them (with their punctuation) in the list."""
    w = words(F.lower(x))
    among = F.array(*map(F.lit, listed.split()))
    return (F.size(w) >= 4) & (F.size(F.filter(w, lambda v: F.array_contains(among, v))) * 4 > F.size(w))


def suspicious_glyphs(x: Column) -> Column:
    """Replacement signs, boxes, runs of question marks, and all question marks where they are a tenth of the text."""
    t = F.coalesce(x, F.lit(""))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    runs = F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"\?{3,}"), F.lit(0)), ""))
    q = count("?")
    many = (F.length(t) >= 12) & (q >= F.greatest(F.lit(3), F.floor(F.length(t) * 0.1).cast("int")))
    return count("�") + count("□") + runs + F.when(many, q).otherwise(0)


def table_like(lines: Column) -> Column:
    """Whether a block's lines (array) look like a table."""
    n = F.size(lines)
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 36))
    digits = F.size(F.filter(lines, lambda x: x.rlike(r"\d")))
    divided = F.size(F.filter(lines, lambda x: x.rlike(r"[|;:]")))
    return (n >= 3) & ((short >= F.greatest(F.lit(2), F.floor(n * 0.6).cast("int"))) & (digits >= 2) | (divided >= 1) & (short >= 2))


def clean_reply(x: Column) -> Column:
    """Without code fences, bold marks and one pair of quotes around."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"```[a-z]*\n?", "")
    t = F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    quoted = (F.length(t) > 2) & t.rlike("^[\"'“]") & t.rlike("[\"'”]$") & ~t.rlike("\n$")
    return F.regexp_replace(F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t), r"(?U)^\s+|\s+$", "")


def reply_parts(x: Column) -> Column:
    """Array of struct(label, text) of a reply that numbers its parts `[1] ... [2] ...`."""
    p = F.lit(r"(?s)\[(\d+)\]\s*(.*?)(?=\[\d+\]|\z)")
    return F.zip_with(
        F.regexp_extract_all(x, p, F.lit(1)), F.regexp_extract_all(x, p, F.lit(2)),
        lambda n, t: F.struct(n.try_cast("int").alias("label"), clean_reply(t).alias("text")),
    )


def parsed_reply(x: Column, expected: Column) -> Column:
    """The parts 1..expected in order (of equal labels the last), by label or else line by line; null if they aren't all there."""
    parts = reply_parts(x)
    labels = F.transform(parts, lambda p: p["label"])
    wanted = F.sequence(F.lit(1), expected)
    last = F.transform(wanted, lambda k: F.element_at(F.filter(parts, lambda p: p["label"] == k), -1)["text"])
    labelled = F.when((F.size(parts) >= expected) & (F.size(F.array_except(wanted, labels)) == 0), last)
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: stripped(F.regexp_replace(stripped(s), r"(?U)^\[\d+\]\s*", ""))), lambda s: s != "")
    return F.coalesce(labelled, F.when(F.size(lines) == expected, F.transform(lines, clean_reply)))


def safe_name(x: Column) -> Column:
    """A file name without reserved signs, at most 200 characters."""
    return F.left(F.trim(F.translate(x, '<>:"/\\|?*', "")), F.lit(200))


def dashed_title(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*[-–—]\s*", " - ")


def marked(name: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


def duration(seconds: Column) -> Column:
    """`1h02m`, `3m04s`; `--` for null; negative counts as 0."""
    s = F.greatest(F.floor(seconds).cast("bigint"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(seconds.isNull(), "--").when(h > 0, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm%02ds", m, F.pmod(s, F.lit(60))))


def rewrapped(text: Column, budgets: Column, count: Column, expansion: float, exact: bool) -> Column:
    """Words of a text into `count` lines of at most the given lengths times `expansion`; the last line takes the rest.

    Missing budgets repeat the last one, none is under 4. With exact, empty lines are kept. A count of one or less, or
    a text without words, gives the trimmed text.
    """
    ws = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    room = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda k: F.greatest(F.lit(4), F.floor(F.element_at(budgets, F.least(k, F.size(budgets))) * F.lit(expansion)).cast("int")),
    )

    def wrapped(words: Column, room: Column) -> Column:
        def put(s: Column, w: Column) -> Column:
            def placed(line: Column) -> Column:
                same = F.slice(s, 1, F.size(s) - 1)
                fits = (F.length(line) + 1 + F.length(w) <= F.element_at(room, F.size(s))) | (F.size(s) >= count)
                return F.when(line == "", F.concat(same, F.array(w))).when(fits, F.concat(same, F.array(F.concat(line, F.lit(" "), w)))).otherwise(F.concat(s, F.array(w)))

            return let(F.element_at(s, -1), placed)

        return F.aggregate(words, F.array(F.lit("")), put)

    def full(lines: Column) -> Column:
        if exact:
            return F.concat(lines, F.array_repeat(F.lit(""), F.greatest(count - F.size(lines), F.lit(0)).cast("int")))
        return F.filter(lines, lambda x: x != "")

    def shaped(words: Column) -> Column:
        lines = let(room, lambda r: wrapped(words, r))
        return F.when((F.size(words) == 0) | (count <= 1), F.trim(text)).otherwise(F.array_join(let(lines, full), "\n"))

    return let(ws, shaped)

"""Defective prompt and response pairs with their kind of defect (problem 6).

Response openings are clustered by verified MinHash. A cluster whose responses answer unrelated prompts (prompts of
different clusters) is a template: a refusal. The word runs of all templates together tell the rarer refusals. The
remaining defects come from a copy check on the canonical form, from the language classifier and from the ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.canon import with_canonical
from folioscope.llm.langid import Model, classifier
from folioscope.llm.openings import clusters, opening
from folioscope.session import broadcast_if_small, checkpointed
from folioscope.sources.tables import once_by_id

#: A template answers at least so many unrelated prompts, and that many for each of its differing prompts.
PROMPTS, SPREAD = 3, 0.5
#: Of all differing pairs of prompt and response, a template has at least this share: what chance brings together grows with the table.
RARE = 1 / 20_000
#: Prompts are related if more than half of them begin (three words) with what at least PROMPTS of them and LIFT times the usual share begin with.
LIFT = 5
#: Share of an opening's three-word runs that must be known from templates.
KNOWN = 0.5
#: Confidence from which a response in another language counts.
SURE = 0.3
#: Length against the prompt below which an answer without an end is broken off.
SHORT = 0.5
#: Letters that a label around a copy may have.
EXTRA = 24
# White space and quotes around a text, and signs that may follow its last full stop.
AROUND = " \t\n\x0b\f\r\"“”„«»'‘’\u200b\ufeff"
CLOSERS = " \t\n\x0b\f\r\"“”„«»'‘’*`)]）」』\u200b"
# Signs of "nothing here".
PLACEHOLDERS = ("n a", "na", "none", "null", "nil", "nan", "empty", "vazio", "tbd", "todo")


def _letters(text: Column) -> Column:
    """What a copy has in common with its source: letters and digits of the canonical form, case undone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def _copied(source: Column, answer: Column) -> Column:
    """Equal, or a source of some length with a label or number of at most EXTRA letters around it."""
    return (source == answer) | (F.length(source) >= 20) & (F.length(answer) <= F.length(source) + EXTRA) & answer.contains(source)


def _unwrapped(text: Column) -> Column:
    """Without code fences, emphasis, quotes, trailing page marks and white space around."""
    t = F.when(text.rlike(r"[*_`]"), F.regexp_replace(text, r"```\w*|[*_`]{1,3}", "")).otherwise(text)
    t = F.when(t.contains("\n"), F.regexp_replace(t, r"(?:\n\s*[\[(]?\d{1,4}[\])]?)?\s*$", "")).otherwise(t)
    return F.btrim(t, F.lit(AROUND))


def _body(text: Column) -> Column:
    """The prompt without a page number or a last line that is only one."""
    last = r"\n\s*(?:[-–—\[(|]?\s*(?:(?:Page|Pág\.?|Página|Seite|S\.|p\.)\s*)?[0-9ivxlcdmoIlO]{1,7}\s*[-–—\])|]?)\s*$"
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("\n"), F.regexp_replace(t, f"(?i){last}", "")).otherwise(t)


def _runs(words: Column) -> Column:
    w = F.split(words, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda k: F.array_join(F.slice(w, k + 1, 3), " ")))


def templates(pairs: DataFrame) -> DataFrame:
    """words of the response openings that recur across unrelated prompts. pairs: q, a (openings of both).

    Openings of fewer words than a shingle are classes of their own and judged by the same test. A prompt asked again
    and again counts once. In a large table any sentence comes up under some unrelated prompts, so a template must hold
    a share of all pairs (RARE); and a response that breaks off after its first words recurs often, but under prompts
    that begin alike (LIFT).
    """
    counted = checkpointed(pairs.select("a", "q").distinct())
    least = max(PROMPTS, RARE * counted.count())
    led = clusters(counted.select(F.col("a").alias("words")).distinct()).select(F.col("words").alias("a"), F.col("leader").alias("al"))
    mine = counted.join(led, "a")
    often = mine.groupBy("al").agg(F.count("*").alias("all")).where(F.col("all") >= least).select("al")
    mine = checkpointed(mine.join(broadcast_if_small(often), "al", "left_semi"))
    # Only the prompts of openings that recur need clusters of their own.
    asked = clusters(mine.select(F.col("q").alias("words")).distinct()).select(F.col("words").alias("q"), F.col("leader").alias("ql"))
    each = checkpointed(mine.select("al", "q").distinct())
    per = each.join(asked, "q").groupBy("al", "ql").agg(F.count("*").alias("n")).groupBy("al").agg(F.sum("n").alias("n"), F.count("*").alias("prompts"))
    told = per.where((F.col("prompts") >= least) & (F.col("prompts") >= SPREAD * F.col("n"))).select("al", "n")
    every, start = counted.select("q").distinct(), F.substring_index("q", " ", 3).alias("start")
    usual = every.groupBy(start).agg(F.count("*").alias("usual"))
    begun = each.groupBy("al", start).agg(F.count("*").alias("c")).where(F.col("c") >= PROMPTS)
    lifted = begun.join(told, "al").join(usual, "start").where(F.col("c") * F.lit(every.count()) >= LIFT * F.col("n") * F.col("usual"))
    related = lifted.groupBy("al", "n").agg(F.sum("c").alias("alike")).where(F.col("alike") > 0.5 * F.col("n")).select("al")
    told = told.join(related, "al", "left_anti").select("al")
    return mine.join(told, "al", "left_semi").select(F.col("a").alias("words")).distinct()


def judged(entries: DataFrame, model: Model) -> DataFrame:
    """entry_id, defect (null if none) of each entry; re-delivered entries count once.

    A null or contentless response is 'empty' unless the prompt has no content either. Prompts without translatable
    words may be repeated.
    """
    none = F.lit("")
    e = once_by_id(entries.select("entry_id", "target_lang", "original", "translated"), "entry_id")
    e = with_canonical(with_canonical(e, "original", "co"), "translated", "ct")
    e = e.withColumns({"u": _unwrapped(F.coalesce("translated", none)), "o": F.coalesce("original", none), "ct": _unwrapped(F.coalesce("ct", none)), "co": F.coalesce("co", none)})
    e = e.withColumn("l", F.get(classifier(model)(F.array("ct")), 0))
    spoken = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    raw = F.coalesce("translated", none)
    raw = F.when(raw.contains("\n"), F.regexp_replace(raw, r"(?:\n\s*[\[(]\d{1,4}[\])])?\s*$", "")).otherwise(raw)
    e = e.withColumns({
        "a": opening(F.col("u")), "q": opening(F.col("o")), "same": _copied(_letters(F.col("co")), _letters(F.col("ct"))),
        "bare": spoken("co"), "answer": spoken("u"), "body": F.rtrim(_body(F.col("o")), F.lit(AROUND)), "end": F.rtrim(raw, F.lit(CLOSERS)),
    })
    words = F.regexp_extract_all("o", F.lit(r"(?<![\p{L}\p{N}\p{M}-])(?:\p{Ll}[\p{L}\p{M}]+|\p{Lo}{2,})"), F.lit(0))
    translatable = (F.size(words) >= 2) | F.col("o").rlike(r"\p{Lu}{2,}(?:\s+\p{Lu}{2,}){3}")
    empty = ~F.col("u").rlike(r"\p{L}") & F.col("bare").rlike(r"\p{L}") | F.col("answer").isin(*PLACEHOLDERS) & (F.col("answer") != F.col("bare"))
    closed = r"[.!?。！？।؟;:]$"
    e = e.withColumns({
        "translatable": translatable, "empty": empty, "closed": F.right("end", F.lit(1)).rlike(closed),
        "cut": F.right("end", F.lit(4)).rlike(r"(?:…|,|[\s]-|\.\.\.|[\p{L}]-|[(])$") & ~F.right("body", F.lit(4)).rlike(r"(?:…|,|-|\.\.\.)$"),
        "full": F.right("body", F.lit(1)).rlike(closed), "short": F.length("end") < SHORT * F.length("body"), "some": F.length("answer") > 0,
        "other": (F.col("l.lang") != "") & (F.col("l.lang") != F.col("target_lang")) & (F.col("l.confidence") >= SURE),
    })
    # From here on only openings and judgements are carried.
    e = checkpointed(e.select("entry_id", "a", "q", "same", "translatable", "empty", "closed", "cut", "full", "short", "some", "other"))
    fresh = e.where("not same and not empty and length(a) > 0")
    told = templates(fresh.select("q", "a"))
    known = told.select(F.explode(_runs(F.col("words"))).alias("run")).distinct()
    known = broadcast_if_small(known).withColumn("is", F.lit(1))
    runs = fresh.select("a").distinct().select("a", F.explode(_runs(F.col("a"))).alias("run"))
    share = runs.join(known, "run", "left").groupBy("a").agg((F.count("is") / F.count("*")).alias("share")).where(F.col("share") >= KNOWN)
    e = e.join(broadcast_if_small(share), "a", "left")
    # An answer without an end is broken off if its prompt has one, or if it is short.
    truncated = F.col("cut") | ~F.col("closed") & (F.col("full") | F.col("short") & F.col("translatable"))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("same"), F.when(F.col("translatable"), "copied"))
        .when(F.col("share").isNotNull(), "refusal")
        .when(F.col("other"), "wrong_language")
        .when(F.col("some") & truncated, "truncated")
    )
    return e.select("entry_id", defect.alias("defect"))


def found(entries: DataFrame, model: Model) -> DataFrame:
    """entry_id, defect of the defective entries."""
    return judged(entries, model).where("defect is not null")

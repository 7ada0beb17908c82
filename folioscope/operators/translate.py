"""The opaque services of a run (translator, text recognition, document reader) as interfaces with deterministic stand-ins."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import NAME_MARKS, should_translate
from folioscope.operators.batching import batch_system_prompt, system_prompt


class Translator(Protocol):
    def __call__(self, texts: list[str]) -> list[str]: ...


class Reader(Protocol):
    def __call__(self, content: bytes) -> list[dict]: ...


class Echo:
    """Stand-in translator: marks each text; fails as told, so that retries can be tested."""

    def __init__(self, mark: str = "»", fail_over: int = 10**9):
        self.mark, self.fail_over, self.calls = mark, fail_over, 0

    def __call__(self, texts: list[str]) -> list[str]:
        self.calls += 1
        if len(texts) > self.fail_over:
            raise RuntimeError("too many texts")
        return [f"{self.mark}{t}" for t in texts]


def with_retries(call: Callable[[], list[str]], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """call(), tried again after 1, 2, 4... seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(2.0**k)
    return []


def translated(texts: list[str], service: Translator, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """One reply per text: a failing batch is halved until single texts fail, which keep their source."""
    if not texts:
        return []
    try:
        out = with_retries(lambda: service(texts), 3, sleep)
        if len(out) == len(texts):
            return out
    except Exception:
        if len(texts) == 1:
            return texts
    if len(texts) == 1:
        return texts
    half = len(texts) // 2
    return translated(texts[:half], service, sleep) + translated(texts[half:], service, sleep)


def clean(reply: str) -> str:
    """A reply without code fences, bold marks and one pair of quotes around, as functions.text.clean_reply."""
    t = re.sub(r"```[a-z]*\n?", "", reply).replace("**", "").replace("__", "")
    return (t[1:-1] if len(t) > 2 and t[0] in "\"'“" and t[-1] in "\"'”" else t).strip()


def same_text(source: str, reply: str) -> bool:
    """Whether a reply of 18 characters and three words at least leaves its source as it is."""
    a, b = " ".join(source.split()), " ".join(reply.split())
    return a == b and len(a) >= 18 and len(a.split()) >= 3


def parts_of(reply: str, expected: int) -> list[str] | None:
    """The numbered parts of a reply in order, or its lines if there are as many; None if neither can be read."""
    found = {int(k): clean(t.strip()) for k, t in re.findall(r"(?s)\[(\d+)\]\s*(.*?)(?=\[\d+\]|\Z)", reply)}
    if all(k in found for k in range(1, expected + 1)):
        return [found[k] for k in range(1, expected + 1)]
    lines = [x for x in (re.sub(r"^\[\d+\]\s*", "", line.strip()) for line in reply.split("\n")) if x]
    return [clean(x) for x in lines] if len(lines) == expected else None


class Asked:
    """A translator of lists over a service that answers one request (instruction, text) with one text.

    Numbered replies are taken apart; one that can't be read is asked for text by text; a text that comes back as it
    was is asked for once more, with emphasis. Errors of a batch are the caller's (who halves it); a single text that
    fails stays as it is.
    """

    def __init__(self, ask: Callable[[str, str], str], source: str = "English", target: str = "Português Brasileiro", sleep: Callable[[float], None] = time.sleep):
        self.ask, self.source, self.target, self.sleep = ask, source, target, sleep

    def one(self, text: str) -> str:
        system = system_prompt(self.source, self.target)
        call = lambda user: clean(with_retries(lambda: self.ask(system, user), 3, self.sleep))
        try:
            out = call(f"Translate to {self.target}:\n{text}")
            return call(f"Translate all of this to {self.target}; it came back unchanged:\n{text}") if same_text(text, out) else out
        except Exception:
            return text

    def title(self, title: str) -> str:
        """A title in the target language; one that fails or comes back with three characters or fewer stays."""
        try:
            out = self.ask(system_prompt(self.source, self.target), f"Translate this book title from {self.source} to {self.target}; keep names. Answer with the title alone:\n{title}").strip().strip("\"").strip("'")
        except Exception:
            return title
        return out if len(out) > 3 else title

    def __call__(self, texts: list[str]) -> list[str]:
        if len(texts) == 1:
            return [self.one(texts[0])]
        user = f"Translate each numbered text to {self.target}:\n" + "\n".join(f"[{k}] {t}" for k, t in enumerate(texts, 1))
        parts = parts_of(self.ask(batch_system_prompt(self.source, self.target), user), len(texts))
        if parts is None:
            return [self.one(t) for t in texts]
        return [self.one(t) or p if same_text(t, p) else p for t, p in zip(texts, parts)]


class EchoAsk:
    """Stand-in service: marks every text that it is asked for."""

    def __init__(self, mark: str = "»"):
        self.mark = mark

    def __call__(self, system: str, user: str) -> str:
        head, _, body = user.partition("\n")
        return re.sub(r"(?m)^(\[\d+\] )", rf"\1{self.mark}", body) if "numbered" in head else self.mark + body


def output_name(stem: str, translate: Callable[[str], str], suffix: str = " traduzido.pdf") -> str:
    """File name of an output: dashes set apart, title translated unless its name says that it is, reserved signs dropped, 200 characters at most."""
    title = re.sub(r"\s*[-–—]\s*", " - ", stem)
    if not any(m in title.lower() for m in NAME_MARKS):
        title = translate(title)
    return re.sub(r'[<>:"/\\|?*]', "", title + suffix).strip()[:200]


def titled(books: DataFrame, make: Callable[[], Asked]) -> DataFrame:
    """name, output: the name of each distinct book's output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for pdf in batches:
            names = pdf["name"].tolist()
            out = [None if n is None else output_name(re.sub(r"(?i)\.pdf$", "", n), service.title) for n in names]
            yield pd.DataFrame({"name": pd.Series(names, dtype=object), "output": pd.Series(out, dtype=object)})

    return books.select("name").distinct().mapInPandas(run, "name string, output string")


def misses(df: DataFrame, make: Callable[[], Translator], most: int = 10, chars: int = 2200, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """text, translated for each distinct translatable text of df.text; one service per partition, batches within limits.

    A batch takes one text and 400 characters at least.
    """
    most, chars = max(1, most), max(400, chars)
    want = df.where(should_translate(F.col("text"))).select(F.trim("text").alias("text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for pdf in batches:
            out, group, used = [], [], 0
            for t in [*pdf["text"], None]:
                if group and (t is None or len(group) >= most or used + max(1, len(t)) > chars):
                    out += translated(group, service, sleep)
                    group, used = [], 0
                if t is not None:
                    group.append(t)
                    used += len(t)
            yield pd.DataFrame({"text": pdf["text"].tolist(), "translated": out})

    return want.mapInPandas(run, "text string, translated string")


def read_documents(spark, path: str, reader: Reader) -> DataFrame:
    """doc (path), page, side-independent spans of every file under a path; the reader turns bytes into span rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, page int, block_no int, line_no int, span_no int, text string, font string, size double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for pdf in batches:
            rows = [{"path": p, **r} for p, c in zip(pdf["path"], pdf["content"]) for r in reader(c)]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def plain_reader(content: bytes) -> list[dict]:
    """Stand-in reader: pages parted by form feeds, blocks by blank lines, one span a line."""
    rows = []
    for p, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for b, block in enumerate(x for x in page.split("\n\n") if x.strip()):
            for k, line in enumerate(x for x in block.split("\n") if x.strip()):
                rows.append({"page": p, "block_no": b, "line_no": k, "span_no": 0, "text": line.strip(), "font": "Helvetica", "size": 10.0})
    return rows

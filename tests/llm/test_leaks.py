"""Leaked passages against brute force over all windows."""

import random
import re
import unicodedata

from folioscope.llm.leaks import OTHER, RUN, leaked


def plain(text):
    t = unicodedata.normalize("NFKD", text or "")
    return re.findall(r"[^\W_]+", "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf")).lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = plain(t)
        for i, x in items:
            v = plain(x)
            if any(sum(a != b for a, b in zip(w[p : p + RUN], v[q : q + RUN])) <= OTHER for p in range(len(w) - RUN + 1) for q in range(len(v) - RUN + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["salt", "Öl", "río", "bell", "x1", "café"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 30)))) for k in range(12)]
    docs = [(99, None), (98, ""), (97, "one")]
    for k in range(60):
        w = items[rnd.randrange(12)][1].split()
        a = rnd.randrange(max(1, len(w) - 12))
        part = w[a : a + rnd.randint(11, 14)]
        for _ in range(rnd.choice((0, 0, 1, 2))):
            part[rnd.randrange(len(part))] = "other"
        text = f"Intro {rnd.random()} " + rnd.choice((" ", "\n", " ", ", ")).join(x.upper() if rnd.random() < 0.3 else unicodedata.normalize("NFD", x) for x in part) + ". End"
        docs.append((k, text))
    docs.append((3, docs[5][1]))
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(*r, 7) for r in [*items, (50, None), (51, "")]], "item_id long, text string, doc_id long")
    want = brute(docs, items)
    assert len(want) > 20
    assert {tuple(r) for r in leaked(d, i).collect()} == want
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0

"""Batches within their limits, of whole blocks, and few."""

import random
from collections import Counter, defaultdict

from folioscope.llm.packing import batches, plan


def test_plans_place_every_item_within_the_limits():
    rnd = random.Random(1)
    used = least = 0
    for _ in range(800):
        chars, places = rnd.choice([(2200, 10), (400, 10), (1500, 5), (7, 1)])
        items = [min(chars, int(rnd.choice([rnd.expovariate(1 / 150), rnd.uniform(0, chars)]))) for _ in range(rnd.randint(1, 60))]
        n, slots = plan(list(Counter(items).items()), chars, places)
        found, seen = defaultdict(list), Counter()
        for length, rank, many, first, per in slots:
            assert rank == seen[length]
            for k in range(many):
                found[first + k // per].append(length)
            seen[length] += many
        assert seen == Counter(items) and len(found) == n
        assert all(sum(v) <= chars and len(v) <= places for v in found.values())
        used, least = used + n, least + max(-(-sum(items) // chars), -(-len(items) // places))
    assert used <= 1.06 * least


def test_many_equal_items_are_planned_from_one_row():
    n, slots = plan([(200, 1_000_000), (100, 500_000)], 2200, 10)
    assert len(slots) < 50 and n <= 1.02 * max(1_500_000 / 10, 250_000_000 / 2200) + 1


def test_blocks(spark):
    rnd = random.Random(2)
    rows = [(k, "orig", k % 3, None if k % 7 == 0 else rnd.choice((10, 90, 250)), "x" * 90) for k in range(90)]
    rows += [(k, "orig", 4, 950, "") for k in range(200, 203)] + [(300, "trans", 1, 50, "y"), (301, "orig", None, 50, "y"), (302, "orig", 5, None, None), (0, "orig", 0, None, "x" * 90)]
    b = spark.createDataFrame([(*r, 3) for r in rows], "block_id long, side string, doc_id long, char_count int, text string, batch_no int")
    books = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, None), (4, 2)], "doc_id long, config_id int")
    conf = spark.createDataFrame([(1, 5, 400), (2, 2, 300)], "config_id int, max_batch_size int, max_batch_chars int")
    got = batches(b, books, conf).collect()
    length = {k: (90 if c is None and t else c or 0) for k, s, _, c, t in rows if s == "orig"}
    limit = {0: (5, 400), 1: (2, 300), 4: (2, 300)}
    by, whole = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"], r["batch_no"]].append(r["n_chars"])
        whole[r["block_id"]].append((r["piece_no"], r["start_pos"], r["n_chars"]))
    for (doc, _), v in by.items():
        size, chars = limit.get(doc, (10, 2200))
        assert len(v) <= size and sum(v) <= chars
    assert set(whole) == set(length)
    for k, pieces in whole.items():
        pieces.sort()
        assert sum(p[2] for p in pieces) == length[k] and [p[0] for p in pieces] == list(range(1, len(pieces) + 1))
        assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
        assert len(pieces) == (4 if length[k] == 950 else 1)
    numbers = defaultdict(set)
    for doc, no in by:
        numbers[doc].add(no)
    assert all(v == set(range(1, len(v) + 1)) for v in numbers.values())
    assert batches(b.limit(0), books, conf).count() == 0

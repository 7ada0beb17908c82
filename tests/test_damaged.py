"""Rules, overlaps and tables on damaged copies of the smallest tables, so that all of them fire, against the same SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_oracle import DATA, plain

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
DAMAGE = """SELECT * REPLACE (
 CASE WHEN side = 'trans' AND doc_id % 7 = 3 THEN text || ' ????' ELSE text END AS text, CASE WHEN side = 'trans' AND doc_id % 7 = 4 THEN avg_size * 0.5 ELSE avg_size END AS avg_size,
 CASE WHEN doc_id % 2 = 0 THEN 36.0 + 180 * (block_no % 3) ELSE x0 END AS x0, CASE WHEN doc_id % 2 = 0 THEN 196.0 + 180 * (block_no % 3) ELSE x1 END AS x1,
 CASE WHEN doc_id % 2 = 0 THEN 72.0 + 20 * (block_no // 3) + 40 * (block_no // 9) WHEN side = 'trans' AND doc_id % 7 = 5 THEN y0 - block_no * 22.0 ELSE y0 END AS y0,
 CASE WHEN doc_id % 2 = 0 THEN 84.0 + 20 * (block_no // 3) + 40 * (block_no // 9) WHEN side = 'trans' AND doc_id % 7 = 5 THEN y1 - block_no * 22.0 ELSE y1 END AS y1)
 FROM text_block WHERE side = 'orig' OR doc_id % 7 <> 1 OR block_no % 3 = 0"""


@pytest.fixture(scope="module")
def damaged(tmp_path_factory):
    to = tmp_path_factory.mktemp("damaged")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        if p.stem != "text_block":
            (to / p.name).symlink_to(p)
    c.execute(f"create table hurt as {DAMAGE}")
    c.execute(f"copy hurt to '{to}/text_block.parquet' (format parquet)")
    c.execute("create or replace view text_block as select * from hurt")
    return str(to), c


@pytest.mark.parametrize("name", ["validate_structural", "validate_char_count", "validate_hybrid", "validate_issues", "validate_book", "overlap_pairs", "table_regions", "table_match", "suspicious_glyphs"])
def test_same_rows(spark, damaged, name):
    folder, duck = damaged
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == want and got
    assert Path(folder).exists()

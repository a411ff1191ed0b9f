from brute import sha, windows_hit

from contentloom.llm import decontaminate
from contentloom.llm.entry import op5_decontamination

FOLDER = "/root/testdata/sf0.01"


def expected(docs, items):
    return {d: (n, hit, len(found), sha(",".join(found)), hit > 0) for d, (n, hit, found) in windows_hit(docs, items).items()}


def test_equals_brute_force(spark):
    rows = op5_decontamination(spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(docs, items)


def test_odd_rows_and_blocks(spark, table):
    words = [f"w{i}" for i in range(40)]
    items = [("1", " ".join(words[:25])), ("2", "Short one"), ("3", None), ("4", ""), ("1", " ".join(words[:25])), (None, "lone item"), ("5", "zz " * 12)]
    rows = [(1, None), (2, ""), (3, "a " + ", ".join(words[3:20])), (4, "short ONE short one"), (5, " ".join(words[:9])), (6, "zz " * 5000), (7, "the lone item"), (7, "the lone item"), (None, "short one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((repr(d), *expected([(0, t)], items)[0]) for d, t in rows)
    for block in (10, 1 << 20):
        made = decontaminate.searched(table(rows), bench, block_chars=block)
        assert made.count() == len(rows) and made.columns[:5] == table(rows).columns
    got = decontaminate.hits(table(rows), bench)
    assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got.collect()) == want
    assert [m["words"] for r in decontaminate.searched(table(rows[2:3]), bench).collect() for m in r["__matches"]] == [17]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(table(rows), bench).collect()) == [1, 2, 5]
    assert decontaminate.hits(table(rows).limit(0), bench).count() == 0
    assert decontaminate.hits(table(rows), bench.limit(0)).where("contaminated").count() == 0

import random

from brute import one_edit, removed_lines, sha

from contentloom.llm import line_dedup, sidelists
from contentloom.llm.entry import op7_line_dedup

FOLDER = "/root/testdata/sf0.01"


def expected(docs):
    gone = removed_lines(docs)
    return {d: ((t or "").count("\n") + (t is not None), len(gone[d]), sha("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[d]))) for d, t in docs}


def test_variants_meet_within_one_edit():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(2))
        x, y = line_dedup.variants(a), line_dedup.variants(b)
        meet = any(p == q for p, q in zip(x[1:], y[1:])) or x[0] in y or y[0] in x
        assert meet == one_edit(a, b)


def test_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in op7_line_dedup(spark, FOLDER).collect()} == expected(docs)


def test_edits_and_odd_rows(spark, table, monkeypatch):
    rnd, base = random.Random(6), "the quick brown fox jumps"
    rows = []
    for d in range(1, 60):
        x = list(base)
        for _ in range(rnd.randint(0, 2)):
            p = rnd.randrange(len(x))
            x[p:p + rnd.randint(0, 1)] = rnd.choice(["", "q", "é", "oo"][:3])
        rows.append((d, "".join(x) + "\nshort\n\n" + "".join(x[:9]) + " more words here"))
    rows += [(70, None), (71, ""), (72, "short\nshort"), (73, "w " * 20000), (74, "w " * 20000 + "w"), (75, "aab aab aab"), (76, "acb aab aab")]
    for limit in (0, 1 << 20):
        monkeypatch.setattr(sidelists, "SEND_BYTES", limit)
        got = {r.doc_id: (r["__n_lines"], r["__n_removed"], sha(r.text or "")) for r in line_dedup.deduplicated(table(rows)).collect()}
        assert got == expected(rows)
    twice = [(1, "one two three\nx"), (1, "one two three\nx"), (None, "one two three"), (2, "one two thre"), (None, None)]
    made = line_dedup.deduplicated(table(twice))
    assert sorted((repr(r.doc_id), repr(r.text)) for r in made.collect()) == sorted([("1", repr("one two three\nx"))] * 2 + [("None", "''"), ("2", "''"), ("None", "None")])
    assert sorted(repr(r.doc_id) for r in line_dedup.with_text_left(table(twice)).collect()) == ["1", "1", "None"]
    assert line_dedup.deduplicated(table(twice).limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_short_lines_and_lines_without_blanks(spark, table):
    rows = [(1, "Read more\n今日は天気がいいので散歩に行きました\n \n"), (2, "Cookie policy\nRead more\n\n \nx"), (3, "Cookie policy\n今日は天気がいいので散歩に行きます\n今日は天気がいいので散歩に行きました\nRead mores"), (4, "今日は天気がいいので散歩に行きまし")]
    gone = removed_lines(rows, least_words=1)
    assert gone == {2: {1}, 3: {0, 2, 3}, 4: {0}}
    got = {r.doc_id: r["__n_removed"] for r in line_dedup.deduplicated(table(rows)).collect()}
    assert got == {d: len(gone[d]) for d, _ in rows}


def test_query_takes_every_line_with_a_word(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    gone = removed_lines(docs, least_words=1)
    want = {d: (len(gone[d]), sha("\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[d]))) for d, t in docs}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in op7_line_dedup(spark, FOLDER).collect()} == want


def test_more_edits_than_one(spark, table):
    rnd = random.Random(4)
    lines = ["Page 12 of a long footer", "Page 34 of a long footer", "a", "abc", "é"]
    lines += ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "xyzw", "uvwxyz"]) for _ in range(40)]
    for _ in range(30):
        x = list(rnd.choice(["some line of words", "quite another one"]))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(x))
            x[k:k + rnd.randint(0, 1)] = rnd.choice(["", "q", "z"])
        lines.append("".join(x))
    rows = list(enumerate(lines))
    for edits in (1, 2, 3):
        want = {d: int(any(distance(x, lines[e]) <= edits for e in range(d))) for d, x in rows}
        assert {r.doc_id: r["__n_removed"] for r in line_dedup.deduplicated(table(rows), edits).collect()} == want, edits


def test_variants_and_parts_are_not_broadcast(spark, table, monkeypatch):
    """Their rows are many times those of the lines, which Spark's estimate does not know."""
    plans = []

    def planned(df, label, *a, write=line_dedup.materialize, **k):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label, *a, **k)

    monkeypatch.setattr(line_dedup, "materialize", planned)
    rows = [(k, "\n".join(f"line {k * 7 + i} of the text" for i in range(9))) for k in range(30)]
    texts = table(rows).selectExpr("doc_id AS id", "text")
    late = line_dedup.removed_lines(texts)
    plans.append(("late", late._jdf.queryExecution().executedPlan().toString()))
    assert late.count() > 0
    joins = {label: plan.count("BroadcastHashJoin") for label, plan in plans}
    # The join of repeated lines with their first place may be a broadcast, as both are read as they are.
    assert joins["candidates"] == joins["variants"] == 0 and joins["late"] <= 1

"""Kept levels against computing them anew after random moves."""

import random

from contentloom.operators import hierarchy, level_table as L

FIELDS = "id string, parent_id string"


def test_equals_full_levels_after_random_moves(spark, tmp_path):
    rnd = random.Random(9)
    tree = {f"n{i}": (f"n{rnd.randrange(i)}" if i > 3 else None) for i in range(60)}
    tree["n5"], tree["lost"], tree["a"], tree["b"], tree["under"] = "", "nowhere", "b", "a", "a"
    frame = lambda rows, fields=FIELDS: spark.createDataFrame(list(rows), fields)
    table = L.create(frame([*tree.items(), (None, "n1")]), str(tmp_path / "t"), 16)

    def check():
        want = {r.id: (r.level, r.issue) for r in hierarchy.levels(frame(tree.items())).collect()}
        assert {r.id: (r.level, r.issue) for r in table.read(spark).collect()} == want
        assert {r.id: r.parent_id for r in table.read(spark).collect()} == {k: v or None for k, v in tree.items()}

    check()
    for turn in range(4):
        names = list(tree)
        moves = {rnd.choice(names): rnd.choice([*names, None, "", f"new{turn}", "nowhere"]) for _ in range(3)}
        if turn == 1:  # under its own child: a cycle
            child = next(k for k, v in tree.items() if v and v in tree and k not in moves and v not in moves)
            moves[tree[child]] = child
        if turn == 2:
            moves["a"] = None  # opens the cycle
        moves[f"new{turn}"] = rnd.choice([*names, None])
        gone = set(rnd.sample(names, 2)) - set(moves)
        L.change(table, frame(moves.items()), frame([(g,) for g in gone], "id string"))
        tree.update(moves)
        for g in gone:
            del tree[g]
        check()
    L.change(table, frame([], FIELDS), frame([], "id string"))
    check()


def test_a_move_touches_its_subtree_only(spark, tmp_path):
    rows = [("root", None), ("left", "root"), ("right", "root")] + [(f"l{i}", "left") for i in range(300)] + [("r1", "right"), ("r2", "r1"), ("r3", "r2")]
    table = L.create(spark.createDataFrame(rows, FIELDS), str(tmp_path / "t"), 64)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "nodes").rglob("*.parquet")}
    written = L.change(table, spark.createDataFrame([("r1", "l7")], FIELDS), spark.createDataFrame([], "id string"))
    assert sorted((r.id, r.level) for r in written.collect()) == [("r1", 3), ("r2", 4), ("r3", 5)]
    same = [p for p in (tmp_path / "t" / "nodes").rglob("*.parquet") if stamps.get(p) == p.stat().st_mtime_ns]
    assert len(same) >= len(stamps) - 3

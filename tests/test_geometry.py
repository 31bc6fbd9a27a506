"""Cells from ruling lines against grids that are known, words against a plain double loop."""

import random

from ledgerloom.operators import geometry

RULED = "doc string, page int, x0 double, top double, x1 double, bottom double"


def merged(draw, rows, cols):
    """A random cut of a grid into rectangles of (row, col, height, width)."""
    taken, out = set(), []
    for r in range(rows):
        for c in range(cols):
            if (r, c) in taken:
                continue
            h, w = draw.choice([1, 1, 1, 2]), draw.choice([1, 1, 1, 2, 3])
            h, w = min(h, rows - r), min(w, cols - c)
            while any((r, c + j) in taken for j in range(w)):
                w -= 1
            taken |= {(r + i, c + j) for i in range(h) for j in range(w)}
            out.append((r, c, h, w))
    return out


def drawn(draw, box):
    """A rectangle's sides, in pieces, reversed or twice."""
    x0, top, x1, bottom = box
    for a in [(x0, top, x1, top), (x0, bottom, x1, bottom), (x0, top, x0, bottom), (x1, top, x1, bottom)]:
        way = draw.randrange(4)
        middle = ((a[0] + a[2]) / 2, (a[1] + a[3]) / 2)
        if way == 0:
            yield from [(*a[:2], *middle), (*middle, *a[2:])]
        elif way == 1:
            yield (*a[2:], *a[:2])
        else:
            yield from [a] * (way - 1)


def test_cells_and_words_equal_a_double_loop(spark):
    draw = random.Random(11)
    rulings, words, want_cells, want_texts = [], [], [], {}
    for doc in ("a", "b", None):
        for page in range(4):
            if doc is None and page:
                continue
            base, boxes = 7.0, []
            for tbl in range(draw.randrange(1, 3)):
                rows, cols = draw.randrange(1, 6), draw.randrange(1, 6)
                xs = [draw.randrange(0, 4) * 10 + 0.5]
                ys = [base]
                for _ in range(cols):
                    xs.append(xs[-1] + draw.randrange(2, 17) * 10)
                for _ in range(rows):
                    ys.append(ys[-1] + draw.randrange(12, 90))
                base = ys[-1] + 30
                own = [(xs[c], ys[r], xs[c + w], ys[r + h]) for r, c, h, w in merged(draw, rows, cols)]
                tops, lefts = sorted({b[1] for b in own}), sorted({b[0] for b in own})
                boxes += [(tbl, tops.index(b[1]), lefts.index(b[0]), b) for b in own]
                rulings += [(doc, page, *s) for b in own for s in drawn(draw, b)]
            rulings += [(doc, page, 0.0, 0.0, 900.0, 700.0), (doc, page, 950.0, 0.0, 950.0, 300.0), (doc, page, 940.0, 2.0, 990.0, 2.0)]
            said = [(float(draw.randrange(0, 700)), draw.randrange(0, 60) * 10.0) for _ in range(80)]
            said = list(dict.fromkeys(said))
            words += [(doc, page, x, y, x + 6.0, y + 5.0, f"w{i}") for i, (x, y) in enumerate(said)]
            if doc is None:
                continue
            want_cells += [(doc, page, t, r, c, *b) for t, r, c, b in boxes]
            for t, r, c, b in boxes:
                inside = [(y, x, f"w{i}") for i, (x, y) in enumerate(said) if b[0] <= x + 3 < b[2] and b[1] <= y + 2.5 < b[3]]
                lines = {}
                for y, x, text in sorted(inside):
                    lines.setdefault(y, []).append(text)
                want_texts[(doc, page, t, r, c)] = "\n".join(" ".join(v) for _, v in sorted(lines.items()))
    cells = geometry.ruled_cells(spark.createDataFrame(rulings, RULED)).where("doc IS NOT NULL")
    assert sorted(map(tuple, cells.collect())) == sorted(want_cells)
    texts = geometry.cell_texts(spark.createDataFrame(words, RULED + ", text string"), cells)
    assert {(r.doc, r.page, r.tbl, r.row, r.col): r.text for r in texts.collect()} == want_texts


def test_open_shapes_and_empty_pages(spark):
    frame = lambda rows: spark.createDataFrame([("d", 1, *map(float, r)) for r in rows], RULED)
    three = [(0, 0, 50, 0), (0, 0, 0, 50), (50, 0, 50, 50)]
    assert geometry.ruled_cells(frame(three)).count() == 0
    # Ends that miss one another by less than the snap close a cell, by more they don't.
    assert [tuple(r)[2:] for r in geometry.ruled_cells(frame([*three, (2, 52, 49, 52)])).collect()] == [(0, 0, 0, 0.0, 0.0, 50.0, 52.0)]
    assert geometry.ruled_cells(frame([*three, (0, 57, 50, 57)])).count() == 0
    words = spark.createDataFrame([("d", 1, 1.0, 1.0, 2.0, 2.0, None)], RULED + ", text string")
    rows = geometry.ruled_tables(words, frame([*three, (0, 50, 50, 50)])).collect()
    assert [(r.tbl, r.top, r.rows) for r in rows] == [(0, 0.0, [[""]])]
    assert geometry.ruled_tables(words, frame([])).count() == 0


def test_plans_do_not_double_at_every_step(spark):
    """A plan of 54 windows took the driver's memory."""
    frame = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 0.0)], RULED)
    words = spark.createDataFrame([("d", 1, 1.0, 1.0, 2.0, 2.0, "w")], RULED + ", text string")
    plan = geometry.ruled_tables(words, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") < 6

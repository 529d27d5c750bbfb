"""Line de-duplication against plain Python."""

import os
import random
from collections import defaultdict

import pytest

from newstide.llm import line_dedup

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACES).translate(LOWER)


def plain(rows, chars=20, documents=3):
    """(n_lines, n_dropped, text) by row, in order. No id is below all others."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(doc_id)
    order = lambda x: (x is not None, x if x is not None else 0)
    keep = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= documents}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        rest = [x for x in lines if key(x) not in keep or keep[key(x)] == doc_id]
        out.append((len(lines), len(lines) - len(rest), "\n".join(rest)))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id long, text string")
    got = line_dedup.drop_shared_lines(df, **more).collect()
    assert [(r.n_lines, r.n_dropped, r.kept) for r in sorted(got, key=lambda r: r.k)] == plain(rows)


LONG = "This line stands in many documents"


def test_odd_texts_ids_and_lines(spark):
    a, b = LONG, "Ünïcode lines ÄÖÜ stay apart 12"
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, a), (5, f"\t{a.upper()} \r"), (6, f"x\n{a}\n{a}\ny"), (7, f"{a}\n"),  # the largest id keeps both its lines
        (8, b), (9, b.lower()), (10, b), (11, "x" * 19), (12, "x" * 19), (13, "x" * 19), (14, "é" * 20), (15, "é" * 20), (16, f"{'é' * 20}\n{a[:10]}"),
        (17, "\x85" + "z" * 20), (18, "z" * 20), (19, "z" * 20), (None, f"{a}\nq"), (None, a), (7, a), (7, f"{a}\n"), (20, "two documents share this line"), (21, "two documents share this line"),
    ]
    check(spark, rows)


def test_repeated_rows_count_once(spark):
    check(spark, [(1, LONG), (1, LONG), (1, LONG), (2, LONG)])
    check(spark, [(None, LONG), (None, LONG + " "), (1, LONG), (2, LONG)])


def test_random_rows_and_a_hot_line(spark):
    dice = random.Random(8)
    stock = [f"stock line number {k} of the shop" for k in range(12)] + ["", " ", "short"]
    rows = [(dice.randrange(400), "\n".join(dice.choice(stock) if dice.random() < 0.6 else f"own line {dice.random()} of a text" for _ in range(dice.randrange(12)))) for _ in range(500)]
    rows += [(1000 + k, f"{LONG}\nown text of document {k}" if k % 3 == 0 else f"own text of document {k}") for k in range(900)]
    check(spark, rows)


def test_very_long_text(spark):
    shared = [f"line {k} which three documents hold" for k in range(40_000)]
    rows = [(k, "\n".join(shared + [f"the own line of document {k}"])) for k in range(3)] + [(3, "\n".join([LONG] * 50_000))]
    check(spark, rows)


def test_clashing_names_other_ids_and_nothing(spark):
    names = ["id", "version", "pos", "h", "g", "n", "row", "whole", "dropped", "kept", "n_lines", "keep", "key", "line", "_slice"]
    df = spark.createDataFrame([(f"d{k}", f"{LONG}\nrest", *range(len(names))) for k in range(3)], f"name string, body string, {', '.join(f'{n} int' for n in names)}")
    got = line_dedup.drop_shared_lines(df, doc_id="name", text="body")
    new = ["n_lines", "n_dropped", "kept"]
    assert got.columns == [c for c in df.columns if c not in new] + new
    rows = {r.name: r for r in got.collect()}
    assert [rows[f"d{k}"].kept for k in range(3)] == ["rest", "rest", f"{LONG}\nrest"]
    assert all(rows["d1"][n] == names.index(n) for n in names if n not in new)
    assert line_dedup.drop_shared_lines(df.limit(0), doc_id="name", text="body").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_query(spark):
    import hashlib

    from newstide.llm import catalog

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(docs, plain(docs), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in catalog.op11_line_dedup(spark, SF).collect()} == want

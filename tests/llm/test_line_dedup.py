import random
import re

import pytest

from palimpsest.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least=8):
    """Texts without the lines that repeat or nearly repeat an earlier one; ids are distinct."""
    seen, gone = [], set()
    for d, text in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line)
            if w:
                if any(w == v or (min(len(w), len(v)) >= least and distance_at_most_one(w, v)) for v in seen):
                    gone.add((d, at))
                seen.append(w)
    return {d: (None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone), sum(g[0] == d for g in gone)) for d, t in rows}


def test_matches_all_pairs(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [[random.choice(vocabulary) for _ in range(n)] for n in (1, 3, 7, 8, 8, 9, 12, 30)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(random.randrange(6)):
            w = list(random.choice(bases))
            for _ in range(random.choice((0, 1, 1, 2))):
                i = random.randrange(len(w) + 1)
                kind = random.randrange(3)
                w = w[:i] + [random.choice(vocabulary)] * (kind != 1) + w[i + (kind != 0) :]
            lines.append(random.choice((" ", "  ", "\t")).join(w) + random.choice(("", " ", "\r")))
        rows.append((d, "\n".join(lines)))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = brute(rows)
    assert {r.doc_id: (r.text, r.n_lines_dropped) for r in got.collect()} == want
    assert sum(n for _, n in want.values()) > 40


def test_matches_all_pairs_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 3000").select("doc_id", "text").limit(90).collect()]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_lines_dropped) for r in got.collect()} == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a\n\na"), (5, long), (6, long + " y"), (7, "b"), (7, "b"), (None, "b\nc"), (8, "c")]
    docs = spark.createDataFrame([(d, t, "1", "2", "3") for d, t in rows], "doc_id long, text string, line string, doc string, at string")
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines_dropped) for r in out.collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, "\n \n", 0), (4, "a\n", 1), (5, long, 0), (6, "", 1), (7, "", 1), (7, "", 1), (None, "b\nc", 0), (8, "", 1)]
    assert got == sorted(want, key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [60])
def test_template_lines_keep_the_earliest(spark, n):
    rows = [(d, f"page {d} of the long report about all the numbers") for d in range(n)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in got.collect() if r.text] == [0]


def test_very_long_lines_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    edited = long.replace(" w777 ", " other ")
    rows = [(1, long), (2, edited), (3, long + "\nshort line"), (4, None), (4, "short line")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, `__gone__` string, `__doc__` string")
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_dropped"]
    got = sorted((r.doc_id, r.text, r.n_lines_dropped, r["__gone__"]) for r in out.collect() if r.text is not None)
    assert got == [(1, long, 0, "a"), (2, "", 1, "a"), (3, "short line", 1, "a"), (4, "", 1, "a")]

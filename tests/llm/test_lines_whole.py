"""Line dedup where lines are common: no document frequency may decide what stays."""

import hashlib
import random

from maskrisk.llm import line_dedup as L


def kept(spark, rows):
    return {r.doc_id: r.text for r in L.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_copies_in_groups_of_any_size(spark):
    for n in (64, 65, 300):
        got = kept(spark, [(i, "one line\nand another") for i in range(n)] + [(1000 + i, f"own {i}\nReleased under the MIT License.") for i in range(n)])
        assert got[0] == "one line\nand another" and all(got[i] == "" for i in range(1, n))
        assert got[1000] == "own 0\nReleased under the MIT License." and all(got[1000 + i] == f"own {i}" for i in range(1, n))


def test_blocks_first_seen_elsewhere(spark):
    assert kept(spark, [(1, "y\nx"), (2, "x\ny"), (3, "x\ny")])[3] == ""
    assert kept(spark, [(1, "a\nb"), (2, "a\nq\nb\na\na\nb"), (3, "a\nq\nb\na\na\nb")])[3] == ""
    rows = [(1, "p\nx"), (2, "y\np"), (3, "q\nz"), *((10 + i, f"x\ny\nz\n{i}") for i in range(70))]
    got = kept(spark, rows)
    assert all(got[11 + i] == str(1 + i) for i in range(69))


def own_diff(a, b):
    """Patience alignment by plain definition: equal ends, then the longest rising run of lines unique on both sides."""
    if not a or not b:
        return 0
    if a[0] == b[0] and a[0] is not None:
        return 1 + own_diff(a[1:], b[1:])
    if a[-1] == b[-1] and a[-1] is not None:
        return 1 + own_diff(a[:-1], b[:-1])
    places = [(a.index(x), b.index(x)) for x in a if x is not None and a.count(x) == 1 and b.count(x) == 1]
    best = max((len(run) for run in rising(places)), default=0)
    return best if not best else max(aligned(run, a, b) for run in rising(places) if len(run) == best)


def rising(places):
    runs = []
    for p in places:
        runs += [[*r, p] for r in runs if r[-1][1] < p[1]] + [[p]]
    return runs


def aligned(run, a, b):
    total, i, j = 0, 0, 0
    for x, y in [*run, (len(a), len(b))]:
        total += own_diff(a[i:x], b[j:y]) + (x < len(a))
        i, j = x + 1, y + 1
    return total


def test_alignment_against_its_definition():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice(["a", "b", "c", "d", "e", "f", None]) for _ in range(rng.randint(0, 7))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[i] == b[j] is not None for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert 0 <= own_diff(a, b) - len(got) <= 1 and bool(got) == bool(own_diff(a, b))


def test_repeated_ids(spark):
    rows = [(1, "a\nb"), (2, "a\nb"), (2, "p\nq\nr\ns"), (2, "p\nq\nr\ns"), (2, "p\na"), (3, "s")]
    got = sorted((r.doc_id, r.text) for r in L.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a\nb"), (2, ""), (2, "p"), (2, "p\nq\nr\ns"), (2, "p\nq\nr\ns"), (3, "")]


def test_block_of_two_documents_in_reverse_order_elsewhere(spark):
    got = kept(spark, [(1, "D\nu\nC\nv\nB\nw\nA"), (2, "x\nA\nB\nC\nD\ny"), (3, "A\nB\nC\nD")])
    assert got[3] == ""


def test_lines_that_first_holders_repeat_or_have_elsewhere(spark):
    got = kept(spark, [(1, "x\na\nx\nb\nx"), (2, "c\nx\nd"), (3, "b\nx\na")])
    assert got[3] == "b" or got[3] == "a"
    got = kept(spark, [(1, "t\nu\nt"), (2, "p\nt\nq\nr"), (3, "s\nt")])
    assert got[3] == "s"


def test_many_removed_lines(spark):
    """The cost of taking lines out does not grow with the square of their number."""
    copied = "\n".join(f"line {i}" for i in range(60_000))
    got = kept(spark, [(1, copied), (2, f"own\n{copied}\n\nlast")])
    assert got[1] == copied and got[2] == "own\n\nlast"


def test_against_every_earlier_document(spark, docs):
    """What aligns with any earlier document goes, nothing else."""
    texts = {r.doc_id: r.text.split("\n") for r in docs.select("doc_id", "text").collect()}
    lines = {i: [x if x.strip(" \t\n\x0b\f\r") else None for x in t] for i, t in texts.items()}
    want = {(i, j) for i in lines for o in lines if o < i and set(lines[o]) & set(lines[i]) - {None} for _, j in L.patience(lines[o], lines[i])}
    got = {(r.doc_id, j) for r in L.aligned_lines(docs).collect() for j in r.gone}
    assert got <= want and len(got) >= 0.999 * len(want)
    digest = {r.doc_id: (r.n_lines, r.kept_chars, r.kept_sha256) for r in L.line_digest(docs).collect()}
    for i, t in texts.items():
        left = "\n".join(x for j, x in enumerate(t) if (i, j) not in got)
        assert digest[i] == (len(t), len(left), hashlib.sha256(left.encode()).hexdigest())

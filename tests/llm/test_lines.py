import random
import re

from tesserae.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(docs, tau, least):
    firsts = {}
    for i, t in sorted({d[:2] for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            if WORD.search(line):
                firsts.setdefault(line, ((i is not None, i or 0), n))
    near = {x for x in firsts for y in firsts if firsts[y] < firsts[x] and min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= tau and edits(x, y) <= tau}
    out = set()
    for i, t, *_ in docs:
        ls = [] if t is None else t.split("\n")
        gone = [n for n, x in enumerate(ls) if WORD.search(x) and (firsts[x] != ((i is not None, i or 0), n) or x in near)]
        exact = sum(firsts[ls[n]] != ((i is not None, i or 0), n) for n in gone)
        out.add((i, len(ls), exact, len(gone) - exact, tuple(gone)))
    return out


def mutate(r, s, n):
    s = list(s)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(s))
        if k == 0:
            s[at] = r.choice("abé𝒳 ")
        elif k == 1:
            del s[at]
        else:
            s.insert(at, r.choice("abé𝒳 "))
    return "".join(s)


def test_band_against_plain_edit_distance(spark):
    r = random.Random(7)
    for tau in (1, 2, 3):
        pairs = []
        for _ in range(300):
            a = "".join(r.choice("ab é𝒳") for _ in range(r.randint(4, 30)))
            b = mutate(r, a, r.randint(0, 5))
            if abs(len(a) - len(b)) <= tau:
                pairs.append((a, b, edits(a, b) <= tau))
        pairs += [("", "", True), ("a", "", True), ("", "a" * tau, True)]
        df = spark.createDataFrame(pairs, "a string, b string, want boolean")
        bad = df.selectExpr("*", f"{lines.within('a', 'b', tau)} as got").filter("got is distinct from want").collect()
        assert bad == []


def test_matches_brute_force(spark):
    r = random.Random(3)
    pool = ["".join(r.choice("ab cdeé") for _ in range(r.randint(1, 45))) for _ in range(40)]
    docs = []
    for i in range(90):
        ls = [mutate(r, x, r.randint(0, 3)) if r.random() < 0.5 and len(x) > 6 else x for x in (r.choice(pool) for _ in range(r.randint(1, 6)))]
        docs.append((i, "\n".join(ls), i))
    docs += [(200, None, 0), (201, "", 0), (202, "\n \n", 0), (None, pool[0] + "\nnew one", 0), (203, pool[1] * 300, 0), (5, docs[5][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int").repartition(3)
    got = {(x.doc_id, x.n_lines, x.n_exact, x.n_near, tuple(x.dropped)) for x in lines.dropped_lines(df).collect()}
    assert got == brute(docs, lines.TAU, lines.MIN_CHARS)
    want = {i: g for i, _, _, _, g in got}
    kept = {x.doc_id: x.text for x in lines.dedup_lines(df).collect()}
    for i, t, _ in docs:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert kept.get(i, left if want[i] and not WORD.search(left) else "gone") == left, i


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pos int")
    assert lines.dropped_lines(df).collect() == [] and lines.dedup_lines(df).columns == ["doc_id", "text", "pos"]


def test_many_lines_of_one_segment(spark, monkeypatch):
    monkeypatch.setattr(lines, "PART", 5)
    r = random.Random(8)
    start = "all of these lines begin with the same words, and they go on "
    docs = [(i, start + "".join(r.choice("abcdefgh") for _ in range(30)) + "\nend of it") for i in range(120)]
    docs += [(200 + i, mutate(r, docs[i][1].split("\n")[0], 2)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.n_lines, x.n_exact, x.n_near, tuple(x.dropped)) for x in lines.dropped_lines(df).collect()}
    assert got == brute(docs, lines.TAU, lines.MIN_CHARS)


def test_very_long_lines_and_clashing_columns(spark):
    long = "0123456789 " * 200_000
    docs = [(1, long + "abc", "x", 7, "s", 3), (2, long + "abd\nown line", "y", 8, "t", 4), (3, "short", "z", 9, "u", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _d string, _dropped int, _s string, n_chars int")
    out = {x.doc_id: x for x in lines.dedup_lines(df).collect()}
    assert out[1].text == docs[0][1] and out[2].text == "own line" and out[2].n_chars == 8 and out[3].n_chars == 5
    assert [(x._d, x._dropped, x._s) for x in (out[1], out[2], out[3])] == [d[2:5] for d in docs]

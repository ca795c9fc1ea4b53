import random
import time

from tagwright.llm import linededup

SPACES = "\t\n\x0b\x0c\r "


def brute(docs, min_lines=3, min_words=50):
    """Delete the lines of every shortest qualifying run that starts earlier as well; (id, text) pairs in order."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        lines = text.split("\n")
        solid = [(i, s) for i, x in enumerate(lines) if (s := x.strip(SPACES))]
        gone = set()
        for k in range(len(solid)):
            for n in range(1, min_lines + 1):
                run = solid[k:k + n]
                if len(run) < n:
                    break
                if n == min_lines or sum(len(s.split()) for _, s in run) >= min_words:
                    if tuple(s for _, s in run) in seen:
                        gone |= {i for i, _ in run}
                    seen.setdefault(tuple(s for _, s in run), doc)
                    break
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 10, 60]))) for _ in range(25)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 15)))) for i in range(150)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(docs, 5), extend=False).collect()}
    assert got == brute(docs)


def brute_runs(docs, min_lines=3, min_words=50):
    """Delete the maximal matches of any two positions that have the lines or words, at the later one."""
    solid = [(doc, i, s) for doc, text in sorted(docs) for i, x in enumerate(text.split("\n")) if (s := x.strip(SPACES))]
    same = lambda a, b: a >= 0 and b < len(solid) and solid[a][2] == solid[b][2]
    ends = lambda k: k + 1 == len(solid) or solid[k][0] != solid[k + 1][0]
    places, gone = {}, set()
    for b, (_, _, line) in enumerate(solid):
        for a in places.setdefault(line, []):
            if a and same(a - 1, b - 1) and not ends(a - 1) and not ends(b - 1):
                continue   # within a match that begins further up
            n = 1
            while same(a + n, b + n) and not ends(a + n - 1) and not ends(b + n - 1):
                n += 1
            if n >= min_lines or sum(len(x.split()) for _, _, x in solid[b:b + n]) >= min_words:
                gone |= {(doc, i) for doc, i, _ in solid[b:b + n]}
        places[line].append(b)
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in gone) for doc, text in docs}


def test_whole_runs_against_maximal_matches(spark, docs_of):
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 10, 30, 60]))) for _ in range(20)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 15)))) for i in range(150)]
    want = brute_runs(docs)
    assert want != brute(docs)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs_of(docs, 5)).collect()}
    assert got == want


def test_last_lines_of_a_run_go_too(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 20), ("c", 20)))
    own = [" ".join(f"own{k}x{i}" for i in range(400)) for k in (1, 2)]
    docs = docs_of([(1, "\n".join([a, b, c, own[0]])), (2, "\n".join([a, b, c, own[1]]))])
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_documents(docs).collect()}[2] == own[1]


def test_only_copies_go_as_a_whole(spark, docs_of):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    shared, parts, body = words("licence", 100), [words(f"part{k}x", 60) for k in range(4)], [words(f"body{k}x", 60) for k in range(6)]
    again = "\n".join(["x y z"] * 60)
    docs = docs_of([(1, shared), (2, f"{shared}\n{words('own', 25)}"),              # a licence is all it shares
                    *[(3 + k, f"{p}\n{words(f'rest{k}x', 60)}") for k, p in enumerate(parts)],
                    (7, "\n".join([*parts, words("new", 40)])),                     # from four documents
                    (8, "\n".join(body)), (9, "\n".join([*body, words("end", 12)])),   # a near copy
                    (10, "\n".join(body)), (11, f"{again}\nlast words"),           # a copy; one that repeats itself
                    (12, f"{body[0]}\n{words('tail', 10)}")])                       # a part of a document
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_documents(docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 11, 12]
    assert got[2] == words("own", 25) and got[7] == words("new", 40) and got[12] == words("tail", 10)
    assert got[11] == "x y z\nlast words"


def test_long_passage_within_other_text(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(51))
    short = "one short line"
    docs = docs_of([(3, f"a\n{passage}\nb"), (1, f"{short}\n{passage}"), (2, f"{short}\nc")])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (f"{short}\n{passage}", 2, 0), 2: (f"{short}\nc", 2, 0), 3: ("a\nb", 3, 1)}


def test_copies_go_and_hostile_rows(spark, hostile):
    kept = linededup.dedup_documents(hostile)
    assert kept.columns == hostile.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "1", "2", "3", "4", "5", "7", "8", "None", "None"]
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(hostile).where("doc_id > 1").collect()}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[6]["text"] == "" and rows[6]["n_removed"] == 4000
    assert rows[4]["text"] == "   \n\t "
    assert linededup.dedup_lines(hostile.limit(0)).count() == 0


def test_plan_is_native(spark, docs_of):
    plan = linededup.dedup_lines(docs_of(["a\nb", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_time_is_linear_in_the_lines_of_a_text(spark, docs_of):
    text = "\n".join(f"line {i} of many" for i in range(160_000))
    begin = time.time()
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in linededup.dedup_lines(docs_of([(1, text), (2, text + "\nlast own")])).collect()}
    assert got == {1: (0, text), 2: (160_000, "last own")}
    assert time.time() - begin < 60

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagwright.llm import divergence as V

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, term string, n string, rank double"


def brute(rows, min_docs=10, k=10):
    """rows: (text, lang, source). Plain Python integers over every term of every group."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in sources:
            pairs = sorted((-sum(f(s, o, t) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -x, i) for i, (x, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(s, None, t), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -x, i) for i, (x, _, t) in enumerate(terms[:k], 1)]
    return sorted(out)


def audited(spark, rows, parts=3, **kw):
    full = [(i, t, lang, s, None, "a", "b", 1.0) for i, (t, lang, s) in enumerate(rows)]
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank"))
                  for r in V.audit(spark.createDataFrame(full, COLUMNS).repartition(parts), **kw).collect())


def sample(seed, docs=150, sources=6, langs=("en", "de"), words=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["Wort", "term", "Éa", "日本", "x"]) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(words)]
    rows = []
    for _ in range(docs):
        s = rng.randrange(sources)
        text = rng.choice([" ", "-", "\n7"]).join(rng.choice(vocabulary[s:] if rng.random() < 0.7 else vocabulary[:9]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(langs), f"s{s}"))
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_matches_brute_force(spark, parts):
    rows = sample(1)
    got = audited(spark, rows, parts)
    assert got == brute(rows) and {r[2] for r in got} == {"pair", "term"}


def test_tiles_and_passed_on_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(V, "TERMS", 7)
    monkeypatch.setattr(V, "SOURCES", 2)
    monkeypatch.setattr(V, "HELD", 5)
    monkeypatch.setattr(V, "PIECE", 3)
    rows = sample(2, sources=7)
    assert audited(spark, rows, min_docs=3, k=4) == brute(rows, 3, 4)


def test_nulls_empty_texts_ties_and_languages_without_terms(spark):
    rows = [(None, None, None), ("", None, "a"), ("only once", "xx", "a"), ("", "xx", None), ("", "alone", "s")]
    rows += [("tie Tie b a \x7f é", "en", s) for s in ("a", "b", None) for _ in range(5)] + [("b b rare", "en", "a")] * 4
    rows += [("long " * 300_000 + "tail", "en", "b")]
    got = audited(spark, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] == "xx"] == [("xx", "", "pair", "a", 0, 1), ("xx", "a", "pair", "", 0, 1)]
    assert audited(spark, []) == []


def test_skyband_holds_the_first_k_and_drops_most():
    rng = np.random.default_rng(3)
    n, total = rng.integers(1, 1000, 3000), rng.integers(1000, 9000, 3000)
    term = [f"t{i:05d}" for i in rng.permutation(3000)]
    kept = set(V.skyband(n, total, term, 10).tolist())
    for i in range(0, 3000, 7):
        dominated = sum((n >= n[i]) & (total <= total[i]) & (np.array(term) < term[i]))
        assert (i in kept) == (dominated < 10)
    assert len(kept) < 1500

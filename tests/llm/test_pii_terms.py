"""Terms of entities of one text and of several, against brute force, and how many rows that takes."""

import math
import random

from roadveil.llm import pii


def test_texts_with_base_spans_may_hold_some(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a.@@-+ ()0123é4155\n") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["1" * 13, "4111 1111-1111 1111", "x@y.z", "a @b.c", "+1.2(3)45 6789", "1.2.3.4", "0001.002.3.04", None, ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).orderBy("i").select(pii.may_hold(pii.F.col("text"))).collect()]
    assert all(g for g, t in zip(got, texts, strict=True) if pii.base_spans(t or ""))
    assert not got[-1] and not got[-2] and not all(got)


def test_terms_meet_brute_force_and_once_mentioned_entities_share_their_rows(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    rows = [(i, noise(20)) for i in range(150)]
    for i in range(150, 170):  # ten entities of their own, two that some share, words of their own and words of a group
        own = " ".join(f"u{i}k{k}@one.org" for k in range(10))
        rows.append((i, f"{noise(5)} {own} +1 555 000 00{i % 3} word{i} group{i % 3} tag{i % 5} team{i % 4}@all.org {noise(5)} rare{i} {'odd' if i < 152 else 'even'}"))
    rows += [(170, rows[-1][1]), (171, rows[-2][1]), (172, None), (173, ""), (None, rows[155][1])]
    tables = {}

    def staged(spark, df, tag):
        out = real(spark, df, tag)
        tables[tag] = out.count()
        return out

    real = pii.staged
    monkeypatch.setattr(pii, "staged", staged)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.find(spark, docs).collect())
    held = {}
    for _, t in rows:
        spans = pii.base_spans(t or "")
        held.setdefault(t, ({pii.entity(k, t[s:e]) for k, s, e in spans}, {m[0].lower() for m in pii.free_words(t or "", spans)}))
    every = [held[t] for _, t in rows]
    words = [{w for w in pii.re.split(r"[\W_]+", (t or "").lower()) if w} for _, t in rows]
    want = []
    for i, text in rows:
        grades = {}
        for c in held[text][0]:
            n_c = sum(c in e for e, _ in every)
            for term in held[text][1]:
                both, n_t = sum(c in e and term in w for e, w in every), sum(term in w for w in words)
                pmi, ic = math.log2(len(rows) * both / (n_c * n_t)), math.log2(len(rows) / n_c)
                grade = "remove" if pmi >= ic / 1.5 else "generalise" if pmi >= max(1, ic / 3) else None
                if grade and pmi > 0:
                    grades[term] = "remove" if "remove" in (grade, grades.get(term)) else grade
        base = pii.base_spans(text or "")
        more = sorted((f"term_{grades[m[0].lower()]}", m.start(), m.end()) for m in pii.free_words(text or "", base) if m[0].lower() in grades)
        want.append((str(i), pii.said([*base, *more])))
    assert got == sorted(want)
    assert "term_generalise" in str(want) and "term_remove" in str(want)
    # ten entities of one text alone are no ten rows a word
    asked = sum(len(w) for e, w in held.values() if e)
    assert 0 < tables["joint"] < 3 * asked and tables["terms"] < 4 * asked
    clean = {str(r["doc_id"]): r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert len(clean) == len(rows) and clean["3"] == rows[3][1] and "rare151" not in clean["151"] and not pii.base_spans(clean["160"]) and clean["172"] is None


def test_sanitise_writes_no_table_that_is_read_once(spark, monkeypatch):
    tags, real = [], pii.staged
    monkeypatch.setattr(pii, "staged", lambda spark, df, tag: tags.append(tag) or real(spark, df, tag))
    docs = spark.createDataFrame([(1, "mail a.b@c.de to zyx"), (2, "mail a.b@c.de to zyx"), (3, "plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert "found" not in tags and "held" in tags
    assert "[EMAIL]" in got[1] and "@" not in got[1] and got[2] == got[1] and got[3] == "plain words"

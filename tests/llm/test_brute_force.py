"""The operators' results against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from roadveil.llm import htmltext, langid, lattice, packing, pieces, pii, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_whole_table(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash_near_dedup(spark, SF).collect()}
    prints = {i: plain_print(t) for i, t, _ in documents}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(near, prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_near_pairs_misses_none(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    for b in list(base[:60]):
        for _ in range(4):
            flipped = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                flipped ^= 1 << bit
            base.append(flipped)
    base = sorted(set(base))
    signed = [b - (1 << 64) if b >> 63 else b for b in base]
    pairs = {(a, b) for a in base for b in base if a < b and (a ^ b).bit_count() <= 3}
    want = components(pairs, base)
    for rows in (8192, 8, 1):  # one shard, many, and shards that are split
        links = simhash.near_pairs(spark, spark.createDataFrame([(s,) for s in signed], "fp long"), rows).collect()
        assert components([(r[0] % 2**64, r[1] % 2**64) for r in links], base) == want


def test_vantage_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    homes = rng.integers(-(1 << 63), (1 << 63) - 1, 4000)
    asking = homes[:1500] ^ (np.int64(1) << rng.integers(0, 63, 1500)) ^ (np.int64(1) << rng.integers(0, 63, 1500))
    near = {(int(x), int(y)) for x in asking for y in homes[np.bitwise_count((homes ^ x).view(np.uint64)) <= 3] if x != y}
    got = set()
    for which in (0, 1):
        both = np.concatenate([homes, asking])
        for x, y in simhash.search(both, both, which):
            got |= set(zip(x.tolist(), y.tolist(), strict=True))
    assert near <= got | {(b, a) for a, b in got}
    tree = simhash.VantageTree(simhash.half_of(homes, 0), 8)
    row, leaf = tree.leaves(simhash.half_of(asking, 0), np.ones(len(asking), np.int16))
    assert tree.pruned > 5 * len(asking) and len(row) < 0.05 * (len(asking) << 8)
    home_row, home = tree.leaves(simhash.half_of(homes, 0), np.zeros(len(homes), np.int16))
    assert sorted(home_row) == list(range(len(homes)))


def test_long_text_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    words = text.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want


def segmentations(model, text):
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, ids))
        for end in range(at + 1, len(text) + 1):
            if hit := model.scores.get(text[at:end]):
                go(end, (*ids, hit[0]), score + hit[1])
        if at < len(text) and text[at] not in model.scores:
            raw = text[at].encode()
            go(at + 1, ids + tuple(model.byte_ids[b] for b in raw), score + model.byte_score * len(raw))

    go(0, (), 0.0)
    return sorted(out, key=lambda p: (-p[0], p[1]))


def test_n_best_is_exact():
    rng = random.Random(1)
    for _ in range(120):
        scores = {",": (290, -2.0), "▁": (300, -9.0), "a": (301, -3.0), "b": (302, -4.0), "▁▁": (303, -50.0)}
        for _ in range(8):
            word = rng.choice(["", "▁"]) + "".join(rng.choice("ab") for _ in range(rng.randint(2, 3)))
            scores.setdefault(word, (304 + len(scores), -float(rng.randint(1, 10))))
        model = pieces.PieceModel.of(scores, list(range(256)), -60.0, [b""] * 400)
        segment = pieces.Segmenter(model, 4)
        texts = ["".join(rng.choice("ab  \né,") for _ in range(rng.randint(0, 9))) for _ in range(6)]
        for text, (got, _) in zip(texts, segment(pa.array(texts)), strict=True):
            every = segmentations(model, "▁" + text.replace(" ", "▁") if text else "")
            assert [g[0] for g in got] == [w[0] for w in every[:4]]
            told = [(w, tuple(ids.tolist())) for w, ids in got]
            assert len(set(told)) == len(told) and set(told) <= set(every)


def test_long_unbroken_texts_take_time_in_proportion():
    import time

    model = pieces.PieceModel.load(packing.vocabulary("piece_bpe_32k.model"))
    took = []
    for n in (20_000, 80_000):
        for text in ("=" * n, "".join(random.Random(3).choices("etaoinshr", k=n))):
            began = time.process_time()
            (found, same), = pieces.Segmenter(model, 3)(pa.array([text]))
            took.append(time.process_time() - began)
            assert same and len(found) == 3 and len({ids.tobytes() for _, ids in found}) == 3
    assert took[2] < 10 * took[0] + 0.2 and took[3] < 10 * took[1] + 0.2


def test_pieces_whole_table(spark, documents):
    import sentencepiece

    got = {r["doc_id"]: r for r in queries.op3_sentencepiece(spark, SF).collect()}
    assert len(got) == len(documents) and all(r["restored"] for r in got.values())
    assert all(r["scores"] == sorted(r["scores"], reverse=True) for r in got.values())
    model = pieces.PieceModel.load(packing.vocabulary("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=packing.vocabulary("piece_bpe_32k.model"))
    agree = total = 0
    for i, text, _ in documents[:40]:
        words = ["▁" + w for w in (text or "").replace("\n", " \n ").split(" ")] if text else []
        # a text's best score is the sum of a plain Viterbi over the whole text
        whole = "▁" + text.replace(" ", "▁") if text else ""
        best = [0.0] + [float("-inf")] * len(whole)
        for end in range(1, len(whole) + 1):
            for start, _, weight in model.arcs(whole, end):
                best[end] = max(best[end], best[start] + weight)
        assert got[i]["best"] == best[-1]
        for w in words:
            total += 1
            agree += list(model.n_best(w, 1)[0][1]) == library.encode(w[1:])
    assert agree >= 0.8 * total
    ids = spark.createDataFrame([(1, [1, 300, 301]), (2, None), (3, [None, -1, 10**6, 300])], "doc_id long, ids array<int>")
    one = model.decode([300]).decode()
    assert {r[0]: r[1] for r in pieces.decode(ids).collect()} == {1: model.decode([300, 301]).decode(), 2: None, 3: one}


def test_packing_whole_table(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    rows = queries.op8_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text, _ in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * total


def test_packing_ids_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    from roadveil.llm import recent

    path = packing.vocabulary("word_bpe_49k.json")
    rng, tokenizer = random.Random(8), Tokenizer.from_file(path)
    texts = ["".join(rng.choice(["a", "Bc", "\u00e9", "\u0301", ".", ",", " ", "\n", "\u00a0", "\u2003", "3", "'s", "<|endoftext|>", "<|", "\u01c5", "&&"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, "", "   ", "one. two, three."]
    for most in (4 << 20, 40):  # the second cuts long texts at blanks
        monkeypatch.setattr(recent, "SLICE", most)
        monkeypatch.setattr(recent.slices, "__defaults__", (most,))
        encode = packing.ChunkEncoder(path, remembered=2000)
        for text, ids in zip(texts, encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def test_language_held_out(spark, documents):
    lang = {i: l for i, _, l in documents}
    rows = [r for r in queries.op5_language_id(spark, SF).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scored = {r["doc_id"]: r["toxic"] for r in toxicity.score(spark, docs, known).collect()}
    rest = [(scored[r["doc_id"]], r["toxic"]) for r in labels.join(known, "doc_id", "left_anti").collect()]
    clean, bad = [p for p, t in rest if not t], [p for p, t in rest if t]
    assert sum(clean) <= 0.05 * len(clean) and sum(bad) >= 0.7 * len(bad)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.5).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0]], 1)
    chain = toxicity.train(("a", "b"), np.arange(3), x, y, np.arange(400) % 5)
    first, second = chain.probabilities(np.eye(3, dtype=np.float32))[:2]
    assert chain.links[1][0] > 0 and first[1] > 0.9 > 0.1 > second[1]
    # the second model's input is the probability of the first category
    z = chain.weights[1][0] + chain.constants[1] + chain.links[1][0] * first[0]
    assert abs(first[1] - 1 / (1 + np.exp(-z))) < 1e-6 and 0 < first[0] < 1


def test_toxicity_against_a_plain_chain(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    chain = toxicity.fit(spark, docs, labels)
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    assert len(got) == len(documents)
    at = {int(h): i for i, h in enumerate(chain.features)}
    for i, text, _ in documents:
        words = {w.encode() for w in "".join(c.lower() if c.isascii() else c for c in text or "").split()}
        hits = {at[h] for w in words for h in toxicity.word_features(w) if h in at}
        told = []
        for k in range(2):
            z = sum(float(chain.weights[k][h]) for h in hits) + chain.constants[k] + sum(p * w for p, w in zip(told, chain.links[k], strict=True))
            told.append(1 / (1 + np.exp(-max(-30, min(30, z)))))
        assert abs(told[0] - got[i]["p_quality"]) < 1e-6 and abs(told[1] - got[i]["p_toxic"]) < 1e-6
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= 0.5)


def test_long_words_count_whole():
    long = b"x" * 70
    assert set(toxicity.word_features(long + b"abc")) - set(toxicity.word_features(long + b"abd"))


def test_language_against_plain_convolutions(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(docs, ~langid.held_out(F.col("id")))
    for r in queries.op5_language_id(spark, SF).collect():
        text = next(t for i, t, _ in documents if i == r["doc_id"])
        raw = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        windows = np.frombuffer(raw + b"\0" * (-len(raw) % net.window), np.uint8).reshape(-1, net.window)
        p = langid.softmax(np.maximum(net.respond(windows).max(1), 0) @ net.dense + net.shift).astype(float).mean(0)
        assert net.langs[int(p.argmax())] == r["lang_pred"] and abs(p.max() - r["score"]) < 1e-4


def test_many_languages_can_be_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i % 70:02}") for i in range(280)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(net.langs) == 70


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in queries.op7_pii(spark, SF).collect()}
    for i, text, _ in documents:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(text or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["spans"].startswith(base)


def test_pii_random_texts():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("a.@@-+ ()0123é4155") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4111 1111 1111 1111")[0] == ("card", 0, 19)


def test_revealing_terms(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    rows = [(i, f"{noise(9)} mister zorro writes from z@secret.org {noise(9)}") for i in range(6)] + [(i, noise(20)) for i in range(6, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(spark, docs).collect()}
    for i, text in rows[:6]:
        at = text.index("zorro")
        assert f"term_remove:{at}:{at + 5}" in got[i]["spans"]
    assert all(got[i]["spans"] == "" for i in range(6, 200))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert "zorro" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[100][1]


@pytest.mark.parametrize("name", ["op2_url_filters", "op9_exact_top_k"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = lambda many: sorted(map(tuple, many), key=repr)
    assert rows(found.select(*columns).collect()) == rows(con.sql(queries.oracle_sql()[name]).select(*columns).fetchall())


@pytest.mark.parametrize("size, blocks, homes", [(64, 1, 1024), (768, 1, 1024), (768, 2, 1024), (96, 3, 1024), (64, 1, 6)])
def test_embedding_links_recall_and_components(spark, monkeypatch, size, blocks, homes):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [*base]
    for v in base[:80]:
        for cos in rng.uniform(0.94, 0.999, 3):
            side = rng.normal(size=size)
            side -= (side @ v) * v
            rows.append(cos * v + np.sqrt(1 - cos**2) * side / np.linalg.norm(side))
    rows += [base[0] + 1e-3 * k * base[1] for k in range(1, 30)]  # a dense group, in which pairs meet in several tables
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    monkeypatch.setattr(lattice.linked, "__defaults__", (homes, 8 * homes))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(spark, df, blocks=blocks).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.95 * close.sum()
    want = components(zip(*map(np.ndarray.tolist, np.nonzero(close)), strict=True), range(len(x)))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.95 * len(x)
    assert all(want[got[i]["component_id"]] == want[i] for i in range(len(x)))  # no link that isn't there


def test_embeddings_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    ids = [i for i, _ in rows]
    want = components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(close), strict=True)], ids)
    got = {r["vec_id"]: r for r in queries.op10_embedding_near_dedup(spark, SF).collect()}
    assert sum(got[i]["n_links"] for i in ids) >= 0.97 * close.sum()
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, close.sum(1), strict=True))
    assert sum(got[i]["component_id"] == want[i] for i in ids) >= 0.97 * len(ids)


@pytest.mark.parametrize("size", [64, 768, 1024])
def test_cells_are_fine_at_any_width(size):
    rng = np.random.default_rng(9)
    unit = lattice.unit_rows(rng.normal(size=(1500, size)))
    home, near = lattice.cells(unit, 0, 1, 8, lattice.SCALE)
    names = {c.tobytes(): k for k, c in enumerate(np.unique(home, axis=0))}
    at = np.array([names[c.tobytes()] for c in home])
    size_of = np.bincount(at)
    met = size_of[at].sum() + sum(size_of[names[c.tobytes()]] for row in near for c in row if c.tobytes() in names)
    assert met < 0.01 * len(unit) ** 2


def test_layout():
    page = "<title>x</title><p>Hello <b>big</b>\n world<p>two<br>three<ul><li>a<li>b<ol><li>c<li>d</ol></ul><table><tr><td>A<td>longer cell<tr><td>xxxxxx<td>y</table><p hidden>no</p><span style='display:none'>no</span>&amp; end<script>if(a<b){}</script>"
    assert htmltext.render(page) == "Hello big world\n\ntwo\nthree\n\n- a\n- b\n  1. c\n  2. d\n\nA       longer cell\nxxxxxx  y\n\n& end"


@pytest.mark.parametrize("page, want", [
    ("<p>a<!-->b<p>c", "ab\n\nc"),
    ("<p>a<!--->b", "ab"),
    ("<p>a<!--x--!>b", "ab"),
    ("<p>a<!-- x -- > y -->b", "ab"),
    ("<p>x <math><mi>y</mi><annotation>no</annotation></math> <svg><title>no</title><text>z</text></svg>", "x y z"),
    ("<form><input type=submit value='Send it'><input value=no></form>", "Send it"),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>", "yes"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td colspan=2>head<td>x<tr><td>1<td>2<td>y</table>", "head  x\n1  2  y"),
])
def test_layout_of_odd_pages(page, want):
    assert htmltext.render(page) == want


def test_layout_grows_with_the_page_alone():
    page = f"<table><tr><td>{'w' * 20_000}<td>x" + "<tr><td>a<td>b" * 2000 + "</table>"
    text = htmltext.render(page)
    assert len(text) < 10 * len(page) and text.startswith("w" * 20_000 + "  x\na")
    deep = "<div>" * 3000 + "end" + "<b>" * 3000
    assert htmltext.render(deep) == "end"


def test_layout_keeps_every_visible_word(spark):
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", page)
        import html

        words = html.unescape(re.sub(r"</?(?:b|a)\b[^>]*>", "", body))
        words = re.sub(r"<[^>]*>", " ", words).split()
        got = re.sub(r"(?m)^- ", "", htmltext.render(page)).split()
        assert got == words

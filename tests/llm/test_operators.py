"""Every operator against a brute-force version on small tables, and its defined results for odd input: nulls, empty
and long texts, ties, repeated rows, empty tables and further columns with clashing names."""

import hashlib
import html
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import public_tokenizers
from allelix.llm import ann, bpe, chat_format, common, html_extract, ngram_join, packing, quality, quality_rules, toxicity, url_filter
from allelix.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "[^\x20\x09-\x0D]+"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeated rows, and columns named like the operators' own."""
    long = "word " * 30_000 + "x" * 6_000
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, long), (4, "same text here"), (4, "same text here"), (None, "no id at all"), (6, "Ünïcode ΣΑΣ <|endoftext|> 1d10t"), (7, "a")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    for c in ("score", "n", "rep", "label", "comp", "tile", "block", "ids", "host", "h", "tri", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- n-gram Jaccard join


def shingles(text, width):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if den * i >= num * len(sets[a] | sets[b]) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=70):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 12, 30, 90, 200]))) for _ in range(n // 3)]
    while len(texts) < n:
        words = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append("\n".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("width,threshold,tile", [(3, "0.9", 4096), (5, "0.8", 4096), (3, "0.7", 6), (3, "0.5", 3)])
def test_jaccard_components(spark, width, threshold, tile):
    rows = near_copies(width * 10 + tile)
    docs = documents(spark, [t for _, t in rows]).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, width, threshold, tile).collect()}
    t = ngram_join.Fraction(threshold)
    assert got == components(rows, width, t.numerator, t.denominator)


def test_jaccard_query(spark, small):
    """The registered query against brute force over the whole table."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.queries()["op2_ngram_jaccard_join"](spark, small).collect()}
    assert got == components(docs, 3, 9, 10)


def test_jaccard_null_ids(spark):
    """A row without an id that copies documents with one has no component."""
    text = "one two three four five six seven"
    rows = [tuple(r) for r in ngram_join.jaccard_components(documents(spark, [text, text, text], [1, 2, None])).collect()]
    assert sorted(rows, key=repr) == sorted([(1, 3, 1), (2, 3, 1), (None, 3, None)], key=repr)


def test_jaccard_odd(spark, odd):
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(odd).collect()), key=repr)
    assert got == sorted([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (6, 1, 6), (7, 1, 7)], key=repr)
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0


def test_common_lines_chain_no_groups(spark, monkeypatch):
    """Texts that have only a line of boilerplate in common aren't candidates (one group of 60 before), copies are."""
    rng = random.Random(4)
    line = " ".join(f"line{i}" for i in range(24))
    texts = [" ".join([*(f"w{rng.randrange(10**9)}" for _ in range(400)), line]) for _ in range(400)]
    texts += [t.replace(" line3 ", " other ") for t in texts[:5]]
    sized, real = [], ngram_join._sized
    monkeypatch.setattr(ngram_join, "_sized", lambda rows: sized.append(real(rows)) or sized[-1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(documents(spark, texts), 5, "0.8").collect()}
    assert got == {k: k % 400 for k in range(405)}
    assert sized[0].agg(F.max("m")).first()[0] <= 4


def test_small_parts_lose_no_link():
    """Sets at the threshold share a signature, whatever their sizes."""
    rng, t = np.random.default_rng(8), ngram_join.Fraction("0.8")
    for n in [1, 2, 4, 5, 9, 20, 40, 60, 90, 150, 300, 700, 2000] * 4:
        apart = n // 5 if n >= 5 else 0  # of the larger set, which holds all of the smaller one
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        two = np.sort(rng.permutation(one)[apart:])
        rows, sigs = ngram_join.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), ngram_join.Bands(t))
        assert np.intersect1d(sigs[rows == 0], sigs[rows == 1]).size, n


def test_planes():
    for docs in ([], [5], [-(1 << 63), -3, 0, 7, 7, (1 << 63) - 1]):
        pairs = np.array([np.arange(len(docs)) * -(1 << 59) + 9, docs], np.int64).reshape(2, -1)
        assert (ngram_join.from_planes(ngram_join.planes(pairs)) == pairs).all()


def test_join_leaves_no_texts_behind(spark, monkeypatch, tmp_path):
    """Tables of texts go once labels are written, the session's settings stay, and edges that repeat count once."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    kept, real = spark.conf.get(common.CLEANUP, None), common.written
    ngram_join.jaccard_components(documents(spark, [t for _, t in near_copies(9, 40)]), 3, "0.5", 4).collect()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "jaccard-labels" in left and not left & {"jaccard-texts", "jaccard-state", "jaccard-finer", "jaccard-sized"}
    assert spark.conf.get(common.CLEANUP, None) == kept
    counts = []
    monkeypatch.setattr(common, "written", lambda *a, **k: counts.append((out := real(*a, **k)).count()) or out)
    edges = [(k % 50 + 1, 0) for k in range(5000)]
    connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).count()
    assert counts == [50, 50]


def test_words_of_long_rows():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(300_000))
    parts = list(ngram_join.words(*ngram_join.text_bytes(pa.array(["a b", text, None, "c"]))))
    assert [n for _, _, _, count in parts for n in count] == [2, 300_000, 0, 1]
    whole = np.concatenate([h for _, _, h, _ in parts])
    alone = np.concatenate([h for w in (["a", "b"], [f"w{i}" for i in range(0, 300_000, 30_000)], ["c"]) for x in w for _, _, h, _ in ngram_join.words(*ngram_join.text_bytes(pa.array([x])))])
    assert (whole[[0, 1, *range(2, 300_002, 30_000), -1]] == alone).all()


def test_components_of_hubs(spark, monkeypatch):
    """Nodes with very many edges, of largest and of least id, with chains behind them; one graph for each group."""
    from allelix.llm import common

    monkeypatch.setattr(common, "HEAVY", 5)
    edges = [(g, 500, i) for g in (1, 2) for i in range(100, 180, g)] + [(g, 5, i) for g in (1, 2) for i in range(200, 240)] + [(1, i, i + 1) for i in range(240, 260)] + [(1, 239, 240), (2, 100, 200)]
    got = {(r["g"], r["node"]): r["component"] for r in connected_components(spark.createDataFrame(edges, "g long, a long, b long"), "g").collect()}
    want = {(1, i): 100 for i in [*range(100, 180), 500]} | {(1, i): 5 for i in [5, *range(200, 261)]} | {(2, i): 5 for i in [5, *range(100, 180, 2), *range(200, 240), 500]}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# ---- tokenizers


def test_bpe_as_the_library(spark, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    rng = random.Random(1)
    texts = ["", "aaaaaaaaa aaa", "I'LL don't 12½", "<|endoftext|>x<|startoftext|>", "ΣΑΣ é É e\u0301 ǅ İ", "\u1c89\ua7cb\U000105c0", "a" * 3000]
    texts += ["".join(chr(rng.choice([*range(32, 127), *range(192, 600), *range(0x400, 0x460), 0x3A3, 0x2003, 0x1F600])) for _ in range(200)) for _ in range(60)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)
    for r, t in zip(own.digests(texts), texts, strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert r == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r for r in entry.queries()["op10_bpe"](spark, small).collect()}
    for r in docs.limit(40).collect():
        assert rows[r["doc_id"]]["n_tokens"] == len(lib.encode(r["text"], add_special_tokens=False).ids)


def test_bpe_segments(monkeypatch):
    own = bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    text = "some words, and more words! " * 50
    whole = next(iter(own.digests([text])))
    monkeypatch.setattr(bpe, "SEGMENT", 37)
    assert next(iter(own.digests([text]))) == whole


def test_bpe_odd(spark, odd):
    got = bpe.encoded_digests(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 9 and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got if r["doc_id"] in (0, 1, 2)} == {i: (0, empty) for i in (0, 1, 2)}
    assert [r["decoded"] for r in bpe.encoded(odd, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 7").collect()] == ["a</w>"]


# ---- packing


def test_packing(spark, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = entry.queries()["op7_best_fit_packing"](spark, small).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for doc, pieces in rows.groupby("doc_id"):
        ids = np.array([*lib.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        p = pieces.sort_values("piece")
        assert p["length"].sum() == len(ids) and (p["start"].to_numpy() == np.cumsum(p["length"]) - p["length"]).all()
        assert (p["length"].iloc[1:] == 2048).all() and len(p) == -(-len(ids) // 2048)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p["start"], p["length"], strict=True)] == p["ids_crc32"].tolist()
    g = rows.sort_values(["sequence_id", "offset"])
    assert (g["offset"] == g.groupby("sequence_id")["length"].cumsum() - g["length"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 2048
    assert g["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(2).integers(1, 101, 700)
    bins, offsets = packing.vector_best_fit(lengths, 100, 4, 4000, rule=rule)
    for b in np.unique(bins):
        own = bins == b
        assert lengths[own].sum() <= 100 and own.sum() <= 4
        assert own.sum() == 1 or (lengths[own].astype(float) ** 2).sum() <= 4000 + 1e-6
        assert sorted(offsets[own]) == list(np.cumsum(np.append(0, lengths[own][np.argsort(offsets[own])]))[:-1])
    with pytest.raises(ValueError):
        packing.vector_best_fit(lengths, 100, 4, 4000, rule="first")


def test_weights_decide_bins():
    """The further capacities take part in choosing bins: with their weights another bin is best fit, at no more bins."""
    lengths = np.array([60, 60, 15, 14, 30, 10, 9, 8, 7, 6, 5, 4])
    plain, weighed = (packing.vector_best_fit(lengths, 100, 5, 10_000, weights=w)[0] for w in ((1.0, 0.0, 0.0), (1.0, 2.0, 1.0)))
    assert plain.tolist() != weighed.tolist() and len(set(plain)) == len(set(weighed))
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 2000, 3000)
    own, tokens = (packing.vector_best_fit(lengths, 2048, 2048, 2048**2, weights=w)[0] for w in ((1.0, 0.01, 0.01), (1.0, 0.0, 0.0)))
    assert own.max() <= tokens.max() and own.tolist() != tokens.tolist()


def test_blocks_of_tiny_pieces(spark, monkeypatch):
    """Blocks are bounded by pieces too: a table of empty texts isn't one group."""
    monkeypatch.setattr(packing, "PIECES", 500)
    docs = documents(spark, [""] * 4000)
    got = packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert len(got) == 4000 and got["sequence_id"].floordiv(1 << 32).value_counts().max() < 1000


def test_packing_odd(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.packed_sequences(odd, path).toPandas()
    assert got[got["doc_id"].isin([0, 1])]["length"].tolist() == [1, 1]
    assert (got["doc_id"] == 4).sum() == 2 and got["doc_id"].isna().sum() == 1
    assert packing.packed_sequences(odd.limit(0), path).count() == 0
    from tokenizers import Tokenizer

    assert packing.encoder(path)("x" * 9000 + " y").tolist() == Tokenizer.from_file(path).encode("x" * 9000 + " y", add_special_tokens=False).ids


# ---- toxicity and quality


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_folding():
    assert toxicity.fold("1d10t, СLОWN! $tupid tr@sh*** i\u00addiot ｍｏｒｏｎ 2024") == ["idiot", "clown", "stupid", "trash", "idiot", "moron", "2024"]


def test_exceptions_and_automaton():
    lex = toxicity.Lexicon({" trash ": 2.0, " mor": 1.0}, frozenset({"trash can"}))
    a = lex.automaton()
    assert lex.hits("the trash and morons".split(), a) == {"trash": 2.0, "morons": 1.0}
    assert lex.hits("a trash can".split(), a) == {}
    assert lex.hits("trash".split(), a) == {"trash": 2.0}
    # Brute force: every word against every entry.
    rng = random.Random(4)
    for _ in range(200):
        words = ["".join(rng.choices("mortash", k=rng.randint(1, 6))) for _ in range(12)]
        want = {w: max(v for t, v in lex.weights.items() if f" {w} ".startswith(t)) for w in words if any(f" {w} ".startswith(t) for t in lex.weights)}
        assert lex.hits(words, a) == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in entry.queries()["op1_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [(r["toxic"], rows[r["doc_id"]]["predicted"]) for r in labels if held(r["doc_id"])]
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert np.mean([a == b for a, b in out]) > 0.93
    assert sum(b for a, b in out if a == 0) <= 2


def test_scores_odd(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex = toxicity.fit(toxicity.training_rows(odd, labels, "toxic"))
    assert all(r["score"] < 1e-6 for r in toxicity.scored(odd, lex).collect())
    assert toxicity.judged(odd, lex, "s").columns == [*odd.columns, "s"]
    assert quality.trained(odd, labels) is None
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {1.0}
    labels = spark.createDataFrame([(i, 1, 0) for i in (0, 1, 3, 4, 6, 7)], "doc_id long, quality int, toxic int")
    net = quality.trained(odd, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.scored(odd, net).collect())
    assert quality.scored(odd.limit(0), net).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in entry.queries()["op6_quality_classifier"](spark, sf).collect()}
    out = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels.collect() if held(r["doc_id"])]
    assert len(rows) == docs.count() and np.mean([a == b for a, b in out]) > 0.97


def test_quality_measures_by_brute_force():
    """Every measure of every text against plain loops; hashed sums against a dictionary of terms."""
    import pyarrow as pa

    texts = ["Some words, some MORE words!", None, "", "a a b a b\nc <1> #$", "Ünï cödé || x", " \n ", "one"]
    x = quality.measured(pa.array(texts))
    for t, row in zip(texts, x, strict=True):
        raw = (t or "").encode()
        w = [m.encode().lower() for m in re.findall(SPACE, t or "")]
        n = max(len(w), 1)
        want = [sum(b in kind for b in raw) for kind in quality.CLASSES.values()]
        want = [(c / max(len(raw), 1)) ** 0.5 for c in want]
        if raw:
            same = [sum(a == b for a, b in zip(w[k:], w, strict=False)) / n for k in (1, 2)]
            want += [np.log1p(len(w)) / 10, np.log1p(len(raw) / n) / 5, *same, np.log(max(len(set(w)), 1) / n) / 5, np.log1p(len(w) / (raw.count(b"\n") + 1)) / 10]
        else:
            want += [0.0, np.log1p(1) / 5, 0, 0, 0, 0]
        assert row[: len(quality.SHAPES)] == pytest.approx(want), t
        assert (row[len(quality.SHAPES) :] ** 2).sum() > 0 or not w
    # Hashed sums: the same words give the same sums in any place, a repeated text the same row, order tells by pairs.
    a, b, c, d = quality.measured(pa.array(["p q r", "x\n\n", "p q r", "r q p"]))[:, len(quality.SHAPES) :]
    assert (a == c).all() and not (a == d).all() and a[a != 0].size <= 5
    single = {w: quality.measured(pa.array([w]))[0, len(quality.SHAPES) :] for w in ("p", "q", "r")}
    pairs = {w: quality.measured(pa.array([w]))[0, len(quality.SHAPES) :] * 3**0.5 - single[w[0]] - single[w[2]] for w in ("p q", "q r")}
    assert a * 5**0.5 == pytest.approx(sum(single.values()) + sum(pairs.values()))


def test_risk_and_its_slope():
    """The non-negative risk by its definition, and the direction against differences; where the bracket is negative the
    direction is that of the bracket, uphill."""
    rng = np.random.default_rng(4)
    layers = [rng.normal(0, 0.5, (5, 3)), rng.normal(0, 0.1, 3), rng.normal(0, 0.5, 3), np.zeros(1)]
    for shift, prior in ((0.0, 0.4), (3.0, 0.9)):
        p, u = rng.normal(0, 1, (20, 5)) - shift, rng.normal(0, 1, (30, 5)) + shift

        def parts(layers):
            g = [np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3][0] for x in (p, u)]
            loss = lambda z: np.mean([np.log1p(np.exp(-v)) for v in z])
            return prior * loss(g[0]), loss(-g[1]) - prior * loss(-g[0])

        for sign in (1, -1):
            layers[2] = abs(layers[2]) * sign if shift else layers[2]
            positive, negative, slope = quality.risk(layers, p, u, prior)
            assert (positive, negative) == pytest.approx(parts(layers))
            for k, layer in enumerate(layers):
                for at in np.ndindex(layer.shape):
                    ends = []
                    for step in (1e-6, -1e-6):
                        moved = [x.copy() for x in layers]
                        moved[k][at] += step
                        a, b = parts(moved)
                        ends.append(a + b if negative >= 0 else -b)
                    assert slope[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_bad_text_that_is_no_junk(spark):
    """Words alone tell: good and bad texts have the same lengths, lines and letters, and no bad label is read."""
    rng = random.Random(3)
    good_words, bad_words = (["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)] for _ in range(2))
    rows = [(i, " ".join(rng.choices(good_words if i % 10 < 7 else bad_words, k=60)), int(i % 10 < 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality.trained(docs, docs.where("quality = 1 and doc_id % 4 > 0").select("doc_id", "quality"))
    assert net.prior == pytest.approx(0.7, abs=0.08)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in quality.scored(docs, net).collect()}
    assert np.mean([got[i] == bool(q) for i, _, q in rows if held(i)]) > 0.95


def test_quality_ties_and_long_texts(spark):
    """Conflicting labels teach nothing; a text of a million words is measured whole; repeated rows are scored alike."""
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, 1), (2, 1), (3, None)], "doc_id long, quality int")
    docs = documents(spark, ["a b", "c d", "word " * 1_000_000 + "end", "e"], [0, 1, 2, 3])
    assert [r["doc_id"] for r in toxicity.training_rows(docs, labels, "quality", (1,)).collect()] == ([] if held(2) else [2])
    net = quality.Network(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), [np.ones((len(quality.NAMES), 2)), np.zeros(2), np.ones(2), np.zeros(1)], 0.5)
    got = [tuple(r) for r in quality.scored(docs.unionByName(docs), net).collect()]
    assert len(got) == 8 and len(set(got)) == 4


def test_prior_estimate():
    rng = np.random.default_rng(0)
    pos, rest = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert quality.estimated_prior(*(np.bincount(quality.bins(x), minlength=quality.BINS) for x in (pos, rest))) == pytest.approx(0.7, abs=0.05)


# ---- nearest neighbours


@pytest.mark.parametrize("scaled,cells", [(False, ann.CELLS), (True, ann.CELLS), (True, 4), (False, 3)])
def test_recall(spark, monkeypatch, scaled, cells):
    """Against brute force; with few cells, lists are found in two steps."""
    monkeypatch.setattr(ann, "CELLS", cells)
    monkeypatch.setattr(ann, "LIST_SIZE", 256 if cells > 4 else 64)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (1500, 16)), rng.normal(0, 0.05, (700, 16)) + rng.normal(0, 1, (7, 16)).repeat(100, 0)])
    x = x * rng.uniform(0.5, 2, (len(x), 1)) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, F.expr("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x, hit = x.astype(float), 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(v == pytest.approx(s[i]) for i, v in got[q].values())
        assert [v for _, (_, v) in sorted(got[q].items())] == sorted((v for _, v in got[q].values()), reverse=True)
        hit += len(set(best) & {i for i, _ in got[q].values()})
    assert hit >= 0.9 * 10 * len(range(0, len(x), 20))


def test_neighbours_query(spark, small):
    """The registered query against brute force, ties at the last place included."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    got = {}
    for r in entry.queries()["op3_nearest_neighbours"](spark, small).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hit = 0
    for q, found in got.items():
        s = (x * x[ids == q][0]).sum(1)
        best = [(int(ids[k]), s[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(v == s[ids == i][0] for i, v in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda f: (-f[1], f[0]))
        hit += len({i for i, _ in best} & {i for i, _ in found.values()})
    assert hit >= 0.95 * 20 * len(got)


def test_ties_across_lists(spark, monkeypatch):
    """Equal vectors under ids that lie in different blocks and lists: the smaller ids win."""
    monkeypatch.setattr(ann, "LIST_SIZE", 8)
    monkeypatch.setattr(ann, "BLOCK", 5)
    rows = [(i, [1.0, float(i % 3), 0.0]) for i in range(90)]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr("vec_id % 20 = 0"), 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 90, 20):
        score = {i: 1.0 + (i % 3) * (q % 3) for i in range(90) if i != q}
        assert [i for _, i in sorted(got[q])] == sorted(score, key=lambda i: (-score[i], i))[:7]


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (1, [1.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, list string")
    got = sorted(tuple(r) for r in ann.neighbours(df, F.expr("vec_id % 20 = 0"), 20).collect())
    # Of the query's rows only its own is left out, and both rows of id 1 count.
    want = [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert got == want
    # Vectors of other sizes are compared with their kind; a vec_id with another vector is a row of its own.
    more = spark.createDataFrame([(40, [2.0], "x"), (60, [3.0, 1.0, 1.0], "x"), (2, [0.5, 0.5], "x")], df.schema)
    got = sorted(tuple(r) for r in ann.neighbours(df.unionByName(more), F.expr("vec_id % 20 = 0"), 20).collect())
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 2, 0.5), (0, 5, 20, 0.0), (20, 1, 2, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 1, 0.0), (20, 5, 2, 0.0), (40, 1, 8, 2.0)])
    assert ann.neighbours(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


@pytest.mark.parametrize("list_size", [ann.LIST_SIZE, 4])
def test_repeated_rows_by_brute_force(spark, monkeypatch, list_size):
    """Repeated ids and rows: every row but the query's own is a candidate."""
    monkeypatch.setattr(ann, "LIST_SIZE", list_size)
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.25]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.125])]
    rows += [(int(rng.integers(0, 60)), [float(x) for x in rng.integers(-3, 4, 2)]) for _ in range(60)]
    rows = [r for r in rows if any(r[1])]
    found = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr("vec_id % 20 = 0"), 70).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for k, (q, v) in enumerate(rows):
        if q % 20 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(rows) if j != k)
            want.setdefault(q, []).extend((n + 1, i, -s) for n, (s, i) in enumerate(others))
    assert {q: sorted(f) for q, f in found.items()} == {q: sorted(f) for q, f in want.items()}


# ---- HTML


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_articles_of_the_tables(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in entry.queries()["op4_html_extraction"](spark, small).collect():
        inside = re.search("<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", "\1", inside)).split("\1")
        want = " ".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_consensus(spark):
    """A page whose advert looks best on its own follows its host's vote."""
    good = [page(f'<div class="post-{i}"><p>{"Some words, of text. " * 8}</p></div><div class="x"><p>note</p></div>') for i in range(5)]
    lone = page(f'<div class="post-9"><p>Short one.</p></div><div class="x"><p>{"Buy this, now. Really, do. " * 9}</p></div>')
    df = spark.createDataFrame([(i, "http://h.net/a", h, "c") for i, h in enumerate([*good, lone])], "page_id long, url string, html string, host string")
    assert {r["page_id"]: r["text"] for r in html_extract.extracted(df).collect()}[5] == "Short one."


def test_extraction_rules():
    get = lambda body: html_extract.extract(page(body), None)[0]
    text = "A long enough paragraph, with commas, and points. " * 3
    assert get(f'<nav>n</nav><header>h</header><article><h1>T&amp;t</h1><p>{text}<b>x</b>y<p>z<script>1</script><form>f</form><aside>s</aside><div class="comments"><p>c</p></div></article><footer>f</footer>') == f"T&t {text.strip()} xy z".replace("points. xy", "points. xy")
    assert get("<article><ul><li>a<li>b</ul>c<br>d &lt; e<!-- no --></article>") == "a b c d < e"
    assert get(f'<div class="has-sidebar"><p>{text}</p></div><div class="sidebar"><p>{text}</p></div>') == text.strip()
    assert html_extract.extract("", None) == ("", None)
    assert html_extract.extract("<p>a <b>b", None)[0] == "a b"
    assert html_extract.extract("<" * 3000 + "\"'" * 1000, None)[0] is not None


PROSE = "A long enough paragraph, with commas, and points."


def paragraphs(n, what=PROSE):
    return " ".join(f"<p>{what} {k}</p>" for k in range(n)), " ".join(f"{what} {k}" for k in range(n))


def test_nested_containers(spark):
    """Heading, lead and every section of an article belong to its text, in votes and without."""
    ten, ten_text = paragraphs(10)
    two, two_text = paragraphs(2, "Another paragraph that is long enough, in a smaller section.")
    bodies = {
        "lead": (f'<article><h1>Head</h1><p>Lead {PROSE}</p><div class="body">{ten}</div></article>', f"Head Lead {PROSE} {ten_text}"),
        "deep": (f'<article><h1>Head</h1><div class="w"><div class="v"><div class="body">{ten}</div></div></div></article>', f"Head {ten_text}"),
        "sections": (f'<article><section class="a">{ten}</section><section class="b">{two}</section></article>', f"{ten_text} {two_text}"),
        "divs": (f'<div class="post"><h1>Head</h1><div class="a">{ten}</div><div class="b">{two}</div></div><div class="x"><p>note</p></div>', f"Head {ten_text} {two_text}"),
        "main": (f'<main><p>Lead {PROSE}</p><div class="body">{ten}</div></main><div class="links">{two}</div>', f"Lead {PROSE} {ten_text}"),
    }
    for body, want in bodies.values():
        assert html_extract.extract(page(body), None)[0] == want
    rows = [(k, f"http://{host}/{k}", page(bodies[host][0])) for k, host in enumerate([*bodies] * 3)]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: bodies[host][1] for k, host in enumerate([*bodies] * 3)}


def test_all_containers_vote(spark):
    """A fourth and fifth container's path gets votes too."""
    body = "".join(f'<table><tr><td class="c{k}">{PROSE}</td></tr></table>' for k in "abcde")
    got = html_extract.votes(spark.createDataFrame([("h", page(body))], "host string, html string")).collect()
    assert {r["path"].rsplit(".", 1)[-1] for r in got} >= {"ca", "cb", "cc", "cd", "ce"} and sum(r["vote"] for r in got) == pytest.approx(1)


def test_wrappers_with_odd_names():
    """A layout's wrapper isn't a sidebar; sidebars, adverts and comments stay out, within it too."""
    get = lambda body: html_extract.extract(page(body), None)[0]
    ten, ten_text = paragraphs(10)
    many, _ = paragraphs(30, "First! I quite agree with everything that is said.")
    side = f'<div class="sidebar"><p>{PROSE}</p></div>'
    for name in ("layout-with-sidebar", "post comments-open", "page has-widgets social"):
        assert get(f'<div class="{name}"><h1>Head</h1><div class="text">{ten}</div>{side}</div>') == f"Head {ten_text}"
        assert get(f'<div class="{name}">{ten}</div>') == ten_text
    assert get(f'<div class="layout-with-sidebar"><article><h1>H</h1>{ten}</article><div class="comments">{many}</div></div>') == f"H {ten_text}"
    assert get(f'<article><h1>H</h1>{ten}</article><div class="comments">{many}</div>') == f"H {ten_text}"
    assert get(f'<div class="text">{ten}</div><div class="comments">{many}</div>') == ten_text


def test_html_odd(spark):
    df = spark.createDataFrame([(0, None, None, 1), (1, "x", "", 1), (None, "http://a/", "<p>t</p>", 1), (1, "x", "", 1)], "page_id long, url string, html string, path int")
    assert sorted((tuple(r)[:3] for r in html_extract.extracted(df).collect()), key=repr) == sorted([(0, None, ""), (1, "x", ""), (1, "x", ""), (None, "http://a/", "t")], key=repr)
    assert html_extract.extracted(df.limit(0)).count() == 0


# ---- URL filter


def verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(8)
    names = ["net", "org", "a.net", "b.a.net", "c.b.a.net", "xa.net", "a-b.net", "a.nets", "b.org", "com"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in names[:6] for p in ("/", "/x/", "/x/y") if rng.random() < 0.6]
    urls = [f"http://{rng.choice(['', 'w.', 'W.'])}{rng.choice(names)}{rng.choice(['', '/', '/x/', '/x/yz', '?q', '#f', '/x/?a://b'])}" for _ in range(200)] + [None, "", "no scheme", "://", "http://", "http://NET/"]
    pages = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judged(pages, none).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_urls_repeated_and_long(spark):
    """Repeated rows give repeated rows; a url of a megabyte is read whole; rules tie by block."""
    long = "http://" + ".".join(["a" * 60] * 200) + ".net/" + "x/" * 400_000 + "?q"
    rows = [(1, "http://w.net/x/"), (1, "http://w.net/x/"), (2, long), (None, "http://NET/x/y#f"), (3, "http://" + "b." * 5_000 + "net/x/")]
    rules = [("net", "/x/", "allow"), ("net", "/x/", "block"), ("NET", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("net", None, "allow")]
    got = sorted((tuple(r) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()), key=repr)
    want = [(i, *verdict(u, [("net", "/x/", "block"), ("net", "/", "allow")])) for i, u in rows]
    assert got == sorted(want, key=repr)


def test_url_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    want = Counter(con.sql(f"select page_id, host, path, rule, verdict from ({entry.oracle_sql()['op5_url_filter']})").fetchall())
    assert Counter(map(tuple, entry.queries()["op5_url_filter"](spark, small).collect())) == want


# ---- chat formatting


@pytest.mark.parametrize("together", [50_000, 1])
def test_links_order_and_errors(spark, monkeypatch, together):
    monkeypatch.setattr(chat_format, "TOGETHER", together)
    calls = [(1, "a", 0, "lookup", '{"query":"q","limit":2.0}', ["b"]), (1, "b", 1, "notify", '{"text":"é","more":1}', []), (1, "c", 2, "none", "{}", ["a"]), (1, "d", 3, "convert", "no json", ["e"]), (1, "e", 4, "convert", '{"amount":1.5,"text":"t"}', ["d"]), (2, "a", 0, "lookup", None, None), (3, None, 0, "lookup", '{"query":"q"}', ["x"]), (1, "f", 5, "notify", '{"text":"t"}', ["e"])]
    df = spark.createDataFrame([(*c, "clash") for c in calls], "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, level string")
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 1, "first"), (9, "z", 1, "stray"), (1, None, 1, "x")], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame(chat_format.SCHEMAS, "name string, schema string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat_format.linked_calls(df, results, schemas).collect()}
    assert {k: (r["level"], r["circular"]) for k, r in got.items()} == {(1, "a"): (1, False), (1, "b"): (0, False), (1, "c"): (1, False), (1, "d"): (None, True), (1, "e"): (None, True), (1, "f"): (None, True), (2, "a"): (0, False), (3, None): (0, False)}
    assert got[1, "a"]["line"] == '{"arguments":{"limit":2,"query":"q"},"id":"a","name":"lookup","result":"first"}' and got[1, "a"]["valid"]
    assert got[1, "b"]["errors"] == ["$.more: unknown"] and got[1, "b"]["line"].startswith('{"arguments":{"more":1,"text":"é"}')
    assert got[1, "c"]["errors"] == ["unknown tool none"] and got[1, "d"]["errors"] == ["$: not JSON"] and got[1, "e"]["errors"] == ["$.amount: not integer"]
    assert not got[2, "a"]["linked"] and got[2, "a"]["errors"] == ["$: not JSON"]
    assert chat_format.linked_calls(df.limit(0), results, schemas).count() == 0


@pytest.mark.parametrize("together", [50_000, 1])
def test_order_is_topological(spark, monkeypatch, together):
    monkeypatch.setattr(chat_format, "TOGETHER", together)
    rng = random.Random(6)
    place = list(range(40))
    rng.shuffle(place)
    needs = {i: [j for j in rng.sample(range(i), min(i, 2))] for i in range(40)}
    rows = [(1, f"k{i}", place[i], "notify", '{"text":"t"}', [f"k{j}" for j in needs[i]]) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    order = [r["call_id"] for r in chat_format.linked_calls(df, none, spark.createDataFrame(chat_format.SCHEMAS, "name string, schema string")).orderBy("level", "turn").collect()]
    assert all(order.index(f"k{j}") < order.index(f"k{i}") for i in needs for j in needs[i])


def test_chat_query(spark, small):
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    rows = entry.queries()["op8_chat_formatting"](spark, small).collect()
    assert len(rows) == sum(r["role"] == "assistant" for r in turns.values())
    for r in rows:
        line, said = json.loads(r["line"]), turns[r["conv_id"], r["turn"]]["text"]
        answer = turns.get((r["conv_id"], r["turn"] + 1))
        assert line["result"] == (answer["text"] if answer and answer["role"] != "assistant" else None)
        assert r["line"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert said in (line["arguments"].get("query"), line["arguments"].get("text"), said if len(said) % 3 == 1 else None)


# ---- quality rules


def measures(t):
    t = t or ""
    w = re.findall(SPACE, t)
    tri = list(zip(w, w[1:], w[2:], strict=False))
    n, covered = Counter(tri), set()
    for i, x in enumerate(tri):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = entry.queries()["op9_quality_rules"](spark, small).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {i: measures(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_measures_odd(spark, odd):
    texts = [r["text"] for r in odd.select("text").collect()] + ["a b a b a b a", "x x x", "a b\n\n a b\na b", "é #é | <é>"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [tuple(r)[1:7] for r in quality_rules.judged(documents(spark, texts), labels).orderBy("doc_id").collect()]
    assert got == [measures(t) for t in texts]
    assert quality_rules.judged(odd, labels).count() == 9 and quality_rules.judged(odd.limit(0), labels).count() == 0


def test_binomial_bounds(spark):
    from math import comb

    rows = [(k, n) for n in (10, 200, 1000) for k in (0, 1, 3, 8)]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))
    for k, n, p in map(tuple, df.collect()):
        want = sum(comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1)) if k < n * 0.01 else 1.0
        assert p == pytest.approx(want, rel=1e-9)


def test_thresholds_limit_false_rejection(spark):
    n = 4000
    rate = np.random.default_rng(3).beta(1, 30, n)
    rows = [("en", float(r), 0.0, 0.0, float(r > 0.1) * 0.9) for r in rate] + [("xx", 0.0, 0.0, 0.0, 0.0)] * 20
    cuts = {r["stratum"]: r for r in quality_rules.thresholds(spark.createDataFrame(rows, "stratum string, symbols double, dup_lines double, repeats double, shouting double")).collect()}
    cut = cuts["en"]["cut_symbols"]
    assert cut in quality_rules.CUTOFFS and (rate > cut).mean() < quality_rules.RISK / 4
    assert cuts["en"]["cut_dup_lines"] == min(quality_rules.CUTOFFS) and cuts["en"]["cut_shouting"] is None
    assert all(cuts["xx"][f"cut_{r}"] is None for r in quality_rules.RATES)


# ---- pipeline


def test_pipeline(spark, tmp_path):
    """Stages against their operators' brute force on a small corpus with planted copies and toxic texts."""
    import corpus_pipeline as pipe

    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = [r["text"] for r in src.where("n_chars between 800 and 2000").orderBy("doc_id").limit(3).collect()]
    more = documents(spark, [clean[0], clean[0] + " tail", clean[1] + " you idiot, moron and stupid scum, worthless loser"], [90_000, 90_001, 90_002])
    src.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipe.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        if name == "n-gram Jaccard join":
            want = components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 4, 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    kept = {r["doc_id"] for r in docs.collect()}
    assert not kept & {90_000, 90_001, 90_002}
    packed = pipe.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == kept
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_odd(spark, odd, tmp_path):
    import corpus_pipeline as pipe

    spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows, most in ((odd, 8), (odd.limit(0), 0)):
        docs = rows
        for name, stage in pipe.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == rows.columns, name
        kept = [r["doc_id"] for r in docs.collect()]
        packed = pipe.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
        assert len(kept) <= most and sorted(map(str, packed.loc[packed["piece"] == 0, "doc_id"].astype("Int64").astype(object))) == sorted("<NA>" if k is None else str(k) for k in kept)
    assert pipe.drop_near_copies(spark, odd, str(tmp_path)).count() == 8


def test_pipeline_keeps_differing_texts(spark, tmp_path):
    """Rows that share a doc_id are judged by their texts; of copies one stays, also of those without an id."""
    import corpus_pipeline as pipe

    text = ["one two three four five six seven", "quite other words that stand in this text", "and a third text with no copy at all"]
    rows = documents(spark, [text[0], text[1], text[0], text[2], text[2], text[2], text[0]], [5, 5, 3, None, 9, 9, 5])
    got = sorted(((r["doc_id"], r["text"]) for r in pipe.drop_near_copies(spark, rows, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(3, text[0]), (5, text[1]), (9, text[2])], key=repr)


def test_pipeline_any_columns(spark, tmp_path):
    """Maps, plain and nested, and columns named like the stages' own; rows without text stay in the join."""
    import corpus_pipeline as pipe

    text = "one two three four five six seven eight"
    rows = documents(spark, [text, text, None, None, ""], [1, 2, 3, 3, 3])
    for c in ("quality_score", "toxicity_score", "row_number", "doc_id_of_row", "component_id", "text_", "row"):
        rows = rows.withColumn(c, F.lit("clash"))
    rows = rows.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("nested", F.array(F.struct(F.create_map(F.lit("b"), F.lit(1)).alias("x"))))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipe.drop_near_copies(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, text), (3, ""), (3, ""), (3, "")]
    for _, stage in pipe.STAGES[:2]:
        assert stage(spark, rows, str(tmp_path)).columns == rows.columns

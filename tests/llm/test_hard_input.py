"""Hard input: page layouts as they are met, very long and deeply nested input, odd JSON, plain prose, contradictory
labels, and dependency graphs with chains, junctions and circles."""

import hashlib
import json
import math
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelix.llm import bpe, chat_format, html_extract, toxicity

PROSE = "A long enough paragraph, with commas, and points."
TEN = " ".join(f"<p>{PROSE} {k}</p>" for k in range(10))
TEN_TEXT = " ".join(f"{PROSE} {k}" for k in range(10))
REMARKS = "".join(f"<p>First! I quite agree with everything that is said. {k}</p>" for k in range(30))


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


LAYOUTS = {
    "form around an article": (f'<form id="aspnetForm"><input name="v"><article><h1>H</h1>{TEN}</article><select><option>x</select></form><div class="comments">{REMARKS}</div>', f"H {TEN_TEXT}"),
    "form around a div": (f'<form id="aspnetForm"><div id="content">{TEN}</div></form>', TEN_TEXT),
    "class menu-collapsed": (f'<div class="site menu-collapsed"><article>{TEN}</article></div>', TEN_TEXT),
    "class tags-page": (f'<div class="tags-page"><article>{TEN}</article></div>', TEN_TEXT),
    "related work": (f'<article>{TEN}<section id="related-work"><h2>Related work</h2><p>{PROSE}</p></section></article>', f"{TEN_TEXT} Related work {PROSE}"),
    "search method": (f'<article>{TEN}<p class="search-method">{PROSE}</p></article>', f"{TEN_TEXT} {PROSE}"),
    "a menu's text": (f'<article>{TEN}<pre class="menu">soup\n  bread</pre></article>', f"{TEN_TEXT} soup bread"),
    "mathematics": (f"<article>{TEN}<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", f"{TEN_TEXT} where x=2 holds"),
    "log-in form": (f'<article>{TEN}</article><form><p>Sign in to read on</p><input name="q"></form>', TEN_TEXT),
    "unclosed nav": (f'<nav><ul><li><a href="/">Home</a></ul><article><h1>H</h1>{TEN}</article>', f"H {TEN_TEXT}"),
    "classic columns": (f'<div id="header"><h2>Site</h2></div><div id="wrap"><div id="sidebar-left"><p>{PROSE}</p></div><div id="content"><h1>H</h1>{TEN}</div></div><div class="site-footer"><p>{PROSE}</p></div>', f"H {TEN_TEXT}"),
    "blog theme": (f'<main class="site-main"><article class="post"><header class="entry-header"><h1>H</h1></header><div class="entry-content">{TEN}<div class="share-buttons"><a href="#">Share</a></div></div></article><div id="comments" class="comments-area">{REMARKS}</div></main><aside class="widget-area"><p>{PROSE}</p></aside>', f"H {TEN_TEXT}"),
    "table layout": (f'<table><tr><td class="nav"><a href="/">a</a></td><td class="text"><h1>H</h1>{TEN}</td></tr></table>', f"H {TEN_TEXT}"),
    "sections in main": (f'<main><section class="intro"><h1>H</h1><p>{PROSE}</p></section><section class="body">{TEN}</section></main><section class="newsletter-signup"><p>{PROSE}</p></section>', f"H {PROSE} {TEN_TEXT}"),
    "cookie banner first": (f'<div class="cookie-banner"><p>{PROSE} {PROSE} {PROSE}</p><button>OK</button></div><div class="story"><h1>H</h1>{TEN}</div>', f"H {TEN_TEXT}"),
    "comparison signs": (f"<article><p>1 < 2 and 3 > 2 {PROSE}</p><p title=\"a>b\" data-x='>'>x</p></article>", f"1 < 2 and 3 > 2 {PROSE} x"),
    "unclosed quote": (f'<article><p class="x>first {PROSE}</p><p>{PROSE}</p></article>', f"first {PROSE} {PROSE}"),
    "nothing but menus": ('<nav><ul><li><a href="x">A</a></li></ul></nav><footer>c 2020</footer>', ""),
    "nothing but comments": (f'<div class="comments">{REMARKS}</div>', ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    body, want = LAYOUTS[name]
    assert html_extract.extract(page(body), None)[0] == want


def test_layouts_by_vote(spark):
    """The same through the operator, each layout a host of its own; and all of them on one host keep their texts."""
    rows = [(k, f"http://h{k % len(LAYOUTS)}.net/{k}", page(list(LAYOUTS.values())[k % len(LAYOUTS)][0])) for k in range(2 * len(LAYOUTS))]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: list(LAYOUTS.values())[k % len(LAYOUTS)][1] for k in got} and len(got) == len(rows)


@pytest.mark.parametrize(
    "html,length",
    [("<a " * 700_000, 0), ("<div>" * 8_000 + "x", 1), ("<div>x" * 200_000, None), ("<b>" * 50_000 + "<p></p>" * 50_000, 0), ("<div>" * 50_000 + "</section>" * 50_000, 0), ("<!" * 500_000, 0), ('<a href="' * 200_000, 0), ("<!--" * 300_000, 0), ("<" * 500_000, 500_000), ("<ul><li>" * 60_000, 0), ("<p " + "class " * 100_000 + ">x", 1), ("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, 0)],
    ids=lambda x: str(x)[:8],
)
def test_linear_time(html, length):
    began = time.perf_counter()
    text = html_extract.extract(html, None)[0]
    assert time.perf_counter() - began < 20 and (length is None or len(text) == length)


# ---- toxicity

PLAIN = [
    "The discussion of the distance travelled by train along the path took more than an hour, and the workers closed the gate before the clouds came. We trade and travel; workers discuss morale.",
    "In the morning the children walked to school past the old stone bridge. Their teacher had promised to tell them about the town, its markets and the great flood.",
    "Die Arbeiter gingen am Morgen über die Brücke in die Stadt, um auf dem Markt Gemüse zu verkaufen. Der Bürgermeister hatte versprochen, die Straße bald zu reparieren, doch niemand glaubte ihm.",
    "Le matin, les enfants traversaient le pont pour aller à l'école du village. Leur maître leur racontait souvent l'histoire de la rivière et des grandes inondations du siècle dernier.",
    "Los trabajadores cruzaron el puente por la mañana para vender verduras en el mercado. El alcalde había prometido reparar la calle pronto, pero nadie le creía.",
]


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    return tuple(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_learnt_without_insults(spark, labelled):
    """Plain prose scores low, and what labels alone teach holds on the held-out third. Some 6 % of the toxic labels
    there are on documents that hold no harmful word at all, in which case no lexicon can find them."""
    docs, labels = labelled
    lexicon = toxicity.fit(toxicity.training_rows(docs, labels, "toxic"), insults=())
    assert max(lexicon.score(lexicon.measure(pa.array(PLAIN)))) < 0.1
    assert lexicon.score(lexicon.measure(pa.array(["you idiot, moron and stupid scum, worthless loser"])))[0] > 0.9
    rows = toxicity.scored(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out() & F.col("toxic").isNotNull()).select("toxic", "score", F.size("matched").alias("n")).collect()
    hit = Counter((r["toxic"], r["score"] >= 0.7) for r in rows)
    assert hit[1, True] / (hit[1, True] + hit[0, True]) > 0.97
    assert hit[1, True] / sum(r["toxic"] == 1 and r["n"] > 0 for r in rows) > 0.95 and hit[1, True] / (hit[1, True] + hit[1, False]) > 0.9


def bound(pos, neg, n_pos, n_neg, z):
    return math.log(((pos + 0.5) / (n_pos + 1)) / ((neg + 0.5) / (n_neg + 1))) - z * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def test_entries_by_brute_force(spark):
    """Words, beginnings and their weights against plain loops; an insult doesn't make its first letters an entry."""
    rng = random.Random(9)
    family = [f"zorkel{x}" for x in ("", "ab", "cd", "ef", "gh", "ij", "kl")]
    texts = [(" ".join(["trash"] * (rng.random() < 0.6) + rng.sample(family, 2) + rng.choices("trade travel train sun moon".split(), k=4)), 1) for _ in range(60)]
    texts += [(" ".join(rng.choices("trade travel train sun moon zorkell stone".split(), k=6)), 0) for _ in range(300)]
    held = [(set(toxicity.fold(t)), y) for t, y in dict(texts).items()]
    n = Counter(y for _, y in held)
    counts = {w: (sum(y == 1 and w in s for s, y in held), sum(y == 0 and w in s for s, y in held)) for s, _ in held for w in s}
    want = {f" {w} ": bound(p, q, n[1], n[0], toxicity.WORD_Z) for w, (p, q) in counts.items() if p >= 3}
    groups = {}
    for w, (p, q) in counts.items():
        for k in toxicity.PREFIXES:
            if len(w) > k:
                groups.setdefault(w[:k], []).append((p, q))
    left = {}
    for b, rows in groups.items():
        p, q, top = sum(x for x, _ in rows), sum(x for _, x in rows), max(x for x, _ in rows)
        if sum(x > 0 for x, _ in rows) >= toxicity.FAMILY and p - top >= 3 and bound(p - top, q, n[1], n[0], toxicity.PREFIX_Z) > toxicity.LEAST_WEIGHT:
            left[b] = (p, bound(p - top, q, n[1], n[0], toxicity.PREFIX_Z))
    want |= {f" {b}": w for b, (p, w) in left.items() if not any(e[:-1] == b and 10 * x >= 9 * p for e, (x, _) in left.items())}
    want = {k: w for k, w in want.items() if w > toxicity.LEAST_WEIGHT}
    lexicon = toxicity.fit(spark.createDataFrame(texts, "text string, label int"), insults=())
    assert lexicon.weights == pytest.approx(want)
    assert " trash " in want and " zorkel" in want and not any(" trash ".startswith(k) and k != " trash " for k in want)
    # Scores: features by hand, and coefficients at which the weighted risk is flat.
    assert all(sum(y == 1 and p in f" {' '.join(toxicity.fold(t))} " for t, y in texts) == 0 for p in (f" {e} " for e in lexicon.exceptions))
    lexicon = toxicity.Lexicon(lexicon.weights)
    x = np.array([lexicon.features(lexicon.hits(toxicity.fold(t), lexicon.automaton()), len(toxicity.fold(t))) for t, _ in texts])
    total = [sum({w: max(v for k, v in want.items() if f" {w} ".startswith(k)) for w in set(toxicity.fold(t)) if any(f" {w} ".startswith(k) for k in want)}.values()) for t, _ in texts]
    assert x[:, 1] == pytest.approx(np.log1p(total)) and lexicon.measure(pa.array([t for t, _ in texts])) == pytest.approx(x)


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((200, 1)), rng.normal(size=(200, 2))], 1)
    y = (x[:, 1] + rng.normal(size=200) > 0.8).astype(float)
    w = toxicity.logistic(x, y, 0.3, 3.0)

    def risk(w):
        z = x @ w
        return (np.where(y == 1, 3.0, 1.0) * (np.logaddexp(0, z) - y * z)).sum() + 0.15 * (w[1:] ** 2).sum() + 0.5e-6 * w[0] ** 2

    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs(risk(w + step) - risk(w - step)) / 2e-5 < 1e-4


def test_exception_phrases_of_any_length():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " mor": 1.0}, frozenset({"the trash can", "moron"}))
    a = lexicon.automaton()
    assert lexicon.hits("take the trash can out".split(), a) == {}
    assert lexicon.hits("a trash can".split(), a) == {"trash": 2.0}
    assert lexicon.hits("the trash can is trash".split(), a) == {"trash": 2.0}
    assert lexicon.hits("moron morons".split(), a) == {"morons": 1.0}
    rng = random.Random(2)
    for _ in range(300):
        words = rng.choices(["the", "trash", "can", "morons", "moron"], k=8)
        free = set()
        for k, w in enumerate(words):
            spared = any(words[i : i + len(p)] == p and i <= k < i + len(p) for p in (["the", "trash", "can"], ["moron"]) for i in range(len(words)))
            if not spared and w in ("trash", "morons", "moron"):
                free.add(w)
        assert set(lexicon.hits(words, a)) == free


def test_contradictory_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k % 4}") for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k in range(12) for y in ((0, 1) if k % 4 == 0 else (k % 2,))] + [(1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["label"] for r in toxicity.training_rows(docs, labels, "toxic").collect()}
    assert got == {k: k % 2 for k in range(12) if k % 4 and not toxicity_held(k)}
    # Of one text's labels the majority counts; a tie teaches nothing.
    rows = [("a b c", 1), ("a b c", 1), ("a b c", 0), ("d e f", 1), ("d e f", 0)]
    assert toxicity.fit(spark.createDataFrame(rows, "text string, label int"), insults=()).coefficients[0] > 15
    assert toxicity.fit(spark.createDataFrame(rows[3:], "text string, label int"), insults=()).weights == {}


def toxicity_held(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 3 == 1


# ---- BPE


def test_long_words_as_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters[:k], k=n)) for k in (1, 2, 3, 5, 26) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 1000, 5000)]
    words += ["".join(rng.choices("漢字仮名交じり文のこともある", k=400)), "the" * 500, "".join(rng.choices(["the", "ing", "tion", "er", "ou"], k=300))]
    for w in words:
        want = lib.encode(w, add_special_tokens=False).ids
        assert own.encode(w) == want and own._pair_by_pair(w.encode()).tolist() == want
    whole = " ".join(words)
    assert own.encode(whole) == lib.encode(whole, add_special_tokens=False).ids
    million = "".join(rng.choices(letters, k=1_000_000))
    began = time.perf_counter()
    assert own.encode(million) == lib.encode(million, add_special_tokens=False).ids
    assert time.perf_counter() - began < 30


def test_falling_ranks_are_merged_pair_by_pair():
    """A vocabulary in which a merge brings up a lower rank: abc also comes of a and bc."""
    own = object.__new__(bpe.WordBPE)
    own.names, own.base, own._dict = [""] * 300, 301, None
    own.inner = np.arange(256)
    own.last = np.arange(256)
    a, b, c, x, ab, bc, abc, xabc = *map(ord, "abcx"), 256, 257, 258, 259
    merges = [(x, abc, xabc), (b, c, bc), (a, bc, abc), (ab, c, abc), (a, b, ab)]
    keys = np.array([left * 301 + right for left, right, _ in merges])
    order = np.argsort(keys)
    own.keys, own.ranks, own.merged = keys[order], order, np.array([m for *_, m in merges])
    for word in (b"xabcxabc", b"abcabc", b"xabc" * 100):
        flat, count = own.merge([word, b"abab"])
        assert flat.tolist() == [*own._pair_by_pair(word), *own._pair_by_pair(b"abab")] and count.tolist() == [len(own._pair_by_pair(word)), 2]
    assert own._in_rounds([b"xabc"])[2].tolist() == [0] and own._by_rank([b"xabc", b"ab"])[2].tolist() == [0]


def test_bpe_query_in_full(spark, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in entry.queries()["op10_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    for r in docs:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(rows) == len(docs)


# ---- chat formatting

TOOLS = {
    "t": {"properties": {"a": {"type": ["string", "null"]}, "n": {"enum": [1]}, "m": {"type": "integer", "minimum": 2}}, "additionalProperties": False},
    "broken": "no schema",
    "odd": {"properties": 7},
    "kind": {"properties": {"a": {"type": "text"}}},
}


@pytest.mark.parametrize(
    "text,name,errors",
    [
        ('{"a":null}', "t", []),
        ('{"a":"x","n":1.0,"m":2.0}', "t", []),
        ('{"a":3}', "t", ["$.a: not string or null"]),
        ('{"n":true}', "t", ["$.n: not in enum"]),
        ('{"m":1}', "t", ["$.m: too small"]),
        ('{"z":1}', "t", ["$.z: unknown"]),
        ("[1]", "t", ["$: not object"]),
        ("[" * 100_000, "t", ["$: nested too deeply"]),
        ('{"a":' + "[" * 300 + "]" * 300 + "}", "t", ["$: nested too deeply"]),
        ('{"a":"\\ud800"}', "t", ["$: lone surrogate"]),
        ('{"a":NaN}', "t", ["$: not JSON"]),
        ('{"a":-Infinity}', "t", ["$: not JSON"]),
        ('{"m":1e400}', "t", ["$: number out of range"]),
        ('{"m":' + "9" * 5000 + "}", "t", ["$: number out of range"]),
        (None, "t", ["$: not JSON"]),
        ("{", "t", ["$: not JSON"]),
        ("{}", "none", ["unknown tool none"]),
        ("{}", None, ["unknown tool None"]),
        ("{}", "broken", ["broken schema of broken"]),
        ("{}", "odd", ["broken schema of odd"]),
        ('{"a":1}', "kind", ["broken schema of kind"]),
    ],
    ids=lambda x: str(x)[:20],
)
def test_arguments(text, name, errors):
    value, found = chat_format.judged(text, name, TOOLS)
    assert found == errors
    line = chat_format.canonical({"arguments": value, "id": "i"})
    assert json.loads(line.encode().decode(), parse_constant=pytest.fail)["id"] == "i"


def test_odd_calls(spark):
    """No row of these stops the job; repeated calls, ties of results and null conversations have their results."""
    calls = [(1, "a", 0, "notify", "[" * 50_000, []), (1, "b", 1, "notify", '{"text":"\\udfff"}', ["a"]), (1, "c", 2, "notify", json.dumps({"text": "long " * 200_000}), None), (1, "c", 2, "notify", '{"text":"again"}', ["b"]), (None, "a", 0, "notify", '{"text":"t"}', ["a"]), (None, None, None, None, None, None)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "c", 5, "y"), (1, "c", 5, "x"), (None, "a", 1, "never"), (1, "a", 3, None)], "conv_id long, call_id string, turn long, content string")
    rows = chat_format.placed(chat_format.linked_calls(df, results, spark.createDataFrame(chat_format.SCHEMAS, "name string, schema string"))).collect()
    assert len(rows) == len(calls)
    assert {(r["conv_id"], r["call_id"], r["valid"], r["linked"]) for r in rows} == {(1, "a", False, True), (1, "b", False, False), (1, "c", True, True), (None, "a", True, False), (None, None, False, False)}
    assert {json.loads(r["line"])["result"] for r in rows if r["call_id"] == "c"} == {"x"}
    assert sorted(r["place"] for r in rows if r["conv_id"] == 1) == [0, 1, 2, 3] and sorted(r["place"] for r in rows if r["conv_id"] is None) == [0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_levels_by_joins(spark, seed):
    """Chains, junctions, circles and what stands behind them: joins give what whole conversations give."""
    rng = random.Random(seed)
    edges = []
    for conv in range(4):
        place = list(range(60))
        rng.shuffle(place)
        for i in range(1, 60):
            for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 1, 2, 3]))):
                edges.append((conv, f"k{j}", f"k{i}", int(place[j] > place[i])))
        if conv % 2:
            edges += [(conv, "k50", "k20", 1), (conv, "r1", "r0", 1), (conv, "r0", "r1", 0), (conv, "r1", "r2", 0), (conv, "s", "s", 1)]
    edges = sorted({(c, n, k): b for c, n, k, b in edges}.items())
    table = pa.table({"conv_id": [e[0] for e, _ in edges], "need": [e[1] for e, _ in edges], "call_id": [e[2] for e, _ in edges], "back": pa.array([b for _, b in edges], pa.int32())})
    want = {(r["conv_id"], r["call_id"]): (r["level"] or (0 if not r["circular"] else None), r["circular"]) for r in chat_format._settled(table).to_pylist()}
    df = spark.createDataFrame(table.to_pandas(), "conv_id long, need string, call_id string, back int")
    got = {(r["conv_id"], r["call_id"]): (r["level"], r["circular"]) for r in chat_format._by_joins(df).collect()}
    assert {k: got.get(k, (0, False)) for k in want} == want and got.keys() <= want.keys()


def test_long_chain_takes_few_rounds(spark):
    n = 3000
    df = spark.createDataFrame([(1, f"k{i}", f"k{i + 1}", 1) for i in range(n)], "conv_id long, need string, call_id string, back int")
    began = time.perf_counter()
    assert {r["call_id"]: r["level"] for r in chat_format._by_joins(df).collect()} == {f"k{i}": i for i in range(1, n + 1)}
    assert time.perf_counter() - began < 60


def test_formatted_conversations(spark, small, monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 3)
    calls, results = chat_format.derived_calls(spark.read.parquet(f"{small}/conversations.parquet"))
    lines = chat_format.linked_calls(calls, results, spark.createDataFrame(chat_format.SCHEMAS, "name string, schema string"))
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r["conv_id"], r["circular"], r["level"] or 0, r["turn"], r["call_id"], r["line"])):
        want.setdefault(r["conv_id"], []).append(r["line"])
    got = {}
    for r in sorted(chat_format.documents(lines).collect(), key=lambda r: (r["conv_id"], r["piece"])):
        assert r["n_lines"] <= 3
        got.setdefault(r["conv_id"], []).extend(r["text"].split("\n"))
    assert got == want


PARAGRAPH = "A long enough paragraph, with commas, and points. "


@pytest.mark.parametrize(
    "name",
    "google-ads adslot ad_300x250 dfp-slot leaderboard-ad discussion reader-feedback cookie-law breadcrumb-trail mobile-nav top-bar share-tools most-read more-stories author-bio tag-list"
    " ad-banner adBox sponsored-links comments-area user-comments sub-navigation newsletter-form left-sidebar".split(),
)
def test_names_left_out(name):
    """Adverts, menus and comments within an article's wrapper and beside it, told by their names."""
    prose = "".join(f"<p>{PARAGRAPH}{k}</p>" for k in range(8))
    want = " ".join(f"{PARAGRAPH}{k}" for k in range(8))
    odd = f'<div class="{name}"><p>{PARAGRAPH}Not this.</p></div>'
    for body in (f"<main>{prose}{odd}</main>", f"<main>{odd}{prose}</main>", f"<article>{prose}{odd}</article>", f'{odd}<div class="text">{prose}</div>{odd}'):
        assert html_extract.extract(page(body), None)[0] == want


@pytest.mark.parametrize("name", "share-price related-work has-sidebar no-ads ad-hoc-networks comments-open lead thread-count roads headers text-block social-history".split())
def test_names_kept(name):
    """Names that only look like these, on a part of the text."""
    prose = "".join(f"<p>{PARAGRAPH}{k}</p>" for k in range(4))
    want = " ".join(f"{PARAGRAPH}{k}" for k in range(8))
    more = "".join(f"<p>{PARAGRAPH}{k}</p>" for k in range(4, 8))
    assert html_extract.extract(page(f'<main>{prose}<div class="{name}">{more}</div></main>'), None)[0] == want
    assert html_extract.extract(page(f'<main>{prose}<section id="discussion">{more}</section></main>'), None)[0] == want

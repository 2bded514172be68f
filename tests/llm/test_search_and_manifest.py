"""Ranked search, Merkle manifest and fingerprints, against plain loops and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelix.llm import fingerprint, merkle, ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, repeated rows and ids, and columns named like the operators' own."""
    rows = [(0, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, "word " * 20_000 + "x" * 6_000, "en"), (4, "same text here", "de"), (4, "same text here", "de"), (4, "same text here", "de"), (4, "another text", "de")]
    rows += [(None, "no id at all", "fr"), (None, "no id at all", "fr"), (6, "Ünïcode ΣΑΣ same\nsame 1d10t", None), (7, "a", "é"), (8, "text", "z")]
    df = spark.createDataFrame([(i, t, lang, None, 5) for i, t, lang in rows], DOCS)
    for c in ("tree", "i", "n", "digest", "range", "at", "block", "h", "none", "down", "copies", "loop", "next", "query", "rank", "score", "terms", "tf", "item_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def in_sql(small, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted((dict(zip(names, row, strict=True)) for row in got.fetchall()), key=repr)


# ---- ranked search


def ranked(docs, items, k):
    """rank, doc_id, score by item row, as the definition says."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(find(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in dict.fromkeys(find(text)) if t in c)
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("documents,held,first,k", [(1 << 14, 1 << 20, 48, 10), (7, 1 << 20, 1, 3), (50, 40, 5, 10), (1, 1, 1, 2)])
def test_search_by_brute_force(spark, monkeypatch, documents, held, first, k):
    """Blocks and first runs of any size; many ties, repeated ids, common and rare words."""
    for name, value in (("DOCUMENTS", documents), ("POSTINGS", held), ("FIRST", first)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(documents)
    words = [f"W{k}" for k in range(40)] + ["Été", "ΣΑΣ", "x1"]
    some = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10, 43])]) for _ in range(n)) + rng.choice(["", "!", " --"])
    docs = [(rng.choice([None, *range(200)]), some(rng.randrange(1, 30))) for _ in range(300)] + [(5, None), (6, ""), (7, "...")]
    items = [(k, some(rng.randrange(1, 12))) for k in range(25)] + [(99, None), (98, "?"), (97, "nowhere"), (1, "W1 W1 W2")]
    got = ranked_search.searched(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, k)


def test_search_in_sets(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERIES", 3)
    docs, items = [(k, f"a{k % 3} b{k % 5} c") for k in range(30)], [(k, f"a{k} b{k}") for k in range(8)]
    got = ranked_search.searched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, 4)


def test_range_maxima():
    rng = np.random.default_rng(1)
    size = 60
    starts, term, value = [0], [], []
    for _ in range(size):
        some = np.flatnonzero(rng.random(9) < 0.6)
        term += some.tolist()
        value += rng.integers(1, 50, len(some)).tolist()
        starts.append(len(term))
    index = ranked_search.Index(np.arange(size), np.array(starts), np.array(term), np.array(value), 9)
    a = rng.integers(0, len(term), (5, 400)) % len(term)
    b = np.minimum(a + rng.integers(0, 40, a.shape), len(term))
    best, place = index.maxima(a, b)
    for x, y, v, p in zip(a.ravel(), b.ravel(), best.ravel(), place.ravel(), strict=True):
        if x == y:
            assert v == 0
        else:
            assert v == index.value[x:y].max() and x <= p < y and index.value[p] == v


def test_intervals_are_dropped(monkeypatch):
    """One outstanding document ends the search after few of a thousand documents."""
    size = 1_000
    value = np.r_[np.full(size, 10), np.full(1, 10_000)]
    starts = np.r_[np.arange(501), np.arange(502, size + 2)]
    term = np.r_[np.zeros(501, int), [1], np.zeros(size - 501, int)]
    value = np.where(term == 1, 10_000, 10)
    index = ranked_search.Index(np.arange(size), starts, term, value, 2)
    taken = []
    monkeypatch.setattr(np, "lexsort", lambda keys, sort=np.lexsort: taken.append(1) or sort(keys))
    docs, scores = index.search(np.array([0, 1]), 1, (0, ranked_search.LAST), None)
    assert (docs.tolist(), scores.tolist(), len(taken)) == ([500], [10_010], 1)


def test_search_query(spark, small):
    got = sorted((r.asDict() for r in entry.queries()["op11_ranked_search"](spark, small).collect()), key=repr)
    want = in_sql(small, entry.oracle_sql()["op11_ranked_search"])
    assert sorted(tuple(sorted(r.items())) for r in got) == sorted(tuple(sorted(r.items())) for r in want)


def test_search_odd(spark, odd):
    items = spark.createDataFrame([(1, "same text", "x"), (None, "no id", "x")], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ranked_search.searched(odd, items, 5).collect()
    assert sorted(map(tuple, got), key=repr) == ranked(rows, [(1, "same text"), (None, "no id")], 5)
    assert ranked_search.searched(odd.limit(0), items).count() == 0
    assert ranked_search.searched(odd, items.limit(0)).count() == 0


# ---- Merkle manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, siblings of each leaf by level: before, behind) by whole levels."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[k] = i // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def proofs(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    whole = {}
    for lang, own in by.items():
        named = sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, sha("".join(field(r[c]) for c in merkle.FIELDS))))
        leaves = [sha("".join(field(r[c]) for c in merkle.FIELDS)) for r in named]
        whole[lang] = (named, leaves, *tree(leaves))
    langs = sorted(whole, key=lambda x: (x is not None, (x or "").encode()))
    root, up = tree([whole[x][2] for x in langs])
    out = []
    for lang, above in zip(langs, up, strict=True):
        named, leaves, subroot, paths = whole[lang]
        for r, leaf, path in zip(named, leaves, paths, strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if changed else r["text"]
            folded = sha("".join(field(x) for x in (r["doc_id"], r["source"], lang, r["n_chars"], text)))
            for a, b in path + above:
                folded = sha(a + folded + b)
            out.append((r["doc_id"], leaf, subroot, root, sha("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(out, key=repr)


def manifested(rows):
    row = {c: F.col(c) for c in merkle.FIELDS}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    claimed = F.when(tampered, merkle.leaf(row | {"text": F.translate("text", *merkle.LOWER)}))
    return sorted(map(tuple, merkle.manifest(rows.select("lang", "doc_id", merkle.leaf(row).alias("digest"), claimed.alias("claimed"))).collect()), key=repr)


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest_by_brute_force(spark, monkeypatch, levels):
    """Blocks of one and of several levels, languages of one document to hundreds, many languages."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rng = random.Random(levels)
    langs = ["en"] * 300 + ["de"] * 64 + ["fr"] * 9 + ["é"] * 8 + [None] * 73 + ["x"] + [f"l{k}" for k in range(12)]
    rows = [(k, rng.choice(["Some Text", "lower", None, ""]) if rng.random() < 0.8 else f"T{k}", lang, rng.choice([None, "s"]), k % 5) for k, lang in enumerate(langs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert manifested(df) == proofs([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])


def test_manifest_query(spark, small):
    got = sorted((tuple(sorted(r.asDict().items())) for r in entry.queries()["op12_merkle_manifest"](spark, small).collect()))
    assert got == sorted(tuple(sorted(r.items())) for r in in_sql(small, entry.oracle_sql()["op12_merkle_manifest"]))
    assert {dict(r)["verified"] for r in got} == {True, False}


def test_manifest_odd(spark, odd):
    assert manifested(odd) == proofs([r.asDict() for r in odd.collect()])
    assert manifested(odd.limit(0)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 600])
def test_appends_in_parts(n):
    """A tree taken up from its frontier, and subtrees appended whole, give the root and witnesses of one that saw all."""
    leaves = [sha(str(k)).encode() for k in range(n)]
    root, paths = tree([x.decode() for x in leaves])
    appender = merkle.Appender()
    nodes = [appender.append(x) for x in leaves]
    assert appender.close().digest.decode() == root
    assert [[(a.decode(), b.decode()) for a, b in node.witness()] for node in nodes] == paths
    for cut in {0, 1, n // 3, n // 8 * 8, n - 1}:
        first = merkle.Appender()
        for x in leaves[:cut]:
            first.append(x)
        second = merkle.Appender(first.frontier())
        for x in leaves[cut:]:
            second.append(x)
        assert second.close().digest.decode() == root
    if n > 64:
        blocks = merkle.Appender()
        for k in range(0, n, 64):
            part = merkle.Appender()
            for x in leaves[k : k + 64]:
                part.append(x)
            blocks.append(part.close(2).digest, 2)
        assert blocks.close().digest.decode() == root
    unaligned = merkle.Appender()
    unaligned.append(leaves[0])
    with pytest.raises(ValueError, match="aligned"):
        unaligned.append(leaves[0], 1)


# ---- fingerprints


def of(spark, *texts):
    rows = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), ["k"]).collect()
    return {r["k"]: r["fingerprint"] for r in rows}


def test_fingerprints_by_brute_force(spark):
    """Lanes as sums over paragraphs, of SHA-256 words; order doesn't matter, every character does."""
    texts = ["b c d\na\n\na", "a\na\n\nb c d", "a\na\nb c d\n", "a\na\nb c d", "a \na\n\nb c d", "", None, "\n", "x" * 50_000 + "\n" + "w " * 70_000]
    got = of(spark, *texts)
    for k, text in enumerate(texts):
        paragraphs = (text or "").split("\n")
        lanes = [sum(int(sha(p)[8 * j : 8 * j + 8], 16) for p in paragraphs) % 2**32 for j in range(fingerprint.EQUAL)]
        assert got[k][: 2 + fingerprint.EQUAL] == [len(paragraphs), sum(len(p.split(" ")) for p in paragraphs), *lanes]
    assert got[0] == got[1] == got[2]
    assert got[5] == got[6]
    assert len({tuple(f) for f in got.values()}) == 6
    n = got[8][1]
    assert all(0 <= lane <= n for lane in got[8][2 + fingerprint.EQUAL :])


def test_insertions_and_deletions(spark):
    """Changed paragraphs alone take a fingerprint from one text's to another's."""
    before, after = "one two three\nfour five\nsix\nsix", "six\nsix\nseven eight nine ten\none two three\n"
    known = spark.createDataFrame([(0, of(spark, before)[0])], "k long, fingerprint array<long>")
    changes = spark.createDataFrame([(0, "four five", -1), (0, "seven eight nine ten", 1), (0, "", 1), (1, "new", 1)], "k long, paragraph string, sign int")
    got = {r["k"]: r["fingerprint"] for r in fingerprint.changed(known, changes, "k").collect()}
    assert got == {0: of(spark, after)[0], 1: of(spark, "new")[0]}


def test_likeness(spark):
    rng = random.Random(2)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(600)] for _ in range(2)]
    texts = [" ".join(words[0][:k] + words[1][: 600 - k]) for k in (600, 500, 300, 0)]
    f = of(spark, *texts, *texts[:1], "")
    rows = spark.createDataFrame([(f[0], f[k]) for k in range(6)], "a array<long>, b array<long>")
    near = [r[0] for r in rows.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == near[4] == 1.0
    assert all(abs(x - want) < 0.2 for x, want in zip(near[1:4] + near[5:], (5 / 6, 1 / 2, 0, 0), strict=True))


def expected(rows):
    """doc_id, n_chars, edited_sha256 of rows (doc_id, text), those of one id in the order of their texts' hashes."""
    out = []
    for k, (i, text) in enumerate(rows):
        take = len(text) // 3
        out.append((i, len(text), sha(text[: len(text) - take] + rows[(k + 1) % len(rows)][1][:take])))
    return sorted(out, key=repr)


def test_fingerprint_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = entry.queries()["op13_document_fingerprints"](spark, small).toPandas()
    assert sorted(zip(got["doc_id"].tolist(), got["n_chars"].tolist(), got["edited_sha256"], strict=True), key=repr) == expected([(r[0], r[1] or "") for r in rows])
    texts = {r[0]: r[1] or "" for r in rows}
    prints = dict(zip(got["doc_id"], got["fingerprint"], strict=True))
    assert len(set(prints.values())) == len({tuple(sorted(t.split("\n"))) for t in texts.values()})
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.97


def test_fingerprint_odd(spark, odd, monkeypatch):
    monkeypatch.setattr(fingerprint, "TOGETHER", 2)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = odd.select("doc_id", F.coalesce("text", F.lit(""))).orderBy(F.desc_nulls_last("doc_id"), key).collect()
    got = fingerprint.edited(odd).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == expected([tuple(r) for r in rows])
    assert fingerprint.edited(odd.limit(0)).count() == 0
    for n in (1, 5):
        one = spark.createDataFrame([(3, "abcdef")] * n, "doc_id long, text string")
        assert [tuple(r)[:3] for r in fingerprint.edited(one).collect()] == [(3, 6, sha("abcdab"))] * n

"""N-gram Jaccard join: documents whose word-shingle sets are alike, as connected components.

Sizes fall into bands so narrow that linked sets lie in the same band or in neighbouring ones. For a band, every set
is dealt by hash into one part more than linked sets can differ in elements, so two linked sets agree on a whole
part: equal part signatures name all candidates, without a frequency list and without pairs of a group. Candidates
meet in size-banded tiles, where the bit counts of hashed parity bitmaps bound the overlap from above before the
sorted hash arrays are intersected exactly.

Shingles are 64-bit hashes, so a set's size or an overlap is wrong only if two different shingles of the compared
texts collide (under 1e-12 for texts of a thousand words). A link is missed as a candidate with a chance of under 1e-18.

Null or empty texts have an empty set and link with nothing; a null doc_id gets its set size and a null component.
Rows that repeat a doc_id are one node. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import connected_components, met, require, written

U = np.uint64
SEGMENT = 1 << 20
BITS = 4096
TILE = 4096
TOGETHER = 256
FLUSH = 1 << 20
SEEDS = 16
#: Elements that a part needs to name candidates, where sets have parts enough.
LEAST = 3
REFINEMENTS = 6
#: Groups, one row each, that are broadcast at most.
MOST_BROADCAST = 100_000
BAND_BITS = 12
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_byte = mix((np.arange(256, dtype=U) + U(1)) * U(BASE))
_byte[65:91] = _byte[97:123]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size, out = max(n, SEGMENT + 1), []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _powers[:] = out
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _segment_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one segment; breaks: where documents start."""
    n = len(data)
    word = ~_space[data]
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    cut[n] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_byte[data] * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)), s


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, words in each row) for runs of rows of about a segment.

    A row longer than a segment is hashed piece by piece, cut at white space."""
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= SEGMENT or j > i + 1:
            starts = offsets[i:j] - a
            h, s = _segment_words(data[a:b], starts[starts < b - a]) if b > a else (np.zeros(0, U), np.zeros(0, np.int64))
            yield i, j, h, np.diff(np.searchsorted(s, np.append(starts, b - a)))
        else:
            parts = []
            while a < b:
                c = min(a + SEGMENT, b)
                while c < b:  # to the next white space
                    at = np.flatnonzero(_space[data[c : c + SEGMENT]])
                    if len(at):
                        c += int(at[0])
                        break
                    c = min(c + SEGMENT, b)
                parts.append(_segment_words(data[a:c], np.zeros(1, np.int64))[0])
                a = c
            h = np.concatenate(parts)
            yield i, j, h, np.array([len(h)])
        i = j


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, flat sorted shingle hashes, set size of each row) for runs of rows."""
    for i, j, w, count in words(*text_bytes(column)):
        ends = np.cumsum(count)
        starts = ends - count
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        out = np.empty(int(n.sum()), U)
        to = np.cumsum(n) - n
        if len(w) >= width:
            s = np.zeros(len(w) - width + 1, U)
            for k in range(width):
                s += w[k : k + len(s)] * U(((2 * k + 1) * 0xA0761D6478BD642F) % (1 << 64) | 1)
            s = mix(s)
        flat_at = 0
        for d in range(j - i):
            c, a = int(count[d]), int(starts[d])
            if c == 0:
                continue
            if c >= width:
                out[to[d] : to[d] + n[d]] = s[a : a + c - width + 1]
                out[to[d] : to[d] + n[d]].sort()
            else:
                v = np.zeros(1, U)
                for k in range(c):
                    v += w[a + k : a + k + 1] * U(((2 * k + 1) * 0xE7037ED1A0B428DB) % (1 << 64) | 1)
                out[to[d]] = mix(v + U(c))[0]
            flat_at += int(n[d])
        row = np.repeat(np.arange(j - i), n)
        first = np.ones(len(out), bool)
        first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        yield i, j, out[first], np.bincount(row[first], minlength=j - i)


class Bands:
    """Size bands for a threshold: linked sets lie in the same or in neighbouring bands."""

    def __init__(self, threshold: Fraction):
        self.t, self.low = threshold, [1]

    def of(self, n: np.ndarray) -> np.ndarray:
        """The band of each size (sizes of 1 or more)."""
        top = int(n.max(initial=1))
        while self.low[-1] <= top + 1 or len(self.low) < 3:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.t.denominator // self.t.numerator)))
        return np.searchsorted(np.array(self.low), n, "right") - 1

    def parts(self, band: np.ndarray) -> np.ndarray:
        """One more than the elements in which linked sets of this band's sizes and below can differ."""
        while len(self.low) < int(band.max(initial=0)) + 2:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.t.denominator // self.t.numerator)))
        high = np.array(self.low)[band + 1] - 1
        return 2 * high * (self.t.denominator - self.t.numerator) // (self.t.denominator + self.t.numerator) + 1


def deals(parts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a set is dealt at most, and the elements that a part needs to say something. common: elements that two
    linked sets share at least. They fail to agree on a part that says something only if each part is touched by a
    difference or holds fewer of the shared ones, each of them with a chance of at most p = 1 - P(as many) / e, all with
    p ** parts. So many deals bring that under 1e-18. A part of a single element is often one of a common line, which
    chains texts that are nothing alike, so it says nothing where sets have parts enough."""
    mean = common / parts
    small, term = np.zeros(len(parts)), np.exp(-mean)
    for least in range(1, LEAST + 1):
        small, term = small + term, term * mean / least
        times = np.ceil(np.log(1e-18) / (parts * np.log(1 - np.exp(-1) * (1 - small)))).astype(np.int64)
        if least == 1:
            found, fewest = np.minimum(SEEDS, times), np.ones(len(parts), np.int64)
        else:
            found, fewest = np.where(times < SEEDS, times, found), np.where(times < SEEDS, least, fewest)
    return found, fewest


def signatures(flat: np.ndarray, n: np.ndarray, bands: Bands, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every part. A part of few elements or none says nothing, so sets that have one are dealt anew
    by other seeds, as often as deals() says; of the last of all seeds such parts count too, which leaves no pair out.
    A signature's last bits are the band that it is for. first: signatures of other values are independent."""
    rows, sigs = [], []
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, U)
    band = np.zeros(len(n), np.int64)
    band[full] = bands.of(n[full])
    for step in (0, 1):
        some, at = full, np.repeat(np.arange(len(n)), n)
        values = flat
        for seed in range(SEEDS):
            g = band[some] + step
            parts = bands.parts(g)
            base = np.zeros(len(n), np.int64)
            base[some] = np.cumsum(parts) - parts
            k = np.zeros(len(n), np.int64)
            k[some] = parts
            slot = base[at] + ((mix(values ^ U(first * BASE % (1 << 64))) * U(2 * seed + 0x9FB21C651E98DF25 | 1) >> U(32)) % k[at].astype(U)).astype(np.int64)
            total, size = np.zeros(int(parts.sum()), U), np.bincount(slot, minlength=int(parts.sum()))
            np.add.at(total, slot, values)
            owner = np.repeat(some, parts)
            part = np.arange(len(total)) - base[owner]
            key = mix(total + mix(np.repeat(g, parts).astype(U) * U(1 << 40) + part.astype(U) * U(SEEDS) + U(seed)) + U(first))
            key = (key >> U(BAND_BITS) << U(BAND_BITS)) | np.repeat(g, parts).astype(U) % U(1 << BAND_BITS)
            # By band and smallest size there, so that two sets of a band are dealt equally often.
            times, fewest = deals(parts, np.array(bands.low)[np.maximum(g - 1, 0)] * float(2 * bands.t / (1 + bands.t)))
            says = size >= np.repeat(fewest, parts)
            keep = says if seed + 1 < SEEDS else np.ones(len(size), bool)
            rows.append(owner[keep])
            sigs.append(key[keep])
            again = np.zeros(len(n), bool)
            again[owner[~says]] = True
            again[some[times <= seed + 1]] = False
            some = some[again[some]]
            if not len(some):
                break
            at, values = at[again[at]], values[again[at]]
    return np.concatenate(rows), np.concatenate(sigs)


def stars(sig: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, least doc) once for each signature, and distinct (band, that doc, another doc that has it)."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    hub = doc[first][np.cumsum(first) - 1]
    other = hub != doc
    band = (sig[other].view(U) % U(1 << BAND_BITS)).astype(np.int64)
    hub, far = hub[other], doc[other]
    order = np.lexsort((far, hub, band))
    edges = np.stack([band, hub, far], 1)[order]
    new = np.ones(len(edges), bool)
    new[1:] = (edges[1:] != edges[:-1]).any(1)
    return sig[first], doc[first], edges[new]


def planes(pairs: np.ndarray) -> bytes:
    """Signatures and ascending docs, as the differences between these, byte by byte: a shuffle's compression takes out
    what is zero."""
    both = np.stack([pairs[0], np.diff(pairs[1], prepend=np.int64(0))])
    return both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    """What planes() took."""
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]
    return np.stack([both[0], np.cumsum(both[1])])


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size) and two hashes of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, n in shingle_sets(batch.column(1), width):
                row = np.repeat(np.arange(j - i), n)
                h1, h2 = np.zeros(j - i, U), np.zeros(j - i, U)
                np.add.at(h1, row, flat)
                np.add.at(h2, row, mix(flat ^ U(BASE)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64))], names=["doc_id", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def packed_signatures(docs: DataFrame, width: int, threshold: Fraction, buckets: int, first: int = 0) -> DataFrame:
    """docs: doc_id, text, and comp where only documents of one comp can meet. Packed (signature, doc) pairs by bucket. A task sends each signature once in a flush, with its least doc; the
    edges from there to its other docs are known at once, so a signature of very many docs stays small."""

    docs_columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, size = Bands(threshold), [], 0
        within = len(docs_columns) > 2

        def flush() -> pa.RecordBatch:
            sig, doc, links = stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            bucket = ((sig >> U(BAND_BITS)) % U(buckets)).astype(np.int64)
            spot = (links[:, 1].astype(U) % U(buckets)).astype(np.int64)
            order, spots = np.lexsort((doc, bucket)), np.argsort(spot, kind="stable")
            used = np.union1d(bucket, spot)
            pairs = np.stack([sig.view(np.int64), doc])[:, order]
            columns = []
            for place, cut in ((bucket[order], lambda i, j: planes(pairs[:, i:j])), (spot[spots], lambda i, j: links[spots[i:j]].tobytes())):
                begin, end = np.searchsorted(place, used), np.searchsorted(place, used, "right")
                columns.append(pa.array([cut(i, j) for i, j in zip(begin, end, strict=True)], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *columns], names=["bucket", "pairs", "edges"])

        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for i, j, flat, n in shingle_sets(batch.column(1), width):
                r, sig = signatures(flat, n, bands, first)
                if within:
                    comp = mix(np.asarray(batch.column(2), np.int64).astype(U))[i:j][r]
                    sig = sig ^ (comp >> U(BAND_BITS) << U(BAND_BITS))
                held.append((sig, ids[i:j][r]))
                size += len(sig)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.where("doc_id is not null").mapInArrow(run, "bucket long, pairs binary, edges binary")


def candidate_edges(rows: DataFrame) -> DataFrame:
    """(band, a, b) of documents that share a signature for that band, as stars."""

    def run(table: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *[from_planes(x) for x in table.column("pairs").to_pylist() if x]], 1)
        known = b"".join(x for x in table.column("edges").to_pylist() if x)
        edges = np.concatenate([stars(pairs[0].view(U), pairs[1])[2], np.frombuffer(known, np.int64).reshape(-1, 3)])
        return pa.table({c: pa.array(edges[:, k].copy()) for k, c in enumerate(("band", "a", "b"))})

    return rows.groupBy("bucket").applyInArrow(run, "band long, a long, b long")


def candidate_groups(rows: DataFrame) -> DataFrame:
    """node, comp: candidates of a band that signatures chain together; a node is in one group for each of its bands.
    Bands apart, sizes can't chain into one large group."""
    graph = connected_components(candidate_edges(rows), "band")
    return graph.select("node", F.xxhash64("band", "component").alias("comp"))


def linked(sets: list[np.ndarray], known: np.ndarray, threshold: Fraction) -> np.ndarray:
    """A root for each set, equal for sets that links join; sets of equal ``known`` count as joined."""
    num, den = threshold.numerator, threshold.denominator
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    sets, n = [sets[k] for k in order], n[order]
    root = np.unique(known, return_inverse=True)[1][order]
    bitmaps = np.zeros((len(sets), BITS // 64), U)
    for k, x in enumerate(sets):
        odd = (np.bincount((x >> U(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
        bitmaps[k] = np.packbits(odd).view(U)
    low = np.searchsorted(n, -(-n * num // den))
    for j in range(len(sets)):
        i = low[j] + np.flatnonzero(root[low[j] : j] != root[j])
        if not len(i) or n[j] == 0:
            continue
        least = num * (n[i] + n[j])  # (num + den) * overlap must reach it
        bound = (n[i] + n[j] - np.bitwise_count(bitmaps[i] ^ bitmaps[j]).sum(1, dtype=np.int64)) // 2
        for k in i[(num + den) * bound >= least]:
            if root[k] == root[j]:
                continue
            both = np.concatenate([sets[k], sets[j]])
            both.sort()
            overlap = int((both[1:] == both[:-1]).sum())
            if (num + den) * overlap >= num * int(n[k] + n[j]):
                root[root == root[j]] = root[k]
    out = np.empty(len(sets), np.int64)
    out[order] = root
    return out


def verify(rows: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """rows: tile, comp, rep, known, text. For each rep of a tile: the least rep of those that links join to it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("comp").combine_chunks()
        comp, rep, known = (np.asarray(table.column(c)) for c in ("comp", "rep", "known"))
        sets: list[np.ndarray] = []
        for chunk in table.column("text").chunks or [pa.array([], pa.string())]:
            for _, _, flat, n in shingle_sets(chunk, width):
                sets += np.split(flat, np.cumsum(n)[:-1])
        label = np.empty(len(rep), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, comp[1:] != comp[:-1])), len(comp))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            root = linked(sets[a:b], known[a:b], threshold)
            least = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, root, rep[a:b])
            label[a:b] = least[root]
        return pa.table({"comp": pa.array(comp), "rep": pa.array(rep), "label": pa.array(label)})

    return rows.groupBy("tile").applyInArrow(run, "comp long, rep long, label long")


def jaccard_components(docs: DataFrame, width: int = 5, threshold: str = "0.8", tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    width: words in a shingle; threshold: the least Jaccard similarity of a link, an exact decimal."""
    t = Fraction(threshold)
    docs = require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A bucket holds the pairs of about 8 MB of text, at every size.
    buckets = int(max(64, size >> 23))
    # Texts are read twice, which is cheaper than keeping all signatures on disk next to their shuffle.
    meta = written(profiles(docs, width), "jaccard-profiles")
    groups = candidate_groups(packed_signatures(docs, width, t, buckets))
    members = meta.join(groups, meta.doc_id == groups.node)
    # Copies of a set are in the same groups.
    reps = written(members.groupBy("n", "h1", "h2", "comp").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    sized = written(_sized(reps.select("comp", "rep")), "jaccard-sized")
    n = sized.count()
    labels = None
    if n:
        # By merge at every size: a broadcast that only small inputs get would say nothing about large ones. The
        # candidates' texts are written, so that all that follows reads them and not the documents.
        text = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text").hint("merge")
        texts = written(sized.join(text, "rep"), "jaccard-texts", instead_of=sized)
        found, tables = _labels(texts, n, width, t, tile, buckets)
        labels = written(found, "jaccard-labels", instead_of=[texts, *tables])
    sets = reps.select("n", "h1", "h2", "rep").distinct()
    if labels is None:
        classes = sets.withColumnRenamed("rep", "label")
    else:
        links = connected_components(labels.select(F.col("rep").alias("a"), F.col("label").alias("b")))
        classes = sets.join(links, sets.rep == links.node, "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return meta.join(classes, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _sized(rows: DataFrame) -> DataFrame:
    """rows (comp, rep, …) of groups of two or more, with the group's size m and its least rep as hub."""
    sizes = rows.groupBy("comp").agg(F.count("*").alias("_n"), F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1")
    return met(rows, sizes, ["comp"], "_n", rows.count())


def _labels(texts: DataFrame, n: int, width: int, t: Fraction, tile: int, buckets: int) -> tuple[DataFrame, list[DataFrame]]:
    """rep, label of groups of candidates, as edges between members that belong together; the tables of texts that they
    are made from."""
    labels = _tiled(texts.where(F.col("m") <= tile).withColumn("known", F.col("rep")), n, width, t)
    if not (texts.agg(F.max("m")).first()[0] or 0) > tile:
        return labels, []
    big = texts.where(F.col("m") > tile).withColumn("chunks", F.ceil(F.col("m") / tile))
    state, links = _with_hubs(big, width, t)
    found, tables = [labels, links], [state]
    # What a group's largest class doesn't hold is compared with all of the group. Where that is much, the group is
    # dealt again first: linked documents agree on a part of every deal, others that a passage or chance brought
    # together part.
    apart, largest = _apart(state)
    for first in range(1, REFINEMENTS + 1):
        if largest <= tile:
            break
        before = largest
        pairs = packed_signatures(state.select(F.col("rep").alias("doc_id"), "text", "comp"), width, t, buckets, first)
        groups = candidate_groups(pairs)
        finer = state.select("rep", "known", "text").distinct().join(groups, F.col("rep") == F.col("node")).select("comp", "rep", "known", "text")
        finer = written(_sized(finer), "jaccard-finer")
        tables.append(finer)
        found.append(_tiled(finer.where(F.col("m") <= tile), n, width, t))
        state = finer.where(F.col("m") > tile).withColumn("chunks", F.ceil(F.col("m") / tile))
        apart, largest = _apart(state)
        if 4 * largest > 3 * before:  # what stays together is alike
            break
    if largest:
        found.append(_with_rest(state, apart, width, t, tile))
    return reduce(DataFrame.unionByName, found), tables


def _tiled(rows: DataFrame, n: int, width: int, t: Fraction) -> DataFrame:
    """rows (comp, rep, known, text) of groups that fit a tile, several groups in a task."""
    tile = F.pmod(F.xxhash64("comp"), F.lit(max(1, n // TOGETHER))).cast("string")
    return verify(rows.select("comp", "rep", tile.alias("tile"), "known", "text"), width, t).select("rep", "label")


def _with_hubs(big: DataFrame, width: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(rows with the class they are known to be in, links) of groups of more candidates than a tile holds: chunks are
    linked within, and with the group's hub."""
    big = big.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
    own = big.select("comp", "rep", F.concat_ws(":", "comp", "chunk").alias("tile"), F.col("rep").alias("known"), "text")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    hubs = big.where("rep = hub").select("comp", "rep", "text", every)
    hubs = hubs.select("comp", "rep", F.concat_ws(":", "comp", "chunk").alias("tile"), F.col("rep").alias("known"), "text")
    first = written(verify(own.unionByName(hubs), width, t), "jaccard-first")
    links = first.select(F.col("rep").alias("a"), F.col("label").alias("b")).where("a <> b")
    merged = connected_components(links)
    state = written(big.join(merged, big.rep == merged.node, "left").select("comp", "rep", "chunks", F.coalesce("component", "rep").alias("known"), "text"), "jaccard-state")
    return state, links.select(F.col("a").alias("rep"), F.col("b").alias("label"))


def _apart(state: DataFrame) -> tuple[DataFrame, int]:
    """(comp, main class, number of rows in others) of groups in which there are others, and the largest number."""
    classes = state.groupBy("comp", "known").count()
    by = classes.groupBy("comp").agg(F.max_by("known", F.struct("count", "known")).alias("main"), (F.sum("count") - F.max("count")).alias("others")).where("others > 0")
    by = written(by, "jaccard-apart")
    return by, by.agg(F.max("others")).first()[0] or 0


def _with_rest(state: DataFrame, apart: DataFrame, width: int, t: Fraction, tile: int) -> DataFrame:
    """What a group's largest class doesn't hold, compared with every chunk of the group: no pair of classes is left
    out, and work follows the group's size where most of it is one class."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = state.join(F.broadcast(apart) if apart.count() <= MOST_BROADCAST else apart, "comp").withColumn("rchunks", F.ceil(F.col("others") / tile))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks"))
    probes = rows.where("known <> main").withColumn("r", F.pmod(F.xxhash64("rep"), "rchunks"))
    sides = rows.select("comp", "rep", "known", "text", "chunk", every("rchunks").alias("r")).unionByName(probes.select("comp", "rep", "known", "text", every("chunks").alias("chunk"), "r"))
    second = verify(sides.select("comp", "rep", "known", F.concat_ws(":", "comp", "chunk", "r").alias("tile"), "text"), width, t)
    # Classes known before are given too, as labels only join what a tile's classes have in common.
    return second.select("rep", "label").unionByName(state.select("rep", F.col("known").alias("label")).where("rep <> label"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold="0.9")

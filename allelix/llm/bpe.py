"""BPE encoding and decoding in batched numpy merge rounds.

The words of many texts that weren't met lately go into one flat array of symbols. Each round looks all neighbouring
pairs up by binary search over the sorted pair keys, finds every word's lowest rank, and merges that pair wherever it
stands in the word; words without a known pair leave the array. Words of more than LONG symbols go into an array of
their own whose rounds go by rank: the lowest rank in all of them is merged wherever it stands, and only the pairs next
to a merge are looked up again, so an unbroken run of any length takes at most as many rounds as there are merges. A
word in which a round brings up a lower rank than its own is merged pair by pair instead, as the order of its merges
may matter. Results are kept by word in a bounded table, so frequent words are merged once.

The file is one of the tokenizers library's: NFC, lower case, white space dropped, words by the file's pattern, the
last symbol of a word marked by the file's suffix, special tokens' strings recognised in texts as that library does.

Null or empty texts have no ids and decode to the empty string. Repeated rows give repeated rows. A null doc_id is
carried. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require
from allelix.llm.packing import byte_alphabet

KEPT_WORDS = 300_000
SEGMENT = 1 << 20
#: Symbols of a word beyond which its merges go by rank.
LONG = 192


def _ranges(chars: list[str]) -> str:
    """Sorted characters as the inside of a character class."""
    out, at = [], 0
    for k in range(1, len(chars) + 1):
        if k == len(chars) or ord(chars[k]) != ord(chars[k - 1]) + 1:
            out.append(f"\\U{ord(chars[at]):08x}-\\U{ord(chars[k - 1]):08x}")
            at = k
    return "".join(out) or "\\U0010ffff"


class WordBPE:
    """Encoder and decoder of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.special = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self._other_unicode(pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = {b: c for c, b in byte_alphabet().items()}
        # A symbol that the vocabulary lacks is -1; no pair has it, and it gives no id.
        self.inner = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], np.int64)
        self.base = len(self.names) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.kept: dict[str, tuple[int, str, str]] = {}
        self._dict: dict[int, int] | None = None

    def _other_unicode(self, pattern: str) -> None:
        """Letters and digits that Python's Unicode lacks: the library may know them, or be older than the regex
        module. It is asked which it takes for letters or digits, and for their lower case."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        known = {c for c, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(new))}
        lower = normalizers.Lowercase()
        self.lower_new = str.maketrans({c: low for c in new if (low := lower.normalize_str(c)) != c.lower()})
        self.coarse = re.compile("[\u0530-\U0010ffff]")
        self.new = regex.compile(f"[{_ranges(new)}]")
        some = _ranges([c for c in new if c not in known])
        less = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{some}])").replace(r"[\p{L}]", rf"(?:(?![{some}])\p{{L}})").replace(r"[\p{N}]", rf"(?:(?![{some}])\p{{N}})")
        self.new_words = regex.compile(less)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; the number of merges where a pair is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], len(self.merged))

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat symbols, the word of each) of words, none of them empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        return sym, np.repeat(np.arange(len(words)), size)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word) of words, none of them empty."""
        long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
        sym, count, again = self._in_rounds([w for w in words if len(w) <= LONG]) if not long.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        if not long.any() and not len(again):
            return sym, count
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        for where, found in ((~long, (sym, count, again)), (long, self._by_rank([w for w in words if len(w) > LONG]) if long.any() else None)):
            if found is None:
                continue
            places = np.flatnonzero(where)
            for k, ids in zip(places, np.split(found[0], np.cumsum(found[1])[:-1]) if len(places) else [], strict=True):
                out[k] = ids
            for k in found[2]:
                out[places[k]] = self._pair_by_pair(words[places[k]])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _in_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, ids of each word, words to be merged again) by rounds over the whole array."""
        sym, word = self.symbols(words)
        done_word, done_sym = [], []
        none = len(self.merged)
        before, again = np.full(len(words), -1), np.zeros(len(words), bool)
        while len(sym):
            rank = np.full(len(sym), none, np.int64)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks_of(sym[:-1], sym[1:]), none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            again[word[first]] |= least < before[word[first]]
            before[word[first]] = least
            low = np.repeat(least, count)
            ended = low == none
            if ended.any():
                done_word.append(word[ended])
                done_sym.append(sym[ended])
            hit = (rank == low) & ~ended
            if hit[1:].any() and (hit[1:] & hit[:-1] & (word[1:] == word[:-1])).any():
                # The same pair over itself (aaa): from the left, every other one of a run.
                run = hit.copy()
                run[1:] &= ~(hit[:-1] & (word[1:] == word[:-1]))
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit &= (np.arange(len(hit)) - begin) % 2 == 0
            spot = np.flatnonzero(hit)
            sym[spot] = self.merged[rank[spot]]
            stay = ~ended
            stay[spot + 1] = False
            sym, word = sym[stay], word[stay]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        word, sym = word[sym >= 0], sym[sym >= 0]
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words)), np.flatnonzero(again)

    def _by_rank(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by rounds over ranks, each over the places where its pair stands."""
        sym, word = self.symbols(words)
        n, none = len(sym), len(self.merged)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, again = np.full(n, none, np.int64), np.zeros(len(words), bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(left: np.ndarray) -> np.ndarray:
            """Sets the ranks of the pairs that begin at these places, and has them wait for their turn."""
            right = after[left]
            inside = right < n
            found = np.full(len(left), none, np.int64)
            a, b = left[inside], right[inside]
            found[inside] = np.where(word[a] == word[b], self.ranks_of(sym[a], sym[b]), none)
            rank[left] = found
            some = found < none
            order = np.argsort(found[some], kind="stable")
            values, places = found[some][order], left[some][order]
            cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
            for r, group in zip(values[cuts].tolist(), np.split(places, cuts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heappush(heap, r)
                waiting[r].append(group)
            return found

        look_up(np.arange(n))
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                joined = after[at[:-1]] == at[1:]
                if joined.any():
                    begin = np.maximum.accumulate(np.where(np.append(True, ~joined), np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            sym[at] = self.merged[r]
            rank[gone] = none
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            sym[gone] = -2
            near = np.concatenate([at, before[at]])
            near = np.unique(near[near >= 0])
            lower = near[look_up(near) < r]
            if len(lower):
                again[word[lower]] = True
        keep = sym >= 0
        return sym[keep], np.bincount(word[keep], minlength=len(words)), np.flatnonzero(again)

    def _pair_by_pair(self, data: bytes) -> np.ndarray:
        """One word's ids, one merge at a time: the lowest rank first, from the left."""
        sym = self.symbols([data])[0].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)) if self._dict is None else self._dict
        self._dict, merged = ranks, self.merged
        rank_at = lambda a, b: ranks.get(a * self.base + b) if a >= 0 and b >= 0 else None
        heap = [(r, k) for k in range(n - 1) if (r := rank_at(sym[k], sym[k + 1])) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            b = after[k] if sym[k] != -2 else n
            if b >= n or (now := rank_at(sym[k], sym[b])) is None or merged[now] != merged[r]:
                continue
            sym[k], sym[b], after[k] = int(merged[r]), -2, after[b]
            if after[k] < n:
                before[after[k]] = k
                if (now := rank_at(sym[k], sym[after[k]])) is not None:
                    heappush(heap, (now, k))
            if before[k] >= 0 and (now := rank_at(sym[before[k]], sym[k])) is not None:
                heappush(heap, (now, before[k]))
        return np.array([x for x in sym if x >= 0], np.int64)

    def learn(self, words: Iterable[str]) -> None:
        """Keeps, for each new word, the number of its ids, the ids in decimal and its decoded form."""
        new = [w for w in words if w not in self.kept]
        if not new:
            return
        ids, count = self.merge([w.encode() for w in new])
        names, at, flat = self.names, 0, ids.tolist()
        for w, n in zip(new, count.tolist(), strict=True):
            own = flat[at : at + n]
            self.kept[w] = (n, " ".join(map(str, own)), " ".join([names[i] for i in own]))
            at += n

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text's stretches, and whether each is a special token; long ones are cut at white space."""
        parts = self.split.split(text) if self.split and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part, True
            else:
                a = 0
                while a < len(part):
                    b = a + SEGMENT
                    while b < len(part) and not part[b] in " \n\t\r":
                        b += 1
                    yield part[a:b], False
                    a = b

    def normal(self, text: str) -> list[str]:
        """The words of a stretch."""
        if not text.isascii():
            # Case is mapped letter by letter: no other form of sigma at the end of words.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.coarse.search(text) and self.new.search(text):
                return self.new_words.findall(text.lower().translate(self.lower_new))
        return self.words.findall(text.lower())

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids in decimal, sha256 of the decoded text) of each text."""
        split = [[([(p, True)] if special else [(self.normal(p), False)])[0] for p, special in self.pieces(t)] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self.learn({w for t in split for p, special in t if not special for w in p})
        get = self.kept.__getitem__
        for t in split:
            n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
            for p, special in t:
                got = [(1, str(self.special[p]), p)] if special else [x for x in map(get, p) if x[0]]
                if got:
                    counts, a, b = zip(*got, strict=True)
                    n += sum(counts)
                    ids.update((gap + " ".join(a)).encode())
                    decoded.update((gap + " ".join(b)).encode())
                    gap = " "
            yield n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p, special in self.pieces(text):
            if special:
                out.append(self.special[p])
            elif w := self.normal(p):
                self.learn(set(w))
                out += [int(i) for x in w for i in self.kept[x][1].split()]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes by a file without a decoder: tokens joined by one space."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text) with ``ids`` and ``decoded``: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the same without ids and texts that nobody reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            a = 0
            while a < len(batch):
                b, size = a, 0
                while b < len(batch) and size < SEGMENT:
                    size += len(batch.column(1)[b].as_py() or "")
                    b += 1
                n, ids, decoded = zip(*bpe.digests([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                a = b

    return require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    import public_tokenizers

    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

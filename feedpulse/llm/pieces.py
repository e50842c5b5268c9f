"""Operator 4, SentencePiece encoding and decoding: batched numpy Viterbi.

The distinct words of a batch (a word is its spaces and what follows up to the next space; no piece
reaches over a word's end) are grouped by length, and all words of one length advance together, one
position at a time. At each position every piece that may end there is found by the hash of the
substring among the sorted keys of the pieces; the best of them over the words is taken by
vectorised maxima and stored as a backpointer.

What makes a path best depends on the model file's kind:

* unigram: the sum of the pieces' scores (the classical Viterbi search);
* BPE: the library merges the best-scored pair first, which no sum of scores reproduces. But a
  segmentation is the merges' result exactly if each piece is its own result and each pair of
  neighbours is what the merges leave of the two joined; for each prefix one piece does so after the
  best path of what is before it. The search therefore scores a step by 0 if the pair is compatible and
  minus infinity if not. Compatibility is decided from the two pieces' merge trees: a merge across
  the border must not come before both sides are consumed by their own trees.

Characters without a piece become byte pieces, as the library does. The merge trees are computed
once on the driver and broadcast (some numbers a piece).

Defined results: a null or empty text has no ids and decodes to an empty text; the sign U+2581 is
the same as a space (as in the library); null and repeated ids are documents of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import mix, ship_code

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000   # words whose ids a task remembers
LONG = 40               # longer words are cut where no piece can reach over
PAIR_SLOTS = 1 << 21   # remembered pairs of pieces, one for each slot of their hash
FILTER_BITS = 20       # leading bits of piece keys by which most other substrings are told apart before the search
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ the model file

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


def load(path: str) -> dict:
    """Pieces, scores and kinds of a model file, its type and whether it adds a space in front."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, model_type, prefix, name, squeeze = [], [], [], UNIGRAM, True, "", True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
            kinds.append(own.get(3, 1))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(_fields(value))
            name, prefix, squeeze = own.get(1, b"").decode(), bool(own.get(3, 1)), bool(own.get(4, 1))
    if name != "identity" or squeeze or model_type not in (UNIGRAM, BPE):
        raise ValueError("only models that keep the text as it is, of the unigram or BPE type, are read")
    return {"pieces": pieces, "scores": scores, "kinds": kinds, "type": model_type, "prefix": prefix}


def merge_order(parts: list[str], rank: dict[str, int]) -> list[tuple[int, str, str]]:
    """The merges (place, left, right) that BPE makes of a list of characters: best rank, then leftmost, first."""
    n = len(parts)
    text, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
    heapq.heapify(heap)
    out = []
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i] if text[i] else n
        if j >= n or text[i] + text[j] != whole:
            continue
        out.append((i, text[i], text[j]))
        text[i], text[j] = whole, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and text[a] + text[b] in rank:
                heapq.heappush(heap, (rank[text[a] + text[b]], a, text[a] + text[b]))
    return out


def merged(parts: list[str], rank: dict[str, int]) -> list[str]:
    text = list(parts)
    for i, a, b in merge_order(parts, rank):
        text[i] = a + b
    out, at = [], 0
    while at < len(text):
        out.append(text[at])
        at += len(text[at])
    return out


def tables(model: dict) -> dict:
    """Arrays for the search: sorted piece keys, and, for BPE, the merge trees' spines."""
    usable = [i for i, k in enumerate(model["kinds"]) if k == 1 and model["pieces"][i]]
    pieces, scores = model["pieces"], model["scores"]
    t = {k: model[k] for k in ("type", "prefix", "pieces", "kinds")}
    t["bytes"] = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model["kinds"][i] == 6}
    t["unknown"] = next((i for i, k in enumerate(model["kinds"]) if k == 2), 0)
    t["scores"] = np.array(scores)
    if model["type"] == BPE:
        order = sorted({-scores[i] for i in usable})
        level = {s: r for r, s in enumerate(order)}
        rank = {pieces[i]: level[-scores[i]] for i in usable}
        t["rank"], n, ids = rank, len(pieces), {pieces[i]: i for i in usable}
        left, right, stable = np.full(n, -1), np.full(n, -1), []
        for i in usable:
            if SPACE * 2 in pieces[i]:
                continue  # runs of spaces: merged by plain rule, see Encoder
            steps = merge_order(list(pieces[i]), rank)
            if len(pieces[i]) == 1:
                stable.append(i)
            elif steps and steps[-1][1] + steps[-1][2] == pieces[i]:
                left[i], right[i] = ids[steps[-1][1]], ids[steps[-1][2]]
                stable.append(i)
        usable = stable
        ranks = np.full(n + 1, np.iinfo(np.int64).max)
        for i in usable:
            ranks[i] = rank[pieces[i]]
        t["right_spine"], t["left_spine"] = _spine(right, ranks, n), _spine(left, ranks, n)
        pairs = [(ids[p[:k]] << 20 | ids[p[k:]], rank[p]) for p in (pieces[i] for i in ids.values())
                 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        pairs.sort()
        t["pair_keys"], t["pair_ranks"] = (np.array([p[j] for p in pairs], dtype=np.int64) for j in (0, 1))
    size = max((len(pieces[i]) for i in usable), default=1)
    t["longest"] = size
    keys = np.array([_hash_one(pieces[i]) for i in usable], dtype=np.uint64)
    order = np.argsort(keys)
    t["keys"], t["ids"] = keys[order], np.array(usable, dtype=np.int64)[order]
    t["chars"] = {pieces[i] for i in usable if len(pieces[i]) == 1}
    t["inside"] = {p[k:k + 2] for p in (pieces[i] for i in usable) for k in range(len(p) - 1)}
    return t


def _spine(child: np.ndarray, ranks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: the nodes on its side towards the border, from itself down, and the rank at which each is consumed."""
    nodes, spent = [np.arange(n)], [np.full(n, np.iinfo(np.int64).max)]
    while True:
        at = nodes[-1]
        down = np.where(at >= 0, child[at], -1)
        if (down < 0).all():
            return np.stack(nodes, 1), np.stack(spent, 1)
        spent.append(np.where(down >= 0, ranks[at], -1))
        nodes.append(down)


def _hash_one(s: str) -> int:
    return int([h for h in _substrings(np.array([[ord(c) for c in s]], dtype=np.uint64), len(s))][-1][0, 0])


def _substrings(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Hashes of the substrings of 1, 2 .. ``longest`` characters from each place of each word."""
    h = np.zeros_like(codes)
    for k in range(longest):
        h = (h[:, :codes.shape[1] - k] + codes[:, k:] + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        yield mix(h + np.uint64(k + 1))


# ------------------------------------------------------------------ encoding

class Encoder:
    """Encodes and decodes with the arrays of ``tables``."""

    def __init__(self, t: dict):
        self.t = t
        # signs that no piece holds are words of their own, so line breaks do not glue words together
        alone = "".join(re.escape(chr(c)) for c in range(32) if not any(chr(c) in x for x in t["chars"]))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self._forget()
        self.pairs = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, dtype=bool)
        self.present = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.present[(t["keys"] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with the given hashes, -1 where there is none."""
        out = np.full(h.shape, -1, dtype=np.int64)
        some = np.nonzero(self.present[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        keys, own = self.t["keys"], h[some]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out[some] = np.where(keys[at] == own, self.t["ids"][at], -1)
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave pieces a and b side by side; -1 on the left is the word's start."""
        pair = (a + 1) << 20 | b
        slot = ((pair.astype(np.uint64) * _MULTIPLIER) >> np.uint64(43)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pairs[slot] != pair)
        if len(new):
            wanted, first, where = np.unique(pair[new], return_index=True, return_inverse=True)
            x, y = (wanted >> 20) - 1, wanted & (1 << 20) - 1
            fits = x < 0
            fits[~fits] = self._compatible(x[~fits], y[~fits])
            at = slot[new[first]]
            self.pairs[at], self.pair_fits[at] = wanted, fits
            out[new] = fits[where]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.t
        ok = np.ones(len(a), dtype=bool)
        (rn, rs), (ln, ls) = t["right_spine"], t["left_spine"]
        for i in range(rn.shape[1]):
            x, x_until = rn[a, i], rs[a, i]
            for j in range(ln.shape[1]):
                y, y_until = ln[b, j], ls[b, j]
                live = np.flatnonzero((x >= 0) & (y >= 0) & ok)
                if not len(live):
                    continue
                pair = x[live] << 20 | y[live]
                at = np.minimum(np.searchsorted(t["pair_keys"], pair), len(t["pair_keys"]) - 1)
                # of equal ranks the leftmost merge comes first
                rank = t["pair_ranks"][at]
                hit = (t["pair_keys"][at] == pair) & (rank < x_until[live]) & (rank <= y_until[live])
                ok[live[hit]] = False
        return ok

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: the ids of all words, their number for each word, and whether it has an unknown character."""
        t, n, size = self.t, len(words), len(words[0])
        codes = np.asfortranarray(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64))
        longest = min(size, t["longest"])
        found = [None, *map(self._find, _substrings(codes, longest))]
        # by place: the best score of the prefix, and as backpointer its last piece and that piece's length
        last = np.full((n, size + 1), -1, dtype=np.int64, order="F")
        width = np.zeros((n, size + 1), dtype=np.int64, order="F")
        best = np.full((n, size + 1), -np.inf, order="F")
        best[:, 0] = 0
        for i in range(1, size + 1):
            for k in range(min(i, longest), 0, -1):
                piece = found[k][:, i - k]
                if t["type"] == UNIGRAM:
                    score = np.where(piece >= 0, best[:, i - k] + t["scores"][piece], -np.inf)
                    better = np.flatnonzero(score > best[:, i])
                    best[better, i] = score[better]
                else:  # the score of a compatible step is 0, the best there is
                    live = np.flatnonzero((piece >= 0) & (best[:, i - k] == 0) & (best[:, i] < 0))
                    better = live[self._fits(last[live, i - k], piece[live])] if len(live) else live
                    best[better, i] = 0
                last[better, i], width[better, i] = piece[better], k
        steps, at, rows = [], np.full(n, size), np.arange(n)
        while len(rows):  # from the end back
            step = np.full(n, -1, dtype=np.int64)
            step[rows] = last[rows, at[rows]]
            steps.append(step)
            at[rows] -= np.maximum(width[rows, at[rows]], 1)
            rows = rows[at[rows] > 0]
        ids = np.stack(steps[::-1], axis=1)
        return ids[ids >= 0].astype(np.uint32), (ids >= 0).sum(axis=1), (found[1] < 0).any(axis=1)

    def _segments(self, word: str) -> list[str]:
        """Parts of a word between which no piece can reach: at unknown characters and at neighbours
        that are in no piece together."""
        chars, inside = self.t["chars"], self.t["inside"]
        cuts = [0] + [i for i in range(1, len(word)) if word[i - 1:i + 1] not in inside
                      or word[i - 1] not in chars or word[i] not in chars] + [len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that are long, have unknown characters or begin with several spaces."""
        parts = [[w] if w[:2] == SPACE * 2 else self._segments(w) for w in words]
        done: dict[str, np.ndarray] = {}
        groups: dict[int, list[str]] = {}
        for x in {x for ps in parts for x in ps}:
            if x[:2] == SPACE * 2:
                done[x] = np.array(self._spaced(x), dtype=np.uint32)
            elif len(x) == 1 and x not in self.t["chars"]:
                done[x] = np.array(self._bytes(x), dtype=np.uint32)
            else:
                groups.setdefault(len(x), []).append(x)
        for same in groups.values():
            flat, counts, _ = self._paths(same)
            done.update(zip(same, np.split(flat, np.cumsum(counts)[:-1])))
        return [done[ps[0]] if len(ps) == 1 else np.concatenate([done[x] for x in ps]) for ps in parts]

    def _store(self, places, flat: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], flat, np.zeros(self.used + len(flat), np.uint32)])
        else:
            self.flat[self.used:self.used + len(flat)] = flat
        self.start[places] = self.used + np.cumsum(counts) - counts
        self.length[places] = counts
        self.used += len(flat)

    def learn(self, words: list[str], first: int) -> None:
        """Encode new words; they have the numbers from ``first`` on."""
        room = first + len(words)
        if room > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(room, np.int64)]) for x in (self.start, self.length))
        groups: dict[int, list[int]] = {}
        odd = []
        for i, w in enumerate(words):
            if len(w) <= LONG and w[:2] != SPACE * 2:
                groups.setdefault(len(w), []).append(i)
            else:
                odd.append(i)
        for same in groups.values():
            for k in range(0, len(same), 50_000):
                own = same[k:k + 50_000]
                flat, counts, unknown = self._paths([words[i] for i in own])
                self._store(first + np.array(own), flat, counts)
                odd += [own[j] for j in np.flatnonzero(unknown)]
        if odd:
            ids = self._odd([words[i] for i in odd])
            self._store(first + np.array(odd), np.concatenate(ids), np.array([len(x) for x in ids]))

    def _bytes(self, char: str) -> list[int]:
        own = [self.t["bytes"].get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.t["unknown"]] if None in own else own

    def _spaced(self, word: str) -> list[int]:
        """Words that begin with several spaces: pieces of spaces share one score, so they go by the plain rule."""
        if self.t["type"] == UNIGRAM:
            return [i for x in self._segments(word)
                    for i in (self._bytes(x) if len(x) == 1 and x not in self.t["chars"] else self._paths([x])[0].tolist())]
        if "all" not in self.t:
            self.t["all"] = {p: i for i, p in enumerate(self.t["pieces"]) if self.t["kinds"][i] == 1}
        return [i for p in merged(list(word), self.t["rank"])
                for i in ([self.t["all"][p]] if p in self.t["all"] else self._bytes(p))]

    def encode(self, texts: list) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._forget()
        front, first = SPACE if self.t["prefix"] else "", len(self.index)
        numbers = [np.fromiter(map(self.index.__getitem__, self.words.findall(front + t.replace(" ", SPACE))), np.int64)
                   if t else np.zeros(0, np.int64) for t in texts]
        if len(self.index) > first:
            self.learn(list(itertools.islice(self.index, first, None)), first)
        return [ragged(self.flat, self.start[n], self.length[n]) for n in numbers]

    def _forget(self) -> None:
        self.index = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not hasattr(self, "heap"):
            parts = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(SPACE, " ").encode()
                     for p, k in zip(self.t["pieces"], self.t["kinds"])]
            self.heap, self.heap_length = np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts])
            self.heap_start = np.cumsum(self.heap_length) - self.heap_length
        out = ragged(self.heap, self.heap_start[ids], self.heap_length[ids]).tobytes()
        return out[1:] if self.t["prefix"] and out.startswith(b" ") else out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")

    def gives_back(self, ids: np.ndarray, text: str | None) -> bool:
        return self.decode_bytes(ids) == (text or "").replace(SPACE, " ").encode("utf-8", "surrogatepass")


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` from each ``start`` on, one after the other."""
    ends = np.cumsum(length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


def _parts(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if size > limit:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if texts:
        yield first, len(texts)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), whether decoding gives
    the text back, and, if wanted, the ids."""
    ship_code(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tables(load(public_tokenizers.path(model))))  # 10 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(dict(held.value))
        for b in batches:
            texts, own = b["text"].tolist(), b["doc_id"].astype("Int64")
            for i, j in _parts(texts):
                ids = e.encode(texts[i:j])
                f = pd.DataFrame({"doc_id": own.array[i:j], "n_tokens": [len(x) for x in ids],
                                  "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                                  "round_trip": [e.gives_back(x, t) for x, t in zip(ids, texts[i:j])]})
                if with_ids:
                    f["ids"] = [x.astype(np.int32) for x in ids]
                yield f

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
                            + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids."""
    ship_code(tokens.sparkSession)
    held = tokens.sparkSession.sparkContext.broadcast(tables(load(public_tokenizers.path(model))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(dict(held.value))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"),
                                "text": [e.decode([] if x is None else x) for x in b["ids"]]})

    return tokens.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(
        run, "doc_id bigint, text string")

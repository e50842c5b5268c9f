"""Operator 2, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Three things are learnt with Spark:

* a character language model: counts of all runs of four characters (26 letters, word end, other)
  in every document, 28^4 numbers whatever the corpus's size, smoothed over shorter contexts;
* a lexicon: words and stems (written ``stem*``) whose presence tells toxic from clean among
  labelled documents, with at most ``MAX_LABELS`` labelled rows (by hash of the id). Near copies
  (equal min-hash) count once; an entry must pass a likelihood-ratio test that allows for the
  number of words tried, and its documents must differ: a word that keeps company with many other
  words belongs to copies of one text;
* for each entry the share of toxic documents among those that hold it, and among those that hold
  none (the leak). A text's score is the noisy-or of its entries' shares and the leak.

Scoring restores what a writer may have hidden: leetspeak, accents, symbols and spaces between
letters, repeated letters. A disguised token becomes a lattice (each position: the letters that it
may stand for, nothing, or a word end, with the cost of that disguise), and a Viterbi search under
the language model finds the likeliest reading, which is then looked up. Tokens are decoded only
if some reading of their lattice holds a lexicon word (the lattice is first followed along the
lexicon's letters, without costs); for any other token no reading could change the score. Readings
are plain letters, so they are looked up among the entries without their accents; entries with
other signs are found as they are written only. ``restore`` decodes all disguised tokens of a text.

Defined results: null and empty texts have no words and get the score of that; rows with a null id
are scored and not held out; a null label is no label; ids labelled more than once are toxic if
any label says so; without labels the lexicon is empty; empty tables give no rows; other columns
are ignored, or carried along by ``keep_documents``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import free_name, ship_code, stored, window_hashes, word_chunks

MAX_LABELS = 20_000       # labelled rows that the lexicon is fitted on
STEMS = (4, 5, 6, 7)      # lengths of stems
PRECISION = 0.8           # least share of toxic documents among those that hold a lexicon word
COMPANY, COMPANIONS = 0.75, 12  # so many unrelated words, at most, may be in so large a share of a word's documents
BOOST = 0.1               # share of disguised words that the channel expects to be lexicon words
THRESHOLD = 0.7
SYMBOLS, ORDER = 28, 4    # word end, a-z, other

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
SUBSTITUTE, DROP, SPLIT, REPEAT = 0.5, 0.5, 1.5, 0.5  # costs, in nats, of one disguise
DROP_LEET = 2.5  # leaving out a sign that may be a letter
_EDGE = "!\"#%&'()*,-./:;<=>?[\\]^_`{|}~+$@«»¿¡…"
_MARKS = "".join(c for c in _EDGE if c not in LEET)
_BETWEEN = " \t.-_*"  # what may stand between spaced-out letters, up to three of them
_SPACED = re.compile(r"(?<!\S)(?:[^\s.\-_*](?![^\s.\-_*])|[ \t.\-_*]){5,}+")  # where no two letters are neighbours
_TRIPLE = re.compile(r"(.)\1\1")
_FOLD: dict[str, str] = {}


def _class_table() -> np.ndarray:
    t = np.full(256, SYMBOLS - 1, dtype=np.int64)
    for i in range(26):
        t[ord("a") + i] = t[ord("A") + i] = i + 1
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


_CLASSES = _class_table()


def char_class(c: str) -> int:
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else SYMBOLS - 1


# ------------------------------------------------------------------ language model

def count_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the runs of four character classes in all documents; each task sends one row per run that it has seen."""
    size = SYMBOLS ** ORDER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            held, size_held = [], 0
            for t in [*b["text"], None]:
                if t:
                    held.append(t.encode("utf-8", "surrogatepass"))
                    size_held += len(t)
                if held and (t is None or size_held > 1 << 20):  # texts end in word ends, so none runs into the next
                    c = _CLASSES[np.frombuffer(b" " + b"   ".join(held) + b"   ", np.uint8)]
                    pair = c[:-1] * SYMBOLS + c[1:]
                    total += np.bincount(pair[:-2] * SYMBOLS ** 2 + pair[2:], minlength=size)
                    held, size_held = [], 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "gram bigint, n bigint")
    got = rows.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 28^4 rows
    out = np.zeros(size)
    out[got["gram"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(class | three classes before), Witten-Bell smoothed down to the uniform distribution."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** order).sum(axis=0).reshape(-1, SYMBOLS)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) // max(1, p.size // SYMBOLS), 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).astype(np.float32).ravel()


# ------------------------------------------------------------------ lattices

def fold(c: str) -> str:
    """A letter without its accents."""
    if c not in _FOLD:
        _FOLD[c] = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
    return _FOLD[c]


def unaccented(word: str) -> str:
    return word if word.isascii() else "".join(map(fold, word))


class _Choices(dict):
    """(sign, length of its run up to 3) -> the strings that the run may stand for and their costs."""

    def __missing__(self, key: tuple[str, int]) -> list[tuple[str, float]]:
        c, n = key
        plain = fold(c)
        letters = [(c, 0.0)] if "a" <= c <= "z" else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if not letters and len(plain) == 1 and "a" <= plain <= "z":
            letters = [(plain, SUBSTITUTE)]
        more = [(x, cost + (REPEAT if n > 1 else 0)) for x, cost in letters]
        more += [(x + x, cost + (REPEAT if n > 2 else 0)) for x, cost in letters if n > 1]
        if not c.isalpha() and not c.isdigit():
            more += [("", DROP_LEET if c in LEET else DROP), (" ", SPLIT)]
        self[key] = more = more or [("", 4 * DROP), (" ", SPLIT)]
        return more


_CHOICES = _Choices()
_RUN = re.compile(r"(.)\1*", re.DOTALL)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per run of equal signs, the strings that it may stand for and their costs."""
    return [_CHOICES[m[1], min(3, m.end() - m.start())] for m in _RUN.finditer(token)]


def decode(token: str, lm: np.ndarray) -> str:
    """The likeliest reading of a token's lattice: Viterbi over states of the last three classes."""
    best = {0: (0.0, "")}
    for choices in lattice(token):
        after: dict[int, tuple[float, str]] = {}
        for state, (score, text) in best.items():
            for emit, cost in choices:
                s, v = state, score - cost
                for c in emit:
                    k = char_class(c)
                    if not (k == 0 and s % SYMBOLS == 0):
                        v += float(lm[s * SYMBOLS + k])
                        s = (s * SYMBOLS + k) % SYMBOLS ** (ORDER - 1)
                if s not in after or v > after[s][0]:
                    after[s] = (v, text + emit)
        best = after
    return max((v + float(lm[s * SYMBOLS]), t) for s, (v, t) in best.items())[1]


_DOUBLE = re.compile(r"(.)\1")


def disguised(token: str) -> bool:
    return not (token.isascii() and token.isalpha()) or _TRIPLE.search(token) is not None


def spaced(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of the longest runs (?<!\\S)(?:\\S[ \\t.\\-_*]{1,3}){2,}\\S(?!\\S). That expression itself
    backtracks without end over rows of dashes, as each may be a sign or stand between two; here all ways are
    followed at once: bit d of ways[k] stands for k + 1 signs (2: or more), the last of them d places before."""
    for m in _SPACED.finditer(text):
        i, end = m.span()
        while i < end:
            if text[i].isspace() or i > m.start() and not text[i - 1].isspace():
                i += 1
                continue
            ways, stop, j = (1, 0, 0), 0, i + 1
            while j < end and any(ways):
                one, two, more = ways
                sign = (0, one > 1, two > 1 or more > 1) if not text[j].isspace() else (0, 0, 0)
                step = tuple(w << 1 & 15 for w in ways) if text[j] in _BETWEEN else (0, 0, 0)
                ways = step[0] | sign[0], step[1] | sign[1], step[2] | sign[2]
                j += 1
                if ways[2] & 1 and (j == len(text) or text[j].isspace()):
                    stop = j
            if stop:
                yield i, stop, text[i:stop]
            i = max(stop, i + 1)


def restore(text: str, lm: np.ndarray) -> str:
    """A text in lower case with its disguised tokens and spaced-out words decoded."""
    text, parts, last = text.lower(), [], 0
    for i, j, run in spaced(text):
        parts += [text[last:i], decode(run, lm)]
        last = j
    text = "".join([*parts, text[last:]])
    return " ".join(decode(w, lm) if disguised(w) else w for w in (t.strip(_EDGE) or t for t in text.split()))


class Reader:
    """Finds the lexicon entries of texts."""

    def __init__(self, entries: list[str], lm: np.ndarray):
        self.lm, self.place = lm, {w: i for i, w in enumerate(entries)}
        self.read: dict[str, int] = {}  # entries as a reading may hold them, without accents
        for i, w in enumerate(entries):
            if re.fullmatch(r"[a-z]+\*?", plain := unaccented(w)) and (plain == w or plain not in self.place):
                self.read.setdefault(plain, i)
        self.stems = {w[:-1] for w in self.read if w[-1] == "*"}
        self.sizes = sorted(set(map(len, self.stems)).union(STEMS))
        self.prefixes = {w.rstrip("*")[:k] for w in self.read for k in range(len(w) + 1)}
        self.starts = {w[:k] for w in self.read for k in range(1, len(w))}
        self.cache: dict[str, tuple[int, ...]] = {}

    def entry(self, word: str) -> int | None:
        """The lexicon entry of a plain word."""
        return self._look(word, self.place)

    def _look(self, word: str, place: dict[str, int]) -> int | None:
        got = place.get(word)
        if got is None:
            for k in self.sizes:
                if len(word) > k:
                    got = place.get(word[:k] + "*")
                    if got is not None:
                        return got
        return got

    def can_read(self, token: str) -> bool:
        """Whether some reading of a token's lattice holds an entry: all its readings are followed along the
        letters of the entries. True as well if a stem is all of a word."""
        at, prefixes, stems = {""}, self.prefixes, self.stems
        one_word = token.isascii() and token.isalnum()
        for m in _RUN.finditer(token):
            after = set()
            for emit, _ in _CHOICES[m[1], min(3, m.end() - m.start())]:
                if emit == " ":  # the next word begins here, whatever came before
                    if any(s in self.read for s in at):
                        return True
                    after.add("")
                elif not emit:
                    after |= at
                else:
                    for s in at:
                        for c in emit:
                            s += c
                            if s in stems:
                                return True
                        if s in prefixes:
                            after.add(s)
            at = after
            if one_word and not at:
                return False
        return any(s in self.read for s in at)

    def reading(self, token: str) -> list[int]:
        """The entries in the likeliest reading of a token."""
        return [i for w in decode(token, self.lm).split() if (i := self._look(w, self.read)) is not None]

    def _token(self, token: str) -> tuple[int, ...]:
        bare = token.strip(_EDGE)
        got = self.entry(bare)
        if got is not None or not self.place:
            return () if got is None else (got,)
        if bare.isascii() and bare.isalpha() and not _DOUBLE.search(bare) and token.strip(_MARKS) == bare:
            got = self._look(bare, self.read)  # its lattice has one reading
            return () if got is None else (got,)
        for t in (token, bare) if token != bare else (token,):
            if self.can_read(t) and (found := self.reading(t)):
                return tuple(found)
        return ()

    def _spaced(self, words: list[str], special: set[str], singles: set[str], runs: set[str], found: set[int]) -> None:
        """Words with spaces between letters, and words that one space was put into: the latter are taken if
        the language model prefers them whole."""
        at = [i for i, w in enumerate(words) if w in special]
        first = 0
        for k in range(1, len(at) + 1):  # runs of neighbouring single signs, over any white space
            if k == len(at) or at[k] != at[k - 1] + 1 or words[at[k]] not in singles:
                if k - first > 2:
                    runs.add(" ".join(words[at[first]:at[k - 1] + 1]))
                first = k
        for run in runs:
            found.update(self._token(run))
        for i in at:
            a = unaccented(words[i])
            if a in self.starts and i + 1 < len(words):
                b = unaccented(words[i + 1].strip(_EDGE))
                got = self._look(a + b, self.read)
                if got is not None and decode(f"{a}-{b}", self.lm) == a + b:
                    found.add(got)

    def words(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if not text or not self.place:
            return found
        text = text.lower()
        words = text.split()
        kinds, cache = set(words), self.cache
        singles = set()
        for w in kinds:
            got = cache.get(w)
            if got is None:
                if len(cache) > 400_000:
                    cache.clear()
                got = cache[w] = self._token(w)
            if got:
                found.update(got)
            if len(w.strip(".-_*")) < 2 or len(w.strip(_EDGE)) == 1:  # a sign, or what may stand between two
                singles.add(w)
        special = kinds & self.starts
        if not text.isascii():
            special |= {w for w in kinds if not w.isascii() and unaccented(w) in self.starts}
        if len(singles) > 1:
            special |= singles
        runs = {run for _, _, run in spaced(text)}
        if special or runs:
            self._spaced(words, special, singles, runs, found)
        return found


# ------------------------------------------------------------------ fitting

def held_out(c="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _plain(text: str | None) -> list[str]:
    """The words and stems of a text."""
    words = {w for w in (t.strip(_EDGE) for t in set((text or "").lower().split())) if w}
    return sorted(words.union(w[:k] + "*" for w in words for k in STEMS if len(w) > k))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """toxic and words of at most MAX_LABELS labelled documents that are not held out, near copies once."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("bigint").alias("lab_id")).agg(F.max("toxic").alias("lab_toxic")))
    known = known.orderBy(F.xxhash64("lab_id"), "lab_id").limit(MAX_LABELS)
    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("i") == F.col("lab_id")).select("text", (F.col("lab_toxic") > 0).alias("toxic"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            least = np.zeros(len(texts), dtype=np.int64)
            for first, last, _, _, _, h, bounds in word_chunks(texts, lower=True):
                for i in range(first, last):
                    own = window_hashes(h[bounds[i - first]:bounds[i - first + 1]], 3)
                    least[i] = own.view(np.int64).min() if len(own) else hash(tuple(h[bounds[i - first]:bounds[i - first + 1]].tolist()))
            yield pd.DataFrame({"toxic": b["toxic"], "least": least, "words": [_plain(t) for t in texts]})

    rows = rows.mapInPandas(words, "toxic boolean, least bigint, words array<string>")
    return stored(rows.dropDuplicates(["toxic", "least"]).select("toxic", "words"), "toxicity-sample")


def _related(a: str, b: str) -> bool:
    """Whether one entry's words are among the other's."""
    return a == b or a[-1] == "*" and b.startswith(a[:-1]) or b[-1] == "*" and a.startswith(b[:-1])


def choose(candidates: list, documents: list[list[int]], n0: int, n1: int, n_words: int) -> list[int]:
    """Places of the candidates (entry, n0, n1) that become the lexicon; documents lists the candidates of each toxic one."""
    def g2(a: int, b: int) -> float:  # likelihood ratio of "toxic more often with the entry"
        base, own = n1 / (n0 + n1), b / (a + b)
        return 2 * (b * math.log(own / base) + (a * math.log((1 - own) / (1 - base)) if a else 0))

    least, found = 2 * math.log(max(n_words, 2)), []
    able = [(i, v) for i, (_, a, b) in enumerate(candidates) if b >= PRECISION * (a + b) and (v := g2(a, b)) >= least]
    lists, holders = [np.asarray(at, dtype=np.int64) for at in documents], {i: [] for i, _ in able}
    for d, at in enumerate(documents):
        for i in at:
            if i in holders:
                holders[i].append(d)
    heads = np.array([hash(c[0][:STEMS[0]].rstrip("*")) for c in candidates])
    for i, value in able:  # a candidate's company is counted over the documents that hold it, one candidate at a time
        own = holders[i]
        together = np.bincount(np.concatenate([lists[d] for d in own]), minlength=len(candidates)) if own else np.zeros(len(candidates))
        company = np.unique(heads[(together > COMPANY * max(len(own), 1)) & (heads != heads[i])])
        if len(company) <= COMPANIONS:
            name = candidates[i][0]
            found.append((-value, name[-1] == "*", -len(name), name, i))
    out: list[int] = []
    for *_, name, i in sorted(found):
        if not any(_related(name, candidates[j][0]) for j in out):
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: language model, lexicon, its entries' shares and the leak."""
    ship_code(docs.sparkSession)
    rows = _sample(docs, labels, id_col, text_col)
    n0, n1 = rows.agg(F.count_if(~F.col("toxic")), F.count_if("toxic")).first()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter(), Counter()
        for b in batches:
            for ws, toxic in zip(b["words"], b["toxic"]):
                n[bool(toxic)].update(ws)
        for k in (k for k in (0, 1) if n[k]):
            yield pd.DataFrame({"word": list(n[k]), "n0": 0 if k else list(n[k].values()), "n1": list(n[k].values()) if k else 0})

    words = rows.mapInPandas(count, "word string, n0 bigint, n1 bigint").groupBy("word").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = stored(words, "toxicity-words")
    n_words = words.count()
    few = 2 * math.log(max(n_words, 2)) / (2 * math.log((n0 + n1) / n1)) if n0 and n1 else 2  # as many pass the test without an exception
    top = words.filter((F.col("n1") >= few) & (F.col("n1") >= PRECISION * (F.col("n0") + F.col("n1"))))
    # as many as there are: words of the labelled rows, of which there are MAX_LABELS at most
    top = [(r["word"], r["n0"], r["n1"]) for r in top.orderBy(F.desc("n1"), "word").collect()]
    names = [t[0] for t in top]

    def which(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(names)}
        for b in batches:
            out = [[place[w] for w in ws if w in place] for ws in b["words"]]
            yield pd.DataFrame({"at": [x for x in out if x]})

    toxic = [r["at"] for r in rows.filter("toxic").mapInPandas(which, "at array<int>").collect()] if names else []
    chosen = choose(top, toxic, n0, n1, n_words) if names and n0 and n1 else []
    lexicon, picked = [names[i] for i in chosen], set(chosen)
    missed = n1 - sum(not picked.isdisjoint(d) for d in toxic)  # toxic documents without an entry
    return {"lm": language_model(boosted(count_grams(docs, text_col), lexicon)), "words": lexicon,
            "shares": [(top[i][2] + 0.5) / (top[i][1] + top[i][2] + 1) for i in chosen], "leak": (missed + 0.5) / (n0 + missed + 1)}


def boosted(counts: np.ndarray, words: list[str]) -> np.ndarray:
    """Counts of a corpus in which a share of BOOST of the words is lexicon words: what is disguised is more
    often one of them than plain text is."""
    out = counts.copy()
    if words:
        ends = counts.reshape(-1, SYMBOLS)[:, 0].sum() - counts.reshape(-1, SYMBOLS, SYMBOLS)[:, 0, 0].sum()  # word ends
        for w in words:
            stem = w[-1] == "*"
            c = [0] + [char_class(x) for x in unaccented(w).rstrip("*")] + [0] * (0 if stem else 3)
            for i in range(len(c) - ORDER + 1):
                at = 0
                for x in c[i:i + ORDER]:
                    at = at * SYMBOLS + x
                out[at] += BOOST * max(ends, 1) / len(words)
            out[c[1]] += BOOST * max(ends, 1) / len(words)  # after a word end and the spaces before it
    return out


def scorer(model: dict):
    """text -> score between 0 and 1."""
    reader = Reader(model["words"], model["lm"])
    clean = [1 - p for p in model["shares"]]
    return lambda text: 1 - (1 - model["leak"]) * math.prod(clean[i] for i in sorted(reader.words(text)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))  # 2.5 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = scorer(model.value)
        for b in batches:
            s = [f(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": s,
                                "predicted": [int(x >= THRESHOLD) for x in s]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("held_out", held_out()).mapInPandas(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    held: dict = {}

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if "f" not in held:
            held["f"] = scorer(model.value)
        return texts.map(held["f"], na_action=None).astype(float)

    name = free_name(docs.columns, "toxic_score")
    return docs.withColumn(name, scored(F.col(text_col))).filter(F.col(name) < THRESHOLD).drop(name)

"""Toxicity of texts after undoing disguised spellings.

Noisy channel: a disguised word is read as a lattice of characters. A digit or sign may stand for the
letters that it resembles, for nothing, or, if it is punctuation, for a space; a run of one letter may
stand for one or two of it; a space between pieces of words may be a space or nothing. Each reading has
a cost, and the Viterbi path under a character trigram model, learned from the words of all documents,
is the restored text, whose words are scored. Decoded are words that show a disguise (a sign or digit
within, a letter three times in a row), runs of ``SINGLES`` or more words of one character, and, where
this makes a word that the model scores, words with a doubled letter and two neighbouring words of up
to ``FRAGMENT`` letters. Any other word is its own lower-case form. A word of over ``LONGEST``
characters without a space is no disguised word: its runs of letters count as they stand, however long.

Scoring: features are the restored words and their beginnings of 5 to 8 letters. From the labelled rows
that may be learned from, at most ``MAX_FEATURES`` are selected whose presence tells most of the label
(z of 4 or more), each with the log ratio of its rates in toxic and clean text. A word counts with the
largest ratio of its features, and a logistic regression on sums, shares and the largest of a text's
ratios gives the score. Labels, language, source and identifiers are never inputs of a score.

The trigram counts cover every document. The regression is fitted on at most ``MAX_TOXIC`` rows with
label 1 and ``MAX_CLEAN`` with label 0, those with the smallest hash of their identifier (ties: the
smallest identifier), its intercept set right for the share of toxic rows among all that may be learned
from; an identifier with both labels counts as toxic. Null and empty texts score as any text without a
feature, whatever its length; time grows with a text's length. Rows that repeat an identifier get equal
scores if their texts are equal; null identifiers are scored and not learned from. Where one of the
labels has no row, every score is that label, or 0.5 without any. Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, text_of
from .pieces import Memo, byte_slices

MAX_TOXIC = 4_000
MAX_CLEAN = 12_000
MAX_FEATURES = 2_000
N_INPUTS = 10

_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SYMBOLS = 64
_OTHER = SYMBOLS - 1
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}  # 0 is a word's edge
_TABLE = np.full(0x250, 0, np.uint8)
for _c, _i in _CODE.items():
    if ord(_c) < len(_TABLE) - 1:
        _TABLE[ord(_c)] = _i  # the last entry, for all characters beyond, is an edge
#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "%": "x", "^": "a", "*": "aeiou", "?": "aeiou"}
FILL = frozenset(".-_*~'`\"/\\,:;=+^#&|!?%$")
LOOK_COST, FILL_COST, ONE_COST, TWO_COST, SELF_COST, BREAK_COST, JOIN_COST = 0.7, 1.2, 0.5, 1.0, 6.0, 1.0, 0.3
LONGEST, SINGLES, FRAGMENT = 64, 3, 4

_START = re.compile(r"[\w@$(<|€£¥+!]")
_SIGN = re.compile(r"[^\w\s]|[\d_]")
_LEADS = re.compile(r"[\d@$!|(<€£¥+]")
_LETTER = re.compile(r"[^\W\d_]")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = frozenset("@$€£¥")


def core_of(token: str) -> str:
    """A token without the signs around it that stand for no letter."""
    first = _START.search(token)
    if not first:
        return ""
    end = len(token)
    while not (token[end - 1].isalnum() or token[end - 1] == "_" or token[end - 1] in _ENDS):
        end -= 1
        if end <= first.start():
            return ""
    return token[first.start() : end]


def disguised(core: str) -> bool:
    """Whether a sign or digit stands after a letter, or one that may be a letter before one, or a letter thrice."""
    letter = _LETTER.search(core)
    if not letter or core.isalpha():
        return bool(letter and _THRICE.search(core))
    if _SIGN.search(core, letter.end()) or _THRICE.search(core):
        return True
    lead = _LEADS.search(core)
    return bool(lead and _LETTER.search(core, lead.end()))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, words padded with two edges before and one after."""
    raw = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0, 0], _TABLE[np.minimum(raw, len(_TABLE) - 1)], [0]]).astype(np.int32)
    a, b, d = c[:-2], c[1:-1], c[2:]
    a = np.where(b == 0, 0, a)  # nothing before an edge counts
    keep = (b > 0) | (d > 0)
    return np.bincount(((a * SYMBOLS + b) * SYMBOLS + d)[keep], minlength=SYMBOLS**3)


def trigram_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two, over all documents, flat; at most 64**3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for lo, hi in byte_slices(b.column(0), 2_000_000):
                total += trigram_counts(b.column(0).slice(lo, hi - lo).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r.gram] = r.n
    return log_model(counts)


def log_model(counts: np.ndarray) -> np.ndarray:
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 1e-3) / (c2.sum() + 1e-3 * SYMBOLS)
    p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
    return np.log((c3 + 4 * p2) / (c3.sum(2, keepdims=True) + 4)).astype(np.float32).ravel()


class Decoder:
    """Restores words by Viterbi search; without ``channel``, words are what they seem to be."""

    def __init__(self, model: np.ndarray, channel: bool = True) -> None:
        self.lm, self.channel = model.tolist(), channel

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Readings of each place, with costs."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(word):
            c, j = word[i], i + 1
            while j < len(word) and word[j] == c:
                j += 1
            n = j - i
            if c.isalpha():
                out.append([(c * n, 0.0), *([(c, ONE_COST)] if n > 1 else [])] if n < 3 else [(c, ONE_COST), (c + c, TWO_COST)])
            elif c.isspace():
                out.append([(" ", 0.0), ("", JOIN_COST)])
            else:
                looks = [(x * k, LOOK_COST * k) for x in LOOKS.get(c, "") for k in ({1, 2} & {1, n})]
                fill = [("", FILL_COST), (" ", BREAK_COST)] if c in FILL else [("", SELF_COST)]
                out.append(looks + fill)
            i = j
        return out

    def restore(self, word: str) -> str:
        """The likeliest reading of a disguised word, or of several; of equals, the one whose readings come first."""
        lm: list[float] = self.lm
        states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for place in self.lattice(word):
            new: dict[tuple[int, int], tuple] = {}
            for (a, b), (s, back) in states.items():
                for letters, cost in place:
                    gain, x, y = s - cost, a, b
                    for c in letters:
                        if c == " ":
                            if y:  # an edge ends a word; more edges change nothing
                                gain += lm[(x * SYMBOLS + y) * SYMBOLS]
                                x = y = 0
                        else:
                            z = _CODE.get(c, _OTHER)
                            gain += lm[(x * SYMBOLS + y) * SYMBOLS + z]
                            x, y = y, z
                    if (x, y) not in new or gain > new[x, y][0]:
                        new[x, y] = gain, (back, letters)
            states = new
        _, back = max(((s + (lm[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), back) for (a, b), (s, back) in states.items()), key=lambda p: p[0])
        letters = []
        while back:
            letters.append(back[1])
            back = back[0]
        return "".join(letters[::-1])

    def words(self, token: str) -> list[str]:
        """The words of a token, of those of the Viterbi path if it is disguised."""
        core = core_of(token)
        if self.channel and len(core) <= LONGEST and disguised(core):
            return self.restore(core).split()
        return _WORD.findall(core)

    def runs(self, tokens: pa.Array, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Runs of words of one character, joined by spaces, and the text that each is in."""
        if not self.channel or not len(tokens):
            return [], np.zeros(0, np.int64)
        single = (pc.utf8_length(tokens).to_numpy() == 1).astype(np.int8)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        turn = np.flatnonzero((np.diff(single) != 0) | (np.diff(text) != 0)) + 1
        begin, end = np.concatenate([[0], turn]), np.concatenate([turn, [len(single)]])
        at = np.flatnonzero((single[begin] == 1) & (end - begin >= SINGLES))
        found = [" ".join(tokens[b : b + n].to_pylist()) for b, n in zip(begin[at].tolist(), (end - begin)[at].tolist())]
        some = [i for i, r in enumerate(found) if sum(map(str.isalpha, r)) >= SINGLES]
        return [found[i] for i in some], text[begin[at]][some]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts, and where each text's begin (and the last one's end)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return words.filter(pa.array(there)), np.concatenate([[0], np.cumsum(there)])[offsets]


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in range(5, 9) if len(word) > n]] if len(word) > 2 else []


@dataclass
class Model:
    """Log ratios of the selected features, weights of what is made of them, and the trigram model."""

    lm: np.ndarray
    ratios: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_INPUTS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_INPUTS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_INPUTS))
    bias: float = 0.0


class Scorer:
    """Scores texts with a model; distinct words are decoded once, within bounds."""

    def __init__(self, model: Model, channel: bool = True) -> None:
        self.model, self.decoder = model, Decoder(model.lm, channel)
        self.memo = Memo(self._tokens, limit=300_000)
        self.whole = pa.array([f for f in model.ratios if not f.endswith("*")], pa.string())

    def _value(self, words: list[str]) -> float:
        ratios = self.model.ratios
        return max([ratios[f] for w in words for f in features_of(w) if f in ratios], default=0.0)

    def _tokens(self, tokens: list[str]) -> list[float]:
        value, decoder, out = self._value, self.decoder, []
        for t in tokens:
            v = value(decoder.words(t))
            if not v and decoder.channel and len(t) <= LONGEST and t.isalpha() and _TWICE.search(t) and value([_TWICE.sub(r"\1", t)]):
                v = value(decoder.restore(t).split())
            out.append(v)
        return out

    def _fragments(self, tokens: pa.Array, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Neighbouring short words that would be a scored word together, and the text that each pair is in."""
        if not self.decoder.channel or len(tokens) < 2 or not len(self.whole):
            return [], np.zeros(0, np.int64)
        short = pc.utf8_length(tokens).to_numpy() <= FRAGMENT
        pair = short[:-1] & short[1:]
        pair[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(tokens))] - 1] = False
        at = np.flatnonzero(pair)
        a, b = tokens.take(pa.array(at)), tokens.take(pa.array(at + 1))
        at = at[pc.is_in(pc.binary_join_element_wise(a, b, ""), self.whole).to_numpy(zero_copy_only=False)]
        return [f"{tokens[i]} {tokens[i + 1]}" for i in at.tolist()], np.searchsorted(offsets, at, "right") - 1

    def inputs(self, texts: pa.Array) -> np.ndarray:
        """Inputs of the regression."""
        tokens, offsets = split_words(texts)
        coded = tokens.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.memo.learn(set(distinct))
        values = np.fromiter(map(known.__getitem__, distinct), np.float64, len(distinct))[coded.indices.to_numpy()]
        at = np.flatnonzero(values)
        which, values = np.searchsorted(offsets, at, "right") - 1, values[at]
        for found, where in (self.decoder.runs(tokens, offsets), self._fragments(tokens, offsets)):
            more = np.array([self._value(self.decoder.restore(f).split()) for f in found])
            which, values = np.concatenate([which, where[more > 0]]), np.concatenate([values, more[more > 0]])
        out = np.zeros((len(texts), N_INPUTS), np.float32)
        hits = np.bincount(which, minlength=len(texts))
        total, most = np.bincount(which, values, len(texts)), np.zeros(len(texts))
        np.maximum.at(most, which, values)
        kinds = np.bincount(np.unique(np.stack([which, values]), axis=1)[0].astype(np.int64), minlength=len(texts)) if len(which) else hits
        x = np.flatnonzero(hits)  # without any, length tells nothing
        n, hits, total, most, kinds = (v[x].astype(np.float64) for v in (np.maximum(np.diff(offsets), hits), hits, total, most, kinds))
        out[x] = np.stack([np.ones(len(x)), np.log1p(total), total / n, most, np.log1p(hits), hits / n, total / n**0.5, np.minimum(kinds, 5), most * (hits > 1), np.log1p(hits) - np.log1p(n / 50)], 1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        m = self.model
        z = ((self.inputs(texts) - m.mean) / m.scale) @ m.weights + m.bias
        return 1 / (1 + np.exp(-z.clip(-40, 40).astype(np.float64)))


def ratios(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Log ratios of rates from each feature's occurrences in toxic and clean text, and under "" those of all tokens."""
    total = next((a, b) for n, a, b in counts if not n)
    return {n: r for n, a, b in counts if n and (r := float(np.log((a + 0.5) / (total[0] + 1)) - np.log((b + 0.5) / (total[1] + 1)))) > 0}


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and bias, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.c_[(x - mean) / scale, np.ones(len(x))].astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), l2 * np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x / len(y) + ridge, x.T @ (p - y) / len(y) + ridge @ w)
        w = w - step.clip(-2, 2)
        if abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


def _may_learn(folds: int = 3, held: int = 1):
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_features: int = MAX_FEATURES, channel: bool = True) -> Model:
    """Trigram counts over all of ``docs``; the regression on bounded samples of labelled rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    lm = trigram_model(rows)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(_may_learn() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Model(lm, bias=0.0 if share is None else 40.0 * (2 * share - 1))
    order = F.xxhash64("doc_id")
    ids = known.where("y = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(max_clean))
    # At most max_toxic + max_clean rows of two numbers: a bounded broadcast.
    sample = cut(rows.join(F.broadcast(ids), "doc_id").select("y", "text"), "toxicity-sample")
    sent = spark.sparkContext.broadcast(Model(lm))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value.lm, channel)
        made = lambda words: {f for w in words for f in features_of(w)}
        memo: Memo = Memo(lambda ts: [made(decoder.words(t)) for t in ts], limit=100_000)
        for b in batches:
            rows, each = ({0: Counter(), 1: Counter()} for _ in range(2))
            ys = b.column(0).to_pylist()
            for lo, hi in byte_slices(b.column(1), 2_000_000):
                tokens, offsets = split_words(b.column(1).slice(lo, hi - lo))
                runs: dict[int, list[set[str]]] = {}
                for r, i in zip(*decoder.runs(tokens, offsets)):
                    runs.setdefault(int(i), []).append(made(decoder.restore(r).split()))
                tokens = tokens.to_numpy(zero_copy_only=False).tolist()
                learned = memo.learn(set(tokens)).__getitem__
                for i, y in enumerate(ys[lo:hi]):
                    found = [*map(learned, tokens[offsets[i] : offsets[i + 1]]), *runs.get(i, ())]
                    rows[y].update(set().union(*found))
                    for f in found:
                        each[y].update(f)
                    each[y][""] += len(found)
            names = list(each[0] | each[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (rows[1], rows[0], each[1], each[0]))], ["name", "a", "b", "oa", "ob"])

    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(lm, bias=40.0 * (2 * max(n, default=0.5) - 1))
    pos, neg = n[1], n[0]
    told = cut(sample.mapInArrow(count, "name string, a long, b long, oa long, ob long").groupBy("name").agg(*(F.sum(c).alias(c) for c in ("a", "b", "oa", "ob"))), "toxicity-features")
    z = (F.col("a") / pos - F.col("b") / neg) / F.sqrt((F.col("a") + F.col("b") + 1) / (pos + neg) * (1 / pos + 1 / neg))
    best = told.where("a >= 3").select("name", "oa", "ob", z.alias("z")).where("z > 4").orderBy(F.desc("z"), F.length("name"), "name").limit(max_features).collect()
    every = told.where("name = ''").select("name", "oa", "ob").first()
    model = Model(lm, ratios([tuple(every), *((r.name, r.oa, r.ob) for r in best)]))
    told_model = spark.sparkContext.broadcast(model)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told_model.value, channel)
        for b in batches:
            for lo, hi in byte_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in scorer.inputs(b.column(1).slice(lo, hi - lo))], pa.binary())], ["y", "x"])

    got = sorted(sample.mapInArrow(inputs, "y int, x binary").collect())
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, N_INPUTS)
    model.mean, model.scale, model.weights, bias = fit_logistic(x, np.array([r.y for r in got], float))
    model.bias = bias + float(np.log(share / (1 - share)) - np.log(pos / neg))
    return model


_made: dict[bytes, Scorer] = {}


def _scorer(model: Model, channel: bool) -> Scorer:
    key = hashlib.sha256(pickle.dumps((model.lm.tobytes(), sorted(model.ratios.items()), *(x.tobytes() for x in (model.mean, model.scale, model.weights)), model.bias, channel))).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Scorer(model, channel)
    return _made[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", channel: bool = True) -> DataFrame:
    """``doc_id, score`` of each row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64**3 numbers and max_features ratios

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value, channel)
        for b in batches:
            for lo, hi in byte_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scorer.score(b.column(1).slice(lo, hi - lo)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, words``: the distinct restored words of each text that differ from how it writes them."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value.lm)
        for b in batches:
            tokens, offsets = split_words(b.column(1))
            more: dict[int, set[str]] = {}
            for r, i in zip(*decoder.runs(tokens, offsets)):
                more.setdefault(int(i), set()).update(decoder.restore(r).split())
            tokens, out = tokens.to_pylist(), []
            for i in range(b.num_rows):
                own = set(tokens[offsets[i] : offsets[i + 1]])
                out.append(sorted(({w for t in own for w in decoder.words(t)} | more.get(i, set())) - own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, words array<string>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row."""
    out = score(docs, fit(docs, labels, **options), options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("channel", True))
    held = F.col("doc_id").isNotNull() & ~_may_learn()
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

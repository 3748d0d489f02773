"""Score of abusive, hateful or sexually explicit language.

A linear classifier over sentences, fitted on reviewed documents: a document is
as abusive as its worst sentence, so the sentence that carries a positive label
is found while fitting (multiple-instance learning), and labels that no sentence
supports fade out. The fit is regularised by counterfactuals: in sentences that
name a group, the name is swapped for others, and any change of the score is
penalised, so that naming a group does not count as abuse by itself.

Only the reviewed sample reaches the driver, at most :data:`MAX_LABELLED`
documents; every document is scored on the workers.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.normal import folded, without_markup
from spindrift.tables import arrow_batches

#: Reviewed documents used to fit the classifier, chosen by a hash of their id.
MAX_LABELLED = 4000
THRESHOLD = 0.5
ROUNDS, STEPS, RATE = 5, 120, 0.2
RIDGE, COUNTERFACTUAL = 0.05, 0.3
SWAPS = 4
#: Share and least number of harmless documents beyond which a word is an everyday one.
EVERYDAY, LEAST_EVERYDAY = 0.006, 3

#: Names of groups of people that may be swapped for each other.
GROUPS = (
    "women", "men", "girls", "foreigners", "immigrants", "refugees", "islanders", "southerners", "northerners", "hill people",
    "old folks", "old people", "young people", "muslims", "christians", "jews", "gays", "lesbians", "blacks", "whites", "asians",
    "mexicans", "germans", "disabled people", "gypsies", "migrants", "ausländer", "frauen",
    "mujeres", "femmes", "extranjeros", "étrangers",
)

#: Words by what they may express. They are features, not verdicts.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit scumbag scumbags bastard bastards clown loser losers repulsive pathetic "
    "dumbass asshole assholes retard wanker twat prick bitch whore slut "
    "vollidiot idiotin versager trottel arschloch depp abschaum wichser hurensohn miststück fresse drecksau schlampe "
    "imbécil idiota gilipollas cabrón payaso puta zorra subnormal "
    "crétin connard connasse ordure abruti imbécile salaud salope gueule pute",
    "mild": "dumb stupid worthless useless trash garbage filth coward brainless lazy ugly sick disgusting disgust despise estúpido estúpida basura inútil dumm débile stupide",
    "hate": "vermin subhuman subhumans savages cockroaches exterminate ungeziefer vermine alimañas weggesperrt untermenschen",
    "sex": "tits boobs blowjob blowjobs pussy dick horny porn xxx cum fuckable milf titten geil fotze tetas polla follar nichons baiser bite salopes",
    "body": "naked nude ass cock lick skirt cams moans strip lap sexy nackt desnuda nue seins legs wet",
    "threat": "regret rape stab fingers teeth bleed throat umbringen schlagen matar crever",
    "swear": "fuck fucking fucked shit shitty damn crap scheiße verdammt mierda joder putain merde",
    "you": "you your yourself you're du dich dein deine dir tú te tu tus vous toi ton ta tes t'es t’es eres",
}

_UNFOLD = {k: [folded(w) for w in v.split()] for k, v in LEXICON.items()}
_CATEGORY: dict[str, list[str]] = {}
for _c, _ws in _UNFOLD.items():
    for _w in _ws:
        _CATEGORY.setdefault(_w, []).append(_c)

_GROUP_WORDS = [folded(g) for g in GROUPS]
_GROUP = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _GROUP_WORDS), key=len, reverse=True)) + r")\b")

_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·][^\W\d_]){3,}(?![^\W_])")
_TOKEN = re.compile(r"[\w*@$|'’]+(?:![\w*@$|]+)*|[.!?\n]")
_TOKEN_ASCII = re.compile(r"[a-z0-9_*@$|']+(?:![a-z0-9*@$|]+)*|[.!?\n]", re.ASCII)
_INNER_DIGIT = re.compile(r"[a-z][013457]+[a-z]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_CAMEL = re.compile(r"\b[A-Za-z]*[a-z]{3}[A-Z][a-z]{2}\w*|\b[A-Za-z]+_\w+")
_UNMASKABLE = [w for c in ("insult", "mild", "swear", "sex", "hate") for w in _UNFOLD[c]]
#: Kinds of words, and bits of a sentence, in the order of their bit.
KINDS = (*LEXICON, "group", "masked")


def spelled(token: str) -> str:
    """The word a token stands for, "" if it is none.

    Digits and signs inside a word become the letters they stand for; letters
    repeated three times or more are reduced to one; a word masked with stars
    becomes the known one it fits, else it keeps one star at its end.
    """
    t = token.strip("_'’|")
    if len(t) > 2 and t[0] == t[-1] == "*":
        t = t.strip("*")
    if "*" in t:
        if not re.search(r"[a-z]\*", t) or not re.fullmatch(r"[a-z*@$!|'’013457]+", t):
            return ""
        shape = re.compile("".join("[a-z]" if c == "*" else re.escape(c.translate(_LEET)) for c in t) + r"\Z")
        return next((w for w in _UNMASKABLE if shape.match(w)), t.replace("*", "") + "*")
    if not t.replace("'", "").replace("’", "").isalpha():
        if "_" in t or not (_INNER_DIGIT.search(t) or re.search(r"[@$!|]", t)) or not re.search(r"[a-z]", t):
            return ""
        t = t.translate(_LEET)
        if not t.isalpha():
            return ""
    return _LONG.sub(r"\1", t).replace("’", "'")


def tokens_of(text: str) -> list[str]:
    """Raw tokens of a folded text, among them the ends of sentences."""
    return (_TOKEN_ASCII if text.isascii() else _TOKEN).findall(text)


def joined(text: str) -> str:
    """Letters set apart, as in "i d i o t", joined."""
    return _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), text)


def set_apart(texts: list[str]) -> np.ndarray:
    """Which texts may have letters set apart: a quick test of all at once."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    b = np.frombuffer(("\n".join(texts) + "\n").encode("ascii", "replace"), np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b == 63)  # other letters come as question marks
    gap = ~letter | (b == 63)
    single = np.zeros(len(b) + 1, bool)
    single[1 : len(b) - 1] = letter[1:-1] & gap[:-2] & gap[2:]
    if len(b) > 1:
        single[0] = letter[0] & gap[1]
    run = single[:-7] & single[2:-5] & single[4:-3] & single[6:-1] if len(single) > 7 else np.zeros(0, bool)
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, np.flatnonzero(run), "right")] = True
    return out


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a text, without those of identifiers."""
    out: list[list[str]] = [[]]
    for t in tokens_of(joined(folded(_CAMEL.sub(" ", without_markup(text))))):
        if t in ".!?\n":
            if out[-1]:
                out.append([])
        elif w := spelled(t):
            out[-1].append(w)
    return out if out[-1] else out[:-1]


_GROUP_PARTS = [g.split() for g in _GROUP_WORDS]
_BITS = {k: 1 << i for i, k in enumerate(KINDS)}
_WORD_BITS: dict[str, int] = {}
for _w, _cs in _CATEGORY.items():
    _WORD_BITS[_w] = sum(_BITS[c] for c in _cs)
for _g in _GROUP_PARTS:
    if len(_g) == 1:
        _WORD_BITS[_g[0]] = _WORD_BITS.get(_g[0], 0) | _BITS["group"]
_GROUP_PAIRS = {(g[0], g[1]) for g in _GROUP_PARTS if len(g) == 2}


def bits_of(tokens: list[str]) -> int:
    """Kinds of words that a sentence has, as bits."""
    out = 0
    for t in tokens:
        out |= _WORD_BITS.get(t, 0) | (_BITS["masked"] if t[-1] == "*" else 0)
    if any(p in _GROUP_PAIRS for p in zip(tokens, tokens[1:])):
        out |= _BITS["group"]
    return out


def bit_features(bits: int) -> list[str]:
    """Kinds, and pairs of a kind with 'you' or a group."""
    kinds = [k for k in KINDS if bits & _BITS[k]]
    out = [f"#{k}" for k in kinds if k != "group"]
    for with_ in ("you", "group"):
        if bits & _BITS[with_]:
            out += [f"#{with_} {k}" for k in kinds if k not in ("you", "group")]
    return out


def features(tokens: list[str]) -> list[str]:
    """Words and pairs of neighbours, as often as they occur, and kinds of words."""
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:])), *bit_features(bits_of(tokens))]


def scale(n_tokens: int) -> float:
    return 1 / math.sqrt(2 * max(2, n_tokens))


def sums(values: np.ndarray, starts: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, placed at ``at`` in an array of ``n``."""
    out = np.zeros(n)
    if len(starts):
        out[at] = np.add.reduceat(values, starts)
    return out


class Rows:
    """Sparse rows with values, as flat arrays in the order of rows and of columns.

    Takes the columns of each row, and a value for each row or each entry.
    """

    def __init__(self, columns: list[list[int]], values: list):
        self.n = len(columns)
        lengths = np.array([len(c) for c in columns], np.int64)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.col = np.fromiter(itertools.chain.from_iterable(columns), np.int64, int(lengths.sum()))
        each = values and isinstance(values[0], np.ndarray)
        self.value = np.concatenate(values) if each else np.repeat(np.asarray(values, np.float64), lengths)
        self.filled = np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.filled]
        order = np.argsort(self.col, kind="stable")
        self.by_column, self.row_of, self.value_of = order, self.row[order], self.value[order]
        self.columns, self.column_starts = np.unique(self.col[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sums(self.value * w[self.col], self.starts, self.n, self.filled)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return sums(self.value_of * g[self.row_of], self.column_starts, size, self.columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Classifier:
    """Weights by feature; see the module's text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._vocabulary: dict[str, int] | None = None

    # Fitting

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], counterfactual: float = COUNTERFACTUAL) -> Classifier:
        """Classifier of texts with labels 0 and 1; ``counterfactual`` weighs what swapped names change."""
        bags: list[list[int]] = []
        known: dict[tuple[str, ...], int] = {}
        for t in texts:
            bags.append(sorted({known.setdefault(tuple(s), len(known)) for s in sentences(t)}))
        if not known or len(set(labels)) < 2:
            return cls({}, -20.0)
        index: dict[str, int] = {}
        seen: dict[str, int] = {}
        feats = [features(list(s)) for s in known]
        for f in feats:
            for x in set(f):
                seen[x] = seen.get(x, 0) + 1
        strong = {x for b, y in zip(bags, labels) if y for i in b for x in feats[i]}

        def number(x: str) -> int:
            return index.setdefault(x, len(index) + 1)

        # A pair of words must recur; a single word may be met once.
        columns = [[0, *(number(g) for g in f if seen[g] > 1 or (g in strong and " " not in g))] for f in feats]
        x = Rows(columns, [np.r_[1.0, np.full(len(c) - 1, scale(len(s)))] for s, c in zip(known, columns)])
        pairs = cls._swapped(list(known), number)
        size = len(index) + 1
        y = np.array(labels)
        w = np.zeros(size)
        w[0] = -3
        # At first a positive document's sentences share its label, weighed by
        # how much more often their features stand in positive documents.
        part = cls._first_weights(x, bags, y)
        marked = cls._marked(list(known), bags, y)
        for turn in range(ROUNDS):
            target, weight = np.zeros(x.n), np.zeros(x.n)
            score = part if turn == 0 else x.dot(w)
            for b, positive in zip(bags, y):
                if not b:
                    continue
                if not positive:
                    for i in b:
                        weight[i] += 1
                        if turn > 1 and score[i] > 2:
                            weight[i] -= 0.7  # likely an error of the reviewer
                    continue
                b = [i for i in b if marked[i]]
                if not b:
                    continue  # nothing but everyday words: an error of the reviewer
                best = b[int(np.argmax(score[b]))]
                if turn > 1 and score[best] < -1.5:
                    continue  # no sentence supports the label
                chosen = {best} | ({i for i in b if score[i] > 1} if turn > 1 else set())
                for i in chosen:
                    target[i] += 1
                    weight[i] += 1
            y_hat = np.divide(target, weight, out=np.zeros(x.n), where=weight > 0)
            weight = np.where(y_hat > 0, 3.0, 1.0) * np.minimum(weight, 3)
            w = cls._descend(x, np.minimum(y_hat, 1), weight, pairs, w, size, counterfactual)
        names = {v: k for k, v in index.items()}
        return cls({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3) if i}, float(w[0]))

    @staticmethod
    def _marked(known: list[tuple[str, ...]], bags: list[list[int]], y: np.ndarray) -> list[bool]:
        """Whether a sentence has a word that is rare in documents labelled harmless."""
        common: dict[str, int] = {}
        for b, positive in zip(bags, y):
            if not positive:
                for w in {w for i in b for w in known[i]}:
                    common[w] = common.get(w, 0) + 1
        most = max(LEAST_EVERYDAY, EVERYDAY * float(len(y) - y.sum()))
        return [any(common.get(w, 0) <= most for w in s) for s in known]

    @staticmethod
    def _first_weights(x: Rows, bags: list[list[int]], y: np.ndarray) -> np.ndarray:
        size = int(x.col.max()) + 1
        by_row: list[np.ndarray] = np.split(x.col, np.cumsum(np.bincount(x.row, minlength=x.n))[:-1])
        count = np.zeros((2, size))
        for b, positive in zip(bags, y):
            if b:
                count[int(positive), np.unique(np.concatenate([by_row[i] for i in b]))] += 1
        rate = np.log((count[1] + 0.2) / (y.sum() + 1)) - np.log((count[0] + 0.2) / (len(y) - y.sum() + 1))
        rate[0] = 0
        rate = np.where(count.sum(0) < 2, np.minimum(rate, 0.5), rate)
        return x.dot(rate)

    @staticmethod
    def _swapped(known: list[tuple[str, ...]], number) -> Rows:
        """Differences of features between sentences and their counterfactuals."""
        rng = np.random.default_rng(11)
        columns, values = [], []
        for s in known:
            text = " ".join(s)
            m = _GROUP.search(text)
            if not m:
                continue
            own = [number(f) for f in features(list(s))]
            for g in rng.choice(_GROUP_WORDS, SWAPS, replace=False):
                swapped = (text[: m.start()] + str(g) + text[m.end() :]).split()
                other = [number(f) for f in features(swapped)]
                columns.append(own + other)
                values.append(np.r_[np.full(len(own), scale(len(s))), np.full(len(other), -scale(len(swapped)))])
        return Rows(columns, values)

    @staticmethod
    def _descend(x: Rows, y: np.ndarray, weight: np.ndarray, pairs: Rows, w: np.ndarray, size: int, counterfactual: float) -> np.ndarray:
        w = w.copy()
        first, second = np.zeros(size), np.zeros(size)
        total = weight.sum()
        for t in range(1, STEPS + 1):
            g = x.back(weight * (sigmoid(x.dot(w)) - y), size) / total
            if pairs.n:
                g += counterfactual * pairs.back(pairs.dot(w), size) / pairs.n
            ridge = RIDGE / total * w
            ridge[0] = 0
            g += ridge
            first = 0.9 * first + 0.1 * g
            second = 0.99 * second + 0.01 * g * g
            w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return w

    # Scoring

    def sentence_score(self, words: list[str]) -> float:
        return self.bias + sum(self.weights.get(x, 0.0) for x in features(words)) * scale(len(words))

    def score(self, text: str) -> float:
        """Probability for the worst sentence; 0 for a text without words."""
        s = [self.sentence_score(t) for t in sentences(text)]
        return float(sigmoid(np.array(max(s)))) if s else 0.0


class Tables(dict):
    """The classifier as arrays, to score many texts at once.

    As a dictionary it numbers raw tokens; it fills itself as tokens turn up.
    """

    DROP, STOP, TEXT, UNKNOWN, MASKED = -1, 0, 1, 2, 3
    MOST = 500_000

    def __init__(self, c: Classifier):
        self.bias = c.bias
        words = {w for f in c.weights if f[0] != "#" for w in f.split()} | set(_WORD_BITS) | {w for p in _GROUP_PAIRS for w in p}
        self.number = {w: i for i, w in enumerate(sorted(words), 4)}
        n = self.n = len(words) + 4
        self.word, self.bit = np.zeros(n), np.zeros(n, np.int64)
        pairs: dict[int, float] = {}
        for f, w in c.weights.items():
            a, _, b = f.partition(" ")
            if f[0] == "#":
                continue
            if b:
                pairs[self.number[a] * n + self.number[b]] = w
            else:
                self.word[self.number[a]] = w
        for w, b in _WORD_BITS.items():
            self.bit[self.number[w]] = b
        self.bit[self.MASKED] = _BITS["masked"]
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_weight = np.array([pairs[p] for p in sorted(pairs)])
        self.group_pair = np.array(sorted(self.number[a] * n + self.number[b] for a, b in _GROUP_PAIRS), np.int64)
        self.kinds = np.array([sum(c.weights.get(f, 0.0) for f in bit_features(b)) for b in range(1 << len(KINDS))])

    def __missing__(self, token: str) -> int:
        if token in (".", "!", "?", "\n"):
            out = self.STOP
        elif not (w := spelled(token)):
            out = self.DROP
        else:
            out = self.number.get(w, self.MASKED if w[-1] == "*" else self.UNKNOWN)
        if len(self) >= self.MOST:
            self.clear()
        self[token] = out
        return out

    def _hits(self, table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
        j = np.minimum(np.searchsorted(table, code), len(table) - 1)
        return table[j] == code, j

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        plain = [folded(_CAMEL.sub(" ", without_markup(t))) for t in texts]  # as in sentences()
        for i in np.flatnonzero(set_apart(plain)):
            plain[i] = joined(plain[i])
        ids: list[int] = []
        for t in plain:
            ids += map(self.__getitem__, tokens_of(t))
            ids.append(self.TEXT)
        x = np.array(ids, np.int64)
        x = x[x != self.DROP]
        stop = x <= self.TEXT
        sentence = np.cumsum(stop) - stop  # a stop closes its sentence
        n = int(sentence[-1]) + 1
        size = np.bincount(sentence, ~stop, n)
        total = np.bincount(sentence, self.word[x], n)
        at = np.flatnonzero((x[:-1] > self.MASKED) & (x[1:] > self.MASKED))
        code = x[at] * self.n + x[at + 1]
        hit, j = self._hits(self.pair, code)
        total += np.bincount(sentence[at[hit]], self.pair_weight[j[hit]], n)
        bits = np.zeros(n, np.int64)
        has = np.flatnonzero(self.bit[x])
        np.bitwise_or.at(bits, sentence[has], self.bit[x[has]])
        bits[sentence[at[self._hits(self.group_pair, code)[0]]]] |= _BITS["group"]
        score = np.where(size > 0, self.bias + (total + self.kinds[bits]) / np.sqrt(2 * np.maximum(size, 2)), -np.inf)
        ends = sentence[x == self.TEXT]
        worst = np.maximum.reduceat(score, np.concatenate([[0], ends[:-1] + 1]))
        return np.where(np.isfinite(worst), sigmoid(worst), 0.0)


# Spark

SCORES = "doc_id long, source string, score double"


def reviewed_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` reviewed documents.

    Several opinions on a document are averaged; equal numbers for and against
    leave it out, as do null labels and null texts. Repeated rows count once.
    """
    sample = (
        labels.select("doc_id", "reviewer", "toxic", "labelled_at").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").distinct()
        .groupBy("doc_id").agg(F.avg("toxic").alias("y")).filter("y <> 0.5")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").collect()
    rows = sorted({(r.doc_id, r.text, r.y) for r in rows})
    return [r[1] for r in rows], [int(r[2] > 0.5) for r in rows]


def _scoring(model: Classifier):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = Tables(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "score": tables.scores(f.text.tolist())})

    return run


def scored(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """Score of every document: doc_id, source, score (0 to 1), flagged.

    Null and empty texts have score 0. Each row of ``documents`` gives one row.
    Without labels of both kinds nothing is learned and every score is 0.
    """
    arrow_batches(documents.sparkSession, 1000)
    model = Classifier.fit(*reviewed_sample(documents, labels, most))
    rows = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(_scoring(model), SCORES).withColumn("flagged", F.col("score") >= threshold)


def rates(scores: DataFrame) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    return scores.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("flagged_share"))

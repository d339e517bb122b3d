"""Language identification with a linear-chain conditional random field (operator 5).

Words are labelled with languages: affix, character n-gram and lexicon features score each
word, learned transitions tie neighbours together, and forward-backward gives every word's
posterior, so that code-switched text is labelled word by word. A document's language is
the one with the most posterior mass, weighted by letters; the score is its share.

The model is fitted on the driver from a bounded sample of labelled rows: at most ``PER_LANG``
documents of each of the ``LANGS`` most frequent languages, chosen by hash, whole texts.
Runs of words of different languages are spliced, so transitions see code-switching. Prediction
reads whole texts, all of them.

Defined results: null text, or text without a letter: ``und``, score 0. Words without a
letter carry no evidence. An empty training set learns no language: everything is ``und``.
Rows with equal texts get equal results.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.base import append_arrow, held, quoted

PER_LANG = 120
LANGS = 256
DIMS = 1 << 15
LEXICON = 400
UND = "und"
#: Letters of a word at most; a longer run, as of text without spaces, is cut into several words.
LONGEST = 40
#: Word types a worker remembers before it starts anew; bounds memory, never results.
CACHE = 150_000
#: Cells (texts x longest) of one forward-backward batch.
CELLS = 200_000


def clean(token: str) -> str:
    """The letters of a token, in lower case."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token.lower()))


def tokens_of(text: str) -> list[str]:
    """White-space tokens, all letters in order; one of more than ``LONGEST`` letters becomes consecutive words of its letters."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= LONGEST:
        return tokens
    out = []
    for t in tokens:
        if len(t) <= LONGEST:
            out.append(t)
        elif len(own := clean(t)) <= LONGEST:
            out.append(own or "-")  # what it has beside letters is no evidence, and may be long
        else:
            out += [own[i : i + LONGEST] for i in range(0, len(own), LONGEST)]
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of non-empty words, as (feature, word number) pairs.

    Character 2- and 3-grams with the word's ends marked, and the 4-grams that touch an end
    (affixes). Computed on code points, all words at once.
    """
    line = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(line.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    start = np.cumsum([0] + [len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), np.diff(start))
    ends = start[1:][owner]
    first = np.arange(len(c)) == start[:-1][owner]
    out, at = [], []
    h = c.copy()
    for n in (2, 3, 4):
        h = h[:-1] * 1_000_003 + c[n - 1 :]
        own = np.arange(len(h)) + n <= ends[: len(h)]
        if n == 4:
            own &= first[: len(h)] | (np.arange(len(h)) + n == ends[: len(h)])
        x = h[own] ^ n
        x = (x ^ (x >> 29)) * 0x2545F4914F6CDD1
        out.append(((x >> 24) ^ x) & (DIMS - 1))
        at.append(owner[: len(h)][own])
    return np.concatenate(out), np.concatenate(at)


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # (DIMS + lexicon features, languages)
    trans: np.ndarray  # (languages, languages), log potentials
    lexicon: dict[str, int]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word (none where it is empty): hashed features scaled by their number, and its lexicon feature."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        for i in range(0, len(words), 20_000):
            own = np.array([i + j for j, w in enumerate(words[i : i + 20_000]) if w], dtype=np.int64)
            if len(own):
                feats, at = grams([words[j] for j in own])
                n = np.bincount(at, minlength=len(own))
                for j in range(len(self.langs)):
                    out[own, j] = np.bincount(at, self.emit[feats, j], len(own)) / np.sqrt(n)
        lex = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out[lex >= 0] += self.emit[DIMS + lex[lex >= 0]]
        return out


def posteriors(score: np.ndarray, mask: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over a batch: score (steps, n, langs), mask (steps, n), a prefix of each column.

    Gives the marginals (0 where masked) and, if asked for, the expected transitions (langs, langs).
    """
    steps, n, k = score.shape
    move = np.exp(trans - trans.max()).astype(np.float32)
    back = np.ascontiguousarray(move.T)
    e = np.exp(score - score.max(axis=2, keepdims=True))
    ones = np.ones((k, k), np.float32)
    ahead, behind = np.empty_like(e), np.empty_like(e)
    a = ahead[0] = e[0] / (e[0] @ ones)
    for t in range(1, steps):
        a = a @ move
        a *= e[t]
        a /= a @ ones
        ahead[t] = a
    live = mask.sum(axis=1)  # sorted or not, how many columns go on at each step
    b = behind[steps - 1] = np.ones((n, k), np.float32)
    for t in range(steps - 1, 0, -1):
        b = (b * e[t]) @ back
        b /= b @ ones
        if live[t] < n:
            b[~mask[t]] = 1  # nothing follows the last word
        behind[t - 1] = b
    post = ahead * behind
    post /= post.sum(axis=2, keepdims=True)
    post[~mask] = 0
    if not pairs:
        return post, None
    w = e[1:] * behind[1:]
    z = ((ahead[:-1] @ move) * w).sum(axis=2, keepdims=True)
    w = np.where(mask[1:, :, None], w / np.maximum(z, 1e-30), 0)
    return post, np.tensordot(ahead[:-1], w, axes=((0, 1), (0, 1))) * move


def fit(rows: list[tuple[str, str]], steps: int = 40, rate: float = 0.5, decay: float = 1e-4, seed: int = 42) -> Crf:
    """A field from (passage, language) rows, by AdaGrad on the conditional likelihood of spliced word sequences."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.RandomState(seed)
    runs: list[tuple[int, list[str]]] = []
    counts: list[dict[str, int]] = [{} for _ in langs]
    for text, lang in rows:
        words = [w for w in map(clean, tokens_of(text)) if w]
        for w in words:
            counts[number[lang]][w] = counts[number[lang]].get(w, 0) + 1
        at = 0
        while at < len(words):
            size = int(rng.randint(4, 25))
            runs.append((number[lang], words[at : at + size]))
            at += size
    lexicon: dict[str, int] = {}
    for own in counts:
        for w in sorted(own, key=lambda x: (-own[x], x))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    crf = Crf(langs, np.zeros((DIMS + len(lexicon), k), np.float32), np.zeros((k, k), np.float32), lexicon)
    if not runs:
        return crf
    order = rng.permutation(len(runs))
    seqs, at = [], 0
    while at < len(order):  # one to three runs, of whatever language, make a sequence
        size = int(rng.randint(1, 4))
        seqs.append([runs[i] for i in order[at : at + size]])
        at += size
    types: dict[str, int] = {}
    width = max(sum(len(r[1]) for r in s) for s in seqs)
    ids, gold = np.zeros((width, len(seqs)), np.int64), np.full((width, len(seqs)), -1)
    for i, s in enumerate(seqs):
        t = 0
        for lang, words in s:
            for w in words:
                ids[t, i], gold[t, i] = types.setdefault(w, len(types)), lang
                t += 1
    mask = gold >= 0
    words = list(types)
    flat, owner = grams(words)
    scale = 1 / np.sqrt(np.bincount(owner, minlength=len(words)))
    lex = np.array([lexicon.get(w, -1) for w in words])
    pairs_gold = np.zeros((k, k))
    np.add.at(pairs_gold, (gold[:-1][mask[1:]], gold[1:][mask[1:]]), 1)
    seen, seen_t, total = np.zeros_like(crf.emit), np.zeros((k, k)), mask.sum()
    for _ in range(steps):
        score = np.empty((len(words), k), np.float32)
        for j in range(k):
            score[:, j] = np.bincount(owner, crf.emit[flat, j], len(words)) * scale
        score[lex >= 0] += crf.emit[DIMS + lex[lex >= 0]]
        post, pairs = posteriors(score[ids], mask, crf.trans, pairs=True)
        diff = -post
        at = np.nonzero(mask)
        diff[at[0], at[1], gold[at]] += 1
        grad = np.zeros_like(crf.emit)
        for j in range(k):
            by_type = np.bincount(ids[mask], diff[..., j][mask], len(words))
            grad[:DIMS, j] = np.bincount(flat, (by_type * scale)[owner], DIMS)
            grad[DIMS:, j] = np.bincount(lex[lex >= 0], by_type[lex >= 0], len(lexicon))
        grad = grad / total * 100 - decay * crf.emit
        move = (pairs_gold - pairs) / total * 100
        seen += grad**2
        seen_t += move**2
        crf.emit += (rate * grad / np.sqrt(seen + 1e-8)).astype(np.float32)
        crf.trans += (rate * move / np.sqrt(seen_t + 1e-8)).astype(np.float32)
    return crf


def training_rows(df: DataFrame, text: str, lang: str, key: str, per_lang: int = PER_LANG, langs: int = LANGS) -> list[tuple[str, str]]:
    """The bounded sample, by hash of the key: ``per_lang`` rows of each of the ``langs`` most frequent languages, whole texts."""
    own = df.where(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(
        quoted(lang).alias("lang"), quoted(text).alias("text"), F.xxhash64(quoted(key).cast("string"), F.lit(7)).alias("h")
    )
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    # A first draw of half as many again by hash, so that only it is ranked.
    share = F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("n"))
    near = own.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    w = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    drawn = near.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_lang)
    return [(r["text"], r["lang"]) for r in drawn.select("text", "lang", "__rank").orderBy("lang", "__rank").collect()]


class Tagger:
    """Labels texts; remembers word types up to a bound."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self._reset()

    def _reset(self):
        self.table = np.zeros((4096, len(self.crf.langs)), np.float32)
        self.weight = np.zeros(4096, np.float32)
        self.at = _Types()
        self.done = 0

    def _learn(self):
        fresh = self.at.fresh
        if not fresh:
            return
        self.at.fresh = []
        words = [clean(w) for w in fresh]
        end = self.done + len(words)
        while end > len(self.table):
            self.table, self.weight = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.weight, np.zeros_like(self.weight)])
        self.table[self.done : end] = self.crf.scores(words)
        self.weight[self.done : end] = [len(w) for w in words]
        self.done = end

    def marginals(self, many: list[str]):
        """Yields, for each text: its number, posteriors of the tokens that have letters, and these tokens' letters."""
        if len(self.at) > CACHE:
            self._reset()
        ids = [np.array(list(map(self.at.__getitem__, tokens_of(t))), np.int32) for t in many]
        self._learn()
        ids = [x[self.weight[x] > 0] for x in ids]
        order = sorted(range(len(many)), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * max(1, len(ids[order[end]])) <= CELLS:
                end += 1
            group = order[at:end]
            at = end
            width = len(ids[group[-1]])
            if not width:
                yield from ((i, np.zeros((0, len(self.crf.langs)), np.float32), self.weight[:0]) for i in group)
                continue
            padded, mask = np.zeros((width, len(group)), np.int32), np.zeros((width, len(group)), bool)
            for r, i in enumerate(group):
                padded[: len(ids[i]), r], mask[: len(ids[i]), r] = ids[i], True
            post = posteriors(self.table[padded], mask, self.crf.trans)[0]
            for r, i in enumerate(group):
                yield i, post[: len(ids[i]), r], self.weight[ids[i]]

    def label(self, many: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.crf.langs:
            return [UND] * len(many), [0.0] * len(many)
        names, scores = [UND] * len(many), [0.0] * len(many)
        for i, post, weight in self.marginals([t or "" for t in many]):
            if len(weight):
                mass = weight @ post
                best = int(np.argmax(mass))
                names[i], scores[i] = self.crf.langs[best], min(1.0, float(mass[best] / mass.sum()))
        return names, scores


class _Types(dict):
    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = i = len(self)
        self.fresh.append(token)
        return i


def identify(df: DataFrame, crf: Crf, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` (string) and ``score`` (double, 0 to 1) to every row. One Arrow pass, no shuffle; the model's size is fixed."""
    shared, name = df.sparkSession.sparkContext.broadcast(crf), uuid.uuid4().hex

    def make():
        tagger = held(("langid", name), lambda: Tagger(shared.value))

        def work(column):
            names, scores = tagger.label(column.to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return append_arrow(df, [text], make, [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())], keep)


def held_out(key: str = "doc_id"):
    """Rows never learned from: crc32 of the key's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))

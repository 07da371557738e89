"""Language identification with a linear-chain conditional random field.

Words carry affix, character n-gram and lexicon features; transitions between the labels of neighbouring
words are learned with them. Forward-backward gives every word its label probabilities, so that
code-switched texts are labelled word by word; a document's language is the one with the largest
expected share of words.

Training sees every language: at most ``DOCUMENTS_A_LANGUAGE`` documents of each and about ``MOST_DOCUMENTS`` in all (one
of each language at least), chosen by a hash of the id, and from each at most ``WORDS_A_DOCUMENT`` words out of
``WINDOW`` characters at a place that a hash gives; spans of them are joined into sequences that switch language. Only
text and label are used.

Defined cases: a null text, or one without letters, has the language ``und`` and score 0; so has every text
if there is nothing to learn from; texts are read whole, the words of a batch laid out in rows of a
fixed length whose transfer matrices are multiplied up, so a very long text costs no more per word; texts are
taken together up to ``MATRICES`` matrix entries, and a longer text alone takes the square of the languages for each row;
ties go to the first language in order; repeated rows give repeated results; an empty table gives an
empty one; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, map_texts, written

DOCUMENTS_A_LANGUAGE, MOST_DOCUMENTS, WORDS_A_DOCUMENT, WINDOW = 250, 20_000, 200, 8_000
MATRICES = 2_000_000
DIMENSIONS, SEQUENCES, LENGTH, EPOCHS, ROW = 1 << 16, 3000, 40, 3, 64
WORD_CACHE, CHUNK_CACHE = 300_000, 300_000
NOT_LETTERS = re.compile(r"[\W\d_]+")


def bare(chunk: str) -> str:
    """The letters of a white-space delimited chunk in lower case."""
    return (chunk if chunk.isalpha() else NOT_LETTERS.sub("", chunk)).lower()


def feature_ids(word: str) -> list[int]:
    """Hashed affixes, all n-grams and, if it isn't long, the word itself."""
    w = f"^{word}$"
    parts = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3, 4)]
    parts += [w[i : i + 3] for i in range(len(w) - 2)]
    if len(word) <= 20:
        parts.append(f"w{word}")
    return [zlib.crc32(p.encode()) % DIMENSIONS for p in parts]


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # feature, language
    moves: np.ndarray  # language before, language
    lexicon: dict[str, int]
    lexicon_weight: np.ndarray

    def emission(self, word: str) -> np.ndarray:
        out = self.weights[feature_ids(word)].sum(0)
        if (known := self.lexicon.get(word)) is not None:
            out[known] += self.lexicon_weight[known]
        return out


class Emissions:
    """Chunk -> row of a growing table of word potentials; both forget everything when full."""

    def __init__(self, crf: Crf):
        self.crf, self.table, self.rows, self.chunks = crf, np.ones((1024, len(crf.languages))), {}, {}
        self.used = 0

    def row(self, chunk: str) -> int:
        """-1 for a chunk without letters."""
        word = bare(chunk)
        if not word:
            at = -1
        elif (at := self.rows.get(word)) is None:
            e = self.crf.emission(word)
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.ones_like(self.table)])
            self.table[self.used] = np.exp(np.maximum(e - e.max(), -30))
            at, self.used = self.used, self.used + 1
            if len(word) <= 64:
                self.rows[word] = at
        if len(chunk) <= 64:
            self.chunks[chunk] = at
        return at

    def rows_of(self, text: str) -> np.ndarray:
        get, own = self.chunks.get, self.row
        found = [own(c) if (r := get(c)) is None else r for c in text.split()]
        out = np.array(found, np.int64)
        return out[out >= 0]

    def fresh(self) -> None:
        """Between batches only, as rows already handed out would lose their meaning."""
        if self.used > WORD_CACHE or len(self.chunks) > CHUNK_CACHE:
            self.rows.clear()
            self.chunks.clear()
            self.used, self.table = 0, np.ones((1024, len(self.crf.languages)))


def shares(moves: np.ndarray, table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """For each text (rows of the potentials of its words; at least one) the mean label probabilities."""
    most = max(1, MATRICES // len(moves) ** 2)
    out, own, rows = [], [], 0
    for text in texts:
        if own and rows + len(text) // ROW + 1 > most:
            out.append(shares_together(moves, table, own))
            own, rows = [], 0
        own.append(text)
        rows += len(text) // ROW + 1
    return np.concatenate([*out, shares_together(moves, table, own)])


def shares_together(moves: np.ndarray, table: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    n = len(moves)
    step = np.exp(moves - moves.max())
    counts = np.array([len(t) for t in texts])
    rows = -(-counts // ROW)
    first = np.concatenate([[0], np.cumsum(rows)])
    total = int(first[-1])
    grid, real = np.zeros(total * ROW, np.int64), np.zeros(total * ROW, bool)
    for t, f in zip(texts, first):
        grid[f * ROW : f * ROW + len(t)] = t
        real[f * ROW : f * ROW + len(t)] = True
    potentials = np.ones((total * ROW, n))
    potentials[real] = table[grid[real]]
    e, real = potentials.reshape(total, ROW, n), real.reshape(total, ROW)
    full = real.all(0)

    product = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for t in range(ROW):
        new = (product.reshape(-1, n) @ step).reshape(total, n, n) * e[:, t, None, :]
        product = new if full[t] else np.where(real[:, t, None, None], new, product)
        if t % 4 == 3:
            product /= product.max((1, 2), keepdims=True)

    before, after = np.ones((total, n)), np.ones((total, n))
    for k in range(1, int(rows.max(initial=1))):
        at = first[:-1][rows > k] + k
        v = np.einsum("rn,rnm->rm", before[at - 1], product[at - 1])
        before[at] = v / v.max(1, keepdims=True)
        at = first[1:][rows > k] - k
        v = np.einsum("rnm,rm->rn", product[at], after[at])
        after[at - 1] = v / v.max(1, keepdims=True)

    ahead, a = np.empty((total, ROW, n)), before
    for t in range(ROW):
        new = (a @ step) * e[:, t]
        new /= new.max(1, keepdims=True)
        a = new if full[t] else np.where(real[:, t, None], new, a)
        ahead[:, t] = a
    back, sums = after, np.zeros((total, n))
    for t in range(ROW - 1, -1, -1):
        p = ahead[:, t] * back
        p /= p.sum(1, keepdims=True)
        new = (e[:, t] * back) @ step.T
        new /= new.max(1, keepdims=True)
        if full[t]:
            sums += p
            back = new
        else:
            sums += np.where(real[:, t, None], p, 0)
            back = np.where(real[:, t, None], new, back)
    return np.add.reduceat(sums, first[:-1], axis=0) / counts[:, None]


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Crf | None:
    """Maximum likelihood by adaptive gradient steps on sequences joined from the (language, text) rows."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    spans: list[list[list[str]]] = [[] for _ in languages]
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        words = [w for c in text.split() if (w := bare(c))]
        if len(words) > WORDS_A_DOCUMENT:
            at = int(rng.integers(len(words) - WORDS_A_DOCUMENT + 1))
            words = words[at : at + WORDS_A_DOCUMENT]
        if words:
            spans[languages.index(lang)].append(words)
            for w in words:
                counts.setdefault(w, Counter())[lang] += 1
    having = [i for i, s in enumerate(spans) if s]
    if not having:
        return None
    lexicon = {}
    for w, c in counts.items():
        lang, most = max(c.items(), key=lambda x: (x[1], x[0]))
        if most >= 3 and most >= 0.8 * sum(c.values()):
            lexicon[w] = languages.index(lang)
    n = len(languages)
    weights, moves, known = np.zeros((DIMENSIONS, n)), np.zeros((n, n)), np.zeros(n)
    sums = [np.full_like(x, 1e-6) for x in (weights, moves, known)]
    ids: dict[str, np.ndarray] = {}
    words, gold = [], np.zeros((SEQUENCES, LENGTH), int)
    for s in range(SEQUENCES):
        own: list[str] = []
        lang = having[int(rng.integers(len(having)))]
        while len(own) < LENGTH:
            if own and rng.random() < 0.6:
                lang = having[int(rng.integers(len(having)))]
            span = spans[lang][int(rng.integers(len(spans[lang])))]
            at, size = int(rng.integers(len(span))), int(rng.integers(4, 24))
            part = span[at : at + size][: LENGTH - len(own)]
            gold[s, len(own) : len(own) + len(part)] = lang
            own += part
        words.append(own)
        for w in own:
            if w not in ids:
                ids[w] = np.array(feature_ids(w))
    size = 60
    for _ in range(EPOCHS):
        for at in range(0, SEQUENCES, size):
            batch = words[at : at + size]
            y = gold[at : at + size]
            flat = [w for own in batch for w in own]
            features = [ids[w] for w in flat]
            joined = np.concatenate(features)
            starts = np.concatenate([[0], np.cumsum([len(f) for f in features])[:-1]])
            e = np.add.reduceat(weights[joined], starts, axis=0)
            lex = np.array([lexicon.get(w, -1) for w in flat])
            has = np.flatnonzero(lex >= 0)
            e[has, lex[has]] += known[lex[has]]
            e = e.reshape(len(batch), LENGTH, n)
            p, pairs = marginals(e, moves)
            truth = np.eye(n)[y]
            error = (truth - p).reshape(-1, n)
            gradient = np.zeros_like(weights)
            np.add.at(gradient, joined, np.repeat(error, [len(f) for f in features], axis=0))
            steps = (
                gradient - 1e-3 * weights * (gradient != 0),
                np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:]) - pairs,
                np.bincount(lex[has], error[has, lex[has]], n),
            )
            for x, g, total in zip((weights, moves, known), steps, sums):
                total += g * g
                x += 0.3 * g / np.sqrt(total)
    return Crf(languages, weights, moves, lexicon, known)


def marginals(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each place, and the expected number of each move."""
    b, length, n = e.shape
    step = np.exp(moves - moves.max())
    e = np.exp(e - e.max(2, keepdims=True))
    ahead, back = np.empty_like(e), np.ones_like(e)
    a = np.ones((b, n))
    for t in range(length):
        a = (a @ step) * e[:, t]
        a /= a.sum(1, keepdims=True)
        ahead[:, t] = a
    for t in range(length - 2, -1, -1):
        x = (e[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] = x / x.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * step * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p, pair.sum((0, 1))


def held_out(id_column: Column) -> Column:
    """False for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(df: DataFrame, id_col: str, text_col: str, label_col: str) -> Crf | None:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    usable = df.where(
        F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    )
    label, text = F.col(label_col).alias("l"), F.col(text_col)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    found = written(usable.groupBy(label).count())
    languages = found.count()
    each = max(1, min(DOCUMENTS_A_LANGUAGE, MOST_DOCUMENTS // max(1, languages)))
    share = found.select("l", F.least(F.lit(1.0), F.lit(1.5 * each + 20) / F.col("count")).alias("share"))
    start = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), F.greatest(F.lit(1), F.length(text) - WINDOW + 1)).cast("int") + 1
    some = usable.select(
        label, place.alias("p"), F.col(id_col).cast("string").alias("i"), F.length(text).alias("n"), start.alias("at"), F.substr(text, start, F.lit(WINDOW)).alias("t")
    )
    # one row a language
    near = some.join(F.broadcast(share), "l").where(F.col("p") < F.col("share") * (1 << 30))
    first = Window.partitionBy("l").orderBy("p", "i", "t")
    picked = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each).orderBy("l", "k").collect()
    return fit([(r["l"], inner_words(r["t"], r["at"] > 1, r["at"] + WINDOW <= r["n"])) for r in picked])


def inner_words(text: str, cut_before: bool, cut_after: bool) -> str:
    """Without the words that the window cuts, if there are others."""
    chunks = text.split()
    if cut_before and len(chunks) > 2:
        chunks = chunks[1:]
    if cut_after and len(chunks) > 2:
        chunks = chunks[:-1]
    return " ".join(chunks)


def predict_languages(
    df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score, lang_shares). No shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by DIMENSIONS times the languages, and the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        emissions = None if crf is None else emissions_of(crf)
        types = {"l": pa.string(), "s": pa.float64(), "m": pa.map_(pa.string(), pa.float64())}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out: list[tuple] = [("und", 0.0, [])] * len(texts)
            if emissions is not None:
                emissions.fresh()
                rows = [emissions.rows_of(t or "") for t in texts]
                having = [i for i, r in enumerate(rows) if len(r)]
                if having:
                    mean = shares(crf.moves, emissions.table, [rows[i] for i in having])
                    for i, m in zip(having, mean):
                        best = int(m.argmax())
                        out[i] = (crf.languages[best], min(1.0, float(m[best])), list(zip(crf.languages, m.tolist())))
            yield batch_of(
                {"id": batch.column(0), "h": batch.column(1)} | dict(zip(types, map(list, zip(*out)))), types
            )

    return map_texts(
        df.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).alias("text")),
        run,
        f"id {id_type}, held_out boolean, lang_pred string, score double, lang_shares map<string,double>",
    ).withColumnRenamed("id", id_col)


READY: dict[int, Emissions] = {}


def emissions_of(crf: Crf) -> Emissions:
    mark = zlib.crc32(crf.weights.tobytes())
    if mark not in READY:
        READY.clear()
        READY[mark] = Emissions(crf)
    return READY[mark]


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    return predict_languages(df, learned(df, id_col, text_col, label_col), id_col, text_col)

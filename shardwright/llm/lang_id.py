"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over its letters (lower-cased, every run of other characters is one space).
The models are fitted on a bounded sample: about DOCS_PER_LANGUAGE labelled documents of each language, chosen by a hash
of id and text, of which a fifth is kept for calibration. The n-gram counts are a distributed aggregate, and a language's
model is made of them in one task; what comes to the driver, and goes to all workers, is bounded by the sample. A model
is sorted arrays of its own n-grams' hashes, one per order, with their log probabilities, and of its contexts with
their back-off; so all models together grow with the number of languages, not with its square. Of a slice of texts each
distinct n-gram is looked up once in every language.

A text gets the language of least cross-entropy per symbol. Its score is a softmax over the languages whose temperature
is fitted on the calibration documents. It is rejected if its cross-entropy is too far above the language's mean, given
its length. The limit is calibrated on documents that the models haven't seen: it is the geometric mean of the distance
that a share of KEPT of the language's documents (of all languages' where it has fewer than ENOUGH) don't reach, and the
one that all but FOREIGN of them are beyond with their symbols shuffled, which leaves the letters and no language.

Defined cases: a text that is null or has no letter is `und`, score 0, rejected; so is every text where nothing could
be learned; a null id is in the fold of the empty text; repeated rows are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm import kernel as K
from shardwright.llm.shared import written

ORDER = 4
DOCS_PER_LANGUAGE = 1000
KEPT = 0.995
FOREIGN = 0.05
ENOUGH = 50
UNKNOWN = "und"
_B = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """For each code point: its lower-case form if it is a letter, else a space."""
    if not _tables:
        t = np.full(0x110000, 0x20, np.uint32)
        for i in range(0x20000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        t[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
        _tables.append(t)
    return _tables[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (letters, and one space after each word) and the row of each."""
    texts = [t or "" for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    s = _lower()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)]
    letter = s != 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    return s[at], np.searchsorted(ends, at, "right")


def grams(s: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The last ORDER symbols at each place, as columns; before a text's start stand spaces."""
    out = np.full((len(s), ORDER), 0x20, np.uint32)
    out[:, -1] = s
    for k in range(1, ORDER):
        if len(s) > k:
            same = row[k:] == row[:-k]
            out[k:, ORDER - 1 - k] = np.where(same, s[:-k], 0x20)
    return out


def key(g: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.full(len(g), g.shape[1] + 1, np.uint64)
    for k in range(g.shape[1]):
        h = (h ^ g[:, k]) * _B
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@dataclass
class Language:
    """One model. By order: sorted hashes of n-grams and their log probabilities, of contexts and their back-off."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    def score(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of n-grams given by the hashes of their last 1, 2, ... symbols and of the contexts of these."""
        out = np.full(len(hashes[0]), self.floor, np.float32)
        for k in range(ORDER):
            own, value = _value(self.keys[k], self.logp[k], hashes[k])
            if k:
                known, back = _value(self.contexts[k], self.backoff[k], contexts[k])
                out[known] += back
            out[own] = value
        return out


def _value(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked are among the sorted keys, and their values."""
    if not len(keys):
        return np.zeros(0, np.int64), values
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    own = np.flatnonzero(keys[at] == asked)
    return own, values[at[own]]


@dataclass
class Model:
    languages: list[str]
    models: list[Language]
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    by_length: np.ndarray | None = None
    limit: np.ndarray | None = None

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol in each language, and the number of symbols, of each text."""
        s, row = symbols(texts)
        return self._entropies(s, row, len(texts)), np.bincount(row, minlength=len(texts))

    def _entropies(self, s: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        out, g = np.zeros((rows, len(self.languages))), grams(s, row)
        if not len(s):
            return out
        first, at, used, size = self._distinct(key(g))
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        full, n = row[begin], np.diff(np.append(begin, len(row)))
        value = np.zeros(size, np.float32)
        for k, logp in enumerate(self._logp(g[first]).T):
            value[used] = logp
            out[full, k] = -np.add.reduceat(value[at], begin, dtype=np.float64) / n
        return out

    def _distinct(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The place of one of each distinct hash; for each hash the number of its kind, of which only some are in use; which
        they are, and how many there could be. Those that any language has are told apart by a lookup, which is quicker
        than sorting them."""
        if "_known" not in self.__dict__:
            self._known = K.Lookup(np.unique(np.concatenate([m.keys[-1] for m in self.models])))
        at, size = self._known(h).astype(np.int32), len(self._known.keys)
        new = np.flatnonzero(at < 0)
        _, first, kind = np.unique(h[new], return_index=True, return_inverse=True)
        at[new] = size + kind
        place = np.full(size + len(first), -1, np.int32)
        place[at] = np.arange(len(at), dtype=np.int32)
        used = np.flatnonzero(place >= 0)
        return place[used], at, used, len(place)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def _logp(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row for each n-gram, a column for each language."""
        hashes = [key(g[:, ORDER - k :]) for k in range(1, order + 1)]
        contexts = [key(g[:, ORDER - k : -1]) for k in range(1, order + 1)]
        return np.stack([m.score(hashes, contexts) for m in self.models], 1)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in it and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        e, n = self.entropies(texts)
        best = np.argmin(e, 1)
        least = e[np.arange(len(e)), best]
        x = -self.temperature * (e - least[:, None]) * np.sqrt(n)[:, None]
        score = np.where(n > 0, 1 / np.exp(np.maximum(x, -700)).sum(1), 0.0)
        z = (least - self.mean[best]) / (self.spread[best] + self.by_length[best] / np.sqrt(np.maximum(n, 1)))
        return [self.languages[k] if m else UNKNOWN for k, m in zip(best, n)], score, least, (n == 0) | (z > self.limit[best])


def language_model(top: np.ndarray, count: np.ndarray, letters: int) -> Language:
    """The model of top-order n-grams (rows of code points) and their counts; letters: symbols that there are in all."""
    # the n-grams of every order with their counts: raw at the top, below it the number of distinct symbols before
    tops = {ORDER: (top, count)}
    for order in range(ORDER - 1, 0, -1):
        g = tops[order + 1][0]
        _, first, c = np.unique(key(g[:, 1:]), return_index=True, return_counts=True)
        tops[order] = g[first, 1:], c
    keys, logp, contexts, backoff = [], [], [], []
    lower_k, lower_p = np.zeros(0, np.int64), np.zeros(0)
    for order in range(1, ORDER + 1):
        g, c = tops[order]
        u = key(g)
        o = np.argsort(u)
        g, c, u = g[o], c[o].astype(np.float64), u[o]
        ctx_u, ctx = np.unique(key(g[:, :-1]), return_inverse=True)
        below = np.full(len(u), 1.0 / letters) if order == 1 else lower_p[np.searchsorted(lower_k, key(g[:, 1:]))]
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = np.bincount(ctx, c, len(ctx_u)), np.bincount(ctx, minlength=len(ctx_u))
        share = d * kinds / total
        p = np.maximum(c - d, 0) / total[ctx] + share[ctx] * below
        keys.append(u)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(ctx_u)
        backoff.append(np.log(np.maximum(share, 1e-12)).astype(np.float32))
        lower_k, lower_p = u, p
    # an unknown symbol: the unigrams' share for new ones
    return Language(keys, logp, contexts, backoff, float(-np.log(letters) + (backoff[0][0] if len(backoff[0]) else 0.0)))


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The models from each language's top-order n-grams (rows of code points) and their counts."""
    langs = sorted(counts)
    letters = len(np.unique(np.concatenate([counts[x][0] for x in langs]))) + 1 if langs else 1
    return Model(langs, [language_model(*counts[x], letters) for x in langs])


_MODEL = "lang string, part int, key long, value float"


def _fitted(letters: int):
    """The n-grams of one language (lang, a, b, n) to the rows of its model: parts 0 to ORDER - 1 are its n-grams by order,
    the next ORDER its contexts, the last its floor."""

    def run(rows: pa.Table) -> pa.Table:
        a, b, n = (rows[c].to_numpy() for c in ("a", "b", "n"))
        m = language_model(np.stack((a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF), 1).astype(np.uint32), n, letters)
        parts = [*zip(m.keys, m.logp), *zip(m.contexts, m.backoff), (np.zeros(1, np.int64), np.array([m.floor], np.float32))]
        part = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        lang = pa.array([rows["lang"][0].as_py()] * len(part), pa.string())
        return pa.table({"lang": lang, "part": part, "key": np.concatenate([k for k, _ in parts]), "value": np.concatenate([v for _, v in parts])})

    return run


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, a, b, n): packed n-grams and their numbers in the batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for x in sorted(set(langs)):
            s, row = symbols([texts[i] for i in np.flatnonzero(langs == x)])
            g = grams(s, row)
            _, first, c = np.unique(key(g), return_index=True, return_counts=True)
            g = g[first].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(c), pa.string()), pa.array(g[:, 0] << 21 | g[:, 1]), pa.array(g[:, 2] << 21 | g[:, 3]), pa.array(c)], ["lang", "a", "b", "n"])


def fit(docs: DataFrame, label: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """The models of all labels. docs: the rows to learn from."""
    docs = docs.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return kneser_ney({})
    # a row for each language is on the driver by now: no join, which would gather a language's texts
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 30).cast("long"))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, per_language / n) * (1 << 30)))))
    sample = docs.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit("part")), F.lit(5)) == 0).alias("apart"))
    sample = written(sample, "language-sample")
    found = sample.where("not apart").select("lang", "text").mapInArrow(K.lean(_gram_counts), "lang string, a long, b long, n long")
    found = written(found.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "language-grams")
    letter = F.explode(F.array(F.shiftright("a", 21), F.col("a").bitwiseAND(0x1FFFFF), F.shiftright("b", 21), F.col("b").bitwiseAND(0x1FFFFF)))
    letters = found.select(letter.alias("x")).distinct().count() + 1
    rows = found.groupBy("lang").applyInArrow(_fitted(letters), _MODEL).toArrow()  # the n-grams of the sample
    model = Model([], [])
    o = np.lexsort((rows["key"].to_numpy(), rows["part"].to_numpy(), (langs := rows["lang"].combine_chunks().dictionary_encode()).indices.to_numpy()))
    lang, part, k, v = langs.indices.to_numpy()[o], rows["part"].to_numpy()[o], rows["key"].to_numpy()[o], rows["value"].to_numpy()[o]
    for code in sorted(set(lang.tolist()), key=lambda c: langs.dictionary[c].as_py()):
        own = lang == code
        parts = [(k[own][part[own] == x], v[own][part[own] == x]) for x in range(2 * ORDER + 1)]
        model.languages.append(langs.dictionary[code].as_py())
        model.models.append(Language([x for x, _ in parts[:ORDER]], [y for _, y in parts[:ORDER]], [x for x, _ in parts[ORDER:-1]], [y for _, y in parts[ORDER:-1]], float(parts[-1][1][0])))
    return calibrated(model, sample.where("apart").select("lang", "text"))


def calibrated(model: Model, labelled: DataFrame) -> Model:
    """Temperature and rejection limit from documents that the model hasn't seen: a bounded sample too."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rng = batch.column(1).to_pylist(), np.random.default_rng(1)
            s, row = symbols(texts)
            shuffled = s[np.lexsort((rng.random(len(s)), row))]
            n = np.bincount(row, minlength=len(texts))
            flat = lambda e: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * e.shape[1]), pa.array(e.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), flat(shared.value._entropies(s, row, len(n))), flat(shared.value._entropies(shuffled, row, len(n)))], ["lang", "n", "e", "shuffled"])

    k = len(model.languages)
    model.mean, model.spread, model.by_length, model.limit = np.full(k, np.inf), np.full(k, 0.1), np.full(k, 2.0), np.full(k, np.inf)
    found = labelled.mapInArrow(K.lean(run), "lang string, n long, e array<double>, shuffled array<double>").where("n > 0").toArrow() if k else None
    if found is None or not found.num_rows:
        return model
    truth = np.array([model.languages.index(x) if x in model.languages else -1 for x in found["lang"].to_pylist()])
    n, e, other = found["n"].to_numpy(), np.array(found["e"].to_pylist()), np.array(found["shuffled"].to_pylist())
    n, e, other, truth = n[truth >= 0], e[truth >= 0], other[truth >= 0], truth[truth >= 0]
    least = e.min(1)

    def loss(t: float) -> float:
        x = -t * (e - least[:, None]) * np.sqrt(n)[:, None]
        return float(np.mean(np.log(np.exp(np.maximum(x, -700)).sum(1)) - x[np.arange(len(x)), truth]))

    model.temperature = min((2.0**i for i in range(-4, 6)), key=loss)
    z: list[np.ndarray] = [np.zeros(0)] * k
    for lang in range(k):
        own = (truth == lang) & (np.argmin(e, 1) == lang)
        if own.any():
            x, m = e[own, lang], n[own]
            model.mean[lang] = np.average(x, weights=np.minimum(m, 500))
            model.by_length[lang] = max(0.5, float(np.sqrt(np.mean((x - model.mean[lang]) ** 2 * np.minimum(m, 500)))))
            model.spread[lang] = max(0.02, float(np.std(x[m >= min(100, np.median(m))])))
            z[lang] = (x - model.mean[lang]) / (model.spread[lang] + model.by_length[lang] / np.sqrt(m))
    model.mean[np.isinf(model.mean)] = model.mean[~np.isinf(model.mean)].max() if (~np.isinf(model.mean)).any() else 0.0
    far = (other - model.mean) / (model.spread + model.by_length / np.sqrt(n)[:, None])
    every = np.concatenate(z)
    for lang in range(k):
        own = z[lang] if len(z[lang]) >= ENOUGH else every
        if len(own):
            kept, foreign = float(np.quantile(own, KEPT)), far[truth == lang, lang]
            model.limit[lang] = max(kept, np.sqrt(max(kept, 0) * max(float(np.quantile(foreign, FOREIGN)), 0))) if len(foreign) else kept
    return model


def predict(docs: DataFrame, model: Model, *keep: str | Column, prefix: str = "") -> DataFrame:
    """The kept columns with lang_pred, score, entropy (nats per symbol) and rejected, their names after the prefix."""
    docs = docs.select(*keep, F.col("text").alias("_text_to_judge"))
    kept = docs.drop("_text_to_judge").schema
    names = [prefix + c for c in ("lang_pred", "score", "entropy", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offs = K.utf8(batch.column(batch.num_columns - 1))
            for lo, hi in K.runs(offs, K.SLICE):
                part = batch.slice(lo, hi - lo)
                lang, score, entropy, no = model.judge(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy.astype(np.float64)), pa.array(no)], [*part.schema.names[:-1], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {kind}" for c, kind in zip(names, ("string", "double", "double", "boolean")))])
    return docs.mapInArrow(K.lean(run), schema)

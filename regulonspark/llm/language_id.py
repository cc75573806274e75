"""Language identification with Kneser-Ney character models.

One interpolated Kneser-Ney model per language over the characters of words
(lower-cased letters, with marks for the start and the end of a word).
Grams of each order are hashed to 64 bits and kept in one sorted array per
order; beside each lie the languages that have it, with their log-probabilities.
A second sorted array holds the back-off weights of the contexts. A text's score under
a language is its cross-entropy in nats per letter; the lowest wins.

Rejection is calibrated on texts that each model keeps back: the spread of their words
per letter and the spread between them give the deviation that is usual for a text of
n letters, sqrt(between^2 + within^2 / n). The limit is as many of these as leave all
texts kept back well inside, ``REJECT_AT`` at least; for normal deviations that is less
than one false rejection in a million. Languages with few texts kept back use
the spreads of all languages together.

The models are fitted on a bounded sample: of each of the ``max_languages`` most frequent
labels at most ``sample_docs`` documents, drawn by hash, of each at most
``sample_chars`` characters (of longer ones a part that starts at a place drawn by hash, so that
labels with long documents only are learnt too), and of all languages together
``total_chars``. More labels than ``max_languages`` are an error, as those left out could
never be predicted. Predictions are made for all documents over their whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0,
and is rejected; so is everything if there is nothing to learn from. Equal
texts get equal answers; of languages that tie the first in code point order wins; repeated rows stay;
an empty table gives an empty result. Only ``doc_id``, ``text`` and, for
learning, ``lang`` are read; :func:`keep_accepted` passes all columns through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UNKNOWN = "und"
ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS, MAX_LANGUAGES = 400, 20_000, 30_000_000, 200
#: Least number of usual deviations above the usual score at which a text is rejected, the margin over the texts kept back, and how many of these a language's own spreads need.
REJECT_AT, MARGIN, ENOUGH = 5.0, 1.5, 12
#: Bytes of remembered word scores in a task, about, bytes that a word takes besides its scores, and the longest word it remembers.
CACHE_BYTES, WORD_BYTES, CACHED_WORD = 16 << 20, 200, 48
#: Numbers up to which the models are also laid out with a row of all languages for every gram, which is faster to read.
DENSE = 8 << 20
#: Characters that are scored at once.
_LONG = 1 << 20

_START, _STOP = 2, 3
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = re.compile(r"[^\W\d_]+")


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their marks in one array, the place within the word, and the word's number."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), owner


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n codes that end at each place; the first n - 1 places mean nothing."""
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * _MUL
        mixed ^= mixed >> np.uint64(29)
        out, power = [mixed], np.uint64(1)
        for n in range(2, order + 1):
            power = power * _MUL
            h = out[-1].copy()
            h[n - 1 :] += mixed[: max(0, len(codes) - n + 1)] * power
            out.append(h)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def clean(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


def fit_language(words: list[str], order: int = ORDER) -> dict:
    """Sorted arrays of one language: per order the grams (with their contexts and suffixes), and the contexts with their back-off weights."""
    codes, place, _ = _padded(words)
    hashes = _hashes(codes, order)
    model: dict = {"grams": [], "contexts": []}
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, order + 1):
        ok = np.flatnonzero(place >= max(1, n - 1))
        keys, at, counts = np.unique(hashes[n - 1][ok], return_index=True, return_counts=True)
        at = ok[at]
        if n < order:
            # a lower order counts the different characters before a gram, but for grams at the start of a word
            longer = ok[place[ok] >= n]
            pairs = np.unique(hashes[n][longer], return_index=True)[1]
            before = np.bincount(np.searchsorted(keys, hashes[n - 1][longer[pairs]]), minlength=len(keys))
            counts = np.where(place[at] == n - 1, counts, before) if n > 1 else before
            counts = np.maximum(counts, 1)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        d = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))
        if n == 1:
            total, kinds = counts.sum(), len(counts)
            model["unknown"] = float(np.log(d * kinds / total / 65536)) if total else -20.0
            p = np.maximum(counts - d, 0) / total + np.exp(model["unknown"]) if total else counts * 1.0
            model["grams"].append((keys, np.log(p), keys, keys))
        else:
            context = hashes[n - 2][at - 1]
            ckeys, inverse = np.unique(context, return_inverse=True)
            mass = np.bincount(inverse, counts)
            back = d * np.bincount(inverse) / mass
            suffix = hashes[n - 2][at]
            i, hit = _find(lower[0], suffix)
            below = np.where(hit, lower[1][i], np.exp(model["unknown"]))
            p = np.maximum(counts - d, 0) / mass[inverse] + back[inverse] * below
            model["grams"].append((keys, np.log(p), context, suffix))
            model["contexts"].append((ckeys, np.log(back)))
        lower = (keys, p)
    return model


class _Sparse:
    """A sorted array of hashes, and for each the languages that have it with their values."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.concatenate([k for k, _ in parts])
        langs = np.repeat(np.arange(len(parts), dtype=np.int16), [len(k) for k, _ in parts])
        order = np.lexsort((langs, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.starts = np.append(first, len(keys)).astype(np.int64)
        self.langs, self.values = langs[order], np.concatenate([v for _, v in parts])[order].astype(np.float32)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``keys``, language, value) of all entries of the keys."""
        at, hit = _find(self.keys, keys)
        rows = np.flatnonzero(hit)
        lo, many = self.starts[at[rows]], np.diff(self.starts)[at[rows]]
        which = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(rows, many), self.langs[which], self.values[which]


class Models:
    """The models of all languages, side by side."""

    def __init__(self, fitted: dict[str, dict], order: int = ORDER):
        self.langs = sorted(fitted)
        self.order = order
        parts = [fitted[x] for x in self.langs]
        self.unknown = np.array([p["unknown"] for p in parts], np.float64)
        self.grams = [_Sparse([p["grams"][n][:2] for p in parts]) for n in range(order)]
        self.contexts = [_Sparse([p["contexts"][n] for p in parts]) for n in range(order - 1)]
        self.tables = self.backs = None
        if sum(len(x.keys) for x in self.grams + self.contexts) * len(self.langs) <= DENSE:
            self._lay_out(parts)

    def _lay_out(self, parts: list[dict]) -> None:
        """A row of all languages for every gram and context, where these are few: a language that lacks a gram has its back-off there."""
        many = len(self.langs)
        self.tables, self.backs = [], []
        for x in self.contexts:
            back = np.zeros((len(x.keys), many), np.float32)
            back[np.repeat(np.arange(len(x.keys)), np.diff(x.starts)), x.langs] = x.values
            self.backs.append(back)
        for n, x in enumerate(self.grams, 1):
            if n == 1:
                table = np.tile(self.unknown.astype(np.float32), (len(x.keys), 1))
            else:
                every, context, suffix = (np.concatenate([p["grams"][n - 1][j] for p in parts]) for j in (0, 2, 3))
                first = np.unique(every, return_index=True)[1]
                table = self._rows(n - 1, suffix[first]) + self._back(n, context[first])
            table[np.repeat(np.arange(len(x.keys)), np.diff(x.starts)), x.langs] = x.values
            self.tables.append(table)
        for x in self.grams + self.contexts:  # from here on only the keys are asked
            del x.starts, x.langs, x.values

    def _rows(self, n: int, keys: np.ndarray) -> np.ndarray:
        at, hit = _find(self.grams[n - 1].keys, keys)
        return np.where(hit[:, None], self.tables[n - 1][at], self.unknown.astype(np.float32))

    def _back(self, n: int, contexts: np.ndarray) -> np.ndarray:
        at, hit = _find(self.contexts[n - 2].keys, contexts)
        return np.where(hit[:, None], self.backs[n - 2][at], np.float32(0)) if len(self.backs[n - 2]) else np.zeros((len(contexts), len(self.langs)), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Per word the sum of log-probabilities under each language, and the number of characters (the end counts)."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        codes, place, owner = _padded(words)
        hashes = _hashes(codes, self.order)
        use = np.flatnonzero(place >= 1)
        logp = np.tile(self.unknown, (len(use), 1))
        for n in range(1, self.order + 1):
            rows = np.flatnonzero(place[use] >= n - 1)
            where = use[rows]
            if self.tables is not None:
                at, hit = _find(self.grams[n - 1].keys, hashes[n - 1][where])
                logp[rows[hit]] = self.tables[n - 1][at[hit]]
                if n > 1:
                    rows, where = rows[~hit], where[~hit]
                    logp[rows] += self._back(n, hashes[n - 2][where - 1])
                continue
            if n > 1:  # a language that has not seen the gram backs off
                at, lang, value = self.contexts[n - 2].entries(hashes[n - 2][where - 1])
                logp[rows[at], lang] += value
            at, lang, value = self.grams[n - 1].entries(hashes[n - 1][where])
            logp[rows[at], lang] = value
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner[use], logp[:, k], len(words))
        out[:, -1] = np.bincount(owner[use], minlength=len(words))
        return out


class Scorer:
    """Cross-entropies of texts, with the scores of words remembered."""

    def __init__(self, models: Models):
        self.models = models
        self.width = len(models.langs) + 1
        self.most = max(2000, CACHE_BYTES // (8 * self.width + WORD_BYTES))
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((4096, self.width))

    def _learn(self, words: list[str]) -> None:
        n = len(self.row)
        if n + len(words) > len(self.table):
            bigger = np.zeros((max(2 * len(self.table), n + len(words)), self.width))
            bigger[:n] = self.table[:n]
            self.table = bigger
        self.table[n : n + len(words)] = self.models.words(words)
        self.row.update(zip(words, range(n, n + len(words))))

    def _new(self, lists: list[list[str]]) -> list[str]:
        row = self.row
        return list(dict.fromkeys(w for words in lists for w in words if w not in row))

    def _block(self, lists: list[list[str]]) -> np.ndarray:
        new = self._new(lists)
        if self.row and len(self.row) + len(new) > self.most:
            self._forget()
            new = self._new(lists)
        long = [w for w in new if len(w) > CACHED_WORD]  # learnt last, and not kept
        if long:
            self._learn([w for w in new if len(w) <= CACHED_WORD])
        if new:
            self._learn(long or new)
        row = self.row
        out = np.array([self.table[list(map(row.__getitem__, words))].sum(0) if words else np.zeros(self.width) for words in lists])
        for w in long:
            del row[w]
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Per word, the log-probability under each language and the number of characters."""
        return self.models.words(words)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Per text, the log-probability sums under each language and the number of characters."""
        total = np.zeros((len(texts), self.width))
        held: list[tuple[int, list[str]]] = []
        size = 0

        def score() -> None:
            for (i, _), x in zip(held, self._block([w for _, w in held])):
                total[i] += x
            held.clear()

        for i, text in enumerate(texts):
            text = text or ""
            if len(text) > _LONG:
                found = (m.group() for m in _LETTERS.finditer(text.lower()))
                while part := list(islice(found, 1 << 15)):
                    held.append((i, part))
                    score()
                continue
            held.append((i, clean(text)))
            size += len(text)
            if size > _LONG:
                score()
                size = 0
        if held:
            score()
        return total


def calibrate(scorer: Scorer, kept_back: dict[str, list[str]], reject_at: float = REJECT_AT) -> dict[str, tuple[float, float, float, float]]:
    """Per language, from its own texts: usual cross-entropy, spread between texts, spread within one per letter, and how many usual deviations are the limit."""
    found = {}
    for k, lang in enumerate(scorer.models.langs):
        h, n, within = [], [], []
        for text in kept_back.get(lang, ()):
            if not (words := clean(text)):
                continue
            rows = scorer.words(words)
            letters, own = rows[:, -1], -rows[:, k]
            if letters.sum() >= 20:
                h.append(own.sum() / letters.sum())
                n.append(letters.sum())
                within.append(((own - h[-1] * letters) ** 2).sum() / letters.sum())
        if h:
            middle = float(np.median(h))
            found[k] = middle, np.array(h) - middle, np.array(n), np.array(within)
    if not found:
        return {lang: (3.0, 1.0, 3.0, reject_at) for lang in scorer.models.langs}

    def spreads(parts) -> tuple[float, float]:
        off, n, within = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        w2 = float(within.mean())
        return max(0.02, float(np.sqrt(max(0.0, (off * off - w2 / n).mean())))), max(0.1, float(np.sqrt(w2)))

    every, out = spreads(found.values()), {}
    usual = float(np.median([f[0] for f in found.values()]))
    for k, lang in enumerate(scorer.models.langs):
        middle, off, n, _ = found.get(k, (usual, np.zeros(0), np.ones(0), None))
        between, within = spreads([found[k]]) if len(off) >= ENOUGH else every
        far = (off / np.hypot(between, within / np.sqrt(n))).max(initial=0.0)
        out[lang] = middle, between, within, max(reject_at, MARGIN * float(far))
    return out


class Identifier:
    def __init__(self, models: Models, usual: dict[str, tuple[float, float, float, float]]):
        self.scorer = Scorer(models)
        self.langs = models.langs
        self.usual = usual

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score from 0 to 1, accepted) of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        return [self._judge(x) for x in self.scorer.sums(texts)]

    def _judge(self, sums: np.ndarray) -> tuple[str, float, bool]:
        n = sums[-1]
        if not n:
            return UNKNOWN, 0.0, False
        h = -sums[:-1] / n
        k = int(h.argmin())
        share = 1 / float(np.exp(-np.minimum((h - h[k]) * min(n, 100.0), 700)).sum())
        middle, between, within, times = self.usual[self.langs[k]]
        limit = times * float(np.hypot(between, within / np.sqrt(n)))
        near = 1 / (1 + np.exp(np.clip(4 * ((h[k] - middle) / limit - 1), -30, 30)))
        return self.langs[k], float(share * near), bool(h[k] - middle <= limit)


def doc_residue():
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(
    labelled: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
    total_chars: int = TOTAL_CHARS, max_languages: int = MAX_LANGUAGES, reject_at: float = REJECT_AT,
) -> Identifier:
    """Models of the labels of ``labelled`` (doc_id, text, lang)."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if not counts:
        return _empty(order)
    if len(counts) > max_languages:
        raise ValueError(f"there are more than {max_languages} languages; raise max_languages or relabel the rare ones")
    # a share of each language by hash, some more than needed, of which fit() takes the first by key
    limits = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.2 * sample_docs + 50) / r["count"])))]
    share = F.try_element_at(F.create_map(*limits), F.col("lang"))
    sample = usable.where(F.pmod("key", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    place = (F.pmod(F.shiftrightunsigned("key", 30), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1).cast("int")
    sample = sample.withColumn("text", F.when(F.length("text") > sample_chars, F.substring("text", place, F.lit(sample_chars))).otherwise(F.col("text")))
    most = total_chars // len(counts)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "text"]).head(sample_docs)
        sizes = group["text"].str.len().cumsum()
        texts = list(group["text"][(sizes <= most) | (sizes == sizes.iloc[0])])
        back = texts[::5] if len(texts) >= 10 else []
        words = [w for i, t in enumerate(texts) if i % 5 or not back for w in clean(t)]
        model = fit_language(words, order) if words else None
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "model": [pickle.dumps((model, back))]})

    rows = sample.groupBy("lang").applyInPandas(fit, "lang string, model binary").collect()
    got = {r["lang"]: pickle.loads(r["model"]) for r in rows}
    fitted = {k: m for k, (m, _) in got.items() if m}
    if not fitted:
        return _empty(order)
    models = Models(fitted, order)
    return Identifier(models, calibrate(Scorer(models), {k: back for k, (_, back) in got.items()}, reject_at))


def _empty(order: int) -> Identifier:
    models = Models.__new__(Models)
    models.langs, models.order = [], order
    return Identifier(models, {})


def _judged(batch: pa.RecordBatch, at: int, who: Identifier) -> list[tuple[str, float, bool]]:
    out = []
    for lo in range(0, batch.num_rows, 256):
        out += who.judge(batch.column(at).slice(lo, 256).to_pylist())
    return out


def identify(docs: DataFrame, who: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of ``docs``."""
    models = docs.sparkSession.sparkContext.broadcast(who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = models.value
        for batch in batches:
            lang, score, ok = zip(*_judged(batch, 2, who)) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (doc_residue() == 2).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, who: Identifier) -> DataFrame:
    """``docs`` without the documents that ``who`` rejects, all columns unchanged."""
    models = docs.sparkSession.sparkContext.broadcast(who)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = models.value
        for batch in batches:
            yield batch.filter(pa.array([x[2] for x in _judged(batch, at, who)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

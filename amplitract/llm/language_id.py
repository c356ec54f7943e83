"""Language ID by interpolated Kneser-Ney character models.

A text is lower-cased, every run of other characters than letters becomes one space, and its n-grams are scored under
one model for each language. A model is a sorted array of 64-bit n-gram hashes for each order, found by binary
search: log probabilities of the n-grams seen in training (interpolated over all lower orders, whose counts are
continuation counts) and back-off weights of their contexts. All languages share the arrays, so that one search serves
all of them. The language of lowest cross-entropy per character is chosen.

Rejection is calibrated on a part of the training sample that the models haven't seen: a text is rejected if it has no
letters, or if its cross-entropy is above all but ``reject_share`` of the calibration texts of its language by a margin that
grows for short texts, whose cross-entropy varies more. The temperature that turns cross-entropies into a score between 0 and 1
is calibrated on the same part.

The training sample is bounded by ``max_docs`` whole documents and about ``max_chars`` characters a language (those of
least hash); every language that has labelled documents is learnt. N-gram counts are summed by Spark, the model is
compiled on the driver and broadcast. Its size is checked against ``max_model_mb``, the number of n-grams before they go
to the driver. Texts that calibrate are scored on the executors. Every document is scored on its whole text.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a null or blank language isn't learned from;
without any training text all is ``und``; ties go to the language whose name comes first; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, freeing, materialize, others, table
from .words import U64, mix64

ORDER = 4
#: Characters that are scored at a time.
CHUNK = 100_000
_STEP = U64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-cased letter of each code point, 32 (space) for those that aren't letters."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(text: str) -> np.ndarray:
    """Code points: one space, then letters in lower case with single spaces between words, then one space."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each position from n - 1 on."""
    count = len(codes) - n + 1
    h = np.full(max(0, count), n, U64)
    for j in range(n):
        h = (h + codes[j : j + count].astype(U64) + U64(1)) * _STEP
        h ^= h >> U64(29)
    return mix64(h)


def hash_of(gram: str) -> int:
    return int(gram_hashes(np.array([ord(c) for c in gram], np.uint32), len(gram))[0])


@dataclass
class Model:
    """keys[n]: sorted hashes of n-grams; logp[n] and backoff[n]: one row for each, one column for each language."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    limit: np.ndarray
    spread: np.ndarray
    temperature: float

    def size(self) -> int:
        return sum(a.nbytes for part in (self.keys, self.logp, self.backoff) for a in part)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The index of each wanted hash, -1 for those not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def log_probabilities(model: Model, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The log probability of each character from the second on, given up to order - 1 before it: characters x languages."""
    return _scored(model, codes, min(order, len(codes)), order)


def _scored(model: Model, codes: np.ndarray, n: int, order: int) -> np.ndarray:
    out = np.empty((max(0, len(codes) - 1), len(model.languages)), np.float32)
    for short in range(2, n):  # the first characters have shorter contexts
        out[short - 2] = _backed(model, codes[:short], short)[-1]
    if n >= 2:
        out[n - 2 :] = _backed(model, codes, n)
    return out


def _backed(model: Model, codes: np.ndarray, n: int) -> np.ndarray:
    """Scores of the n-grams of codes; those not seen in any language are scored by the rest of them and a back-off weight."""
    at = _find(model.keys[n], gram_hashes(codes, n))
    out = model.logp[n][np.maximum(at, 0)] if len(model.keys[n]) else np.empty((len(at), len(model.languages)), np.float32)
    lost = np.flatnonzero(at < 0)
    if len(lost) and n == 1:
        out[lost] = model.unseen
    elif len(lost):
        windows = np.lib.stride_tricks.sliding_window_view(codes, n)[lost]
        lower = _backed_rows(model, windows[:, 1:])
        context = _find(model.keys[n - 1], _row_hashes(windows[:, :-1]))
        weight = np.where((context >= 0)[:, None], model.backoff[n - 1][np.maximum(context, 0)], 0)
        out[lost] = lower + weight
    return out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), rows.shape[1], U64)
    for j in range(rows.shape[1]):
        h = (h + rows[:, j].astype(U64) + U64(1)) * _STEP
        h ^= h >> U64(29)
    return mix64(h)


def _backed_rows(model: Model, rows: np.ndarray) -> np.ndarray:
    n = rows.shape[1]
    at = _find(model.keys[n], _row_hashes(rows))
    out = model.logp[n][np.maximum(at, 0)]
    lost = np.flatnonzero(at < 0)
    if len(lost) and n == 1:
        out[lost] = model.unseen
    elif len(lost):
        context = _find(model.keys[n - 1], _row_hashes(rows[lost][:, :-1]))
        out[lost] = _backed_rows(model, rows[lost][:, 1:]) + np.where((context >= 0)[:, None], model.backoff[n - 1][np.maximum(context, 0)], 0)
    return out


def compile_model(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """counts: for each language the counts of its n-grams of the highest order, padded by spaces at the text's start."""
    languages = sorted(counts)
    tables = {lang: _kneser_ney(counts[lang], order) for lang in languages}
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    model = Model(languages, [np.empty(0, U64)], [np.empty((0, 0))], [np.empty((0, 0))], np.empty(0), np.empty(0), np.empty(0), 1.0)
    # the chance of a character that a language hasn't seen: what unigram discounting left, over an alphabet of all languages
    model.unseen = np.array([math.log(max(tables[lang][2], 1e-6) / alphabet) for lang in languages], np.float32)
    for n in range(1, order + 1):
        grams = sorted({g for lang in languages for g in tables[lang][0][n]})
        hashes = np.array([hash_of(g) for g in grams], U64)
        by = np.argsort(hashes)
        logp, back = np.empty((len(grams), len(languages)), np.float32), np.zeros((len(grams), len(languages)), np.float32)
        for j, lang in enumerate(languages):
            seen, weight, _ = tables[lang]
            lower = lambda g: seen[len(g)][g] if g in seen[len(g)] else model.unseen[j] if len(g) == 1 else weight.get(g[:-1], 0.0) + lower(g[1:])  # noqa: B023, E731
            logp[:, j] = [lower(g) for g in grams]
            back[:, j] = [weight.get(g, 0.0) for g in grams]
        model.keys.append(hashes[by])
        model.logp.append(logp[by])
        model.backoff.append(back[by])
    return model


def _kneser_ney(counts: dict[str, int], order: int) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Interpolated log probabilities of seen n-grams by n, log back-off weights of contexts, and the mass left for unseen characters."""
    by_order: list[dict[str, int]] = [{} for _ in range(order + 1)]
    by_order[order] = counts
    for n in range(order - 1, 0, -1):  # in how many contexts an n-gram is found
        before: dict[str, int] = defaultdict(int)
        for g in by_order[n + 1]:
            before[g[1:]] += 1
        by_order[n] = before
    seen: list[dict[str, float]] = [{} for _ in range(order + 1)]
    weights: dict[str, float] = {}
    left = 0.0
    for n in range(1, order + 1):
        once, twice = sum(c == 1 for c in by_order[n].values()), sum(c == 2 for c in by_order[n].values())
        discount = once / (once + 2 * twice) if once else 0.5
        discount = min(max(discount, 0.1), 0.95)
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for g, c in by_order[n].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        for context, t in total.items():
            if context:
                weights[context] = math.log(discount * kinds[context] / t)
        for g, c in by_order[n].items():
            p = (c - discount) / total[g[:-1]]
            if n > 1:
                p += discount * kinds[g[:-1]] / total[g[:-1]] * math.exp(seen[n - 1][g[1:]])
            seen[n][g] = math.log(p)
        if n == 1:
            left = discount * kinds[""] / total[""] if total else 1.0
    return seen, weights, left


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The cross-entropy per character of each text under each language, and the number of characters; 0 without letters."""
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def score() -> None:
        codes = np.concatenate([c for _, c in waiting])
        lengths = np.array([len(c) for _, c in waiting])
        ends = np.cumsum(lengths)
        p = _scored(model, codes, ORDER, ORDER)
        for (i, _), a, b in zip(waiting, ends - lengths, ends, strict=True):
            # padded by spaces, so that the first letter has a whole context; windows over two texts are left out
            sums[i] -= p[a + ORDER - 2 : b - 1].sum(axis=0, dtype=np.float64)
            sizes[i] += b - a - ORDER + 1
        waiting.clear()

    for i, text in enumerate(texts):
        codes = normalised(text) if text else np.empty(0, np.uint32)
        if len(codes) < 2:
            continue
        codes = np.concatenate([np.full(ORDER - 2, 32, np.uint32), codes])
        for at in range(0, len(codes) - ORDER + 1, CHUNK):
            waiting.append((i, codes[at : at + CHUNK + ORDER - 1]))
            held += len(waiting[-1][1])
            if held >= CHUNK:
                score()
                held = 0
    if waiting:
        score()
    return sums / np.maximum(sizes, 1)[:, None], sizes


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The language, score, whether rejected, and cross-entropy of each text."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.full(len(texts), np.nan)
    h, n = entropies(model, texts)
    best = h.argmin(axis=1) if len(texts) else np.empty(0, int)
    least = h[np.arange(len(texts)), best]
    with np.errstate(over="ignore"):
        score = 1 / np.exp((least[:, None] - h) * (model.temperature * np.sqrt(n))[:, None]).sum(axis=1)
    limit = model.limit[best] + model.spread[best] / np.sqrt(np.maximum(n, 1))
    names = [model.languages[b] if k else "und" for b, k in zip(best, n, strict=True)]
    return names, np.where(n > 0, score, 0.0), (n == 0) | (least > limit), np.where(n > 0, least, np.nan)


def calibrate(model: Model, h: np.ndarray, n: np.ndarray, truth: list[str], reject_share: float) -> None:
    """Sets the rejection limits and the temperature of scores from the entropies h and sizes n of labelled texts that the
    model hasn't seen."""
    own = np.array([model.languages.index(t) for t in truth], np.int64)
    real = h[np.arange(len(own)), own]
    k = len(model.languages)
    model.limit, model.spread = np.full(k, np.inf), np.zeros(k)
    for j in range(k):
        mine = (own == j) & (n > 0)
        if mine.sum() < 20:  # too few of its own: those of all languages
            mine = n > 0
        if mine.sum() >= 20:
            middle = float(np.median(real[mine]))
            # how much a text of one character may differ, by texts of all lengths
            model.spread[j] = 4 * float(np.quantile(np.abs(real[mine] - middle) * np.sqrt(n[mine]), 0.9))
            model.limit[j] = max(float(np.quantile(real[mine], 1 - reject_share)), middle) + 0.25 * middle
    use = n > 0
    best = (np.inf, 1.0)
    for t in (0.25, 0.5, 1, 2, 4, 8):
        logit = (h[use] - real[use][:, None]) * (t * np.sqrt(n[use]))[:, None]
        with np.errstate(over="ignore"):
            loss = float(np.mean(np.logaddexp.reduce(-logit, axis=1))) if use.any() else 0.0
        best = min(best, (loss, t))
    model.temperature = best[1]


def count_grams(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of all n-grams of the highest order in train (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                codes = np.concatenate([np.full(order - 2, 32, np.uint32), normalised(text.as_py())])
                whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
                grams, n = np.unique([whole[i : i + order] for i in range(len(whole) - order + 1)], return_counts=True)
                for g, c in zip(grams.tolist(), n.tolist(), strict=True):
                    sums[lang.as_py(), g] += c
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["lang", "gram", "n"])

    return train.select("lang", "text").mapInArrow(freeing(counted), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def held_entropies(held: DataFrame, model: Model) -> DataFrame:
    """(lang, h, n) of held (lang, text): the entropies under each language and the number of characters."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = entropies(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["lang", "h", "n"])

    return held.select("lang", "text").mapInArrow(freeing(scored), "lang string, h array<double>, n long")


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 400, max_chars: int = 4_000_000, learn: Column | None = None) -> DataFrame:
    """(lang, text, h): of each language the labelled documents of least hash h, max_docs of them and together about
    max_chars characters at most (one document at least). Equal rows count once."""
    known = docs.where((F.lit(True) if learn is None else learn) & docs[lang].isNotNull() & docs[text].isNotNull() & (F.trim(docs[lang].cast("string")) != ""))
    name = docs[lang].cast("string")
    counts = known.groupBy(name.alias("lang")).count().collect()
    mixed = F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(1 << 40))
    # the share that gives max_docs rows, and a tenth more, of which the least hashes stay
    share = {r["lang"]: min(1 << 40, math.ceil((1 << 40) * 1.1 * (max_docs + 30) / r["count"])) for r in counts}
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair]) if share else F.create_map(F.lit(""), F.lit(0))
    sample = known.where(mixed < shares[name]).select(name.alias("lang"), docs[text].alias("text"), mixed.alias("h")).dropDuplicates(["lang", "h"])
    by_hash = Window.partitionBy("lang").orderBy("h")
    before = F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    sample = sample.withColumn("k", F.row_number().over(by_hash)).withColumn("before", F.coalesce(before, F.lit(0)))
    return sample.where((F.col("k") <= max_docs) & (F.col("before") < max_chars)).select("lang", "text", "h")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 400, max_chars: int = 4_000_000, reject_share: float = 0.002, max_model_mb: int = 200, learn: Column | None = None) -> Model:
    """Learns from a training_sample of each language; a fifth of it is held out to calibrate."""
    sample = materialize(training_sample(docs, key, text, lang, max_docs, max_chars, learn), "language-sample")
    is_held = F.pmod(F.floor(F.col("h") / 7), F.lit(5)) == 0
    counted = materialize(count_grams(sample.where(~is_held)), "language-grams")
    # an n-gram of the highest order and those in it have at least so many bytes in the arrays
    if counted.count() * 8 > max_model_mb << 20:
        raise ValueError("the sample has too many n-grams; lower max_docs or max_chars")
    grams: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted.toLocalIterator():
        grams[r["lang"]][r["gram"]] = r["n"]
    model = compile_model(grams)
    if model.size() > max_model_mb << 20:
        raise ValueError(f"the language models take {model.size() >> 20} MB; lower max_docs or max_chars")
    held = held_entropies(sample.where(is_held & F.col("lang").isin(list(grams))), model).collect()
    calibrate(model, np.array([r["h"] for r in held]).reshape(len(held), len(grams)), np.array([r["n"] for r in held], np.int64), [r["lang"] for r in held], reject_share)
    discard(sample, counted)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (string), score (double, 0 to 1), rejected (boolean) and cross_entropy (double, null without
    letters); columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "rejected", "cross_entropy")
    mine = docs.select(*others(docs, *names, "_text"), docs[text].alias("_text"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lang, score, rejected, h = decide(shared.value, part.column(part.num_columns - 1).to_pylist())
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(h, pa.float64(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], *names])

    schema = mine.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("cross_entropy", "double")
    return mine.mapInArrow(freeing(judged), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(docs["doc_id"].cast("string")) % 3 == 1
    model = train(docs, learn=~held_out)
    asked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")

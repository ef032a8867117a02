"""Language of texts by a convolutional network over bytes, trained and applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
_EMBED, _FILTERS, _WIDEST = 8, 16, max(WIDTHS)


class Network(NamedTuple):
    """embed: 256 bytes (0 pads) by _EMBED; filters: _WIDEST * _EMBED by all filters (zero beyond a filter's width);
    out: filters by languages."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every text's UTF-8 bytes in windows of WINDOW, the last one padded with zeros, and each window's text."""
    raw = [x.encode() for x in texts]
    count = np.array([-(-len(x) // WINDOW) for x in raw], np.int64)
    data = b"".join(x.ljust(k * WINDOW, b"\0") for x, k in zip(raw, count.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(raw)), count)


def _patches(embedded: np.ndarray) -> np.ndarray:
    n, places = len(embedded), WINDOW - _WIDEST + 1
    stride = embedded.strides
    view = np.lib.stride_tricks.as_strided(embedded, (n, places, _WIDEST * _EMBED), (stride[0], stride[1], stride[2]))
    return np.ascontiguousarray(view).reshape(n * places, -1)


def _pooled(net: Network, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    embedded = np.ascontiguousarray(net.embed[chars])
    hidden = (_patches(embedded) @ net.filters).reshape(len(chars), -1, net.filters.shape[1])
    return hidden, embedded


#: Windows whose filters' values at all places are held at once.
_HELD = 64


def _pooled_by_parts(net: Network, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _pooled, some windows after others."""
    return (_pooled(net, chars[at : at + _HELD]) for at in range(0, len(chars), _HELD))


def log_probabilities(net: Network, chars: np.ndarray) -> np.ndarray:
    top = np.concatenate([hidden.max(axis=1) for hidden, _ in _pooled_by_parts(net, chars)])
    top = np.maximum(top + net.bias, 0)
    z = top @ net.out + net.out_bias
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class _Learner:
    """Weights that Adam moves, a batch of windows at a time."""

    def __init__(self, net: Network, rate: float):
        self.languages, self.weights, self.rate, self.count = net.languages, list(net[1:]), rate, 0
        self.first, self.second = ([np.zeros_like(x) for x in self.weights] for _ in range(2))
        self.mask = _mask()

    @property
    def net(self) -> Network:
        return Network(self.languages, *self.weights)

    def step(self, x: np.ndarray, y: np.ndarray, share: np.ndarray | None = None, sure: float = 1.0) -> None:
        """Along the cross-entropy of windows x with targets y, each counted by its share; those that have their target
        with a probability of `sure` or more already add nothing."""
        net = self.net
        parts = [(hidden.argmax(axis=1), hidden.max(axis=1), embedded) for hidden, embedded in _pooled_by_parts(net, x)]
        place, top, embedded = (np.concatenate(part) for part in zip(*parts, strict=True))
        top += net.bias
        live = top > 0
        top = top * live
        z = top @ net.out + net.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        total, open_ = len(y), p[np.arange(len(y)), y] < sure
        if sure < 1:
            if not open_.any():
                return
            x, y, place, embedded, live, top, p = (a[open_] for a in (x, y, place, embedded, live, top, p))
        p[np.arange(len(y)), y] -= 1
        p /= total
        if share is not None:
            p *= share[open_, None] if sure < 1 else share[:, None]
        back = (p @ net.out.T) * live
        # Only the place that each filter's maximum comes from takes part.
        spot = place[:, :, None] + np.arange(_WIDEST)
        patch = embedded[np.arange(len(y))[:, None, None], spot].reshape(len(y), len(net.bias), -1)
        grad_filters = np.einsum("nf,nfk->kf", back, patch) * self.mask
        flow = (back[:, :, None] * net.filters.T[None]).reshape(-1, _EMBED)
        grad_embed = np.zeros_like(net.embed)
        np.add.at(grad_embed, x[np.arange(len(y))[:, None, None], spot].reshape(-1), flow)
        self.count += 1
        for i, g in enumerate((grad_embed, grad_filters, back.sum(axis=0), top.T @ p, p.sum(axis=0))):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            self.weights[i] = (self.weights[i] - self.rate * (self.first[i] / (1 - 0.9**self.count)) / (np.sqrt(self.second[i] / (1 - 0.999**self.count)) + 1e-7)).astype(np.float32)


def _mask() -> np.ndarray:
    mask = np.zeros((_WIDEST * _EMBED, _FILTERS * len(WIDTHS)), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * _EMBED, i * _FILTERS : (i + 1) * _FILTERS] = 1
    return mask


def _shortened(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the windows cut to a beginning of random length, as short texts are."""
    x = x.copy()
    cut = np.where(rng.random(len(x)) < 0.5, WINDOW, rng.integers(8, WINDOW, len(x)))
    x[np.arange(WINDOW) >= cut[:, None]] = 0
    return x


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.004, most_windows: int = 8000, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows, at most most_windows of them; each epoch also sees beginnings of windows
    of random length, as short texts are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    chars, of = windows(texts)
    target = np.array([languages.index(x) for x in labels], np.int64)[of] if len(of) else np.zeros(0, np.int64)
    if len(chars) > most_windows:
        some = rng.permutation(len(chars))[:most_windows]
        chars, target = chars[some], target[some]
    total, mask = _FILTERS * len(WIDTHS), _mask()
    k = max(1, len(languages))
    net = Network(languages, rng.normal(0, 0.5, (256, _EMBED)).astype(np.float32), (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32), rng.normal(0, 0.1, (total, k)).astype(np.float32), np.zeros(k, np.float32))
    learner = _Learner(net, rate)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(chars))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            learner.step(_shortened(chars[own], rng), target[own])
    return learner.net


def predict(net: Network, texts: list[str | None], most_windows: int = 512) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts: the mean over all their windows. UNKNOWN and 0 without a letter or a language."""
    plain = [x or "" for x in texts]
    chars, of = windows(plain)
    sums = np.zeros((len(plain), len(net.out_bias)))
    for at in range(0, len(chars), most_windows):
        np.add.at(sums, of[at : at + most_windows], log_probabilities(net, chars[at : at + most_windows]))
    mean = sums / np.maximum(np.bincount(of, minlength=len(plain)), 1)[:, None]
    mean = np.exp(mean - mean.max(axis=1, keepdims=True))
    mean /= mean.sum(axis=1, keepdims=True)
    best = mean.argmax(axis=1)
    known = np.array([bool(net.languages) and any(map(str.isalpha, x)) for x in plain], bool)
    return [net.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, mean.max(axis=1), 0.0)


def held_out():
    """Whether a row is kept from training: crc32(doc_id as text) mod 4 is 2 (a null doc_id counts as an empty text)."""
    return crc_mod(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) == 2


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _counts(docs: DataFrame, most_languages: int) -> dict[str, int]:
    """Labelled rows that are not held out, of each of the most frequent languages."""
    return {r["lang"]: r["count"] for r in _labelled(docs).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}


def _first(docs: DataFrame, counts: dict[str, int], per_language: int, chars: int) -> tuple[list[str], list[str]]:
    """Stretches of about per_language rows, by a hash, of each language: what a network begins with."""
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    hashed = F.xxhash64("doc_id", F.lit(11))
    some = _labelled(docs).where(F.pmod(hashed, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    place = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    rows = some.select("lang", F.substring("text", place.cast("int"), F.lit(chars)).alias("text"), hashed.alias("h")).limit(4 * per_language * len(counts)).collect()
    rows = sorted(rows, key=lambda row: (row["h"], row["lang"], row["text"]))
    return [row["text"] for row in rows], [row["lang"] for row in rows]


#: Windows of a step over all rows; the probability from which a window adds nothing to it; its rate; how finely the weights
#: are summed, as whole numbers, so that the order of tasks doesn't matter.
_STEP, _SURE, _RATE, _FINE = 512, 0.9, 0.001, 1 << 20


def learned(docs: DataFrame, net: Network, counts: dict[str, int], used: frozenset[str] = frozenset()) -> Network:
    """The network after all windows of all labelled rows that are not held out: each task moves it along its own ones, and
    the weights of all tasks are averaged by their windows. Languages count alike, however many rows they have. If the
    network knows UNKNOWN, each batch adds made-up texts of its own, as many as two languages have."""
    if len(net.languages) < 2:
        return net
    place = {k: i for i, k in enumerate(net.languages)}
    mean = sum(counts.values()) / max(1, len(counts))
    shares = np.array([min(10.0, max(0.1, mean / counts[k])) if k in counts else 1.0 for k in net.languages], np.float32)
    shapes = [x.shape for x in net[1:]]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, learner, seen = np.random.default_rng(TaskContext.get().partitionId()), _Learner(net, _RATE), 0
        for batch in batches:
            texts, target = batch["text"].tolist(), [place[x] for x in batch["lang"]]
            if UNKNOWN in place and UNKNOWN not in counts:
                more = outside(texts, -(-2 * len(texts) // len(counts)), int(rng.integers(1 << 30)), used)
                texts, target = texts + more, target + [place[UNKNOWN]] * len(more)
            chars, of = windows(texts)
            y, order = np.array(target, np.int64)[of], rng.permutation(len(chars))
            for at in range(0, len(order), _STEP):
                own = order[at : at + _STEP]
                learner.step(_shortened(chars[own], rng), y[own], shares[y[own]], _SURE)
            seen += len(chars)
        if seen:
            flat = np.concatenate([x.ravel() for x in learner.weights]).astype(np.float64)
            yield pd.DataFrame({"windows": [seen], "weights": [np.rint(flat * seen * _FINE).astype(np.int64)]})

    small_batches(docs.sparkSession)
    rows = _labelled(docs).where(F.col("lang").isin(net.languages)).select("lang", "text").mapInPandas(learn, "windows long, weights array<long>")
    sums = rows.select("windows", F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.sum("windows").alias("n")).orderBy("at").collect()
    if not sums:
        return net
    flat = np.array([r["w"] / r["n"] / _FINE for r in sums]).astype(np.float32)
    parts = np.split(flat, np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
    return Network(net.languages, *[x.reshape(shape) for x, shape in zip(parts, shapes, strict=True)])


def fit(docs: DataFrame, per_language: int = 300, most_languages: int = 256, chars: int = 2048) -> Network:
    """Train on the labelled rows that are not held out, of the most_languages most frequent languages: all windows of all
    of them (see learned), from a network that begins with stretches of about per_language rows of each. Without such rows
    the network knows no language."""
    counts = _counts(docs, most_languages)
    return learned(docs, train(*_first(docs, counts, per_language, chars)), counts)


def characters(docs: DataFrame) -> frozenset[str]:
    """All characters of the labelled rows that are not held out."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"c": sorted(set().union(*batch["text"]))})

    small_batches(docs.sparkSession)
    return frozenset(r["c"] for r in _labelled(docs).select("text").mapInPandas(of, "c string").distinct().collect())


def outside(texts: list[str], count: int, seed: int = 17, used: frozenset[str] = frozenset()) -> list[str]:
    """So many texts in no language: letters of the given texts in any order, digits and letters as codes have them, a few
    characters over and over, and letters of scripts that the texts, and all that are labelled (used), don't use."""
    rng = np.random.default_rng(seed)
    used = used or set().union(*texts)
    scripts = [[c for c in map(chr, range(first, first + 96)) if c.isalpha() and c not in used] for first in (0x250, 0x391, 0x410, 0x531, 0x5D0, 0x620, 0x905, 0xE01, 0x10A0, 0x1200, 0x3041, 0x30A1, *range(0x4E00, 0x9F00, 0x600), *range(0xAC00, 0xD700, 0x800), 0x10330, 0x12000, 0x13000)]
    scripts = [x for x in scripts if x]
    codes = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", "abcdefghijklmnopqrstuvwxyz", "0123456789 .,-:;|/()", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    letters = sorted({c for c in used if c.isalpha()} | set("abc"))
    out = []
    for i in range(count):
        size = int(rng.integers(24, 600))
        kind = i % 4
        if kind == 0 and texts:
            own = list(texts[int(rng.integers(len(texts)))][:600])
            out.append("".join(own[k] for k in rng.permutation(len(own))))
            continue
        if kind == 1:
            alphabet = list(codes[int(rng.integers(len(codes)))])
        elif kind == 2:
            alphabet = [letters[int(k)] for k in rng.integers(0, len(letters), int(rng.integers(1, 4)))]
        else:
            alphabet = scripts[int(rng.integers(len(scripts)))]
        drawn = [alphabet[int(k)] for k in rng.integers(0, len(alphabet), size)]
        if rng.random() < 0.5:  # in words of some length
            long = int(rng.integers(2, 12))
            drawn = [" " if k % (long + 1) == long else c for k, c in enumerate(drawn)]
        out.append("".join(drawn))
    return out


def fit_with_outside(docs: DataFrame, per_language: int = 300, most_languages: int = 256, chars: int = 2048) -> Network:
    """As fit, with UNKNOWN as a class of its own, learned from as many made-up texts as two languages have."""
    counts = _counts(docs, most_languages)
    texts, labels = _first(docs, counts, per_language, chars)
    if not texts:
        return train([], [])
    used = characters(docs)
    more = outside(texts, 2 * -(-len(texts) // len(set(labels))), used=used)
    return learned(docs, train(texts + more, labels + [UNKNOWN] * len(more)), counts, used)


def predictor(net: Network):
    """A column function: struct of lang_pred and score of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        languages, scores = predict(net, [None if x is None or x != x else x for x in texts])
        return pd.DataFrame({"lang_pred": languages, "score": scores})

    return of


def confidence(net: Network, texts: list[str | None], most_windows: int = 512) -> np.ndarray:
    """How sure it is, from all windows of a text, that it is in one of the languages (of a network of fit_with_outside)."""
    own = net.languages.index(UNKNOWN)
    chars, of = windows([x or "" for x in texts])
    sums = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(chars), most_windows):
        np.add.at(sums, of[at : at + most_windows], log_probabilities(net, chars[at : at + most_windows]))
    mean = sums / np.maximum(np.bincount(of, minlength=len(texts)), 1)[:, None]
    mean = np.exp(mean - mean.max(axis=1, keepdims=True))
    return 1 - mean[:, own] / mean.sum(axis=1)


#: A text of fewer letters says too little to be turned down.
LEAST_LETTERS = 64


def letters_of(text: str | None) -> int:
    return sum(map(str.isalpha, text or ""))


#: Steps of confidence that calibrate tells apart.
_GRID = 4096


def calibrate(docs: DataFrame, net: Network, lost: float = 0.001) -> float:
    """The confidence below which a text is in no language that the network knows: a half, or the largest one below (in
    steps of 1 / _GRID) where no more than the share `lost` of all labelled rows with letters enough, none of which took part
    in training, fall below. Counts by step are all that leaves the tasks."""
    if UNKNOWN not in net.languages:
        return 0.0

    @F.pandas_udf("int")
    def step(texts: pd.Series) -> pd.Series:
        enough = np.array([letters_of(x) >= LEAST_LETTERS for x in texts], bool)
        out = np.full(len(texts), -1)
        if enough.any():
            out[enough] = np.floor(np.minimum(confidence(net, texts[enough].tolist()), 0.5) * _GRID)
        return pd.Series(out)

    small_batches(docs.sparkSession)
    labelled = docs.where(held_out() & F.col("lang").isin(net.languages) & F.col("text").isNotNull())
    counts = {r["step"]: r["count"] for r in labelled.select(step("text").alias("step")).groupBy("step").count().collect() if r["step"] >= 0}
    left, least = int(lost * sum(counts.values())), 0
    while least < _GRID // 2 and counts.get(least, 0) <= left:
        left -= counts.get(least, 0)
        least += 1
    return least / _GRID


def in_language(net: Network, least: float):
    """A column function: whether a text has a letter, and is too short to tell or in a language with that confidence."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        plain = ["" if x is None or x != x else x for x in texts]
        count = np.array([letters_of(x) for x in plain], np.int64)
        if UNKNOWN not in net.languages:
            return pd.Series(count > 0)
        return pd.Series((count > 0) & ((count < LEAST_LETTERS) | (confidence(net, plain) >= least)))

    return of


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of doc_id, text, lang; a null text or one without a letter is und."""
    small_batches(docs.sparkSession)
    net = net or fit(docs)
    of = predictor(net)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), of(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and is in a language: of the labelled ones, by a
    network that knows texts in no language as well (see fit_with_outside and calibrate). Texts of fewer than LEAST_LETTERS
    letters stay. Where no row is labelled, all texts with a letter stay."""
    small_batches(docs.sparkSession)
    net = fit_with_outside(docs)
    return docs.where(in_language(net, calibrate(docs, net))(F.col("text")))

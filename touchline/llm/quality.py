"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix, word_hashes
from .shared import modest_batches, sliced, table
from .subwords import groups

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the of and to in is that with for on as by an de la le les des et en un une que pour dans der die das und den von mit ist nicht ein el los las del y por con se su".split()

#: Each labeller votes bad (0), abstains (1) or votes good (2): statistic, bad from (or up to), good up to (or from).
LABELLERS = (
    ("symbols", 0.08, 0.03),  # symbols other than sentence marks, a character
    ("capitals", 0.40, 0.15),  # capitals, a letter
    ("shouts", 0.15, 0.03),  # exclamation marks, a word
    ("bars", 0.15, 0.01),  # words without letters or digits, a word
    ("repeats", 0.15, 0.03),  # words equal to the one before
    ("sameness", 0.80, 0.55),  # 1 - distinct words, a word, inside blocks of BLOCK words: the mean of all blocks
    ("functional", -0.02, -0.06),  # minus the share of function words
    ("stops", -0.004, -0.02),  # minus the sentence marks, a word
    ("copied", 0.30, 0.03),  # runs of RUN words that the document had before, a run, however far back
)
#: Votes (bad, abstains, good) that each labeller is taken to have given bad and good documents before any is seen:
#: a bad vote says much, a good one little. They only matter in small tables.
PSEUDO = np.array([[25.0, 5.0, 20.0], [0.5, 4.5, 45.0]])
#: Words of a block: the share of distinct words falls with length, so it is only compared between equal lengths.
BLOCK = 400
#: Words of a run: plain prose hardly ever repeats so many, however long it is.
RUN = 8
BINS = 8
#: Slots of the scorer: for character classes and statistics, then for hashed words and pairs of words.
CLASSES, WORDS = 1 << 12, 1 << 16
SLOTS = CLASSES + WORDS
#: Features of the scorer's sample that the driver computes on at a time, about.
FEATURES_AT_ONCE = 1 << 18

_CLASS = np.full(256, 1, np.uint64)  # other bytes of letters
for _c in range(128):
    _CLASS[_c] = 2 if chr(_c).islower() else 3 if chr(_c).isupper() else 4 if chr(_c).isdigit() else 5 if chr(_c).isspace() else 6 + _c
_SYMBOL = np.array([c < 128 and not chr(c).isalnum() and not chr(c).isspace() and chr(c) not in ".,;:?'\"-()" and c > 31 for c in range(256)])
_LOWER, _CAPITAL, _STOP, _SHOUT = (np.array([chr(c) in s for c in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".?", "!"))
_ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def _distinct(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text, the distinct words of every block of BLOCK consecutive words, summed over all its blocks."""
    return np.array([sum(len(np.unique(words[k : min(k + BLOCK, b)])) for k in range(a, b, BLOCK)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], float)


def _copied(words: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each text, the share of its runs of RUN words that it had before; a short text has too few to tell."""
    runs = np.maximum(count - RUN + 1, 0)
    last = max(0, len(words) - RUN + 1)
    h = mix(owner[:last].astype(np.uint64))
    for k in range(RUN):
        h = mix(h + words[k : last + k] * np.uint64(2 * k + 3))
    inside = np.flatnonzero(owner[:last] == owner[len(words) - last :])
    new = inside[np.unique(h[inside], return_index=True)[1]]
    return (runs - np.bincount(owner[new], minlength=len(count)) + 0.5) / (runs + 5)


def statistics(texts: list[bytes], hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One row a text, one column a labeller; NaN where a text has no words. hashed: their ``word_hashes``."""
    n = len(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), at[:-1]) if n else np.zeros(0)
    words, count = hashed or word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(n), count)
    per = lambda flags: np.bincount(owner, flags, minlength=n)
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    usual = np.isin(words, _USUAL)
    space = raw <= 32
    plain = _ALNUM[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    inside = np.add.reduceat(plain.astype(np.int64), begins) if len(begins) else np.zeros(0)
    bare = np.bincount(np.searchsorted(at, begins, "right") - 1, inside == 0, minlength=n)
    k = count + 5  # a few words more than there are, so that very short texts look neither odd nor good
    letters = total(_LOWER[raw] | _CAPITAL[raw]) + 20
    chars = total(~space) + 20
    out = np.stack([total(_SYMBOL[raw]) / chars, total(_CAPITAL[raw]) / letters, total(_SHOUT[raw]) / k, bare / k, per(same) / k, (count - _distinct(words, first)) / np.maximum(count, np.minimum(k, BLOCK)), -per(usual) / k, -total(_STOP[raw]) / k, _copied(words, owner, count)], axis=1)
    out[count == 0] = np.nan
    return out


_USUAL = word_hashes([w.encode() for w in FUNCTION_WORDS])[0]


def votes(stats: np.ndarray) -> np.ndarray:
    """0 bad, 1 abstains, 2 good; a text without words gets no vote from anyone."""
    out = np.ones(stats.shape, np.int64)
    for k, (_, bad, good) in enumerate(LABELLERS):
        out[stats[:, k] >= bad, k] = 0
        out[stats[:, k] <= good, k] = 2
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1]) if len(v) else np.zeros(0, np.int64)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: each pattern's probability of good, the labellers' vote rates [class, labeller, vote], the prior.

    Votes are taken as independent given the class. A bad vote is rare and seldom wrong, so it starts from
    "good unless somebody says bad"; that also fixes which class is which.
    """
    m = len(LABELLERS)
    v = patterns[:, None] // 3 ** np.arange(m) % 3
    good = 1 / (1 + np.exp(4.0 * (v == 0).sum(axis=1) - 2.0))
    onehot = np.stack([v == x for x in range(3)], axis=2).astype(float)
    rates, prior = np.full((2, m, 3), 1 / 3), 0.5
    for _ in range(rounds):
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            rates[c] = (np.einsum("p,pmx->mx", weight, onehot) + PSEUDO[c]) / (weight.sum() + PSEUDO[c].sum())
        prior = ((good * counts).sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("cmx,pmx->cp", np.log(rates), onehot)
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -50, 50)))
    return good, rates, prior


def _words(words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): hashed words and pairs of neighbouring words of each text, scaled to unit length."""
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix(words[inside] + words[inside + 1] * np.uint64(3))
    slot = (np.concatenate([words, pairs]) >> np.uint64(48)).astype(np.int64)
    key, times = np.unique(np.concatenate([owner, owner[inside]]) * WORDS + slot, return_counts=True)
    row = key // WORDS
    return row, CLASSES + key % WORDS, np.sqrt(times / np.maximum(1, 2 * count - 1)[row])


def features(texts: list[bytes], stats: np.ndarray, hashed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): hashed words and pairs of words, trigrams of character classes and bins of the statistics."""
    n = len(texts)
    raw = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)  # two spaces before and after, so that no trigram reaches into a neighbour
    sizes = np.array([len(t) + 2 for t in texts])
    code = _CLASS[raw]
    h = (code[:-2] * np.uint64(131) + code[1:-1]) * np.uint64(131) + code[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)  # 12 bits
    row = np.repeat(np.arange(n), sizes)[: len(h)]
    key, value = np.unique(row * CLASSES + h[: len(row)].astype(np.int64), return_counts=True)
    grams = value / sizes[key // CLASSES]
    edges = np.array([np.linspace(min(a, b) - abs(a - b), max(a, b) + abs(a - b), BINS) for _, a, b in LABELLERS])
    bins = np.stack([np.where(np.isnan(stats[:, k]), BINS + 1, np.searchsorted(edges[k], stats[:, k])) for k in range(len(LABELLERS))], axis=1) if n else np.zeros((0, len(LABELLERS)), np.int64)
    spots = ((np.arange(len(LABELLERS)) * 64 + bins + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(52)
    said = _words(*hashed)
    rows = np.concatenate([key // CLASSES, np.repeat(np.arange(n), len(LABELLERS)), said[0]])
    return rows, np.concatenate([key % CLASSES, spots.astype(np.int64).ravel(), said[1]]), np.concatenate([np.sqrt(grams), np.full(spots.size, 0.5), said[2]])


def fit_scorer(rows, slots, values, target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights and bias of a logistic regression on soft targets, by full-batch adaptive gradient steps; a text counts by its weight.

    Features are gone through text by text in parts of about FEATURES_AT_ONCE, so that the driver holds little beside the
    features themselves; a sum goes on from part to part in the order of the features, so parts don't change it.
    """
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, slots, values = rows[order], slots[order], values[order]
    return _fit(list(_feature_parts(np.bincount(rows, minlength=len(target)), slots, values)), target, weight, rounds, rate, decay)


def _feature_parts(count: np.ndarray, slots: np.ndarray, values: np.ndarray):
    """(first text, features of each text, slots, values) of whole texts with about FEATURES_AT_ONCE features together; count: features of each text."""
    stops = np.cumsum(count)
    text = at = 0
    while text < len(count):
        last = max(text + 1, int(np.searchsorted(stops, at + FEATURES_AT_ONCE, "right")))
        yield text, count[text:last], slots[at : stops[last - 1]], values[at : stops[last - 1]]
        text, at = last, stops[last - 1]


def _fit(parts: list, target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    w, speed, part = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8), weight / weight.sum()
    every = np.arange(SLOTS)
    for _ in range(rounds):
        total, slips = np.zeros(SLOTS), []
        for text, count, slots, values in parts:
            own = slice(text, text + len(count))
            rows = np.repeat(np.arange(len(count)), count)
            z = np.bincount(rows, w[slots] * values, minlength=len(count)) + w[-1]
            slips.append((1 / (1 + np.exp(-z)) - target[own]) * part[own])
            total = np.bincount(np.concatenate([every, slots]), np.concatenate([total, slips[-1][rows] * values]), minlength=SLOTS)
        step = np.append(total, np.concatenate(slips).sum())
        step[:-1] += decay * w[:-1]
        speed += step * step
        w -= rate * step / np.sqrt(speed)
    return w


def _slices(texts) -> list[slice]:
    """Parts of some hundred thousand bytes: statistics and features take some fifty times that for a moment."""
    return list(groups(texts))


def _patterns(batches):
    for batch in sliced(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        found = [pattern_of(votes(statistics(texts[s]))) for s in _slices(texts)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())], names=["pattern"])


def priority_sample(texts: DataFrame, size: int) -> list[tuple[int, int, float]]:
    """(h, g, weight) of at most ``size`` distinct texts, by the hashes of ``keyed``, in the order of h and g.

    Priority sampling: with u a uniform number from the hash, the texts of the largest copies / u are drawn, and each
    stands for max(copies, the largest copies / u not drawn) rows. Sums of these weights estimate sums over all rows
    without bias; a text with very many copies is drawn for certain and stands for just these. A table of up to
    ``size`` distinct texts is drawn whole. Nothing depends on the order or the partitions of the rows.
    """
    uniform = (F.shiftrightunsigned("g", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    counted = texts.groupBy("h", "g").count().withColumn("priority", F.col("count") / uniform)
    drawn = counted.orderBy(F.desc("priority"), "h", "g").limit(size + 1).collect()
    bar = drawn[size]["priority"] if len(drawn) > size else 0.0
    return sorted((r["h"], r["g"], max(float(r["count"]), bar)) for r in drawn[:size])


def keyed(texts: DataFrame) -> DataFrame:
    """text with two hashes of it, h and g; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return texts.select("text", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def _once(batches):
    """The first row of each text that a task sees."""
    seen = set()
    for batch in batches:
        new = []
        for key in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def _featured(batches):
    for batch in sliced(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        for s in _slices(texts):
            own = batch.slice(s.start, s.stop - s.start)
            hashed = word_hashes(texts[s])
            stats = statistics(texts[s], hashed)
            rows, slots, values = features(texts[s], stats, hashed)
            order = np.argsort(rows, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts[s])))])
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("h"),
                    own.column("g"),
                    pa.array(pattern_of(votes(stats)), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slots[order], pa.int32())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[order].astype(np.float32))),
                ],
                names=["h", "g", "pattern", "slots", "values"],
            )


def _trained(rows: pa.Table, good: dict[int, float], weight: np.ndarray) -> np.ndarray:
    """The scorer's weights from the drawn texts' features (h, g, pattern, slots, values), taken in the order of h and g.

    Slots and values keep their 4 bytes; only a part at a time is widened.
    """
    order = pa.compute.sort_indices(rows.select(["h", "g"]), [("h", "ascending"), ("g", "ascending")])
    target = np.array([good[p] for p in rows.column("pattern").take(order).to_pylist()])
    count = pa.compute.list_value_length(rows.column("slots")).take(order).to_numpy().astype(np.int64)
    cut = [0, *(text + len(own) for text, own, _, _ in _feature_parts(count, count[:0], count[:0]))]
    parts = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = rows.select(["slots", "values"]).take(order.slice(a, b - a))
        parts.append((a, count[a:b], *(np.concatenate([c.flatten().to_numpy() for c in own.column(name).chunks]) for name in ("slots", "values"))))
    return _fit(parts, target, weight)


def score_quality(docs: DataFrame, threshold: float = 0.2, max_train: int = 4000) -> DataFrame:
    """All columns of ``docs`` with quality_score (probability of good) and keep.

    All statistics are of the whole text, however long it is. Three steps: every document's votes are counted by pattern
    (at most 3**9 of them, so EM runs on sums over the whole table, whatever its size); the labellers' accuracies give each pattern a posterior; a linear scorer on
    hashed features learns the posteriors of at most max_train distinct texts, drawn by copies and hash and weighted
    by the rows that they stand for (``priority_sample``), and judges every document. The model is the same for the
    same rows, in any order and any partitions.

    A null or empty text has no words: every labeller abstains, its score comes from its own bin, and it is kept
    only if that reaches the threshold (0.2: a document goes only when it is clearly bad). Rows are never dropped here.
    Repeated rows get equal scores. An empty table gives an empty result. Columns quality_score and keep of the input are
    replaced.
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop("quality_score", "keep")
    texts = docs.select(docs["text"])
    seen = texts.mapInArrow(_patterns, "pattern long").groupBy("pattern").count().collect()
    seen.sort(key=lambda r: r["pattern"])
    patterns, counts = np.array([r["pattern"] for r in seen], np.int64), np.array([r["count"] for r in seen], float)
    weights = np.zeros(SLOTS + 1)
    if len(seen):
        good = dict(zip(patterns.tolist(), fit_labellers(patterns, counts)[0].tolist(), strict=True))
        keys = keyed(texts)
        drawn = priority_sample(keys, max_train)
        picked = docs.sparkSession.createDataFrame([d[:2] for d in drawn], "h long, g long")
        sample = keys.join(F.broadcast(picked), ["h", "g"], "left_semi").select("text", "h", "g")
        sample = sample.mapInArrow(_once, "text string, h long, g long").dropDuplicates(["h", "g"])
        rows = sample.mapInArrow(_featured, "h long, g long, pattern long, slots array<int>, values array<float>").toArrow()
        weights = _trained(rows, good, np.array([d[2] for d in drawn]))
        del rows
        pa.default_memory_pool().release_unused()

    def judge(batches):
        for batch in sliced(batches):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            scores = []
            for s in _slices(raw):
                hashed = word_hashes(raw[s])
                row, slot, value = features(raw[s], statistics(raw[s], hashed), hashed)
                scores.append(np.bincount(row, weights[slot] * value, minlength=len(raw[s])) + weights[-1])
            p = 1 / (1 + np.exp(-np.concatenate(scores))) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= threshold)], names=[*batch.schema.names, "quality_score", "keep"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, kinds + ", quality_score double, keep boolean")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "keep")


QUERIES = {"op7_quality": op7_quality}
SQL: dict = {}

"""The quality classifier's statistics, votes, EM, features and training against plain Python."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import quality
from touchline.llm.hashing import word_hashes

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MADE = ["", " \n ", "one", "BUY NOW!!! $$$ *** " * 40, "a b " * 500, "The end of the day. Is it?\tThe DOG, 中文 é—x -- 12 @#", "w " * 7 + "x", " ".join(f"w{k % 97}" for k in range(1700)), "\x01\x02 \x7f ~~", "ABC def!? " * 3]


def plain_statistics(text):
    """The nine statistics of one text, from their descriptions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    if not words:
        return [math.nan] * 9
    raw = text.encode()
    chars = [b for b in raw if b > 32]
    symbol = sum(33 <= b < 128 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()" for b in chars)
    capitals, letters = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    n, k = len(words), len(words) + 5
    bare = sum(not any(b >= 128 or chr(b).isalnum() for b in w) for w in re.findall(rb"[^\x00-\x20]+", raw))
    distinct = sum(len(set(words[a : a + 400])) for a in range(0, n, 400))
    runs = [tuple(words[a : a + 8]) for a in range(n - 7)]
    return [
        symbol / (len(chars) + 20), capitals / (letters + 20), raw.count(b"!") / k, bare / k, sum(a == b for a, b in zip(words, words[1:])) / k, (n - distinct) / max(n, min(k, 400)),
        -sum(w in quality.FUNCTION_WORDS for w in words) / k, -(raw.count(b".") + raw.count(b"?")) / k, (len(runs) - len(set(runs)) + 0.5) / (len(runs) + 5),
    ]


def plain_votes(stats):
    return tuple(1 if math.isnan(x) else 2 if x <= good else 0 if x >= bad else 1 for x, (_, bad, good) in zip(stats, quality.LABELLERS, strict=True))


def plain_em(counts, rounds=100):
    """Each pattern's probability of good."""
    total = sum(counts.values())
    good = {p: 1 / (1 + math.exp(4.0 * p.count(0) - 2.0)) for p in counts}
    for _ in range(rounds):
        rates = {}
        for c in (0, 1):
            weight = {p: n * (good[p] if c else 1 - good[p]) for p, n in counts.items()}
            for m in range(9):
                for x in range(3):
                    rates[c, m, x] = (sum(w for p, w in weight.items() if p[m] == x) + quality.PSEUDO[c][x]) / (sum(weight.values()) + quality.PSEUDO[c].sum())
        prior = (sum(n * good[p] for p, n in counts.items()) + 1) / (total + 2)
        for p in counts:
            logs = [sum(math.log(rates[c, m, x]) for m, x in enumerate(p)) for c in (0, 1)]
            good[p] = 1 / (1 + math.exp(min(50, max(-50, logs[0] - logs[1] + math.log((1 - prior) / prior)))))
    return good


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + MADE


def test_statistics_and_votes(texts):
    got = quality.statistics([t.encode() for t in texts])
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True)
    assert [tuple(v) for v in quality.votes(got).tolist()] == [plain_votes(s) for s in want.tolist()]


def test_em_and_posteriors(texts):
    counts = Counter(plain_votes(plain_statistics(t)) for t in texts)
    want = plain_em(counts)
    numbers = {int(quality.pattern_of(np.array([p]))[0]): p for p in counts}
    patterns = np.array(sorted(numbers), np.int64)
    good, _, _ = quality.fit_labellers(patterns, np.array([counts[numbers[int(p)]] for p in patterns], float))
    assert len(counts) > 10 and good.tolist() == pytest.approx([want[numbers[int(p)]] for p in patterns], rel=1e-8, abs=1e-12)


def plain_features(text):
    """Slots of one text with their values."""
    words = word_hashes([text.encode()])[0].tolist()
    out, grams = Counter(), Counter()
    kinds = [int(quality._CLASS[b]) for b in b"  " + text.encode() + b"  "]
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        grams[(((a * 131 + b) * 131 + c) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52] += 1
    said = Counter(w >> 48 for w in words)
    mixed = lambda h: int(quality.mix(np.array([h % (1 << 64)], np.uint64))[0])
    said.update(mixed(a + 3 * b) >> 48 for a, b in zip(words, words[1:]))
    for k, (x, (_, bad, good)) in enumerate(zip(plain_statistics(text), quality.LABELLERS, strict=True)):
        low, high = min(bad, good) - abs(bad - good), max(bad, good) + abs(bad - good)
        spot = 9 if math.isnan(x) else sum(low + (high - low) * j / 7 < x for j in range(8))
        out[((k * 64 + spot + 1) * 0xD1B54A32D192ED03 % (1 << 64)) >> 52] += 0.5
    for slot, n in grams.items():
        out[slot] += math.sqrt(n / (len(text.encode()) + 2))
    for slot, n in said.items():
        out[quality.CLASSES + slot] += math.sqrt(n / max(1, 2 * len(words) - 1))
    return out


def test_features_and_training(texts):
    some = [t for t in texts if len(t) < 3000][:25] + MADE
    raw = [t.encode() for t in some]
    hashed = word_hashes(raw)
    rows, slots, values = quality.features(raw, quality.statistics(raw, hashed), hashed)
    got = [Counter() for _ in some]
    for r, s, v in zip(rows.tolist(), slots.tolist(), values.tolist(), strict=True):
        got[r][s] += v
    want = [plain_features(t) for t in some]
    inner = [k for k, t in enumerate(some) if t]  # the neighbours' spaces stand about an empty text
    for k in inner:
        edge = {s for s in set(got[k]) | set(want[k]) if abs(got[k][s] - want[k][s]) > 1e-9}
        assert len(edge) <= 3, (k, edge)  # trigrams at the very ends reach over one space more or less
    target, weight = np.linspace(0.1, 0.9, len(some)), np.arange(1.0, len(some) + 1)
    w, bias, speed, part = Counter(), 0.0, Counter(), weight / weight.sum()
    own, speed_b = got, 1e-8
    for _ in range(4):
        slips = [(1 / (1 + math.exp(-(sum(w[s] * v for s, v in f.items()) + bias))) - t) * p for f, t, p in zip(own, target, part, strict=True)]
        step = Counter()
        for f, slip in zip(own, slips, strict=True):
            for s, v in f.items():
                step[s] += slip * v
        for s in {s for f in own for s in f}:
            g = step[s] + 1e-5 * w[s]
            speed[s] += g * g + (1e-8 if s not in speed else 0)
            w[s] -= 0.5 * g / math.sqrt(speed[s])
        speed_b += sum(slips) ** 2
        bias -= 0.5 * sum(slips) / math.sqrt(speed_b)
    fitted = quality.fit_scorer(rows, slots, values, target, weight, rounds=4)
    assert fitted[-1] == pytest.approx(bias) and all(fitted[s] == pytest.approx(v, rel=1e-6, abs=1e-9) for s, v in w.items())


def test_the_scorer_is_fitted_in_parts(monkeypatch):
    """The driver holds little beside the features, and the weights are those of one pass over them all, to the last bit."""
    rng = np.random.default_rng(3)
    count = np.concatenate([[0, 500_000, 0], rng.integers(0, 9000, 700), [0]])
    rows = np.repeat(np.arange(len(count)), count)
    slots, values = rng.integers(0, quality.SLOTS, len(rows)).astype(np.int32), rng.random(len(rows), np.float32)
    target, weight = rng.random(len(count)), rng.random(len(count))
    tracemalloc.start()
    got = quality.fit_scorer(rows, slots, values, target, weight, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(rows), peak / len(rows)
    w, speed, part = np.zeros(quality.SLOTS + 1), np.full(quality.SLOTS + 1, 1e-8), weight / weight.sum()
    for _ in range(3):
        slip = (1 / (1 + np.exp(-(np.bincount(rows, w[slots] * values, minlength=len(target)) + w[-1]))) - target) * part
        step = np.append(np.bincount(slots, slip[rows] * values, minlength=quality.SLOTS), slip.sum())
        step[:-1] += 1e-5 * w[:-1]
        speed += step * step
        w -= 0.5 * step / np.sqrt(speed)
    assert (got == w).all()
    # the same from Arrow rows in any order and any chunks
    ends = np.cumsum(count)
    table = pa.table({"h": np.arange(len(count)) // 2, "g": np.arange(len(count)), "pattern": np.arange(len(count)), "slots": [slots[b - n : b] for n, b in zip(count, ends, strict=True)], "values": [values[b - n : b] for n, b in zip(count, ends, strict=True)]})
    mixed = table.take(pa.array(rng.permutation(len(count))))
    monkeypatch.setattr(quality, "_fit", lambda parts, target, weight, fit=quality._fit: fit(parts, target, weight, rounds=3))
    assert (quality._trained(pa.concat_tables([mixed.slice(k, 100) for k in range(0, len(count), 100)]), dict(enumerate(target.tolist())), weight) == w).all()

"""Operators 11 to 13 against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from touchline.llm import repair, resample, runs, shared, simhash

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(shared.UPPER, shared.LOWER)
LONG = "A line that is long enough to be counted by the operator"
ODD = [(1, None), (2, ""), (3, f"{LONG}\nb"), (4, f"  {LONG.upper()}\t\nc\n"), (5, f"{LONG}\n{LONG}"), (5, f"{LONG}\n{LONG}"), (None, LONG), (6, "x" * 200_000 + " y" * 1000), (7, "é▁ 中\U0001f600\r\n"), (8, "..., !"), (9, "one"), (10, "Two words")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, rows):
    """Documents with columns that operators use inside for themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as print", "1 as n", "'y' as key", "2 as weight", "'z' as rank", "3 as place", "4 as part", "5 as able")


def pairs_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# 12 SimHash


def brute_prints(rows):
    out = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        out.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def brute_parts(prints, most=2):
    """The smallest doc_id that each print reaches."""
    values = sorted({p for d, p in prints if d is not None})
    parent = {p: p for p in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                parent[root(a)] = root(b)
    lowest = {}
    for d, p in prints:
        if d is not None:
            lowest[root(p)] = min(d, lowest.get(root(p), d))
    return {p: lowest[root(p)] for p in values}


def test_simhash_brute_force(spark, docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    edited = [(1000 + k, " ".join([*base[:299], f"e{k % 40}"])) for k in range(80)]
    for rows in (pairs_of(docs) + edited, ODD):
        prints = brute_prints(rows)
        parts = brute_parts(prints)
        want = sorted(((d, p - (1 << 64) * (p >> 63), parts[p] if d is not None else None) for d, p in prints), key=str)
        got = simhash.simhash_duplicates(odd(spark, rows)).collect()
        assert sorted(((r.doc_id, r.print, r.component_id) for r in got), key=str) == want
    assert len(set(parts.values())) < len(rows)
    assert simhash.simhash_duplicates(odd(spark, [])).count() == 0


@pytest.mark.parametrize("most_paired", [1, 4, 1000])
def test_simhash_links_of_prints(spark, most_paired):
    """Crowded cubes, chains of single bits and random prints: the same components by pairs, by midpoints and by both."""
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        base, places = rng.getrandbits(64), rng.sample(range(64), 12)
        values |= {base ^ sum(1 << b for b in places if rng.random() < 0.5) for _ in range(120)}
    for seed in rng.sample(sorted(values), 60):
        for bits in (1, 2, 3):
            values.add(seed ^ sum(1 << b for b in rng.sample(range(64), bits)))
    values |= {0, 1, 3, 7, 1 << 63, (1 << 64) - 1, (1 << 64) - 4}
    numbers = {p: k for k, p in enumerate(sorted(values))}
    want = brute_parts([(k, p) for p, k in numbers.items()])
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in values], "print long")
    found = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.print_links(df, most_paired).collect()}
    assert all((a ^ b).bit_count() in (1, 2) for a, b in found)
    parent = {p: p for p in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    groups = collections.defaultdict(set)
    for p in values:
        groups[root(p)].add(p)
    assert {p: min(numbers[q] for q in groups[root(p)]) for p in values} == want


def test_simhash_very_long_text_in_slices(monkeypatch):
    text = " ".join(f"W{k % 701}" for k in range(5000))
    table = simhash._TABLE
    whole = [simhash._text_prints(w, 3).tolist() for w in runs.words_of(pa.array([text, "a b", None]), table)]
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(runs, "BUFFER_BYTES", 1000)
    cut = [simhash._text_prints(w, 3).tolist() for w in runs.words_of(pa.array([text, "a b", None]), table)]
    assert sum(whole, []) == sum(cut, []) == [p for _, p in brute_prints([(0, text), (1, "a b"), (2, None)])]


# 13 importance resampling


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, percent=5, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, brute_features(text)[1]))
    for text in target:
        t.update(map(bucket, brute_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        n, features = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        out.append([doc, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resample_brute_force(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    many = ODD + [(20 + k, " ".join(f"w{(k * j) % 37}" for j in range(25))) for k in range(50)] + [(None, "again " * 30), (21, "tied " * 30)]
    for rows, percent in ((pairs_of(docs), 5), (many, 40)):
        got = resample.resample(odd(spark, rows), target.selectExpr("*", "1 as bucket", "2 as n"), percent).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resample(rows, texts, percent)))
    empty = resample.resample(odd(spark, ODD), target.limit(0), 100).collect()
    assert sorted(map(str, map(tuple, empty))) == sorted(map(str, brute_resample(ODD, [], 100)))
    assert resample.resample(odd(spark, []), target).count() == 0


def test_derived_crcs(monkeypatch):
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 7)
    texts = ["One, two; three four-five\nsix é7 中▁ x", None, "", "!?", "z" * 70_000 + " q " + "y" * 300, "a b c d e f g h i j k l m n o p"] * 3
    got = collections.Counter()
    for words in runs.words_of(pa.array(texts), resample._TABLE):
        for text, crc in resample.run_crcs(words):
            got.update(zip((text + words.rows.start).tolist(), crc.tolist(), strict=True))
    assert got == collections.Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in brute_features(t)[1])


def test_shifts_are_zero_bytes():
    states = np.array([0, 1, 0xFFFFFFFF, 0x12345678], np.uint32)
    for n in (0, 1, 255, 256, 257, 70_000, 1 << 24):
        got = resample.shifted(states, np.full(4, n))
        assert got.tolist() == [zlib.crc32(b"\0" * n, int(s)) ^ zlib.crc32(b"\0" * n) for s in states]
    assert resample.before_space(np.array([zlib.crc32(b"abc ")], np.uint32)).tolist() == [zlib.crc32(b"abc")]


# 11 conversation repair


def brute_edits(rows):
    """(cost, audit, repaired rows) by a forward search that keeps, for each state, the cheapest and then ASCII-least audit."""

    def inserted(best):
        for _ in range(4):
            for q, (cost, audit, out) in list(best.items()):
                to = "a" if q == "u" else "u"
                mine = (cost + 5, audit + "I", out + [({"u": "user", "a": "assistant"}[to], "")])
                best[to] = min(mine, best.get(to, mine))
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        found = {}
        for q, (cost, audit, out) in inserted(best).items():
            moves = [("D", 2, q, out)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in (("s", "u") if q == "" else ("a",) if q == "u" else ("u",)):
                    moves.append(("K", extra, role[:1], [*out, (role, text)]))
                to = "a" if q == "u" else "u"
                moves.append(("R", 1 + extra, to, [*out, ({"u": "user", "a": "assistant"}[to], text)]))
            for edit, fee, to, after in moves:
                mine = (cost + fee, audit + edit, after)
                found[to] = min(mine, found.get(to, mine))
        best = found
    ends = inserted(best)
    return min(ends[q] for q in ("", "a") if q in ends)


def brute_repair(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs[conv]
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in own:
            body = text.rstrip(shared.SPACES)
            fault = "blank" if not body.lstrip(shared.SPACES) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        starts = [r[:1] for _, r, _ in own]
        cost, audit, repaired = brute_edits(marked)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        ))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def query11(spark, rows):
    """The query's own steps over some rows with columns that clash."""
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as place", "1 as kind", "2 as fault", "'z' as edit", "4 as copy")
    reports, repaired = repair.repair_conversations(repair.damaged(turns), turns)
    digests = {r.conv_id: r.repaired_sha256 for r in repaired.mapInArrow(repair._digests, "conv_id long, repaired_sha256 string").collect()}
    return [(*tuple(r), digests.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in reports.collect()]


def test_repair_brute_force(spark):
    rng, rows = random.Random(5), []
    for conv in range(300):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5]), role, rng.choice([f"Text {rng.randrange(4)}.", "cut off", " \t", None, "Is it?\n", "é!"])))
    rows += [(None, k, "user", "x.") for k in range(9)] + [(-5, 1, "user", "y" * 300_000 + ".")]
    rows += [(77777, k, rng.choice(["user", "assistant"]), f"{k % 50}.") for k in range(3000)]
    assert sorted(map(str, query11(spark, rows))) == sorted(map(str, brute_repair(rows)))
    assert query11(spark, []) == []


def test_repair_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op11_conversation_repair(spark, SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_repair(rows)))


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_block_tables(size):
    """Any block length gives what a plain search gives."""
    made, rng = repair.Tables(size), random.Random(size)
    names = ["system", "user", "assistant", "tool"]
    for _ in range(1500):
        symbols = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(15)))
        rows = [(names[x % 4], "", "blank" if x == 8 else "truncated" if x >= 4 else "") for x in symbols]
        assert made.cheapest(symbols) == brute_edits(rows)[:2]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_importance_resampling"])
def test_sql(spark, name):
    import duckdb

    from compare import plain
    from touchline.llm import registered

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registered.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(registered.SQL[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[heads.index(c)]) for c in cols) for r in cur.fetchall())

"""Each operator against brute force or an exact round trip, and its edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import chat, decontaminate, jaccard, lines, neighbours, quality, sentencepiece_scan, shared, token_counts, token_files, urls

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(shared.UPPER, shared.LOWER)
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, rows, extra=True):
    """Documents with columns that operators use inside for themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as rep", "1 as n", "'y' as h", "2 as token", "'z' as keep") if extra else df


LONG = "A line that is long enough to be counted by the operator"
ODD = [(1, None), (2, ""), (3, f"{LONG}\nb"), (4, f"  {LONG.upper()}\t\nc\n"), (5, f"{LONG}\n{LONG}"), (5, f"{LONG}\n{LONG}"), (None, LONG), (6, "x" * 200_000 + " y" * 1000), (7, "é\u2581 中\U0001f600\r\n")]


# 10 line dedup


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda s: s.strip(shared.SPACES).translate(FOLD)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        ls = (text or "").split("\n")
        stay = [s for s in ls if doc is None or len(holders[key(s)]) < min_docs or max(holders[key(s)]) == doc]
        out.append((doc, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_lines_brute_force(spark, docs):
    for rows in ([tuple(r) for r in docs.select("doc_id", "text").collect()], ODD):
        got = lines.dedup_lines(odd(spark, rows), batches=3).collect()
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got], key=str) == brute_lines(rows)


def test_lines_carry_and_batch_size(spark, docs):
    """Columns named like the result's or the operator's own; batches made by size give the same."""
    df = odd(spark, ODD).selectExpr("doc_id", "text", "1 as gone", "2 as n_lines", "3 as n_dropped", "4 as batch", "5 as keeper")
    out = lines.dedup_lines(df, carry=("gone", "n_lines", "n_dropped", "batch", "keeper"))
    assert out.columns == ["doc_id", "gone", "batch", "keeper", "text", "n_lines", "n_dropped"]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()], key=str) == brute_lines(ODD) and out.where("gone = 1 and batch = 4 and keeper = 5").count() == len(ODD)
    small = lines.dedup_lines(docs, batches=1, batch_docs=60)
    assert sorted(small.select("doc_id", "n_dropped", "text").collect()) == sorted(lines.dedup_lines(docs).select("doc_id", "n_dropped", "text").collect())


def test_lines_empty_and_compaction(spark):
    assert lines.dedup_lines(odd(spark, [])).count() == 0
    runs = lines.LineRuns(spark, 4, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(bytes([k % 3]), 1, 10 - k)], "h binary, n long, keeper long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r.h)[0]: (r.n, r.keeper) for r in runs.counts().collect()} == {0: (2, 10), 1: (2, 9), 2: (1, 8)}


# 2 Jaccard join


def brute_components(rows, words, num, den):
    """Of each row (numbered if doc_ids repeat) its set's size and the smallest doc_id that it reaches."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[doc] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(seed, sizes, words=400):
    """Groups of edited copies: few and many edits, short and long texts, a common passage."""
    rng, out = random.Random(seed), []
    passage = [f"p{k}" for k in range(40)]
    for group, (copies, length, edits) in enumerate(sizes):
        base = [f"w{rng.randrange(words)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(own + (passage if group % 2 else []))))
    return out


def test_jaccard_brute_force(spark, docs):
    made = corpus(1, [(30, 60, 4), (20, 9, 1), (20, 12, 1), (15, 17, 2), (40, 150, 8), (25, 6, 1), (30, 25, 2)])
    for rows, words, num in (([tuple(r) for r in docs.select("doc_id", "text").collect()], 4, 85), (made, 4, 85), (made, 5, 80), (made, 2, 60)):
        want = brute_components(rows, words, num, 100)
        got = jaccard.near_duplicates(odd(spark, rows), words, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_edges(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd(spark, ODD), 4, 85, 100).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 10, 3), (None, 9, None)} <= got and len([x for x in got if x[0] == 5]) == 1
    text, near, other = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "u v w x y z " * 3
    rows = [(5, text), (5, other), (9, near), (1, text), (None, text), (12, other), (12, "alone in the table"), (12, "alone in the table")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd(spark, rows), 4, 85, 100).collect())
    assert got == sorted([("5", 17, 1), ("5", 6, 5), ("9", 17, 1), ("1", 17, 1), ("None", 17, None), ("12", 6, 5), ("12", 1, 12), ("12", 1, 12)])
    assert jaccard.near_duplicates(odd(spark, []), 4, 85, 100).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_jaccard_long_words(spark):
    """Words that polynomial hashes confuse by construction, and a word of a megabyte, are told apart."""
    swap = str.maketrans("ab", "ba")
    words = [w for n in (8, 1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n).translate(swap))] + ["m" * (1 << 20), "m" * (1 << 20) + "n", "m" * ((1 << 20) - 1)]
    rows = list(enumerate(words)) + [(100 + k, f"one two three four {w} five six seven") for k, w in enumerate(words)]
    for words_, num in ((4, 85), (5, 80)):
        got = jaccard.near_duplicates(odd(spark, rows), words_, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, words_, num, 100)
    from touchline.llm.hashing import word_hashes

    assert len(set(word_hashes([w.encode() for w in words])[0].tolist())) == len(words)


def test_jaccard_branches(spark, monkeypatch):
    """Short texts that differ by a word at the end: their links come from the light branch, or from the heavy one where it is closed."""
    rng, rows = random.Random(4), []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 18))]
        rows += [(len(rows) + k, " ".join(base[: len(base) - k % 2])) for k in range(2)]
    rows += [(1000 + k, " ".join(["the same ten words stand in front of every one of these texts"] + [f"x{k}"] * 2)) for k in range(60)]
    want = brute_components(rows, 4, 85, 100)
    links = sum(want[d][1] != d for d, _ in rows)
    assert links >= 30
    join = lambda: jaccard.JaccardJoin(odd(spark, rows), 4, 85, 100)
    chosen = join()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in chosen.run().collect()} == want and chosen.boundary >= 8
    # all sets have 17 elements at most: with boundary 20 no inverted list is left, so every link is the light branch's
    for most in (0, 20):
        monkeypatch.setattr(jaccard.JaccardJoin, "_boundary", lambda self, post, shared, most=most: most)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in join().run().collect()} == want


def test_jaccard_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_ROWS", 0)
    made = corpus(2, [(20, 60, 4), (20, 12, 1)])
    got = jaccard.near_duplicates(odd(spark, made), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(made, 4, 85, 100)


def test_jaccard_plans_few_queries(spark):
    """The driver plans and keeps every query, so there are few: none for a round without pairs, none to look up components again."""
    made = corpus(2, [(20, 60, 4), (20, 12, 1)])
    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsCount()
    got = jaccard.near_duplicates(odd(spark, made), 4, 85, 100).collect()
    after = seen.executionsCount()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(made, 4, 85, 100)
    planned = [seen.executionsList(before, after - before).apply(k).physicalPlanDescription() for k in range(after - before)]
    joins = sum(len(re.findall(r"^\(\d+\) (?:SortMergeJoin|BroadcastHashJoin)", p, re.M)) for p in planned)
    assert after - before <= 42 and joins <= 66, (after - before, joins)


def test_subset_sizes_meet():
    for n in range(1, 21):
        for m in range(n, 21):
            c = jaccard.least_overlap(n, m, 85, 100)
            if c <= n:
                assert c in jaccard.subset_sizes(n, 85, 100, 20) and c in jaccard.subset_sizes(m, 85, 100, 20)


def test_components(spark):
    links = [(k + 1, k) for k in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# 1 decontamination


def edit_search(p, t):
    row, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(t):
        new = [0]
        for i, a in enumerate(p):
            new.append(min(row[i] + (a != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, (row[-1], j + 1))
    return best


def test_myers():
    rng = random.Random(2)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (14, 40))
        assert decontaminate.myers(p, t) == edit_search(p, t)


def test_leaks_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdefgh éñ"
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(30, 90)))) for k in range(12)] + [(12, None), (13, "short")]
    rows = []
    for k in range(60):
        item = decontaminate.normalise(items[k % 12][1]).decode()
        edited = list(item)
        for _ in range(rng.randrange(7)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "x", "yz"])
        rows.append((k, "".join(rng.choice(letters) for _ in range(50)) + " " + "".join(edited).upper() + "! " + "".join(rng.choice(letters) for _ in range(50))))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(odd(spark, rows), spark.createDataFrame(items, "item_id long, text string"), rate=0.1, block_bytes=300).collect()}
    want = set()
    for doc, text in rows:
        for item, said in items:
            p, t = decontaminate.normalise(said).decode(), decontaminate.normalise(text).decode()
            if len(p) >= 16 and (d := edit_search(p, t)[0]) <= int(0.1 * len(p)):
                want.add((doc, item, d))
    assert got == want and len(want) > 20


def test_leaks_short_items(spark):
    items = [(1, "Paris?"), (2, "北京是首都"), (3, "été"), (4, "!?"), (5, "a longer question, to be found with edits"), (6, "4"), (7, None)]
    rows = [(1, "In comparison, parisian; then (PARIS) 44 or x4"), (2, "我们说北京是首都。"), (3, "étés, l'été"), (4, "a longer question to be found withedits; 4"), (5, None), (6, "")]
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.stop, r.short) for r in decontaminate.find_leaks(odd(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = {d: decontaminate.normalise(t).decode() for d, t in rows}
    at = lambda d, said: (plain[d].rindex(said), plain[d].rindex(said) + len(said))
    assert {g for g in got if g[5]} == {(1, 1, 0, *at(1, "paris"), True), (2, 2, 0, *at(2, "北京是首都"), True), (3, 3, 0, *at(3, "été"), True), (4, 6, 0, *at(4, "4"), True)}
    assert {g[:3] for g in got if not g[5]} == {(4, 5, 1)}


def test_leaks_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_leaks_long_texts_and_repeated_rows(spark):
    """A passage deep in a very long text, repeated documents and items, null ids, and columns named like the result's."""
    item = "which river flows through the old town and under the seven bridges of the harbour"
    long_ = "filler words " * 60_000 + item.upper() + " tail " * 1000
    rows = [(1, long_), (2, item), (2, item), (None, item), (3, "nothing of it")]
    items = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string").selectExpr("*", "1 as distance", "2 as start", "3 as doc_id")
    docs = odd(spark, rows).selectExpr("*", "1 as distance", "2 as stop", "true as short")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance, r.short) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == sorted([(d, i, 0, False) for d in ("1", "2", "2", "None") for i in ("7", "7", "None")])


# 3 URL filters


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(FOLD)
    fits = [(len(h + p), h + p, said) for said, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    given = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [None, "", "no-scheme", "http://COM", "http://com/", "http://x.Example.COM/en/a?b#c", "https://www.example.com/en/", "http://evilnet/es/", "a://b.net/es/x://y", "http://é.net#f"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(given)], "page_id long, url string").selectExpr("*", "'h' as host", "'s' as score")
    for r in urls.filter_urls(df).collect():
        host, path, rule, verdict = brute_rule(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict) and (r.score is None) == (verdict is not None)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_urls_long_repeated_and_own_labels(spark):
    given = ["http://a.org/" + "x/" * 100_000, "http://" + "sub." * 20_000 + "example.com/en/", "http://b.org/q", "http://b.org/q"]
    df = spark.createDataFrame([(k // 3, u) for k, u in enumerate(given)], "page_id long, url string").selectExpr("*", "'v' as verdict", "'r' as rule", "'b' as blocked")
    out = urls.filter_urls(df).collect()
    assert len(out) == 4 and sorted(r.rule or "" for r in out) == ["", "", "", "example.com/en/"] and len({(r.host, r.verdict, r.score) for r in out if r.host == "b.org"}) == 1


def test_url_model_held_out(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    known = [(*brute_rule(r.url)[:2], brute_rule(r.url)[3] == "block") for r in rows if brute_rule(r.url)[3]]
    train, test = known[::2], known[1::2]
    w = urls.fit_urls([x[0] for x in train], [x[1] for x in train], [x[2] for x in train])
    said = urls.score_urls(w, [x[0] for x in test], [x[1] for x in test]) > 0
    assert np.mean(said == np.array([x[2] for x in test])) > 0.95


# 4 chat formatting


def test_chat_round_trip(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (1, 2, None, None), (1, 2, "assistant", "é中\U0001f600 \\\\#<:"), (2, 5, "a:b\\", ""), (None, 0, "assistant", "x"), (3, None, "user", "y\n"), (3, None, "user", "y\n")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 as grp", "'f' as formatted")).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        want = sorted([x[1:] for x in rows if x[0] == conv], key=lambda x: ((x[0] is not None, x[0] or 0), (x[1] is not None, x[1] or ""), x[2] or ""))
        turns = chat.parse(r.formatted)
        assert turns == [(a or "", b or "") for _, a, b in want] and r.n_turns == len(want)
        assert [chat.unescape(r.formatted[s.start : s.stop]) for s in r.loss_spans] == [b or "" for _, a, b in want if a == "assistant"]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_long_texts_in_parts(spark):
    """A batch of several megabytes is cut into parts; nothing changes at their edges."""
    rows = [(k // 3, k % 3, "assistant" if k % 3 else "user", f"#{k} <" + "é\\#" * 150_000) for k in range(12)] + [(50, 0, "user", "\n" * 2_000_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()}
    assert set(got) == {0, 1, 2, 3, 50}
    for conv, r in got.items():
        assert chat.parse(r.formatted) == [x[2:] for x in rows if x[0] == conv]
        assert [chat.unescape(r.formatted[s.start : s.stop]) for s in r.loss_spans] == [x[3] for x in rows if x[0] == conv and x[2] == "assistant"]


# 5 neighbours


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16)).astype(np.float32)
    base[100:160] = base[100]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (1020, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as cell")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, stripe=150, query_block=10).collect()}
    b, hits = base.astype(float), 0
    for q in range(0, 700, 20):
        s = np.zeros(700)
        for d in range(16):
            s += b[:, d] * b[q, d]
        order = [v for v in np.lexsort((np.arange(700), -s)) if v != q][:20]
        hits += sum(got[q, k + 1] == (v, s[v]) for k, v in enumerate(order))
    assert len(got) == 35 * 20 and hits >= 0.99 * len(got)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).count() == 2
    assert neighbours.nearest(df.where("vec_id > 999"), F.col("vec_id") % 20 == 0).count() == 0  # none takes part


def test_neighbours_repeated_rows(spark):
    """Equal rows are candidates each and asked once; a vec_id with two vectors is ranked for each; copies tie by id."""
    rows = [(20, [1.0, 0.0])] * 3 + [(20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 2.0]), (2, [0.5, 2.0])] + [(k, [0.25, 0.25]) for k in range(5, 60, 5) if k % 20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=6).collect())
    one = [(1, 1.0), (2, 0.5), (2, 0.5), (5, 0.25), (10, 0.25), (15, 0.25)]
    two = [(2, 2.0), (2, 2.0), (1, 0.5), (5, 0.25), (10, 0.25), (15, 0.25)]
    assert got == sorted((20, k + 1, *x) for some in (one, two) for k, x in enumerate(some))


def test_neighbours_bounds():
    """Codes leave few vectors to score exactly and lose no neighbour."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(16384, 64))
    turn = neighbours.rotation(64, neighbours.code_bits(64))
    asked = np.arange(0, 16384, 400)
    search = neighbours.Search(asked, x[asked], turn, 21, 4.0)
    search.add(x, neighbours.Codes(*neighbours.encode_bits(x, turn)), [[k] for k in range(16384)], [[1]] * 16384)
    assert search.met == len(asked) * 16384 and search.scored < 0.05 * search.met
    got, want = {}, {}
    for j, vec_id, _ in search.found(20):
        got.setdefault(j, []).append(vec_id)
    for j, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -np.inf
        want[j] = np.argsort(-s)[:20].tolist()
    assert np.mean([v in got[j] for j in want for v in want[j]]) >= 0.999


def test_neighbours_estimate_is_unbiased():
    rng = np.random.default_rng(12)
    x, q = rng.normal(size=(20_000, 40)), rng.normal(size=40)
    turn = neighbours.rotation(40, 512)
    codes = neighbours.Codes(*neighbours.encode_bits(x, turn))
    guess, most = neighbours.estimates(codes, neighbours.Asked(q, turn), 1.0)
    off = (guess - x @ q / np.linalg.norm(q) / codes.unit) / (most - guess)
    assert abs(off.mean()) < 0.05 and 0.9 < off.std() < 1.1 and np.mean(np.abs(off) > 4) < 0.001


@pytest.mark.parametrize("size", [1e-30, 1e25])
def test_neighbours_of_any_length(spark, size):
    """Very long and very short vectors, in several blocks: nothing overflows, and the codes still choose."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(900, 24)) * size
    base[::50] *= 1e3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id long, embedding array<double>")
    with np.errstate(over="raise"):
        got = {}
        for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, stripe=200, query_block=10).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 900, 20):
        s = base @ (base[q] / size)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.99 * 45 * 20
    turn = neighbours.rotation(24, 512)
    search = neighbours.Search(np.array([0]), base[:1], turn, 21, 4.0)
    for k in range(0, 900, 300):
        own = base[k : k + 300]
        search.add(own, neighbours.Codes(*neighbours.encode_bits(own, turn)), [[k + j] for j in range(300)], [[1]] * 300)
    assert search.scored < search.met


# 6 and 9 tokens


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode_batch(texts, add_special_tokens=False)


def test_token_counts_carry(spark):
    df = spark.createDataFrame([(1, "one\ntwo", 5, 6, 7)], "doc_id long, text string, section long, n_tokens long, other long")
    out = token_counts.count_tokens(df, BPE, carry=("doc_id", "section", "n_tokens", "n_chars", "other"))
    assert out.columns == ["doc_id", "other", "section", "n_chars", "n_tokens", "n_crossing"] and [(r.section, r.n_chars, r.other) for r in out.collect()] == [(0, 4, 7), (1, 3, 7)]


def test_token_counts(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()][:120] + [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "a\n\n b\né中\U0001f600\n"), (9004, "a\n\n b\né中\U0001f600\n")]
    for rule in token_counts.RULES:
        got = collections.Counter((r.doc_id, r.section, r.n_chars, r.n_tokens, r.n_crossing) for r in token_counts.count_tokens(odd(spark, rows), BPE, rule).collect())
        want = collections.Counter()
        for (doc, text), enc in zip(rows, library_ids([t or "" for _, t in rows]), strict=True):
            text = text or ""
            cuts = [0] + [k + 1 for k, c in enumerate(text[:-1]) if c == "\n"]
            tokens, crossing = [0] * len(cuts), [0] * len(cuts)
            of = lambda p, cuts=cuts: max(k for k, c in enumerate(cuts) if c <= p)
            for a, b in enc.offsets:
                first, last = of(a), of(max(a, b - 1))
                own = {"first": first, "last": last}.get(rule)
                if own is None:
                    own = max(range(first, last + 1), key=lambda k: (sum(of(p) == k for p in range(a, b)), -k))
                tokens[own] += 1
                crossing[own] += first != last
            for k, c in enumerate(cuts):
                want[doc, k, (cuts + [len(text)])[k + 1] - c, tokens[k], crossing[k]] += 1
        assert got == want
    given = spark.createDataFrame([(1, "hello world again", [6, None, 99, 6, -3])], "doc_id long, text string, at array<long>")
    assert [(r.section, r.n_chars, r.n_tokens, r.n_crossing) for r in token_counts.count_tokens(given, BPE, sections="at").orderBy("section").collect()] == [(0, 6, 2, 1), (1, 11, 1, 0)]
    assert token_counts.count_tokens(odd(spark, []), BPE).count() == 0


def test_units_equal_library():
    """Ids and offsets of random Unicode, of white space, apostrophes and special tokens in any mixture, and of very long units."""
    from touchline.llm.subwords import Encoder

    rng = random.Random(1)
    pool = list("ab cd  ''''strevmldl\n\t\r\xa0\u3000\u0085\u2003\u200b é ßñ中文日本ก١٢²½Ⅷ\U0001f600\u200d!?.,-_\u0301\0\x1f<|>123 4") + ["'s", "'re", "'ll", " '", "'ve", "'d", "\n\n", "  ", "<|endoftext|>", "''s", "'st"]
    any_ = lambda: chr(rng.randrange(0x20, 0xD7FF) if rng.random() < 0.7 else rng.randrange(0xE000, 0x110000))
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(6000)] + ["".join(any_() for _ in range(30)) for _ in range(1500)] + ["x" * 30_000, " " * 30_000, "", "a" + "\n" * 999 + "b"]
    rng.shuffle(texts)
    coder = Encoder(BPE, keep=500)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, starts, ends, counts, base = coder.spans(pa.array(part))
        want = library_ids(part)
        assert ids.tolist() == [k for e in want for k in e.ids] and counts.tolist() == [len(e.ids) for e in want]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(a + b, a + c) for e, a in zip(want, base.tolist(), strict=False) for b, c in e.offsets]
    assert all(len(unit) <= 64 for unit in coder.known.young)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, docs, planes):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(-5, None), (10**6, ""), (7, "again"), (8, "word " * 3000), (9, "word " * 3000), (None, "no id " * 1500), (None, None)]
    path = shared.new_path(spark, "files")
    token_files.write_token_files(odd(spark, rows), path, BPE, block=1000, planes=planes)
    want = collections.defaultdict(set)
    for (doc, _), enc in zip(rows, library_ids([t or "" for _, t in rows]), strict=True):
        want[doc].add(tuple([*enc.ids, 0]))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert r.start == start and r.n_tokens == len(ids) and ids in want[r.doc_id]
        start += len(ids)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_token_files(spark, path, checksums=True).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in got}
    index = token_files.chunk_index(spark, path).orderBy("start").collect()
    assert sum(r.n_ids for r in index) == start and all(a.start + a.n_ids == b.start for a, b in zip(index, index[1:], strict=False))


def test_token_files_empty(spark):
    path = shared.new_path(spark, "files")
    token_files.write_token_files(odd(spark, []), path, BPE)
    assert token_files.read_token_files(spark, path).count() == 0


# 7 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.keep for r in scored if r.quality == 1]) > 0.99
    assert np.mean([r.keep for r in scored if r.quality == 0]) < 0.1


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    m = len(quality.LABELLERS)
    truth = rng.random(20000) < 0.8
    right = np.linspace(0.7, 0.95, m)
    v = np.where(rng.random((20000, m)) < right, truth[:, None] * 2, 2 - truth[:, None] * 2)
    v[rng.random((20000, m)) < 0.3] = 1
    p, c = np.unique(quality.pattern_of(v), return_counts=True)
    good, rates, prior = quality.fit_labellers(p, c.astype(float))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(rates[1, :, 2] / (rates[1, :, 2] + rates[1, :, 0]) - right).max() < 0.05


def test_quality_edges(spark):
    df = odd(spark, [*ODD, (8, "The end of the day is in the end. It is a good day for the man and the dog."), (9, "BUY!! " * 300)])
    got = quality.score_quality(df).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.quality_score <= 1 for r in got) and got[0].rep == "x"
    assert quality.score_quality(df.limit(0)).count() == 0


def test_quality_sample(spark, docs):
    said = [r.text for r in docs.select("text").distinct().collect()]
    rows = said + [said[0]] * 150 + [None] * 40 + [""] * 30
    size = 50
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    drawn = quality.priority_sample(quality.keyed(df), size)
    mass = {(h, g): w for h, g, w in drawn}
    assert len(drawn) == len(mass) == size
    (copied,) = quality.keyed(df.where(F.col("text") == said[0])).distinct().collect()
    (empty,) = quality.keyed(df.where("coalesce(text, '') = ''")).select("h", "g").distinct().collect()
    assert mass[copied.h, copied.g] == 151 and mass[empty.h, empty.g] == rows.count(None) + rows.count("")
    assert 0.6 * len(rows) < sum(mass.values()) < 1.5 * len(rows)
    assert [w for *_, w in quality.priority_sample(quality.keyed(df.where("text <> ''").distinct()), 10_000)] == [1.0] * len({t for t in rows if t})
    scores = []
    for df in (df.repartition(3, "text"), spark.createDataFrame([(t,) for t in rows[::-1]], "text string").coalesce(1)):
        scores.append({r.text: r.quality_score for r in quality.score_quality(df, max_train=size).collect()})
    assert scores[0] == scores[1]


def test_quality_sees_whole_texts():
    names = [name for name, *_ in quality.LABELLERS]
    vote = lambda text: dict(zip(names, quality.votes(quality.statistics([b"before it", text.encode(), b"", b"after it"]))[1], strict=True))
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 700, n))
    head, block = prose(400), prose(900)
    assert vote(head)["sameness"] == vote(prose(8000))["sameness"] == 2 and vote(head)["copied"] == vote(prose(8000))["copied"] == 2
    assert vote(head + " the same few words come here again and again." * 600)["sameness"] == 0  # repetition from word 401 on
    assert vote(head + " the same few words come here again and again." * 40)["copied"] == 0
    assert vote(head + f" {block}" * 3)["copied"] == 0  # what repeats is longer than a block of words
    assert vote("a b")["copied"] == 1  # no run to tell by
    stats = quality.statistics([(head + " x" * k).encode() for k in (0, 1, 400, 4000)])[:, names.index("sameness")]
    assert abs(stats[1] - stats[0]) < 0.01 and stats[2] > stats[0] + 0.2 and stats[3] > 0.9
    assert quality.statistics([]).shape == (0, len(names)) and np.isnan(quality.statistics([b"", b" "])).all()


# 8 SentencePiece


def test_pieces_equal_library(spark, docs):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(8)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(9001, None), (9002, ""), (9003, "  a  b \n\n c "), (9004, "".join(rng.choice("abethrin") for _ in range(5000))), (9005, "é中\U0001f600\u2581x" * 400), (9005, "é中\U0001f600\u2581x" * 400)]
    for chunk in (300, 16384):
        encoded = sentencepiece_scan.encode_pieces(odd(spark, rows), PIECES, chunk)
        got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect())
        assert got == sorted((d, ref.encode(t or "")) for d, t in rows)
    back = sentencepiece_scan.decode_pieces(encoded, PIECES)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((d, (t or "").replace("\u2581", " ")) for d, t in rows)
    assert sentencepiece_scan.encode_pieces(odd(spark, []), PIECES).count() == 0
    none = spark.createDataFrame([(1, None, "old"), (2, b"", "old")], "doc_id long, ids binary, text string")
    assert sorted(tuple(r) for r in sentencepiece_scan.decode_pieces(none, PIECES).collect()) == [(1, 0, ""), (2, 0, "")]
    assert sentencepiece_scan.decode_pieces(none.limit(0), PIECES).count() == 0


def test_scan_is_associative():
    m = [[("a", "b"), ("a", "c")], [("b", "d"), ("c", "d"), ("c", "e")], [("d", "f"), ("e", "g")]]
    left = sentencepiece_scan.product(sentencepiece_scan.product(m[0], m[1]), m[2])
    assert left == sentencepiece_scan.product(m[0], sentencepiece_scan.product(m[1], m[2])) == [("a", "f"), ("a", "g")]


# the pipeline


def test_pipeline_brute_force(spark, docs):
    import sentencepiece

    import corpus_pipeline

    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra = spark.createDataFrame([(5000, "Before it. " + passage + " After it.", "en", "s", 1), (5001, None, None, None, None)], DOCS)
    start = docs.unionByName(extra)
    table, kept = start, []
    for name, stage in corpus_pipeline.STAGES:
        table = shared.written(stage(spark, table, SF), "stage")
        kept.append((name, {r.doc_id for r in table.select("doc_id").collect()}))
        if name != "sentencepiece":
            assert table.columns == list(corpus_pipeline.COLUMNS)
            last = {r.doc_id: r.text for r in table.collect()}
    steps = dict(kept)
    verdict = {r.doc_id: r.keep for r in quality.score_quality(start).collect()}
    assert steps["quality"] == {d for d, k in verdict.items() if k} == steps["line_dedup"]
    rows = [(d, t) for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in start.collect() if verdict[r.doc_id]])]
    comps = brute_components(rows, 5, 80, 100)
    assert steps["near_duplicate"] == {d for d, (_, c) in comps.items() if c == d}
    assert 5000 not in steps["decontaminate"] and steps["decontaminate"] <= steps["near_duplicate"]
    ref = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in table.collect():
        assert r.n_tokens == len(ref.encode(last[r.doc_id] or "")) and r.decoded_sha256 == hashlib.sha256((last[r.doc_id] or "").encode()).hexdigest()


def test_stages_odd_rows(spark):
    """Repeated doc_ids, nulls, repeated rows, clashing columns, long texts and empty tables, stage by stage."""
    import corpus_pipeline

    prose = "The end of the day is in the end. It is a good day for the man and the dog of the house by the sea, and that is that."
    other = "Der Hund und die Katze sind in dem Haus, und das ist nicht so schlecht. Wir gehen mit den Kindern an den See von Bern."
    rows = [(1, prose), (5, prose), (5, other), (5, other), (None, prose), (None, prose), (7, None), (8, ""), (9, "x" * 200_000 + " y" * 1000)]
    full = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], DOCS).selectExpr("*", "'k' as keep", "1 as component_id", "'t' as text_id", "2 as n_lines")
    near = corpus_pipeline.near_duplicate(spark, full, SF)
    assert near.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert got == sorted([(1, prose), (5, other), (None, prose), (None, prose), (7, None), (8, ""), rows[-1]], key=str)  # a null doc_id is nobody's copy
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, SF)
        assert stage(spark, full.limit(0), SF).count() == 0
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name in ("line_dedup", "decontaminate", "sentencepiece"):
            assert sorted((str(r.doc_id) for r in out.collect())) == sorted(str(d) for d, _ in rows)

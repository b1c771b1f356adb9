"""The registry: a season match by match, versions, commands, looks, and what is missing."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from touchline.operators import registry_store as store
from touchline.operators import roster
from touchline.plans import season_queries

SCHEMA = "team string, match_id long, key long, number int, resid double, h_n long, fingerprint array<double>, fp_n long, zone_x double, votes map<string,double>, n_frames long, n_clips long"


def profile(match, key, number=None, resid=None, looks=None, frames=120, team="t", clips=1, votes=None, zone=None, n=3):
    return (team, match, key, number, resid, n if resid is not None else 0, looks, n if looks else 0, zone, votes or ({str(number): 3.0} if number else {}), frames, clips)


SEASON = [
    profile(1, 7, 7, 2.0, [0.5, 0.1, 0.0], 300, clips=2), profile(1, 11, 11, -8.0, [0.1, 0.5, 0.0], 240), profile(1, 99, None, 40.0, [0.0, 0.0, 0.5], 80),
    profile(2, 7, 7, 3.0, [0.5, 0.1, 0.0], 280), profile(2, 11, 11, -7.0, [0.1, 0.5, 0.0], 200),
    profile(3, 5, 23, -7.0, [0.1, 0.5, 0.0], 150),
    profile(4, 1, 11, -6.5, None, 50), profile(4, 2, 15, -20.0, None, 50), profile(5, 1, None, None, None, 10),
]


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def test_season(spark):
    players = {r.player_id: r for r in store.registry_ingest(made(spark, SEASON)).collect()}
    seven, eleven = players[roster.new_id("t", 1, 7)], players[roster.new_id("t", 1, 11)]
    assert (seven.number, seven.matches, seven.n_frames, seven.n_clips) == (7, 2, 580, 3)
    assert [(w.number, w.matches, w.last_seen) for w in eleven.history] == [(11, 3, 4), (23, 1, 3)]
    assert eleven.matches == 4 and eleven.number == 11 and -12 < eleven.resid < -4 and eleven.votes == {"11": 9.0, "23": 3.0}
    assert roster.new_id("t", 4, 2) in players  # eleven is taken and seven too far off
    assert players[roster.new_id("t", 5, 1)].resid is None and len(players) == 5
    assert table(store.registry_ingest(made(spark, SEASON + SEASON[:3]))) == table(store.registry_ingest(made(spark, SEASON)))
    assert roster.drifted(0.0, 300, 100.0, 300) == 6.0 and roster.drifted(None, 0, 4.0, 5) == 4.0 and roster.drifted(0.0, 390, 4.0, 100) == 1.0
    assert roster.blended([1.0], 300, [3.0], 300) == ([2.5], 400) and roster.blended([1.0], 3, [1.0, 2.0], 3) == ([1.0], 3) and roster.blended(None, 0, [2.0], 500) == ([2.0], 400)


def test_players_of_one_height(spark):
    """Two players of one height stay two, and are told apart by looks."""
    rows = [profile(1, 1, 4, 10.0, [1.0, 0.0]), profile(1, 2, 5, 11.0, [0.0, 1.0]), profile(2, 8, None, 10.5, [0.1, 1.0]), profile(2, 9, None, 10.6, [1.0, 0.1]), profile(3, 1, None, 10.5, None), profile(3, 2, None, 10.5, [1.0, 1.0])]
    players, seen = roster.fold(made(spark, rows))
    how = {(r.match_id, r.key): (r.player_id, r.how) for r in seen.collect()}
    four, five = roster.new_id("t", 1, 1), roster.new_id("t", 1, 2)
    assert how[2, 8] == (five, "height+fp")
    assert how[2, 9] == (four, "height")  # five is taken in this match
    assert how[3, 1][1] == "new" and how[3, 2][1] == "new"
    assert players.count() == 4 and len({v[0] for k, v in how.items() if k[0] == 2}) == 2


def test_versions(spark, tmp_path):
    """Match by match equals all at once; a match taken in again or late gives what all in order would; a version stays as it was."""
    registry = roster.Registry(spark, str(tmp_path / "registry"))
    assert registry.version() == 0 and registry.players().count() == 0
    other = [profile(2, 1, 9, 1.0, team="u"), profile(3, 1, 9, 2.0, team="u"), profile(1, 1, 3, 1.0, team=None)]
    for match in range(1, 6):
        assert registry.ingest(made(spark, [r for r in SEASON + other if r[1] == match])) == match
    whole, seen = roster.fold(made(spark, SEASON + other))
    assert table(registry.players()) == table(whole) and table(registry.read("observations")) == table(seen)
    assert registry.ingest(made(spark, [r for r in SEASON if r[1] == 2])) == 6
    assert table(registry.players()) == table(whole)
    changed = [profile(2, 7, 7, 30.0, [0.0, 1.0, 0.0], 1), *[r for r in SEASON if r[1] == 2 and r[2] != 7]]
    registry.ingest(made(spark, changed))
    assert table(registry.players()) == table(roster.fold(made(spark, [r for r in SEASON if r[1] != 2] + changed + other))[0])
    assert registry.read("players", 3).count() == 5 and registry.version() == 7
    assert registry.ingest(made(spark, [])) == 8 and registry.players().count() == whole.count()


def test_commands_are_kept(spark, tmp_path):
    registry = roster.Registry(spark, str(tmp_path / "registry"))
    seven, eleven, last = (roster.new_id("t", 1, k) for k in (7, 11, 99))
    command = lambda *rows: registry.change(spark.createDataFrame([("t", k, *r) for k, r in enumerate(rows)], "team string, seq long, op string, player_id string, other_id string, number int, name string"))
    registry.ingest(made(spark, [r for r in SEASON if r[1] <= 2]))
    before = {r.player_id: r for r in registry.players().collect()}
    command(("set_me", eleven, None, None, None), ("set_me", seven, None, None, None), ("rename", seven, None, None, "Pou"), ("rename", eleven, None, None, ""), ("set_number", eleven, None, 12, None), ("merge", eleven, last, None, None), ("merge", eleven, "nobody", None, None), ("add", "new", None, 2, "Sub"), ("rename", "nobody", None, None, "x"))
    now = {r.player_id: r for r in registry.players().collect()}
    assert [r.player_id for r in now.values() if r.is_me] == [seven] and now[seven].display_name == "Pou" and now[eleven].display_name is None
    assert last not in now and now[eleven].n_frames == before[eleven].n_frames + before[last].n_frames and now[eleven].number == 12
    a, b = before[eleven], before[last]
    assert now[eleven].resid == pytest.approx((a.resid * a.h_n + b.resid * b.h_n) / (a.h_n + b.h_n)) and now["new"].number == 2
    registry.ingest(made(spark, [r for r in SEASON if r[1] == 1]))  # the team is folded anew, and the commands with it
    assert table(registry.players()) == sorted(str(r.asDict(recursive=True)) for r in now.values())
    with pytest.raises(Exception, match="no command is called"):
        command(("paint", seven, None, None, None))
    assert table(registry.players()) == sorted(str(r.asDict(recursive=True)) for r in now.values())


def test_what_is_missing(spark):
    nan = math.nan
    rows = [profile(1, None, None, nan, [nan, 1.0], None), profile(None, 2, 5, 3.0, [], 5), profile(1, 3, 6, math.inf, None, 7, team=None), profile(2, 3, 6, 1.0, None, 7, team=None)]
    players, seen = roster.fold(made(spark, rows).select("*", F.lit("x").alias("state"), F.lit(1).alias("kind"), F.lit("y").alias("op")))
    got = {(r.team, r.n_frames): (r.number, r.resid, r.matches) for r in players.collect()}
    assert got == {("t", 0): (None, None, 1), ("t", 5): (5, 3.0, 1), (None, 14): (6, 1.0, 2)} and seen.count() == 4
    assert roster.fold(made(spark, []))[0].count() == 0
    few = made(spark, SEASON).select("team", "match_id", "key", "number", "resid", "n_frames")
    assert store.registry_ingest(few).count() == 5


def plain_fold(rows):
    """Numbers and heights only, as plainly as can be."""
    teams = {}
    for team, match, key, number, resid, frames in sorted(rows, key=lambda r: (r[0], r[1], r[3] is None, r[3] or 0, r[2])):
        players, claimed = teams.setdefault(team, ([], {}))
        taken = claimed.setdefault(match, [])
        found = None
        if number is not None:
            worn = [p for p in players if p["number"] == number]
            worn = [max(worn, key=lambda p: (p["last"], -p["ord"]))] if worn else [p for p in players if number in p["once"]][:1]
            found = worn[0] if worn and worn[0] not in taken else None
        if found is None:
            near = sorted((p for p in players if p not in taken), key=lambda p: (abs(p["resid"] - resid), p["ord"]))
            gaps = [abs(p["resid"] - resid) for p in near[:2]]
            found = near[0] if near and gaps[0] <= 12 and (len(near) == 1 or gaps[1] - gaps[0] >= 3) else None
        if found is None:
            found = {"id": hashlib.sha256(f"{team}|{match}|{key}".encode()).hexdigest()[:32], "ord": len(players), "number": None, "once": set(), "resid": None, "n": 0, "frames": 0, "matches": 0}
            players.append(found)
        step = 0 if found["resid"] is None else (resid - found["resid"]) * frames / min(400, found["n"] + frames)
        found["resid"] = resid if found["resid"] is None else found["resid"] + max(-6.0, min(6.0, step))
        found["n"], found["frames"], found["matches"], found["last"] = min(400, found["n"] + frames), found["frames"] + frames, found["matches"] + 1, match
        if number is not None:
            found["number"] = number
            found["once"].add(number)
        taken.append(found)
    return sorted((team, p["id"], p["number"], round(p["resid"], 6), p["frames"], p["matches"]) for team, (players, _) in teams.items() for p in players)


def test_query_against_plain_fold(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in season_queries.observations(spark, sf).select("team", "match_id", "key", "number", "resid", "n_frames").collect()]
    got = season_queries.registry(spark, sf).select("team", "player_id", "number", "resid", "n_frames", "matches").collect()
    assert sorted((r.team, r.player_id, r.number, round(r.resid, 6), r.n_frames, r.matches) for r in got) == plain_fold(rows)


def test_rule_out(spark):
    players = store.registry_ingest(made(spark, SEASON))
    eleven = roster.new_id("t", 1, 11)
    out = roster.rule_out(players, spark.createDataFrame([("t", 23)], "team string, number int")).orderBy("place").collect()  # 23 is who wore it once
    assert eleven not in {r.player_id for r in out} and [r.number for r in out] == [7, 15, None, None] and [r.place for r in out] == [1, 2, 3, 4]
    assert out[0].evidence == pytest.approx(round(0.45 * (1 - math.exp(-580 / 120)) + 0.2 + 0.35, 3))
    assert roster.rule_out(players, spark.createDataFrame([("t", roster.new_id("t", 1, 7))], "team string, player_id string")).count() == 4


def test_candidates_and_commands_of_tables(spark):
    known = spark.createDataFrame([("t", "a", 7, 0.0, [1.0, 0.0], []), ("t", "b", 9, 1.0, [0.0, 1.0], [4]), ("t", "c", 10, 40.0, None, [])], "team string, player_id string, number int, resid double, fingerprint array<double>, history array<int>")
    asked = [("t", 9, 1, 4, 30.0, None), ("t", 9, 2, None, 0.5, None), ("t", 9, 3, None, 0.5, [0.1, 1.0]), ("t", 9, 4, None, 45.0, None), ("t", 9, 5, 3, 20.0, None), ("t", 9, 6, None, None, None)]
    got = {r.key: (r.player_id, r.how) for r in store.link_candidates(spark.createDataFrame(asked, "team string, match_id long, key long, number int, resid double, fingerprint array<double>"), known).collect()}
    assert got == {1: ("b", "number"), 2: (None, "new"), 3: ("b", "height+fp"), 4: ("c", "height"), 5: (None, "new"), 6: (None, "new")}
    me = store.set_me(store.rename(known, known.select("team", "player_id", F.lit("").alias("display_name"))), "t", "b")
    assert [r.player_id for r in me.where("is_me").collect()] == ["b"] and me.where("display_name is not null").count() == 0


    claimed = spark.createDataFrame([("t", 9, "b")], "team string, match_id long, player_id string")
    free = {r.key: (r.player_id, r.how) for r in store.link_candidates(spark.createDataFrame(asked, "team string, match_id long, key long, number int, resid double, fingerprint array<double>"), known, claimed).collect()}
    assert free[1] == ("c", "height") and free[2] == ("a", "height") and free[4] == ("c", "height")


def test_merge_of_tables(spark):
    rows = [profile(1, 1, 7, 2.0, [1.0, 0.0], 100), profile(1, 2, None, 30.0, [0.0, 1.0], 50), profile(1, 3, 9, None, None, 10)]
    players = store.registry_ingest(made(spark, rows))
    keep, drop, third = (roster.new_id("t", 1, k) for k in (1, 2, 3))
    pairs = spark.createDataFrame([("t", keep, drop), ("t", keep, "nobody")], "team string, keep string, drop string")
    got = {r.player_id: r for r in store.registry_merge(players, pairs).collect()}
    one = got[keep]
    assert set(got) == {keep, third} and (one.number, one.resid, one.h_n, one.n_frames, one.matches, one.fp_n) == (7, 16.0, 6, 150, 2, 6)
    assert one.fingerprint == [0.5, 0.5] and one.votes == {"7": 3.0} and [(w.number, w.matches) for w in one.history] == [(7, 1)]
    assert got[third].resid is None and got[third].number == 9


def test_candidates_against_the_whole_roster(spark):
    """Links by height and looks are those of a plain search in the whole roster, and no profile meets all of it."""
    import random

    from touchline.operators import registry_store

    rng = random.Random(3)
    looks = lambda: rng.choice([None, [1.0, 2.0], [2.0, 1.0], [0.0, 0.0], [rng.random(), rng.random()]])
    height = lambda: rng.choice([None, float(rng.randrange(0, 400)), rng.uniform(0, 400), 7.5])
    players = [(f"t{k % 3}", f"p{k}", None, height(), looks(), []) for k in range(150)] + [("lone", "q", None, 50.0, None, [])]
    profiles = [(f"t{k % 3}", k % 4, k, None, height(), looks()) for k in range(300)] + [("lone", 0, 900, None, 55.0, None), ("lone", 0, 901, None, 90.0, None), ("none", 0, 902, None, 5.0, None)]
    a = spark.createDataFrame(profiles, "team string, match_id long, key long, number int, resid double, fingerprint array<double>")
    b = spark.createDataFrame(players, "team string, player_id string, number int, resid double, fingerprint array<double>, history array<int>")

    def apart(p, q):
        if p is None or q is None or not any(p) or not any(q):
            return None
        return 1 - sum(x * y for x, y in zip(p, q, strict=True)) / (math.sqrt(sum(x * x for x in p)) * math.sqrt(sum(x * x for x in q)))

    want = {}
    for team, _, key, _, resid, own in profiles:
        near = sorted((abs(resid - r), i, f) for t, i, _, r, f, _ in players if t == team and r is not None) if resid is not None else []
        want[key] = (None, "new")
        if near and near[0][0] <= 12:
            told = sorted((apart(own, f), i) for d, i, f in near if d - near[0][0] < 3 and apart(own, f) is not None)
            if len(near) == 1 or near[1][0] - near[0][0] >= 3:
                want[key] = (near[0][1], "height")
            elif len(told) >= 2 and told[1][0] - told[0][0] >= 0.05:
                want[key] = (told[0][1], "height+fp")
    out = registry_store.link_candidates(a, b)
    assert {r.key: (r.player_id, r.how) for r in out.collect()} == want
    assert {how for _, how in want.values()} == {"new", "height", "height+fp"}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_looks_are_those_of_all_players():
    """Counting players by their looks finds whom a search among all finds, at the margin's edges and with looks that are null, zero or no numbers."""
    import random

    import pyarrow as pa

    from touchline.operators import looks

    rng = random.Random(5)
    nan = float("nan")
    look = lambda: rng.choice([[1.0, 2.0], [2.0, 4.0], [2.0, 1.0], [0.0, 0.0], [None, 1.0], [nan, 1.0], [3.0], [rng.random(), rng.random()]])
    height = lambda: rng.choice([float(rng.randrange(0, 30)), rng.uniform(0, 30), rng.randrange(0, 300) / 10])
    players = [(f"p{k}", height(), look()) for k in range(60)] + [("x", nan, [1.0, 2.0])]
    asked = [(height(), rng.choice([0.0, 1.0, 2.5]), look()) for _ in range(400)]

    def apart(p, q):
        if len(p) != len(q) or None in p or None in q:
            return None
        dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
        norm = math.sqrt(dot(p, p)) * math.sqrt(dot(q, q))
        return None if norm <= 0 else math.inf if norm != norm else 1.0 - dot(p, q) / norm

    want = {}
    for k, (at, d, own) in enumerate(asked):
        told = sorted((apart(own, f), i) for i, r, f in players if abs(at - r) - d < 3.0 and apart(own, f) is not None)
        if len(told) >= 2 and not told[1][0] - told[0][0] < 0.05:
            want[k] = told[0][1]
    table = lambda rows, *names: pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    found, near = looks.most_alike(table(asked, "at", "d", "fingerprint"), table(players, "player_id", "resid", "fingerprint"), 3.0, 0.05)
    assert {int(k): players[i][0] for k, i in zip(found, near, strict=True)} == want and 20 < len(want) < 380


def test_profiles_meet_looks_not_players(spark):
    """Where many players of few looks are of one height, a profile isn't joined to each of them."""
    n = 3000
    players = spark.range(n).selectExpr("'t' AS team", "concat('p', id) AS player_id", "CAST(NULL AS INT) AS number", "id % 400 / 100e0 AS resid", "array(id % 7 + 1e0, 2e0) AS fingerprint", "CAST(NULL AS ARRAY<INT>) AS history")
    profiles = spark.range(n).selectExpr("'t' AS team", "0L AS match_id", "id AS key", "CAST(NULL AS INT) AS number", "id % 397 / 100e0 AS resid", "array(id % 5 + 1e0, 2e0) AS fingerprint")
    out = store.link_candidates(profiles, players)
    assert {(r.player_id, r.how) for r in out.collect()} == {(None, "new")} and out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan  # looks were compared for each pair of a joined row


def test_profiles_are_linked_without_going_through_the_team():
    class Players(dict):
        times = 0

        def values(self):
            Players.times += 1
            return super().values()

    team = roster.Roster("t")
    team.players = Players()
    for match in range(3):
        for key in range(2000):
            number = key % 30 if key % 3 == 0 else None
            team.take(roster._clean(dict.fromkeys(roster.columns(roster.PROFILE)) | {"match_id": match, "key": key, "number": number, "resid": (key * 7919 % 2000) / 1.5, "h_n": 5}))
    assert len(team.players) > 2000 and Players.times < 10

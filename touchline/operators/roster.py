"""A persistent registry of players: each match's profiles are linked and folded in, in order, version by version."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import evidence

# Pixels of height for a link and of margin to the next player, the least gap in looks that tells players
# of one height apart, the window of the running means, the drift that one match may bring.
HEIGHT_LINK, HEIGHT_MARGIN, LOOKS_MARGIN, WINDOW, DRIFT = 12.0, 3.0, 0.05, 400, 6.0
WORN = "array<struct<number:int,matches:long,last_seen:long>>"
PLAYERS = (
    "team string, player_id string, ord long, display_name string, is_me boolean, number int, history " + WORN + ", resid double, resid_std double, h_n long, fingerprint array<double>, fp_n long, "
    "zone_x double, zone_y double, speed double, votes map<string,double>, n_frames long, n_clips long, matches long, last_match long"
)
#: A match profile. All but the first three may be missing or null.
PROFILE = "team string, match_id long, key long, number int, resid double, resid_std double, h_n long, fingerprint array<double>, fp_n long, zone_x double, zone_y double, speed double, votes map<string,double>, n_frames long, n_clips long"
OBSERVED = PROFILE + ", player_id string, how string"
#: What people change: op is add, set_me, rename, set_number or merge (other_id goes into player_id), after match_id, in order of seq.
COMMAND = "team string, match_id long, seq long, op string, player_id string, other_id string, number int, name string"


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def new_id(team: str | None, match: int | None, key: int | None) -> str:
    """The same id for the same player of the same match, however often a task is run."""
    said = ["" if v is None else str(v) for v in (team, match, key)]
    return hashlib.sha256("|".join(said).encode()).hexdigest()[:32]


def drifted(old: float | None, old_n: int, seen: float | None, seen_n: int) -> float | None:
    """A running mean over at most WINDOW samples that one match moves by DRIFT at most."""
    if seen is None or seen_n <= 0:
        return old
    if old is None or old_n <= 0:
        return seen
    step = (seen - old) * seen_n / min(WINDOW, old_n + seen_n)
    return old + min(max(step, -DRIFT), DRIFT)


def blended(old: list | None, old_n: int, seen: list | None, seen_n: int) -> tuple[list | None, int]:
    """A running mean vector over at most WINDOW samples; a vector of another length changes nothing."""
    if seen is None or seen_n <= 0 or old is not None and old_n > 0 and len(old) != len(seen):
        return old, min(WINDOW, max(0, old_n))
    if old is None or old_n <= 0:
        return seen, min(WINDOW, seen_n)
    share = seen_n / min(WINDOW, old_n + seen_n)
    return [a + (b - a) * share for a, b in zip(old, seen, strict=True)], min(WINDOW, old_n + seen_n)


def _cosine(a: list, b: list) -> float | None:
    if a is None or b is None or len(a) != len(b):
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 1.0 - sum(x * y for x, y in zip(a, b, strict=True)) / size if size > 0 else None


class Roster:
    """One team's players, by id, and the players that the match at hand has shown.

    A profile is linked without going through the team: ``free`` has the heights of players whom the match hasn't shown, sorted, ``worn`` a heap of
    each number's wearers, first choice on top (entries that no longer hold are dropped when they get there), ``once`` who wore a number first. They are
    made when a profile comes and given up when a command changes players.
    """

    def __init__(self, team: str | None):
        self.team, self.players, self.match, self.claimed = team, {}, object(), set()
        self.free = None

    def index(self) -> None:
        if self.free is not None:
            return
        self.free, self.worn, self.once = [], {}, {}
        self.release(p for p in self.players.values() if p["player_id"] not in self.claimed)
        for p in self.players.values():
            self.note(p)

    def release(self, players) -> None:
        """Players whom the match has not shown."""
        self.free += [(p["resid"], p["ord"], p["player_id"]) for p in players if p["resid"] is not None and p["h_n"] > 0]
        self.free.sort()

    @staticmethod
    def choice(p: dict) -> tuple:
        """Wearers of a number by this: me first, then who was seen last."""
        return (not p["is_me"], -math.inf if p["last_match"] is None else -p["last_match"], p["ord"])

    def note(self, p: dict) -> None:
        """Who wears and has worn which number."""
        if p["number"] is not None:
            heapq.heappush(self.worn.setdefault(p["number"], []), (*self.choice(p), p["player_id"]))
        for worn in p["history"]:
            self.once[worn["number"]] = min(self.once.get(worn["number"], (math.inf, "")), (p["ord"], p["player_id"]))

    def add(self, player_id: str, number: int | None, match: int | None) -> dict:
        p = dict.fromkeys(columns(PLAYERS)) | {"team": self.team, "player_id": player_id, "ord": len(self.players), "is_me": False, "history": [], "h_n": 0, "fp_n": 0, "votes": {}, "n_frames": 0, "n_clips": 0, "matches": 0}
        self.players[player_id] = p
        return p

    def wears(self, p: dict, number: int | None, match: int | None, times: int = 1) -> None:
        if number is None:
            return
        p["number"] = number
        for worn in p["history"]:
            if worn["number"] == number:
                worn["matches"], worn["last_seen"] = worn["matches"] + times, match
                return
        p["history"].append({"number": number, "matches": times, "last_seen": match})

    def of_number(self, number: int) -> str | None:
        """Who wears a number (me first, then who was seen last), else the first who wore it."""
        wearers = self.worn.get(number, [])
        while wearers:
            *choice, player_id = wearers[0]
            p = self.players[player_id]
            if p["number"] == number and self.choice(p) == tuple(choice):
                return player_id
            heapq.heappop(wearers)
        return self.once[number][1] if number in self.once else None

    def link(self, r: dict) -> tuple[str | None, str]:
        """Who a profile is, and how that is known: by number, height, height and looks; or new."""
        if r["number"] is not None:
            found = self.of_number(r["number"])
            if found is not None and found not in self.claimed:
                return found, "number"
        if r["resid"] is None:
            return None, "new"
        at = bisect_left(self.free, (r["resid"],))
        near = sorted((abs(f[0] - r["resid"]), f[1], f[2]) for f in self.free[max(0, at - 2) : at + 2])
        if not near or near[0][0] > HEIGHT_LINK:
            return None, "new"
        if len(near) == 1 or near[1][0] - near[0][0] >= HEIGHT_MARGIN:
            return near[0][2], "height"
        if r["fingerprint"] is None:
            return None, "new"
        reach = near[0][0] + HEIGHT_MARGIN + 1e-6 * (1.0 + abs(r["resid"]))
        about = [self.players[f[2]] for f in self.free[bisect_left(self.free, (r["resid"] - reach,)) : bisect_left(self.free, (r["resid"] + reach, math.inf))]]
        tied = [(_cosine(r["fingerprint"], p["fingerprint"]), p["ord"], p) for p in about if abs(p["resid"] - r["resid"]) - near[0][0] < HEIGHT_MARGIN]
        tied = sorted((t for t in tied if t[0] is not None), key=lambda t: t[:2])
        if len(tied) >= 2 and tied[1][0] - tied[0][0] >= LOOKS_MARGIN:
            return tied[0][2]["player_id"], "height+fp"
        return None, "new"

    def take(self, r: dict) -> tuple[str, str]:
        """Folds a profile in."""
        if r["match_id"] != self.match:
            shown, self.match, self.claimed = self.claimed, r["match_id"], set()
            if self.free is not None:
                self.release(self.players[player_id] for player_id in shown)
        self.index()
        found, how = self.link(r)
        p = self.players[found] if found is not None else self.add(new_id(self.team, r["match_id"], r["key"]), r["number"], r["match_id"])
        if found is not None:
            at = bisect_left(self.free, (p["resid"], p["ord"])) if p["resid"] is not None else len(self.free)
            if at < len(self.free) and self.free[at][2] == found:
                del self.free[at]
        p["resid"] = drifted(p["resid"], p["h_n"], r["resid"], r["h_n"])
        p["h_n"] = min(WINDOW, p["h_n"] + max(0, r["h_n"])) if r["resid"] is not None else p["h_n"]
        p["fingerprint"], p["fp_n"] = blended(p["fingerprint"], p["fp_n"], r["fingerprint"], r["fp_n"])
        for name in ("resid_std", "zone_x", "zone_y", "speed"):
            p[name] = r[name] if r[name] is not None else p[name]
        for number, weight in r["votes"].items():
            p["votes"][number] = p["votes"].get(number, 0.0) + weight
        self.wears(p, r["number"], r["match_id"])
        p["n_frames"], p["n_clips"] = p["n_frames"] + r["n_frames"], p["n_clips"] + max(1, r["n_clips"])
        p["matches"], p["last_match"] = p["matches"] + 1, r["match_id"]
        self.claimed.add(p["player_id"])
        self.note(p)
        return p["player_id"], how

    def command(self, c: dict) -> None:
        """A change by hand; one that names a player whom nothing has shown changes nothing."""
        self.free = None
        if c["op"] == "add":
            if c["player_id"] not in self.players:
                p = self.add(c["player_id"], c["number"], c["match_id"])
                p["display_name"] = c["name"]
                self.wears(p, c["number"], c["match_id"])
            return
        p = self.players.get(c["player_id"])
        if p is None:
            return
        if c["op"] == "set_me":
            for other in self.players.values():
                other["is_me"] = other is p
        elif c["op"] == "rename":
            p["display_name"] = c["name"] or p["display_name"]
        elif c["op"] == "set_number":
            self.wears(p, c["number"], c["match_id"])
        elif c["op"] == "merge":
            self.merge(p, c["other_id"])
        else:
            raise ValueError(f"no command is called {c['op']!r}")

    def merge(self, keep: dict, other_id: str) -> None:
        """Heights weighted by their samples, looks blended, votes, histories and counts added; the kept one's own traits win."""
        gone = self.players.get(other_id)
        if gone is None or gone is keep:
            return
        del self.players[other_id]
        n, m = keep["h_n"], gone["h_n"]
        if keep["resid"] is None or gone["resid"] is None:
            keep["resid"], keep["h_n"] = (gone["resid"], m) if keep["resid"] is None else (keep["resid"], n)
        elif n + m > 0:
            keep["resid"], keep["h_n"] = (keep["resid"] * n + gone["resid"] * m) / (n + m), min(WINDOW, n + m)
        keep["resid_std"] = keep["resid_std"] if keep["resid_std"] is not None else gone["resid_std"]
        keep["fingerprint"], keep["fp_n"] = blended(keep["fingerprint"], keep["fp_n"], gone["fingerprint"], gone["fp_n"])
        for number, weight in gone["votes"].items():
            keep["votes"][number] = keep["votes"].get(number, 0.0) + weight
        number = keep["number"] if keep["number"] is not None else gone["number"]
        for worn in gone["history"]:
            self.wears(keep, worn["number"], worn["last_seen"])
        keep["number"], keep["is_me"] = number, keep["is_me"] or gone["is_me"]
        for name in ("n_frames", "n_clips", "matches"):
            keep[name] += gone[name]
        seen = [m for m in (keep["last_match"], gone["last_match"]) if m is not None]
        keep["last_match"] = max(seen, default=None)


def _vector(value) -> list | None:
    """A vector of finite numbers, else None."""
    if value is None or not len(value):
        return None
    out = [math.nan if v is None else float(v) for v in value]
    return out if all(map(math.isfinite, out)) else None


def _clean(row: dict) -> dict:
    """A profile with None for what is missing, not a number or infinite, and 0 for counts."""
    number = lambda v: None if v is None or isinstance(v, float) and not math.isfinite(v) else v
    out = {k: number(v) if not isinstance(v, (list, np.ndarray, dict)) else v for k, v in row.items()}
    for name in ("match_id", "key", "number", "seq"):
        out[name] = None if out.get(name) is None else int(out[name])
    out["votes"] = {k: float(v) for k, v in dict(row.get("votes") or {}).items() if v is not None and math.isfinite(v)}
    out["fingerprint"] = _vector(row.get("fingerprint"))
    for name, default in (("n_frames", 0), ("n_clips", 0), ("h_n", out.get("n_frames") or 0), ("fp_n", out.get("n_frames") or 0)):
        out[name] = int(out[name]) if out.get(name) is not None else int(default)
    return out


def _rows(batches, names: list[str]):
    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in names), strict=True):
            yield dict(zip(names, row, strict=True))


_EVENT = ["kind", "state", *columns(PROFILE), "seq", "op", "player_id", "other_id", "name"]


def _folded(batches):
    """Streams a team's stored players, then its profiles and commands in order; the state is the team's roster."""
    none = object()
    team, roster, seen = none, None, []

    def frame():
        if roster is None:
            return None
        out = [("player", p, None) for p in roster.players.values()] + [("seen", None, r) for r in seen]
        return pd.DataFrame(out, columns=["kind", "player", "seen"]) if out else None

    for row in _rows(batches, _EVENT):
        own = row["team"] if isinstance(row["team"], str) else None
        if team is none or own != team:
            out = frame()
            if out is not None:
                yield out
            team, roster, seen = own, Roster(own), []
        if row["kind"] == 0:
            p = _stored(row["state"])
            roster.players[p["player_id"]] = p
        elif row["kind"] == 1:
            r = _clean(row)
            player_id, how = roster.take(r)
            seen.append({k: r[k] for k in columns(PROFILE)} | {"team": own, "player_id": player_id, "how": how})
            if len(seen) >= 5000:
                yield pd.DataFrame([("seen", None, x) for x in seen], columns=["kind", "player", "seen"])
                seen = []
        else:
            roster.command(_clean(row) | {k: row[k] if isinstance(row[k], str) else None for k in ("op", "player_id", "other_id", "name")})
    out = frame()
    if out is not None:
        yield out


def _stored(state) -> dict:
    """A player as the fold keeps it, from a row of the players table."""
    p = {k: state[k] for k in columns(PLAYERS)}
    none = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    p = {k: none(v) if not isinstance(v, (list, np.ndarray, dict)) else v for k, v in p.items()}
    p["history"] = [{k: None if w[k] is None else int(w[k]) for k in ("number", "matches", "last_seen")} for w in (p["history"] if p["history"] is not None else [])]
    p["fingerprint"] = _vector(p["fingerprint"])
    p["votes"] = dict(p["votes"] or {})
    for name in ("ord", "number", "h_n", "fp_n", "n_frames", "n_clips", "matches", "last_match"):
        p[name] = None if p[name] is None else int(p[name])
    return p


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, null where the table lacks one; further columns are left out."""
    kinds = dict(c.split(" ", 1) for c in schema.split(", "))
    return df.select(*[(df[c] if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def fold(profiles: DataFrame, commands: DataFrame | None = None, players: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(players, observations): the registry after folding profiles and commands, in order of match, into ``players``.

    A profile is the player of its number (who wears it now: me first, then who was seen last; else the first who wore it), else the only
    one of its height, else, of players of that height, the one that looks like it; else a new player. A player whom the match has shown
    already is nobody else in it. Within a match numbered profiles come first, by number and key, commands last, by seq. Heights and
    looks are running means over a window, heights with bounded drift; votes and counts add up; zone, speed and spread are
    the latest seen; the history has each number worn with its matches and when it was last seen.

    A null team is a team; null keys, matches and numbers are values of their own; null, NaN and infinite measures are missing, null
    counts 0 (h_n and fp_n default to n_frames). Of rows equal in team, match_id and key one is folded.
    Teams are dealt over tasks; a task streams its sorted rows and holds one team's roster.
    """
    spark = profiles.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _typed(profiles, PROFILE)
    rows = rows.groupBy("team", "match_id", "key").agg(*[F.first(c).alias(c) for c in columns(PROFILE)[3:]]).withColumn("kind", F.lit(1))
    if commands is not None:
        rows = rows.unionByName(_typed(commands, COMMAND).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if players is not None:
        own = _typed(players, PLAYERS)
        rows = rows.unionByName(own.select("team", F.struct(*columns(PLAYERS)).alias("state"), F.col("ord").alias("key"), F.lit(0).alias("kind")), allowMissingColumns=True)
    rows = _typed(rows, f"kind int, {PROFILE}, seq long, op string, player_id string, other_id string, name string, state {_struct(PLAYERS)}")
    dealt = rows.repartition(n, "team").sortWithinPartitions("team", F.col("kind") > 0, "match_id", "kind", F.col("number").isNull(), "seq", "number", "key")
    out = dealt.select(*_EVENT).mapInPandas(_folded, f"kind string, player {_struct(PLAYERS)}, seen {_struct(OBSERVED)}")
    return out.where("kind = 'player'").select("player.*"), out.where("kind = 'seen'").select("seen.*")


def _struct(schema: str) -> str:
    return "struct<" + ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in schema.split(", ")) + ">"


class Registry:
    """Versions of a registry in a folder: ``version=N/players``, ``observations`` and ``commands``, and ``CURRENT`` with the number.

    A version is written whole before ``CURRENT`` is replaced in one step, so a reader always finds a finished one and a run that dies
    half way changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The current version's number, 0 before the first."""
        at = self._path("CURRENT")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return 0
        return int(self.spark.read.text(f"{self.folder}/CURRENT").first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """players, observations or commands of a version."""
        version = self.version() if version is None else version
        schema = {"players": PLAYERS, "observations": OBSERVED, "commands": COMMAND}[name]
        if version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/version={version}/{name}")

    def players(self) -> DataFrame:
        return self.read("players")

    def ingest(self, profiles: DataFrame) -> int:
        """Takes matches in and returns the new version.

        A team whose new matches all follow what it has is folded on from its stored roster. Where a match was there before, or comes
        late, the team is folded anew from its observations, with the match's old ones taken out, so that the
        registry is always what all matches in order would have given, and taking a match in twice changes nothing.
        """
        new = _typed(profiles, PROFILE).dropDuplicates(["team", "match_id", "key"])
        return self._next(new, None)

    def change(self, commands: DataFrame) -> int:
        """Applies commands after each team's latest match and returns the new version. They are kept, and told again when a team is folded anew."""
        had = self.read("commands")
        last = self.players().groupBy("team").agg(F.max("last_match").alias("match_id"))
        told = had.groupBy("team").agg(F.max("seq").alias("before"))
        own = _typed(commands, COMMAND).drop("match_id").withColumnRenamed("team", "_team")
        met = own.join(last.hint("shuffle_hash"), F.col("_team").eqNullSafe(F.col("team")), "left").drop("team")
        met = met.join(told.hint("shuffle_hash"), F.col("_team").eqNullSafe(F.col("team")), "left").drop("team").withColumnRenamed("_team", "team")
        return self._next(self.spark.createDataFrame([], PROFILE), met.withColumn("seq", F.coalesce("before", F.lit(0)) + 1 + F.col("seq")))

    def _next(self, new: DataFrame, told: DataFrame | None) -> int:
        version = self.version()
        at = f"{self.folder}/version={version + 1}"
        old, had, known = self.read("observations", version), self.read("commands", version), self.read("players", version)
        told = _typed(told, COMMAND) if told is not None else self.spark.createDataFrame([], COMMAND)
        same = lambda a, b, *names: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in names])
        first = new.groupBy("team").agg(F.min(F.coalesce("match_id", F.lit(-(2**63)))).alias("first")).withColumnRenamed("team", "t1")
        last = old.groupBy("team").agg(F.max(F.coalesce("match_id", F.lit(-(2**63)))).alias("last")).withColumnRenamed("team", "t2")
        both = first.join(last.hint("shuffle_hash"), F.col("t1").eqNullSafe(F.col("t2")), "left")
        again = both.where("first <= last").select(F.col("t1").alias("team"))
        touched = new.select("team").union(told.select("team")).distinct()
        out = lambda df, teams, how: df.join(teams.hint("shuffle_hash"), same(df, teams, "team"), how)
        taken = new.select("team", "match_id").distinct()
        kept = old.join(taken.hint("shuffle_hash"), same(old, taken, "team", "match_id"), "left_anti")
        profiles = new.unionByName(out(kept, again, "left_semi").select(*columns(PROFILE)))
        rosters = out(out(known, touched, "left_semi"), again, "left_anti")
        commands = told.unionByName(out(had, again, "left_semi"))
        players, seen = fold(profiles, commands, rosters)
        players.unionByName(out(known, touched, "left_anti")).write.parquet(f"{at}/players")
        seen.unionByName(out(kept, again, "left_anti")).write.parquet(f"{at}/observations")
        had.unionByName(told).write.parquet(f"{at}/commands")
        self._point(version + 1)
        return version + 1

    def _point(self, version: int) -> None:
        """Replaces CURRENT in one step."""
        fresh, conf = self._path(f".CURRENT-{version}"), self.spark._jsc.hadoopConfiguration()
        stream = fresh.getFileSystem(conf).create(fresh, True)
        stream.write(bytearray(str(version).encode()))
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, self._path("CURRENT"), options)


def rule_out(players: DataFrame, me: DataFrame) -> DataFrame:
    """Every other player of my team as not me, with what tells them apart: team, place, player_id, number, resid, ..., evidence.

    me: team and player_id, or team and number (the player who wears it: me first, then who was seen last; else who wore it first). place
    counts a team's players by number, unnumbered last, then by name. A team without me has nobody to rule out.
    """
    players = _typed(players, PLAYERS)
    given = _typed(me, "team string, player_id string, number int").withColumnRenamed("player_id", "mine").withColumnRenamed("number", "asked")
    met = players.join(given.hint("shuffle_hash"), "team")
    wore = F.exists("history", lambda w: w["number"] == F.col("asked"))
    rank = F.when(F.col("number") == F.col("asked"), F.struct(F.lit(0).alias("a"), (~F.col("is_me")).cast("int").cast("long").alias("b"), (-F.coalesce("last_match", F.lit(-(2**62)))).alias("c"), F.col("ord").alias("d")))
    rank = rank.when(wore, F.struct(F.lit(1).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.col("ord").alias("d")))
    found = met.groupBy("team").agg(F.first("mine").alias("mine"), F.min_by("player_id", rank).alias("wears"))
    found = found.select("team", F.coalesce("mine", "wears").alias("mine"))
    best, total = F.array_max(F.map_values("votes")), F.aggregate(F.map_values("votes"), F.lit(0.0), lambda s, v: s + v)
    named = F.when(F.col("number").isNull(), 0.0).otherwise(0.5 + 0.5 * F.coalesce(F.when(total > 0, best / total), F.lit(0.0)))
    others = players.join(found.hint("shuffle_hash"), "team").where(F.col("player_id") != F.coalesce("mine", F.lit("")))
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.asc_nulls_last("number"), F.coalesce("display_name", F.lit("")), "ord"))
    return others.select("team", place.cast("long").alias("place"), "player_id", "display_name", "number", "resid", "resid_std", "fingerprint", evidence(F.col("n_frames"), F.col("n_clips"), named).alias("evidence"))

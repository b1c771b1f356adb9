"""A registry of players as a table: linking profiles to it and changing it. ``roster`` folds matches in and keeps versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .looks import most_alike
from .roster import HEIGHT_LINK, HEIGHT_MARGIN, LOOKS_MARGIN, PLAYERS, WINDOW, WORN, _typed, columns, fold


def link_candidates(profiles: DataFrame, players: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Who each profile (team, match_id, key, number, resid, fingerprint) is: player_id and how, null and "new" for nobody.

    By number: the player who wears it, else one who wore it once (``history``). Else by height: the nearest player if at
    most 12 px away and 3 px nearer than the next one; of players within that margin the one whose fingerprint is
    nearer by 0.05 than the next one's. What stays ambiguous is new. Without a height there is no link by height.
    players: team, player_id, number, resid, fingerprint and history (numbers, or structs with a number). A team's players are a roster,
    small. Every profile is asked about by itself; ``claimed`` (team, match_id, player_id) names players whom a match has shown already and who
    can't be anybody else in it (``roster.fold`` claims as it goes).
    """
    keys = ["team", "match_id", "key"]
    kind = players.schema["history"].dataType.elementType
    if kind.typeName() == "struct":
        players = players.withColumn("history", F.transform("history", lambda w: w["number"]))
    if claimed is not None:
        return _link_unclaimed(profiles, players, claimed)
    worn = players.select("team", "player_id", F.col("number").cast("int").alias("number"), F.lit(0).alias("since"))
    once = players.select("team", "player_id", F.explode(F.col("history").cast("array<int>")).alias("number"), F.lit(1).alias("since"))
    of_number = worn.unionByName(once).where("number is not null").groupBy("team", "number").agg(F.min_by("player_id", F.struct("since", "player_id")).alias("same"))
    by_number = profiles.withColumn("number", F.col("number").cast("int")).join(of_number.hint("merge"), ["team", "number"], "left").select(*keys, "same")
    ranked = _by_height(profiles.where("resid is not null").select(*keys, F.col("resid").cast("double").alias("resid"), "fingerprint"), players.where("resid is not null").select("team", "player_id", F.col("resid").cast("double").alias("resid"), "fingerprint"))
    out = by_number.join(ranked, keys, "left")
    return out.select(*keys, F.coalesce("same", "near").alias("player_id"), F.when(F.col("same").isNotNull(), "number").otherwise(F.coalesce("by", F.lit("new"))).alias("how"))


def _by_height(profiles: DataFrame, players: DataFrame) -> DataFrame:
    """Who profiles are by height, then by looks: team, match_id, key, by, near. Profiles without any player of their team may lack a row.

    A profile meets the two heights around it, in one sorted pass along its team, not the whole roster. Only where these leave it open are the
    players looked at whose heights tie, by bins of height.
    """
    keys = ["team", "match_id", "key"]
    own = F.struct(*[F.col(c).alias(c) for c in keys]).alias("who")
    heights = players.groupBy("team", F.col("resid").alias("at")).agg(F.min("player_id").alias("player_id"), F.count("*").alias("n"))
    line = heights.select("team", "at", F.struct("at", "player_id", "n").alias("p"), F.lit(None).cast(profiles.select(own).schema["who"].dataType).alias("who"))
    line = line.unionByName(profiles.select("team", F.col("resid").alias("at"), F.lit(None).cast(line.schema["p"].dataType).alias("p"), own))
    ahead, back = Window.partitionBy("team").orderBy("at").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("team").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    along, behind = Window.partitionBy("team").orderBy("at"), Window.partitionBy("team").orderBy(F.desc("at"))
    known = line.where("p is not null").withColumn("_low", F.lag("p").over(along)).withColumn("_high", F.lag("p").over(behind))
    line = known.unionByName(line.where("p is null"), allowMissingColumns=True).withColumn("_s", F.when(F.col("p").isNotNull(), F.struct("p", "_low", "_high")))
    line = line.withColumn("_under", F.last("_s", ignorenulls=True).over(ahead)).withColumn("_over", F.last("_s", ignorenulls=True).over(back)).where("who is not null")
    d = lambda p: F.abs(F.col("at") - p["at"])
    around = F.filter(F.array_distinct(F.array("_under.p", "_under._low", "_over.p", "_over._high")), lambda p: p.isNotNull())
    met = line.select("who.*", "at", F.array_sort(F.transform(around, lambda p: F.struct(d(p).alias("d"), p["player_id"].alias("player_id"), p["n"].alias("n")))).alias("r"))
    best = F.get("r", F.lit(0))
    alone = F.when(best["n"] >= 2, F.lit(False)).when(F.size("r") == 1, F.lit(True)).otherwise(F.get("r", F.lit(1))["d"] - best["d"] >= HEIGHT_MARGIN)
    met = met.where(F.size("r") > 0).select(*keys, "at", best["d"].alias("d"), best["player_id"].alias("first"), F.coalesce(best["d"] <= HEIGHT_LINK, F.lit(False)).alias("fits"), alone.alias("alone"))
    alone = met.where("fits and alone").select(*keys, F.lit("height").alias("by"), F.col("first").alias("near"))
    return alone.unionByName(_by_looks(met.where("fits and not alone").select(*keys, "at", "d"), profiles, players))


def _by_looks(open_: DataFrame, profiles: DataFrame, players: DataFrame) -> DataFrame:
    """Of the players whose heights tie for a profile the one that looks like it, if it does so more than the next one.

    Profiles and the players within their reach meet by cells of height of a team, where players of one look are counted at once (``looks.most_alike``).
    """
    keys = ["team", "match_id", "key"]
    cell, reach = lambda c: F.floor(c / (2 * HEIGHT_MARGIN)), HEIGHT_LINK + HEIGHT_MARGIN + 1e-6
    asked = open_.join(profiles.where("fingerprint is not null").select(*keys, "fingerprint"), keys).withColumn("cell", cell(F.col("at")))
    asked = asked.select(*keys, "cell", "at", "d", F.col("fingerprint").cast("array<double>").alias("fingerprint"))
    seen = players.where("fingerprint is not null and team is not null").withColumn("cell", F.explode(F.sequence(cell(F.col("resid") - reach), cell(F.col("resid") + reach))))
    seen = seen.select("team", "cell", "player_id", "resid", F.col("fingerprint").cast("array<double>").alias("fingerprint"))
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *seen.schema.fields]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", by string, near {kinds['player_id']}"

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select(keys).append_column("by", pa.array([], pa.string())).append_column("near", right.column("player_id").slice(0, 0))
        found, near = most_alike(left, right, HEIGHT_MARGIN, LOOKS_MARGIN)
        return left.select(keys).take(found).append_column("by", pa.array(["height+fp"] * len(found), pa.string())).append_column("near", right.column("player_id").take(near))

    return asked.groupBy("team", "cell").cogroup(seen.groupBy("team", "cell")).applyInArrow(alike, schema)


def _link_unclaimed(profiles: DataFrame, players: DataFrame, claimed: DataFrame) -> DataFrame:
    """Links match by match: a match has a team of its own, which its claimed players have left."""
    matches = profiles.select("team", "match_id").distinct()
    free = players.join(matches, "team").join(claimed.select("team", "match_id", "player_id").distinct(), ["team", "match_id", "player_id"], "left_anti")
    apart = lambda df: df.withColumn("_real", F.col("team")).withColumn("team", F.to_json(F.struct("team", "match_id")))
    out = link_candidates(apart(profiles).drop("_real"), apart(free).drop("_real"))
    return out.withColumn("team", F.get_json_object("team", "$.team"))


def registry_ingest(profiles: DataFrame) -> DataFrame:
    """The registry from all match profiles, folded in order of match (``roster.fold``); ``roster.Registry`` keeps versions of it."""
    return fold(profiles)[0]


def _pooled(acc: Column, x: Column) -> Column:
    """Heights weighted by their samples and looks blended, over a window."""
    n, m = acc["h_n"], x["h_n"]
    one = acc["resid"].isNull() | x["resid"].isNull() | (n + m <= 0)
    resid = F.when(one, F.coalesce(acc["resid"], x["resid"])).otherwise((acc["resid"] * n + x["resid"] * m) / (n + m))
    count = F.when(one, F.when(acc["resid"].isNull(), m).otherwise(n)).otherwise(F.least(F.lit(WINDOW).cast("long"), n + m))
    k, j = F.coalesce(acc["fp_n"], F.lit(0)), F.coalesce(x["fp_n"], F.lit(0))
    had, have = acc["fingerprint"].isNotNull() & (k > 0), x["fingerprint"].isNotNull() & (j > 0)
    fits = have & (~had | (F.size(acc["fingerprint"]) == F.size(x["fingerprint"])))
    share = j / F.least(F.lit(WINDOW), k + j)
    looks = F.when(~fits, acc["fingerprint"]).when(~had, x["fingerprint"]).otherwise(F.zip_with(acc["fingerprint"], x["fingerprint"], lambda a, b: a + (b - a) * share))
    seen = F.when(~fits, F.least(F.lit(WINDOW).cast("long"), k)).when(~had, F.least(F.lit(WINDOW).cast("long"), j)).otherwise(F.least(F.lit(WINDOW).cast("long"), k + j))
    return F.struct(resid.alias("resid"), count.alias("h_n"), looks.alias("fingerprint"), seen.alias("fp_n"))


def registry_merge(players: DataFrame, pairs: DataFrame) -> DataFrame:
    """Folds player ``drop`` into ``keep`` of a team: heights weighted by their samples, looks blended, votes and counts added, histories joined.

    The kept player's number, name, place and spread stand where it has them. Several drops of one player go in by player_id. Columns
    that players lack are null. A pair of which either isn't there changes nothing.
    """
    players = _typed(players, PLAYERS)
    there = players.select("team", F.col("player_id").alias("keep")).distinct()
    kept = pairs.where("keep <> drop").join(there, ["team", "keep"], "left_semi").select("team", F.col("drop").alias("player_id"), "keep")
    moved = players.join(kept.hint("shuffle_hash"), ["team", "player_id"], "left").withColumn("_id", F.coalesce("keep", "player_id"))
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    rest = [c for c in columns(PLAYERS) if c not in ("team", "player_id", "h_n", "fp_n")]
    all_ = moved.groupBy("team", "_id").agg(F.sort_array(F.collect_list(F.struct((F.col("_id") != F.col("player_id")).alias("_other"), "player_id", count("h_n"), count("fp_n"), F.struct(*[c for c in rest if c != "votes"]).alias("r"), F.map_entries(F.coalesce("votes", F.create_map().cast("map<string,double>"))).alias("v")))).alias("a"))  # few, named by hand
    start = F.struct(F.lit(None).cast("double").alias("resid"), F.lit(0).cast("long").alias("h_n"), F.lit(None).cast("array<double>").alias("fingerprint"), F.lit(0).cast("long").alias("fp_n"))
    pooled = F.aggregate(F.transform("a", lambda x: F.struct(x["r"]["resid"].alias("resid"), x["h_n"].alias("h_n"), x["r"]["fingerprint"].alias("fingerprint"), x["fp_n"].alias("fp_n"))), start, _pooled)
    first = lambda name: F.get(F.filter(F.transform("a", lambda x: x["r"][name]), lambda v: v.isNotNull()), F.lit(0))
    total = lambda name: F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["r"][name], F.lit(0)))
    votes = F.flatten(F.transform("a", lambda x: x["v"]))
    sums = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(votes, lambda e: e["key"]))), lambda k: F.struct(k, F.aggregate(F.filter(votes, lambda e: e["key"] == k), F.lit(0.0), lambda s, e: s + e["value"]))))
    worn = F.flatten(F.transform("a", lambda x: F.coalesce(x["r"]["history"], F.array().cast(WORN))))
    history = F.transform(F.array_distinct(F.transform(worn, lambda w: w["number"])), lambda n: F.struct(n.alias("number"), F.aggregate(F.filter(worn, lambda w: w["number"] == n), F.lit(0).cast("long"), lambda s, w: s + w["matches"]).alias("matches"), F.array_max(F.transform(F.filter(worn, lambda w: w["number"] == n), lambda w: w["last_seen"])).alias("last_seen")))
    told = {c: first(c) for c in ("ord", "display_name", "number", "resid_std", "zone_x", "zone_y", "speed")} | {c: total(c) for c in ("n_frames", "n_clips", "matches")}
    told |= {c: F.col("p")[c] for c in ("resid", "h_n", "fingerprint", "fp_n")} | {"votes": sums, "history": history, "team": F.col("team"), "player_id": F.col("_id")}
    told |= {"is_me": F.exists("a", lambda x: F.coalesce(x["r"]["is_me"], F.lit(False))), "last_match": F.array_max(F.transform("a", lambda x: x["r"]["last_match"]))}
    return all_.withColumn("p", pooled).select(*[told[c].alias(c) for c in columns(PLAYERS)])


def set_numbers(players: DataFrame, changes: DataFrame) -> DataFrame:
    """Players get the numbers of ``changes`` (team, player_id, number); histories keep those worn before."""
    met = players.join(changes.select("team", "player_id", F.col("number").cast("int").alias("_to")), ["team", "player_id"], "left")
    told = F.array_sort(F.array_union("history", F.array("_to")))
    return met.withColumn("history", F.when(F.col("_to").isNotNull(), told).otherwise(F.col("history"))).withColumn("number", F.coalesce("_to", "number")).select(*players.columns)


def rename(players: DataFrame, names: DataFrame) -> DataFrame:
    """Players get the display_name of ``names`` (team, player_id, display_name); empty names change nothing."""
    had = players if "display_name" in players.columns else players.withColumn("display_name", F.lit(None).cast("string"))
    new = names.select("team", "player_id", F.nullif(F.col("display_name"), F.lit("")).alias("_said"))
    return had.join(new, ["team", "player_id"], "left").withColumn("display_name", F.coalesce("_said", "display_name")).select(*had.columns)


def set_me(players: DataFrame, team: str, player_id: str) -> DataFrame:
    """Marks the one player that is me."""
    return players.withColumn("is_me", (F.col("team") == team) & (F.col("player_id") == player_id))


def add_players(players: DataFrame, new: DataFrame) -> DataFrame:
    """Adds players (team, match_id, key, number) that no observation has shown; their ids follow from team, match and key."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("team", "match_id", "key")]
    own = F.substr(F.sha2(F.concat_ws("|", *said), 256), F.lit(1), F.lit(32))
    number = F.col("number").cast("int")
    rows = new.select("team", own.alias("player_id"), number.alias("number"), F.lit(0).cast("long").alias("n_frames"), F.lit(0).cast("long").alias("matches"), F.when(number.isNotNull(), F.array(number)).otherwise(F.array().cast("array<int>")).alias("history"))
    return players.unionByName(rows, allowMissingColumns=True)


def list_players(players: DataFrame, me: str | None = None) -> DataFrame:
    """Adds place, a team's players in order: me (``me``, or is_me where players carry it) first, then by number, unnumbered last, then by name."""
    is_me = F.col("player_id") == F.lit(me) if me is not None else F.col("is_me") if "is_me" in players.columns else F.lit(False)
    name = F.coalesce("display_name", F.lit("")) if "display_name" in players.columns else F.lit("")
    order = [F.desc(F.coalesce(is_me, F.lit(False))), F.asc_nulls_last("number"), name, "player_id"]
    return players.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(*order)).cast("long"))

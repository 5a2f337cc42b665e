"""Version selection, actual-game bounds and point-in-time entity state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import newest_first
from arenaflow.functions.temporal import asof_lookup
from arenaflow.schemas import PROPERTY_ARRAY


def latest_successful(extractions: DataFrame) -> DataFrame:
    """Per match the newest success: completion, then start (NULLs last), then identifier.

    The pick is a ``max_by`` aggregate: it combines map-side, so a match with
    very many attempts never gathers in one task.
    """
    carried = [name for name in extractions.columns if name not in ("match_id", "status")]
    return (
        extractions.where("status = 'succeeded'")
        .groupBy("match_id")
        .agg(F.max_by(
            F.struct(*carried),
            newest_first(F.col("completed_at"), F.col("started_at"), F.col("extraction_id")),
        ).alias("row"))
        .select("match_id", "row.*")
    )


def _newest(table: DataFrame, time: str, identifier: str, fields: dict[str, str]) -> DataFrame:
    return table.groupBy("match_id").agg(
        F.max_by(
            F.struct(*[F.col(source).alias(name) for name, source in fields.items()]),
            newest_first(F.col(time), F.col(identifier)),
        ).alias("row"),
        F.count("*").alias("attempts"),
    ).select("match_id", "row.*", "attempts")


def known_matches(acquisitions: DataFrame, extractions: DataFrame) -> DataFrame:
    return acquisitions.select("match_id").union(extractions.select("match_id")).distinct()


def latest_status(acquisitions: DataFrame, extractions: DataFrame, analysed: DataFrame) -> DataFrame:
    """``match_id, status`` where a derived summary outranks the catalog."""
    extraction = _newest(extractions, "started_at", "extraction_id", {"extraction_status": "status"})
    acquisition = _newest(acquisitions, "requested_at", "acquisition_id", {"acquisition_status": "status"})
    derived = analysed.select("match_id", F.lit(True).alias("derived")).distinct()
    return (
        known_matches(acquisitions, extractions)
        .join(extraction.drop("attempts"), "match_id", "left")
        .join(acquisition.drop("attempts"), "match_id", "left")
        .join(derived, "match_id", "left")
        .select("match_id", F.when(F.col("derived"), F.lit("succeeded")).otherwise(
            F.coalesce("extraction_status", "acquisition_status", F.lit("unknown"))
        ).alias("status"))
    )


def entity_property_history(updates: DataFrame, requests: DataFrame) -> DataFrame:
    """Every update of the requested ``extraction_id, entity_instance_id, property_path``."""
    return updates.join(
        requests.select("extraction_id", "entity_instance_id", "property_path").distinct(),
        ["extraction_id", "entity_instance_id", "property_path"], "left_semi",
    ).select("extraction_id", "entity_instance_id", "property_path", "sequence", "demo_tick", "net_tick",
             "game_time", "value_type", "value")


def entity_state_at(checkpoints: DataFrame, updates: DataFrame, requests: DataFrame,
                    cell_seconds: float = 60.0) -> DataFrame:
    """State of entities at requested times.

    ``requests`` holds ``request_id, extraction_id, entity_instance_id,
    selected_game_time``.  The newest checkpoint at or before the time is the
    base; later updates up to the time overlay it, last write per property.
    Both picks are as-of lookups, so requests are never paired with history.
    """
    entity = ["extraction_id", "entity_instance_id"]
    based = asof_lookup(
        requests.select("request_id", *entity, "selected_game_time"),
        checkpoints.select(*entity, "checkpoint_game_time", "sequence"),
        entity, "selected_game_time", "checkpoint_game_time", ["sequence"], ["sequence"], cell_seconds, "base",
    ).select("request_id", *entity, "selected_game_time", F.col("base.sequence").alias("base_sequence"))

    from_checkpoint = (
        based.where("base_sequence IS NOT NULL")
        .join(checkpoints.withColumnRenamed("sequence", "base_sequence"), [*entity, "base_sequence"])
        .select(
            "request_id", *entity, "selected_game_time",
            F.inline(F.from_json("properties", PROPERTY_ARRAY)),
            F.col("base_sequence").alias("sequence"), "demo_tick", "net_tick",
            F.col("checkpoint_game_time").alias("game_time"), F.lit("checkpoint").alias("source"),
        )
        .withColumnRenamed("propertyPath", "property_path").withColumnRenamed("valueType", "value_type")
    )
    fields = ["value_type", "value", "sequence", "demo_tick", "net_tick", "game_time", "source"]
    timed = updates.where("game_time IS NOT NULL")
    wanted = based.join(timed.select(*entity, "property_path").distinct(), entity)
    from_updates = (
        asof_lookup(
            wanted, timed, [*entity, "property_path"], "selected_game_time", "game_time", ["sequence"],
            ["value_type", "value", "demo_tick", "net_tick"], cell_seconds, "found", highest=True,
        )
        .where("found.sequence > coalesce(base_sequence, 0)")
        .select("request_id", *entity, "selected_game_time", "property_path",
                *[F.col(f"found.{name}").alias(name) for name in fields[:-1]], F.lit("update").alias("source"))
    )
    return (
        from_checkpoint.select(from_updates.columns).unionByName(from_updates)
        .groupBy("request_id", *entity, "selected_game_time", "property_path")
        .agg(F.max_by(F.struct(*fields), "sequence").alias("row"))
        .select("request_id", *entity, "selected_game_time", "property_path",
                "row.value_type", "row.value", F.col("row.sequence").alias("source_sequence"),
                F.col("row.demo_tick").alias("source_demo_tick"), F.col("row.net_tick").alias("source_net_tick"),
                F.col("row.game_time").alias("source_game_time"), "row.source")
    )


def checkpoint_properties(checkpoints: DataFrame) -> DataFrame:
    """One row per property of a checkpoint; only needed columns pass the explode."""
    return checkpoints.select(
        "extraction_id", "sequence", "entity_instance_id", "checkpoint_kind", "checkpoint_game_time",
        F.inline(F.from_json("properties", PROPERTY_ARRAY)),
    ).withColumnRenamed("propertyPath", "property_path").withColumnRenamed("valueType", "value_type")


# --- actual game ----------------------------------------------------------------------------


def _markers(combat: DataFrame) -> DataFrame:
    return combat.where(F.col("event_type") == fixed.GAME_STATE).select(
        "extraction_id", "sequence", "game_time", "value"
    )


def game_bounds(combat: DataFrame) -> DataFrame:
    """``extraction_id, start_sequence, stop_sequence``; the stop is NULL when missing."""
    markers = _markers(combat).where(F.col("value").isin(fixed.STATE_START, fixed.STATE_STOP))
    starts = markers.where(F.col("value") == fixed.STATE_START).groupBy("extraction_id").agg(
        F.min("sequence").alias("start_sequence")
    )
    stops = (
        markers.where(F.col("value") == fixed.STATE_STOP).join(starts, "extraction_id")
        .where("sequence > start_sequence")
        .groupBy("extraction_id").agg(F.min("sequence").alias("stop_sequence"))
    )
    return starts.join(stops, "extraction_id", "left")


def actual_game(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events with start <= sequence < stop; nothing when a marker is missing."""
    limits = bounds.where("stop_sequence IS NOT NULL").select("extraction_id", "start_sequence", "stop_sequence")
    return (
        events.join(limits, "extraction_id")
        .where("sequence >= start_sequence AND sequence < stop_sequence")
        .drop("start_sequence", "stop_sequence")
    )


def is_actual_game(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Requests with a boolean ``is_actual_game``; false when anything is missing."""
    inside = (F.col("sequence") >= F.col("start_sequence")) & (F.col("sequence") < F.col("stop_sequence"))
    return requests.join(bounds, "extraction_id", "left").withColumn(
        "is_actual_game", F.coalesce(inside, F.lit(False))
    ).drop("start_sequence", "stop_sequence")


def game_clock(combat: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bounds with ``zero_time``: first clock marker, else first start marker, else 0."""
    def first_time(state: int) -> Column:
        return F.min(F.when(F.col("value") == state, F.col("game_time")))

    zero = actual_game(_markers(combat), bounds).groupBy("extraction_id").agg(
        F.coalesce(first_time(fixed.STATE_CLOCK), first_time(fixed.STATE_START), F.lit(0.0)).alias("zero_time")
    )
    return bounds.where("stop_sequence IS NOT NULL").join(zero, "extraction_id")


def marker_availability(combat: DataFrame) -> DataFrame:
    """Two availability answers per extraction.

    ``has_ordered_markers`` (damage timelines) needs a stop after the start;
    ``has_combat`` (fights) only needs both markers to exist.
    """
    exists = _markers(combat).groupBy("extraction_id").agg(
        F.max((F.col("value") == fixed.STATE_START).cast("int")).alias("any_start"),
        F.max((F.col("value") == fixed.STATE_STOP).cast("int")).alias("any_stop"),
    )
    bounds = game_bounds(combat)
    return exists.join(bounds, "extraction_id", "left").select(
        "extraction_id",
        F.col("stop_sequence").isNotNull().alias("has_ordered_markers"),
        ((F.col("any_start") == 1) & (F.col("any_stop") == 1)).alias("has_combat"),
    )


def position_availability(extractions: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions are available when the manifest declares them or rows exist."""
    present = positions.select("extraction_id").distinct().withColumn("present", F.lit(True))
    declared = F.get_json_object("manifest", "$.files.heroPositions").isNotNull()
    return extractions.join(present, "extraction_id", "left").select(
        "extraction_id", (declared | F.coalesce("present", F.lit(False))).alias("positions_available")
    )


def farming_availability(extractions: DataFrame) -> DataFrame:
    """Farming is available for the profile that stages camps, also with no rows."""
    profile = F.get_json_object("manifest", "$.profile")
    return extractions.select(
        "extraction_id", F.coalesce(profile == fixed.FARMING_PROFILE, F.lit(False)).alias("farming_available")
    )


# --- summaries ------------------------------------------------------------------------------


def match_summary(matches: DataFrame, latest: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Typed summary of the latest extraction; ``lobby_type_name`` falls back to the document.

    ``texts`` (``extraction_id, sequence, raw_lobby``) holds what the overview documents say, see ``documents.match_texts``.
    """
    chosen = matches.join(latest.select("extraction_id", "match_id"), ["extraction_id", "match_id"], "left_semi")
    if texts is None:
        return chosen
    raw = texts.groupBy("extraction_id").agg(F.min_by("raw_lobby", "sequence").alias("raw_lobby"))
    return chosen.join(raw, "extraction_id", "left").withColumn(
        "lobby_type_name", F.coalesce(F.col("lobby_type").cast("string"), F.col("raw_lobby"))
    ).drop("raw_lobby")


def match_players(players: DataFrame, latest: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Players of the latest extractions, with their item strip when items are given.

    A strip holds at most ten entries, so collecting it is bounded.  Players and
    items are exploded documents, which Spark takes to be as few as the documents
    and would broadcast: they meet in merge joins.
    """
    chosen = players.join(latest.select("extraction_id", "match_id").hint("merge"), "extraction_id")
    if items is None:
        return chosen
    strip = items.groupBy("extraction_id", "player_slot").agg(
        F.array_sort(F.collect_list(F.struct("item_slot", "item_id"))).alias("items")
    )
    return chosen.join(strip.hint("merge"), ["extraction_id", "player_slot"], "left")


def _final_keys(instances: DataFrame, checkpoints: DataFrame, latest: DataFrame, class_name: str) -> DataFrame:
    """``extraction_id, entity_instance_id, sequence, match_id`` of the last completion checkpoint of the first entity of a class.

    Entities and checkpoints may be exploded, which Spark takes to be few: they meet in merge joins.
    """
    first_entity = (
        instances.where(F.col("class_name") == class_name)
        .join(latest.select("extraction_id", "match_id").hint("merge"), "extraction_id")
        .groupBy("extraction_id", "match_id")
        .agg(F.min_by("entity_instance_id", "sequence").alias("entity_instance_id"))
    )
    entity = ["extraction_id", "entity_instance_id"]
    completions = checkpoints.where("checkpoint_kind = 'completion'").select(*entity, "sequence")
    return completions.join(first_entity.hint("merge"), entity).groupBy(*entity, "match_id").agg(
        F.max("sequence").alias("sequence"))


def _final_checkpoint(instances: DataFrame, checkpoints: DataFrame, latest: DataFrame, class_name: str) -> DataFrame:
    """The last completion checkpoint of the first entity of a class, per extraction."""
    return checkpoints.where("checkpoint_kind = 'completion'").join(
        _final_keys(instances, checkpoints, latest, class_name).hint("merge"),
        ["extraction_id", "entity_instance_id", "sequence"])


def summary_from_checkpoint(instances: DataFrame, checkpoints: DataFrame, latest: DataFrame) -> DataFrame:
    """Match result read from the final game-rules checkpoint."""
    final = _final_checkpoint(instances, checkpoints, latest, fixed.RULES_CLASS)
    properties = final.select("match_id", "extraction_id", F.inline(F.from_json("properties", PROPERTY_ARRAY)))

    def latest_value(name: str, kind: str) -> Column:
        return F.max(F.when(F.col("propertyPath") == f"m_pGameRules.{name}", F.col("value"))).cast(kind)

    winner = F.col("winner_team_id")
    return properties.groupBy("match_id", "extraction_id").agg(
        latest_value("m_nGameWinner", "int").alias("winner_team_id"),
        latest_value("m_iGameMode", "int").alias("game_mode_id"),
        latest_value("m_flGameStartTime", "double").alias("game_start_time"),
        latest_value("m_flGameEndTime", "double").alias("game_end_time"),
    ).select(
        "match_id", "extraction_id", "winner_team_id",
        F.when(winner == fixed.RADIANT, "Radiant").when(winner == fixed.DIRE, "Dire")
        .when(winner.isNotNull(), "Unknown").alias("winner_team"),
        "game_mode_id", "game_start_time", "game_end_time",
        (F.col("game_end_time") - F.col("game_start_time")).alias("duration_seconds"),
    )


# Player properties of the final resource checkpoint.
_PLAYER_PROPERTIES = {
    "is_valid": ("m_vecPlayerData", "m_bIsValid", "boolean"),
    "steam_id": ("m_vecPlayerData", "m_iPlayerSteamID", "decimal(20,0)"),
    "team_id": ("m_vecPlayerData", "m_iPlayerTeam", "int"),
    "player_name": ("m_vecPlayerData", "m_iszPlayerName", "string"),
    "hero_handle": ("m_vecPlayerTeamData", "m_hSelectedHero", "decimal(20,0)"),
    "hero_id": ("m_vecPlayerTeamData", "m_nSelectedHeroID", "int"),
    "kills": ("m_vecPlayerTeamData", "m_iKills", "int"),
    "deaths": ("m_vecPlayerTeamData", "m_iDeaths", "int"),
    "assists": ("m_vecPlayerTeamData", "m_iAssists", "int"),
    "level": ("m_vecPlayerTeamData", "m_iLevel", "int"),
}


def _player_texts(checkpoints: DataFrame) -> DataFrame:
    """``extraction_id, entity_instance_id, sequence, player_index, ...``: the texts of the players 0 to 9 of each checkpoint.

    A document is kilobytes of text and its players are a few words, so documents shrink before they meet anything.  A
    property that is listed twice has its greatest text.  Documents that name no player properties give no row.
    """
    keys = ["extraction_id", "entity_instance_id", "sequence"]
    text = F.col("properties")

    def computed(frame: DataFrame, **columns: Column) -> DataFrame:
        # One-row generators: a filter pushed below would compute the columns again, for every mention of them.
        return frame.select(*keys, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))

    listed = computed(checkpoints.where(text.contains("m_vecPlayer") | text.contains("\\u")),
                      listed=F.from_json(text, PROPERTY_ARRAY))
    greatest_first = F.reverse(F.array_sort(F.transform("listed", lambda entry: F.struct(
        entry["propertyPath"].alias("propertyPath"), entry["value"].alias("value")))))
    once = F.size(F.array_distinct("listed.propertyPath")) == F.size("listed")
    looked_up = computed(listed, **{name: F.when(once, F.col(f"listed.{name}")).otherwise(greatest_first[name])
                                    for name in ("propertyPath", "value")})
    paths = F.array(*[F.struct(F.lit(index).alias("player_index"), *[
        F.lit(f"{vector}.{index:04d}.{field}").alias(name) for name, (vector, field, _) in _PLAYER_PROPERTIES.items()])
        for index in range(10)])
    return looked_up.select(*keys, "propertyPath", "value", F.inline(paths)).select(*keys, "player_index", *[
        F.get("value", (F.array_position("propertyPath", F.col(name)) - 1).cast("int")).alias(name)
        for name in _PLAYER_PROPERTIES])


def players_from_checkpoint(instances: DataFrame, checkpoints: DataFrame, latest: DataFrame) -> DataFrame:
    """Ten-player pivot of the final resource checkpoint with the hero class by handle.

    Players are looked up in their document by the paths of their properties.  Where the final checkpoint is there
    more than once, a player has the greatest text of each property.
    """
    keys = ["extraction_id", "entity_instance_id", "sequence"]
    final = _player_texts(checkpoints.where("checkpoint_kind = 'completion'")).join(
        _final_keys(instances, checkpoints, latest, fixed.PLAYER_RESOURCE_CLASS).hint("merge"), keys)
    # An extraction and match have one final checkpoint: its keys beside theirs change no group and spare a shuffle.
    players = final.groupBy(*keys, "match_id", "player_index").agg(*[
        F.max(name).cast(kind).alias(name) for name, (_, _, kind) in _PLAYER_PROPERTIES.items()
    ]).where(F.col("is_valid") & F.col("team_id").isin(fixed.RADIANT, fixed.DIRE))
    heroes = instances.select("extraction_id", F.col("handle").alias("hero_handle"),
                              F.col("class_name").alias("hero_class"))
    return players.join(heroes.hint("merge"), ["extraction_id", "hero_handle"], "left").select(
        "match_id", "extraction_id", "player_index", "team_id",
        F.when(F.col("team_id") == fixed.RADIANT, "Radiant").otherwise("Dire").alias("team"),
        "player_name", "steam_id", "hero_id", "hero_class", "kills", "deaths", "assists", "level",
    )

"""Match documents normalised to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.columns import count_if, finite
from arenaflow.operators.versions import actual_game

# Every leaf is declared as text and cast afterwards: one bad field becomes a
# NULL in its own column and never hides the rest of the document.
_PLAYER_FIELDS = (
    "player_slot", "team_number", "team_slot", "account_id", "player_name", "hero_id", "level", "kills", "deaths",
    "assists", "last_hits", "denies", "gold_per_min", "xp_per_min", "net_worth", "hero_damage", "tower_damage",
    "hero_healing",
) + tuple(f"item_{slot}" for slot in range(10))
_PLAYERS = "ARRAY<STRUCT<" + ", ".join(f"{name}: STRING" for name in _PLAYER_FIELDS) + ">>"
_OVERVIEW_FIELDS = (
    "match_id", "starttime", "duration", "game_mode", "lobby_type", "match_outcome", "radiant_team_score",
    "dire_team_score", "radiant_team_name", "dire_team_name", "cluster", "first_blood_time",
)
_GRAPHS = ("graph_net_worth", "graph_gold_earned", "graph_experience")
_METADATA = (
    "version STRING, metadata STRUCT<teams: ARRAY<STRUCT<dota_team: STRING, "
    "players: ARRAY<STRUCT<game_player_id: STRING, player_slot: STRING>>, "
    + ", ".join(f"{name}: ARRAY<STRING>" for name in _GRAPHS) + ">>>"
)


def _documents(records: DataFrame, record_type: str) -> DataFrame:
    return records.where(F.col("record_type") == record_type).select("extraction_id", "sequence", "payload")


def document_violations(records: DataFrame, extractions: DataFrame) -> DataFrame:
    """``extraction_id, problem``: documents must come as one pair, and report the requested match."""
    wanted = records.where(F.col("record_type").isin(fixed.OVERVIEW_DOCUMENT, fixed.METADATA_DOCUMENT))
    counts = wanted.groupBy("extraction_id").agg(
        count_if(F.col("record_type") == fixed.OVERVIEW_DOCUMENT).alias("overviews"),
        count_if(F.col("record_type") == fixed.METADATA_DOCUMENT).alias("metadata"),
        F.max(F.when(F.col("record_type") == fixed.OVERVIEW_DOCUMENT,
                     F.get_json_object("payload", "$.match_id").try_cast("decimal(20,0)"))).alias("reported"),
    )
    problem = (
        F.when((F.col("overviews") != 1) | (F.col("metadata") != 1), "one overview and one metadata document required")
        .when(~F.col("reported").eqNullSafe(F.col("match_id")), "reported match differs")
    )
    return counts.join(extractions.select("extraction_id", "match_id"), "extraction_id").withColumn(
        "problem", problem
    ).where("problem IS NOT NULL").select("extraction_id", "problem")


def lobby_code(name: Column) -> Column:
    named = F.create_map(*[part for code, lobby in enumerate(fixed.LOBBY_NAMES)
                           for part in (F.lit(fixed.LOBBY_PREFIX + lobby), F.lit(code))])
    return F.coalesce(F.element_at(named, name), name.try_cast("int"))


def winner_code(outcome: Column) -> Column:
    text = F.lower(outcome)
    return (
        F.when(text.contains("radiantvictory") | text.contains("radvictory"), F.lit(fixed.RADIANT))
        .when(text.contains("direvictory"), F.lit(fixed.DIRE))
    )


def team_name(team: Column) -> Column:
    return F.when(team == fixed.RADIANT, "Radiant").when(team == fixed.DIRE, "Dire")


_PARTS = {"match": ", ".join(f"{name} STRING" for name in _OVERVIEW_FIELDS), "draft": "picks_bans STRING",
          "players": f"players {_PLAYERS}"}


def overviews(records: DataFrame, *parts: str) -> DataFrame:
    """``extraction_id, m``: every overview document parsed once for the parts named (all: match, players, draft).

    Players are rows and the draft is JSON text.  Tables of players, items,
    drafts and matches follow from it; write it where several of them are read.
    """
    schema = ", ".join(_PARTS[part] for part in parts or _PARTS)
    return _documents(records, fixed.OVERVIEW_DOCUMENT).select("extraction_id", F.from_json("payload", schema).alias("m"))


def match_texts(records: DataFrame) -> DataFrame:
    """``extraction_id, sequence, m, raw_lobby``: what match rows and the names of their lobbies are made of.

    Write it where both are read: documents are large, and a filter on a parsed field would parse them once more.
    """
    return _documents(records, fixed.OVERVIEW_DOCUMENT).select(
        "extraction_id", "sequence", F.from_json("payload", _PARTS["match"]).alias("m"),
        F.get_json_object("payload", "$.lobby_type").alias("raw_lobby"))


def matches(records: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """One typed row per overview document; ``parsed`` are the documents of ``records`` where they are parsed already."""
    versions = _documents(records, fixed.METADATA_DOCUMENT).groupBy("extraction_id").agg(
        F.min_by(F.get_json_object("payload", "$.version").try_cast("int"), "sequence").alias("metadata_version")
    )
    found = overviews(records, "match") if parsed is None else parsed
    return match_rows(found).join(versions, "extraction_id", "left")


def match_rows(parsed: DataFrame) -> DataFrame:
    """Typed rows of parsed overviews, without the version of the metadata document."""
    winner = winner_code(F.col("m.match_outcome"))
    return parsed.select(
        "extraction_id",
        F.col("m.match_id").try_cast("decimal(20,0)").alias("match_id"),
        F.timestamp_seconds(F.col("m.starttime").try_cast("bigint")).alias("start_time"),
        F.col("m.duration").try_cast("int").alias("duration_seconds"),
        F.col("m.game_mode").alias("game_mode"),
        lobby_code(F.col("m.lobby_type")).alias("lobby_type"),
        winner.alias("winner_team_id"),
        team_name(winner).alias("winner_team"),
        F.col("m.radiant_team_score").try_cast("int").alias("radiant_score"),
        F.col("m.dire_team_score").try_cast("int").alias("dire_score"),
        F.col("m.radiant_team_name").alias("radiant_team_name"),
        F.col("m.dire_team_name").alias("dire_team_name"),
        F.col("m.cluster").try_cast("int").alias("cluster"),
        F.col("m.first_blood_time").try_cast("int").alias("first_blood_seconds"),
    )


def _document_players(parsed: DataFrame) -> DataFrame:
    team = F.col("team_number")
    return (
        parsed.select("extraction_id", F.inline("m.players"))
        .withColumn("team_id", F.when(team == "DOTA_GC_TEAM_GOOD_GUYS", F.lit(fixed.RADIANT))
                    .when(team == "DOTA_GC_TEAM_BAD_GUYS", F.lit(fixed.DIRE)))
        .where("team_id IS NOT NULL")
    )


def players(records: DataFrame) -> DataFrame:
    """Players of the two teams; other teams are dropped."""
    return player_rows(overviews(records, "players"))


def player_rows(parsed: DataFrame) -> DataFrame:
    """Players of parsed overviews."""
    integers = ("hero_id", "level", "kills", "deaths", "assists", "last_hits", "denies", "gold_per_min", "xp_per_min",
                "net_worth", "hero_damage", "tower_damage", "hero_healing")
    return _document_players(parsed).select(
        "extraction_id", F.col("player_slot").try_cast("bigint").alias("player_slot"), "team_id",
        team_name(F.col("team_id")).alias("team"), F.col("team_slot").try_cast("bigint").alias("team_slot"),
        F.col("account_id").try_cast("decimal(20,0)").alias("account_id"),
        F.nullif("player_name", F.lit("")).alias("player_name"),
        *[F.col(name).try_cast("int").alias(name) for name in integers],
    )


def player_items(records: DataFrame) -> DataFrame:
    """Ten item slots per player."""
    return item_rows(overviews(records, "players"))


def item_rows(parsed: DataFrame) -> DataFrame:
    """Item slots of parsed overviews."""
    return _document_players(parsed).select(
        "extraction_id", F.col("player_slot").try_cast("bigint").alias("player_slot"),
        F.posexplode(F.array(*[F.col(f"item_{slot}").try_cast("int") for slot in range(10)]))
        .alias("item_slot", "item_id"),
    )


def hero_draft_events(records: DataFrame) -> DataFrame:
    """Draft entries with strictly typed fields; the array position stays the order.

    Strict typing needs the JSON type, so entries are read as VARIANT: a quoted
    number or boolean is not accepted.
    """
    return draft_rows(overviews(records, "draft"))


def draft_rows(parsed: DataFrame) -> DataFrame:
    """Draft entries of parsed overviews."""
    entries = parsed.select(
        "extraction_id",
        F.posexplode(F.try_variant_get(F.try_parse_json("m.picks_bans"), "$", "array<variant>")).alias("draft_order", "entry"),
    )

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("entry", f"$.{field}", "variant"))

    typed = entries.select(
        "extraction_id", "draft_order",
        F.when(kind("hero_id") == "BIGINT", F.try_variant_get("entry", "$.hero_id", "int")).alias("hero_id"),
        F.when(kind("is_pick") == "BOOLEAN", F.try_variant_get("entry", "$.is_pick", "boolean")).alias("is_pick"),
        F.when(kind("team") == "BIGINT", F.try_variant_get("entry", "$.team", "int")).alias("team_index"),
    )
    return typed.where("hero_id > 0 AND is_pick IS NOT NULL AND team_index IN (0, 1)")


def _metadata_teams(records: DataFrame) -> DataFrame:
    return _documents(records, fixed.METADATA_DOCUMENT).select(
        "extraction_id", F.inline(F.from_json("payload", _METADATA)["metadata"]["teams"])
    ).withColumn("team_id", F.col("dota_team").try_cast("int"))


def team_time_series(records: DataFrame) -> DataFrame:
    """Minute samples of both teams; net worth drives, the other graphs join by position."""
    return (
        _metadata_teams(records).where(F.col("team_id").isin(fixed.RADIANT, fixed.DIRE))
        .select("extraction_id", "team_id", "graph_gold_earned", "graph_experience",
                F.posexplode("graph_net_worth").alias("sample_index", "net_worth"))
        .select("extraction_id", "team_id", "sample_index", F.col("net_worth").try_cast("double").alias("net_worth"),
                F.get("graph_gold_earned", F.col("sample_index")).try_cast("double").alias("gold_earned"),
                F.get("graph_experience", F.col("sample_index")).try_cast("double").alias("experience"))
    )


def metadata_candidates(records: DataFrame) -> DataFrame:
    """Every metadata player entry, valid or not."""
    return (
        _metadata_teams(records).select("extraction_id", "team_id", F.inline("players"))
        .select("extraction_id", F.col("game_player_id").try_cast("int").alias("game_player_id"),
                F.col("player_slot").try_cast("bigint").alias("player_slot"), "team_id")
    )


def metadata_roster(candidates: DataFrame, unique_by: str, identifier_limit: int | None = 9) -> DataFrame:
    """Unambiguous metadata players.

    ``unique_by``: ``game_player_id`` (positions), ``player_slot`` (gold) or
    ``both`` (fights).  A repeated key is ambiguous and is left out.
    """
    usable = candidates.where(F.col("player_slot").isNotNull() & F.col("team_id").isin(fixed.RADIANT, fixed.DIRE)
                              & (F.col("game_player_id") >= 0))
    if identifier_limit is not None:
        usable = usable.where(F.col("game_player_id") <= identifier_limit)

    def unique(key: str) -> DataFrame:
        others = [name for name in ("game_player_id", "player_slot", "team_id") if name != key]
        return usable.groupBy("extraction_id", key).agg(
            F.count("*").alias("candidates"), *[F.min(name).alias(name) for name in others]
        ).where("candidates = 1").select("extraction_id", "game_player_id", "player_slot", "team_id")

    if unique_by == "both":
        # Either side has a row once, so a row that is there twice is in both.  A join would do it too, but Spark takes
        # exploded documents to be as few as the documents and would broadcast one side.
        names = ["extraction_id", "game_player_id", "player_slot", "team_id"]
        return unique("game_player_id").unionByName(unique("player_slot")).groupBy(*names).agg(
            F.count("*").alias("sides")).where("sides = 2").select(*names)
    return unique(unique_by)


GOLD_PATH = r"^m_vecDataTeam\.([0-9]+)\.m_iTotalEarnedGold$"


def player_gold_events(updates: DataFrame, instances: DataFrame, bounds: DataFrame,
                       roster: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cumulative gold facts of the actual game, mapped to unambiguous players."""
    sources = instances.where(F.col("class_name").isin(fixed.RADIANT_DATA_CLASS, fixed.DIRE_DATA_CLASS)).select(
        "extraction_id", "entity_instance_id",
        F.when(F.col("class_name") == fixed.RADIANT_DATA_CLASS, F.lit(fixed.RADIANT))
        .otherwise(F.lit(fixed.DIRE)).alias("team_id"),
    )
    slots = (
        roster.where(F.col("team_id").isin(fixed.RADIANT, fixed.DIRE) & F.col("team_slot").isNotNull())
        .groupBy("extraction_id", "team_id", "team_slot")
        .agg(F.count("*").alias("entries"), F.min("player_slot").alias("player_slot")).where("entries = 1")
        .join(metadata_roster(candidates, "player_slot", None), ["extraction_id", "player_slot", "team_id"])
        .select("extraction_id", "team_id", "team_slot", "player_slot", "game_player_id")
    )
    gold = (
        updates.where(F.col("property_path").rlike(GOLD_PATH) & finite(F.col("game_time")))
        .select("extraction_id", "entity_instance_id", "sequence", "game_time",
                F.regexp_extract("property_path", GOLD_PATH, 1).try_cast("bigint").alias("team_slot"),
                F.col("value").try_cast("bigint").alias("total_gold_earned"))
        .where("total_gold_earned >= 0 AND team_slot IS NOT NULL")
        .join(sources, ["extraction_id", "entity_instance_id"])
    )
    return actual_game(gold, bounds).join(slots, ["extraction_id", "team_id", "team_slot"]).select(
        "extraction_id", "sequence", "game_player_id", "player_slot", "team_id",
        F.col("game_time").alias("game_time_seconds"), "total_gold_earned",
    )


def position_mismatches(positions: DataFrame, candidates: DataFrame, roster: DataFrame) -> DataFrame:
    """Position rows that disagree with the match roster."""
    mapped = _mapped_players(candidates, roster)
    return positions.join(mapped, ["extraction_id", "game_player_id"], "left").where(
        F.col("player_slot").isNull()
        | ~F.col("roster_hero_id").eqNullSafe(F.col("hero_id"))
        | ~F.col("roster_team_id").eqNullSafe(F.col("team_id"))
    ).drop("player_slot", "roster_hero_id", "roster_team_id")


def _mapped_players(candidates: DataFrame, roster: DataFrame) -> DataFrame:
    return metadata_roster(candidates, "game_player_id").join(
        roster.select("extraction_id", "player_slot", "team_id", "hero_id"),
        ["extraction_id", "player_slot", "team_id"],
    ).select("extraction_id", "game_player_id", "player_slot", F.col("hero_id").alias("roster_hero_id"),
             F.col("team_id").alias("roster_team_id"))


def hero_position_samples(strict: DataFrame, candidates: DataFrame, roster: DataFrame,
                          declared: DataFrame) -> DataFrame:
    """Imported samples of extractions whose rows are all valid and agree with the roster.

    ``declared`` holds ``extraction_id, declared_rows`` of the manifest, which
    the imported count must equal.  A failing row rejects its whole extraction.
    """
    mapped = _mapped_players(candidates, roster)
    checked = strict.join(mapped, ["extraction_id", "game_player_id"], "left").withColumn(
        "rejected",
        F.col("invalid") | F.col("player_slot").isNull()
        | ~F.col("roster_hero_id").eqNullSafe(F.col("hero_id"))
        | ~F.col("roster_team_id").eqNullSafe(F.col("team_id")),
    )
    accepted = checked.groupBy("extraction_id").agg(
        F.max("rejected").alias("any_rejected"), F.count("*").alias("stored_rows")
    ).where("NOT any_rejected").join(declared, "extraction_id").where("stored_rows = declared_rows")
    return checked.join(accepted.select("extraction_id"), "extraction_id", "left_semi").select(
        "extraction_id", "sequence", "game_time_milliseconds", "player_slot", "hero_id", "team_id",
        F.col("world_x").cast("float").alias("world_x"), F.col("world_y").cast("float").alias("world_y"),
    )

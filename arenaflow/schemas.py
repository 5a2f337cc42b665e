"""Explicit schemas: staged NDJSON rows and the warehouse tables they become."""

from __future__ import annotations

from pyspark.sql import types as T

# Staged column, warehouse column and type of the combat log.
COMBAT_COLUMNS = (
    ("sequence", "BIGINT"),
    ("game_time", "DOUBLE"),
    ("raw_time", "DOUBLE"),
    ("event_type", "STRING"),
    ("target_name", "STRING"),
    ("attacker_name", "STRING"),
    ("damage_source_name", "STRING"),
    ("inflictor_name", "STRING"),
    ("target_team", "INT"),
    ("attacker_team", "INT"),
    ("value", "INT"),
    ("health", "INT"),
    ("location_x", "FLOAT"),
    ("location_y", "FLOAT"),
    ("event_location", "INT"),
    ("stun_duration", "FLOAT"),
    ("slow_duration", "FLOAT"),
    ("modifier_duration", "FLOAT"),
    ("gold_reason", "INT"),
    ("xp_reason", "INT"),
    ("last_hits", "INT"),
    ("net_worth", "INT"),
    ("gpm", "INT"),
    ("xpm", "INT"),
    ("attacker_hero_level", "INT"),
    ("target_hero_level", "INT"),
    ("damage_type", "INT"),
    ("damage_category", "INT"),
    ("rune_type", "INT"),
    ("stack_count", "INT"),
    ("observer_wards_placed", "INT"),
    ("assist_players", "ARRAY<INT>"),
    ("attacker_hero", "BOOLEAN"),
    ("target_hero", "BOOLEAN"),
    ("target_building", "BOOLEAN"),
    ("attacker_illusion", "BOOLEAN"),
    ("target_illusion", "BOOLEAN"),
    ("heal_save", "BOOLEAN"),
    ("long_range_kill", "BOOLEAN"),
    ("target_source_name", "STRING"),
    ("value_name", "STRING"),
    ("modifier_elapsed_duration", "FLOAT"),
    ("ability_level", "INT"),
    ("neutral_camp_type", "INT"),
    ("building_type", "INT"),
    ("modifier_purge_ability", "INT"),
    ("modifier_purge_npc", "INT"),
    ("total_unit_death_count", "INT"),
    ("modifier_ability", "INT"),
    ("kill_eater_event", "INT"),
    ("unit_status_label", "INT"),
    ("neutral_camp_team", "INT"),
    ("regenerated_health", "FLOAT"),
    ("tracked_stat_id", "INT"),
    ("modifier_purged_duration", "FLOAT"),
    ("visible_radiant", "BOOLEAN"),
    ("visible_dire", "BOOLEAN"),
    ("ability_toggle_on", "BOOLEAN"),
    ("ability_toggle_off", "BOOLEAN"),
    ("hidden_modifier", "BOOLEAN"),
    ("ultimate_ability", "BOOLEAN"),
    ("target_self", "BOOLEAN"),
    ("invisibility_modifier", "BOOLEAN"),
    ("silence_modifier", "BOOLEAN"),
    ("heal_from_lifesteal", "BOOLEAN"),
    ("modifier_purged", "BOOLEAN"),
    ("spell_evaded", "BOOLEAN"),
    ("motion_controller_modifier", "BOOLEAN"),
    ("root_modifier", "BOOLEAN"),
    ("aura_modifier", "BOOLEAN"),
    ("armor_debuff_modifier", "BOOLEAN"),
    ("no_physical_damage_modifier", "BOOLEAN"),
    ("modifier_hidden", "BOOLEAN"),
    ("inflictor_is_stolen_ability", "BOOLEAN"),
    ("spell_generated_attack", "BOOLEAN"),
    ("at_night_time", "BOOLEAN"),
    ("attacker_has_scepter", "BOOLEAN"),
    ("will_reincarnate", "BOOLEAN"),
    ("uses_charges", "BOOLEAN"),
    ("heal_from_regen", "BOOLEAN"),
)

_CLOCK = "demo_tick BIGINT, net_tick BIGINT, game_time DOUBLE"

TABLES = {
    "records": f"extraction_id STRING, sequence BIGINT, {_CLOCK}, category STRING, record_type STRING, payload STRING",
    "combatEvents": "extraction_id STRING, " + ", ".join(f"{name} {kind}" for name, kind in COMBAT_COLUMNS),
    "entityInstances": (
        "extraction_id STRING, sequence BIGINT, entity_instance_id BIGINT, entity_index BIGINT, serial BIGINT, "
        f"handle DECIMAL(20,0), class_id INT, class_name STRING, {_CLOCK}"
    ),
    "entityEvents": (
        f"extraction_id STRING, sequence BIGINT, entity_instance_id BIGINT, event_type STRING, {_CLOCK}, synthetic BOOLEAN"
    ),
    "propertyUpdates": (
        "extraction_id STRING, sequence BIGINT, entity_instance_id BIGINT, property_path STRING, "
        f"value_type STRING, value STRING, {_CLOCK}"
    ),
    "checkpoints": (
        f"extraction_id STRING, sequence BIGINT, entity_instance_id BIGINT, checkpoint_kind STRING, {_CLOCK}, "
        "checkpoint_game_time DOUBLE, properties STRING"
    ),
    "blobs": (
        f"extraction_id STRING, sequence BIGINT, {_CLOCK}, blob_id STRING, record_sequence BIGINT, "
        "field_path STRING, value BINARY"
    ),
    "heroPositions": (
        "extraction_id STRING, sequence BIGINT, demo_tick BIGINT, game_time_milliseconds BIGINT, "
        "game_player_id BIGINT, hero_id INT, team_id INT, world_x DOUBLE, world_y DOUBLE"
    ),
}

EXTRACTIONS = (
    "extraction_id STRING, match_id DECIMAL(20,0), replay_sha256 STRING, parser_name STRING, parser_version STRING, "
    "exporter_version STRING, extraction_config STRING, checkpoint_interval_seconds DOUBLE, output_limit_bytes BIGINT, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, status STRING, record_counts STRING, manifest STRING"
)
PLAYERS = (
    "extraction_id STRING, player_slot BIGINT, team_id INT, team STRING, team_slot BIGINT, account_id DECIMAL(20,0), "
    "player_name STRING, hero_id INT, level INT, kills INT, deaths INT, assists INT, last_hits INT, denies INT, "
    "gold_per_min INT, xp_per_min INT, net_worth INT, hero_damage INT, tower_damage INT, hero_healing INT"
)
PROPERTY_ARRAY = "ARRAY<STRUCT<propertyPath: STRING, valueType: STRING, value: STRING>>"


def table_schema(logical: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[logical])


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


# Staged fields whose warehouse column has another name.
RENAMED = {("blobs", "value"): "valueBase64"}


def staged_name(logical: str, column: str) -> str:
    return RENAMED.get((logical, column), camel(column))


def staged_schema(logical: str) -> T.StructType:
    """Schema of a staged row: the warehouse types, with large numbers and raw JSON as text.

    Identifiers arrive either as numbers or as digit strings; reading them as
    text keeps all 64 bits.  Nested JSON (payload, value, properties) read as
    text keeps the exact source document.
    """
    fields = []
    for field in table_schema(logical).fields:
        wide = isinstance(field.dataType, (T.LongType, T.DecimalType, T.BinaryType)) or logical == "heroPositions"
        kind = T.StringType() if wide else field.dataType
        fields.append(T.StructField(staged_name(logical, field.name), kind))
    return T.StructType(fields)

"""Values fixed by the telemetry format and by the analysis definitions."""

# Combat-log event types.
GAME_STATE = "DOTA_COMBATLOG_GAME_STATE"
DAMAGE = "DOTA_COMBATLOG_DAMAGE"
HEAL = "DOTA_COMBATLOG_HEAL"
DEATH = "DOTA_COMBATLOG_DEATH"
XP = "DOTA_COMBATLOG_XP"

# Game states that bound the actual game and start its clock.
STATE_START = 4
STATE_CLOCK = 5
STATE_STOP = 6

# Teams.
RADIANT = 2
DIRE = 3
NEUTRAL = 4
TEAM_NAMES = {2: "Radiant", 3: "Dire"}

# Document record types.
OVERVIEW_DOCUMENT = "CMsgDOTAMatch"
METADATA_DOCUMENT = "CDOTAMatchMetadataFile"

# Entity classes.
RULES_CLASS = "CDOTAGamerulesProxy"
PLAYER_RESOURCE_CLASS = "CDOTA_PlayerResource"
RADIANT_DATA_CLASS = "CDOTA_DataRadiant"
DIRE_DATA_CLASS = "CDOTA_DataDire"
SPAWNER_CLASS = "CDOTA_NeutralSpawner"
CREEP_CLASS = "CDOTA_BaseNPC_Creep_Neutral"
INVALID_HANDLE = 16777215
NULL_HANDLES = (-1, 16777215, 4294967295)
CELL_SIZE = 128.0
CELL_ORIGIN = 16384.0
SAMPLE_MS = 100
GRAPH_POSITIONS = 64
NEUTRAL_NAME_PREFIX = "npc_dota_neutral_"

# Storage policy.
REJECTED_RECORD_TYPES = (
    "CSVCMsg_VoiceData",
    "CSVCMsg_VoiceInit",
    "CUserMessageVoiceMask",
    "CUserMessageSendAudio",
    "CUserMsg_ParticleManager",
    "CMsgSosStartSoundEvent",
    "CMsgSosSetSoundEventParams",
    "CMsgSosStopSoundEvent",
    "CMsgSosStopSoundEventHash",
    "CDOTAUserMsg_TE_UnitAnimation",
    "CDOTAUserMsg_TE_UnitAnimationEnd",
    "CDOTAUserMsg_TE_DotaBloodImpact",
    "CDOTAUserMsg_TE_Projectile",
    "CDOTAUserMsg_TE_ProjectileLoc",
    "CMsgTEEffectDispatch",
    "CDOTAUserMsg_KillEffect",
    "CSVCMsg_HLTVStatus",
    "CSVCMsg_PacketEntities",
)
REJECTED_ENTITY_CLASSES = (
    "CParticleSystem",
    "CDOTA_DataSpectator",
    "CDOTASpectatorGraphManagerProxy",
    "CDOTACameraBounds",
)
STORED_ENTITY_EVENTS = ("create", "delete")
STORED_CHECKPOINT_KINDS = ("creation", "completion")

# Lobby names in code order.
LOBBY_NAMES = (
    "NORMAL", "PRACTICE", "TOURNAMENT", "TUTORIAL", "COOP_BOTS", "TEAM_MATCH", "SOLO_QUEUE", "RANKED",
    "1V1MID", "WEEKEND_TOURNEY", "LOCAL_BOTS", "SPECTATOR", "EVENT", "GAUNTLET", "NEW_PLAYER", "FEATURED",
)
LOBBY_PREFIX = "DOTA_LOBBY_TYPE_"
RANKED_LOBBY = 7

# Staged file of every logical table, and the manifest schema that introduced it.
STAGED_FILES = {
    "records": ("records.ndjson", 1),
    "combatEvents": ("combat_events.ndjson", 1),
    "blobs": ("blobs.ndjson", 1),
    "entityInstances": ("entity_instances.ndjson", 1),
    "entityEvents": ("entity_events.ndjson", 1),
    "propertyUpdates": ("property_updates.ndjson", 1),
    "checkpoints": ("checkpoints.ndjson", 1),
    "heroPositions": ("hero_positions.ndjson", 2),
    "winProbability": ("win_probability.ndjson", 3),
}

# Probability sample sources.
GRAPH_HISTORY = "graph_history"
SPECTATOR_UPDATES = "spectator_updates"

# Map bounds and grid.
WORLD_MINIMUM = -8288.0
WORLD_MAXIMUM = 8288.0
HEATMAP_GRID = 64

# Fight detection.
FIGHT_VERSION = "death-anchored-fights-v1"
LINK_GAP_SECONDS = 20.0
LINK_DISTANCE = 2500.0
IDLE_GAP_SECONDS = 10.0
PRELUDE_SECONDS = 60.0
TAIL_SECONDS = 20.0
OUTCOME_SECONDS = 30.0
LOCAL_RADIUS = 3500.0
VIEW_MINIMUM = 2400.0
VIEW_MAXIMUM = 6500.0
VIEW_PADDING = 800.0

# Camp farming.
FARMING_DEFINITION = "neutral-camp-farming-v1"
FARMING_PROFILE = "match-analysis-v4"
POSITION_TOLERANCE_MS = 250
CAMP_RADIUS = 1200.0
DAMAGE_GAP_MS = 8000
BEFORE_CLOCK_MS = -9007199254740991

# Damage timelines and charts.
DAMAGE_INTERVAL_SECONDS = 30
NAMED_SERIES = 7

# Sampler.
WINDOW_DELAY_MINUTES = 90

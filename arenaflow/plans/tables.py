"""Telemetry-shaped tables derived by Spark from the given tables.

The given tables hold no match telemetry, so these views map them: 19 users of
``events`` form one match, 30 days become 40 minutes, and event types become
combat-log types.  Every view grows with its source table and nothing is
collected.  ``oracle.py`` states the same mapping in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arenaflow import fixed_values as fixed
from arenaflow.functions.heroes import combat_log_name
from arenaflow.functions.temporal import running_total
from arenaflow.schemas import COMBAT_COLUMNS

USERS = 19
OBJECTIVES = {90: "npc_dota_roshan", 91: "npc_dota_miniboss", 92: "npc_dota_badguys_tower1_mid",
              93: "npc_dota_goodguys_melee_rax_bot", 94: "npc_dota_badguys_tower2_top"}


def _pick(key: Column, options: dict[int, str | None]) -> Column:
    chosen = F.lit(None).cast("string")
    for number, text in options.items():
        chosen = F.when(key == number, F.lit(text)).otherwise(chosen)
    return chosen


@dataclass
class Telemetry:
    """Match telemetry derived from one folder of the given tables."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- events -----------------------------------------------------------------------------

    @cached_property
    def ev(self) -> DataFrame:
        user = F.col("user_id")
        k = F.get_json_object("props", "$.k").cast("bigint")
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
        return self.table("events").select(
            F.floor(user / USERS).cast("bigint").alias("ext"), (user % USERS).alias("slot"), "user_id",
            (F.lit(2) + user % 2).cast("int").alias("team_id"), F.col("event_id").alias("sequence"),
            F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            k.alias("k"), F.floor(micros / 1080000).cast("bigint").alias("t_ms"),
        ).select(
            F.concat(F.lit("x"), "ext").alias("extraction_id"), "*",
            ((F.col("k") - 50) * 120.0).alias("px"), ((F.col("sequence") * 37 % 100 - 50) * 120.0).alias("py"))

    @staticmethod
    def _hero(slot: Column) -> Column:
        return (F.lit(1) + slot % 18).cast("int")

    @cached_property
    def combat(self) -> DataFrame:
        k, kind = F.col("k"), F.col("kind")
        opponent = (F.col("slot") + 1 + k) % USERS
        ev = self.ev.withColumn("other", opponent).withColumn(
            "hit", F.when(kind.isin("purchase", "click"), F.col("other")).otherwise(F.col("slot"))
        ).withColumn("actor", F.when(kind == "error", F.col("other")).otherwise(F.col("slot")))
        marker = (kind == "signup") & (k < 12)
        neutral = (kind == "click") & (k % 4 == 0)
        objective = (kind == "error") & k.between(90, 94)
        state = F.when(F.col("t_ms") < 600000, 4).when(F.col("t_ms") < 1500000, 5).otherwise(6)
        actor_name = combat_log_name(self._hero(F.col("actor")))
        hit_name = combat_log_name(self._hero(F.col("hit")))
        located = k % 4 != 0

        def team_of(slot: str) -> Column:
            return (F.lit(2) + (F.col("ext") * USERS + F.col(slot)) % 2).cast("int")

        def flag(divisor: int) -> Column:
            return F.when(k % divisor == 0, True).when(k % divisor == 1, F.lit(None).cast("boolean")).otherwise(False)

        values = {
            "sequence": F.col("sequence"),
            "game_time": F.col("t_ms") / 1000.0,
            "raw_time": F.col("t_ms") / 1000.0 + 10,
            "event_type": F.when(kind == "error", fixed.DEATH).when(kind.isin("purchase", "click"), fixed.DAMAGE)
                .when(kind == "view", fixed.HEAL).when(marker, fixed.GAME_STATE).otherwise(fixed.XP),
            "target_name": F.when(neutral, "npc_dota_neutral_kobold").when(objective, _pick(k, OBJECTIVES))
                .otherwise(hit_name),
            "attacker_name": F.when(k % 5 == 0, "npc_dota_summon").otherwise(actor_name),
            "damage_source_name": F.when(k % 3 == 1, actor_name).when(
                k % 3 == 2, F.concat(F.lit("npc_dota_unit_"), k % 7)),
            "inflictor_name": _pick(k % 4, {1: "dota_fire_blast", 2: "item_dagon", 3: ""}),
            "target_team": F.when(neutral, 4).otherwise(team_of("hit")),
            "attacker_team": team_of("actor"),
            "value": F.when(marker, state).when(k != 99, F.floor(F.col("cents") / 10)),
            "location_x": F.when(located, F.col("px")), "location_y": F.when(located, F.col("py")),
            "damage_type": k % 3,
            "assist_players": F.when(k % 2 == 0, F.array(
                (F.col("slot") + 3) % USERS, (F.col("slot") + 5 + k % 4) % USERS)),
            "target_hero": ~(neutral | objective),
            "target_building": F.when(objective, k.isin(92, 93)),
            "attacker_illusion": flag(13), "target_illusion": flag(17),
            "target_source_name": F.when(k % 6 == 0, hit_name).when(k % 6 == 1, "npc_dota_owner"),
            "spell_generated_attack": F.when(k % 2 == 0, True),
        }
        columns = []
        for name, data_type in COMBAT_COLUMNS:
            columns.append(values.get(name, F.lit(None)).cast(data_type).alias(name))
        return ev.select("extraction_id", *columns)

    @cached_property
    def users(self) -> DataFrame:
        """Per user: event counts and sums, the base of the roster."""
        def amount(kind: str) -> Column:
            return F.count(F.when(F.col("kind") == kind, 1)).cast("int")

        return self.ev.groupBy("extraction_id", "ext", "slot", "team_id").agg(
            amount("error").alias("kills"), amount("purchase").alias("deaths"), amount("view").alias("assists"),
            amount("click").alias("last_hits"), amount("signup").alias("denies"),
            F.sum("cents").cast("int").alias("net_worth"), F.max("cents").cast("int").alias("hero_damage"),
            F.min("cents").cast("int").alias("tower_damage"), F.sum("k").cast("int").alias("hero_healing"))

    @cached_property
    def players(self) -> DataFrame:
        stats = ("kills", "deaths", "assists", "last_hits", "denies", "net_worth", "hero_damage", "tower_damage",
                 "hero_healing")
        return self.users.select(
            "extraction_id", F.col("slot").alias("player_slot"), "team_id",
            F.when(F.col("team_id") == 2, "Radiant").otherwise("Dire").alias("team"),
            F.floor(F.col("slot") / 2).cast("bigint").alias("team_slot"), self._hero(F.col("slot")).alias("hero_id"),
            F.floor(F.col("net_worth") / 40).cast("int").alias("gold_per_min"),
            (F.col("kills") * 10).alias("xp_per_min"), *stats)

    @cached_property
    def metadata_candidates(self) -> DataFrame:
        shared = (F.col("slot") == 11) & (F.col("ext") % 3 == 0)
        return self.users.select(
            "extraction_id", F.when(shared, 3).otherwise(F.col("slot")).cast("int").alias("game_player_id"),
            F.col("slot").alias("player_slot"), "team_id")

    @cached_property
    def matches(self) -> DataFrame:
        return self.ev.groupBy("extraction_id", "ext").agg(F.max("t_ms").alias("end_ms")).select(
            "extraction_id", (F.col("ext") + 1).cast("decimal(20,0)").alias("match_id"),
            F.floor(F.col("end_ms") / 1000).cast("int").alias("duration_seconds"),
            (F.lit(2) + F.col("ext") % 2).cast("int").alias("winner_team_id"))

    @cached_property
    def latest(self) -> DataFrame:
        return self.matches.select("extraction_id", "match_id")

    @cached_property
    def gold(self) -> DataFrame:
        total = running_total(self.ev.select("extraction_id", "slot", "team_id", "t_ms", "sequence", "cents"),
                              ["extraction_id", "slot"], ["t_ms", "sequence"], "cents", 120_000, "total_gold_earned")
        return total.select(
            "extraction_id", "sequence", F.col("slot").alias("player_slot"), "team_id",
            ((F.col("t_ms") - 60000) / 1000.0).alias("game_time_seconds"), "total_gold_earned")

    @cached_property
    def positions(self) -> DataFrame:
        return self.ev.groupBy(
            "extraction_id", F.col("slot").alias("player_slot"), "team_id",
            (F.floor(F.col("t_ms") / 100) * 100).cast("bigint").alias("game_time_milliseconds"),
        ).agg(F.max(F.struct("sequence", "px", "py")).alias("last")).select(
            "extraction_id", F.col("last.sequence").alias("sequence"), "game_time_milliseconds", "player_slot",
            self._hero(F.col("player_slot")).alias("hero_id"), "team_id", F.col("last.px").cast("float").alias("world_x"),
            F.col("last.py").cast("float").alias("world_y"))

    @cached_property
    def team_series(self) -> DataFrame:
        minute = F.floor(F.col("t_ms") / 60000).cast("bigint")
        return self.ev.groupBy("extraction_id", "team_id", minute.alias("sample_index")).agg(
            F.sum("cents").cast("double").alias("cents"), F.count("*").cast("double").alias("gold_earned"),
            F.sum("k").cast("double").alias("experience")).select(
            "extraction_id", "team_id", "sample_index",
            F.when(F.col("sample_index") % 7 != 3, F.col("cents")).alias("net_worth"), "gold_earned", "experience")

    @cached_property
    def probability(self) -> DataFrame:
        return self.ev.where("kind = 'view'").groupBy("extraction_id", "t_ms").agg(
            F.max(F.struct("sequence", "k")).alias("last")).select(
            "extraction_id", F.col("last.sequence").alias("sample_index"),
            (F.col("t_ms") / 1000.0).alias("game_time_seconds"), (F.col("last.k") / 100.0).alias("radiant_probability"),
            F.when(F.col("t_ms") < 1200000, fixed.GRAPH_HISTORY).otherwise(fixed.SPECTATOR_UPDATES).alias("source"))

    # --- entities ---------------------------------------------------------------------------

    @cached_property
    def spawner_rows(self) -> DataFrame:
        """Spawners: the first sign-up per match and handle; one handle keeps all of them."""
        marked = self.ev.where("kind = 'signup' AND k BETWEEN 12 AND 17")
        single = marked.where("k < 17").groupBy("extraction_id", "k").agg(
            F.min(F.struct("sequence", "t_ms", "px", "py")).alias("row")).select("extraction_id", "k", "row.*")
        return single.unionByName(marked.where("k = 17").select("extraction_id", "k", "sequence", "t_ms", "px", "py"))

    @cached_property
    def creep_rows(self) -> DataFrame:
        return self.ev.where("kind = 'view'").select(
            "extraction_id", "sequence", "t_ms", "k", (F.lit(1012) + F.col("k") % 6).alias("spawner_handle"),
            (F.col("t_ms") + 1000 * (20 + F.col("k") * 7 % 90)).alias("fatal_ms"))

    @cached_property
    def instances(self) -> DataFrame:
        def shape(frame: DataFrame, handle: Column, class_name: str) -> DataFrame:
            return frame.select(
                "extraction_id", "sequence", F.col("sequence").alias("entity_instance_id"),
                handle.cast("decimal(20,0)").alias("handle"), F.lit(class_name).alias("class_name"),
                F.lit(None).cast("double").alias("game_time"))

        return shape(self.spawner_rows, F.lit(1000) + F.col("k"), fixed.SPAWNER_CLASS).unionByName(
            shape(self.creep_rows, F.lit(5000000) + F.col("sequence"), fixed.CREEP_CLASS))

    @cached_property
    def entity_events(self) -> DataFrame:
        def shape(frame: DataFrame, kind: str, time: Column) -> DataFrame:
            return frame.select("extraction_id", F.col("sequence").alias("entity_instance_id"), "sequence",
                                F.lit(kind).alias("event_type"), time.alias("game_time"))

        seconds = F.col("t_ms") / 1000.0
        return shape(self.spawner_rows, "create", F.when(F.col("k") != 12, seconds)).unionByName(
            shape(self.spawner_rows.where("k = 13"), "delete", seconds + 600)).unionByName(
            shape(self.creep_rows, "create", seconds)).unionByName(
            shape(self.creep_rows.where("k % 5 = 0"), "delete", seconds + 120))

    @cached_property
    def checkpoints(self) -> DataFrame:
        entry = "struct<propertyPath: string, valueType: string, value: string>"

        def shape(frame: DataFrame, properties: dict[str, Column]) -> DataFrame:
            listed = F.array(*[F.struct(F.lit(path).alias("propertyPath"), F.lit("int").alias("valueType"),
                                        value.cast("string").alias("value")).cast(entry)
                               for path, value in properties.items()])
            return frame.select("extraction_id", "sequence", F.col("sequence").alias("entity_instance_id"),
                                F.lit("creation").alias("checkpoint_kind"), F.lit(None).cast("double").alias(
                                    "checkpoint_game_time"), F.to_json(listed).alias("properties"))

        return shape(self.spawner_rows, {"m_Type": F.col("k") % 4, "worldX": F.col("px"), "worldY": F.col("py")}
                     ).unionByName(shape(self.creep_rows, {
                         "m_hNeutralSpawner": F.col("spawner_handle"), "m_iTeamNum":
                         F.when(F.col("k") % 11 == 0, 3).otherwise(4), "m_iHealth": F.lit(100),
                         "m_lifeState": F.lit(0), "m_bIsSummoned": F.lit(False)}))

    @cached_property
    def updates(self) -> DataFrame:
        """Health falls for two thirds of the creeps; one half of these reports it through the life state."""
        def shape(frame: DataFrame, step: int, path: str, value: Column, time: Column) -> DataFrame:
            return frame.select(
                "extraction_id", F.col("sequence").alias("entity_instance_id"),
                (F.col("sequence") * 10 + step).alias("sequence"), F.lit(path).alias("property_path"),
                F.lit("int").alias("value_type"), value.cast("string").alias("value"), (time / 1000.0).alias("game_time"))

        creeps, fatal = self.creep_rows, F.col("fatal_ms")
        return shape(creeps, 1, "m_iHealth", F.lit(40), F.col("t_ms") + 5000).unionByName(
            shape(creeps.where("k % 3 = 1"), 2, "m_lifeState", F.lit(1), fatal)).unionByName(
            shape(creeps.where("k % 3 = 2"), 3, "m_iHealth", F.lit(0), fatal)).unionByName(
            shape(creeps.where("k % 3 = 2"), 4, "m_iHealth", F.lit(0), fatal + 1000))

    # --- catalog ----------------------------------------------------------------------------

    @cached_property
    def extractions(self) -> DataFrame:
        """Orders as extraction attempts of their customer's match."""
        status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(
            F.col("o_orderstatus") == "O", "started").otherwise("failed")
        done = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 != 0), F.col("o_orderdate"))
        config = F.to_json(F.struct(
            F.lit(1).alias("maxInputBytes"), F.lit(2).alias("maxOutputBytes"), F.lit(3).alias("maxRecords"),
            (F.col("o_orderkey") % 2).alias("timeoutSeconds"), F.lit(30).alias("checkpointIntervalSeconds"),
            F.concat(F.lit("p"), F.col("o_orderkey") % 3).alias("profile")))
        profile = F.when(F.col("o_orderkey") % 2 == 0, fixed.FARMING_PROFILE).otherwise("match-analysis-v3")
        return self.table("orders").select(
            F.format_string("e%010d", "o_orderkey").alias("extraction_id"),
            F.col("o_custkey").cast("decimal(20,0)").alias("match_id"),
            F.sha2(F.concat(F.lit("r"), "o_custkey"), 256).alias("replay_sha256"),
            F.lit("reader").alias("parser_name"), F.concat(F.lit("v"), F.col("o_orderkey") % 2).alias("parser_version"),
            F.lit("3").alias("exporter_version"), config.alias("extraction_config"),
            F.col("o_orderdate").alias("started_at"), done.alias("completed_at"), status.alias("status"),
            F.to_json(F.struct((F.col("o_orderkey") % 100).alias("records"),
                               (F.col("o_orderkey") % 1000).alias("total"))).alias("record_counts"),
            F.to_json(F.struct(profile.alias("profile"), F.lit(3).alias("schemaVersion"), F.when(
                F.col("o_orderkey") % 3 == 0, F.struct(F.struct(F.lit("p").alias("path")).alias("heroPositions"))
            ).alias("files"))).alias("manifest"),
            F.when(status == "failed", "load_failed").alias("error_code"),
            F.when(status == "failed", "failed to load").alias("error_message"), "o_totalprice")

    @cached_property
    def acquisitions(self) -> DataFrame:
        """Line items as acquisition attempts of their part's match."""
        return self.table("lineitem").select(
            F.format_string("a%010d-%d-%d-%d-%s", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
            .alias("acquisition_id"),
            F.col("l_partkey").cast("decimal(20,0)").alias("match_id"), F.col("l_shipdate").alias("requested_at"),
            F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.when(
                F.col("l_returnflag") == "A", "succeeded").when(
                F.col("l_returnflag") == "N", "replay_unavailable").otherwise("failed").alias("status"),
            F.col("l_quantity").cast("bigint").alias("replay_size_bytes"),
            F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"))

    # --- documents --------------------------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        """Two JSON documents per order: an overview and its metadata."""
        o = F.col("o_orderkey")

        def player(p: Column) -> Column:
            team = F.when((p == 9) & (o % 7 == 0), "DOTA_GC_TEAM_SPECTATOR").when(
                p < 5, "DOTA_GC_TEAM_GOOD_GUYS").otherwise("DOTA_GC_TEAM_BAD_GUYS")
            return F.struct(
                F.when(p < 5, p).otherwise(p + 123).alias("player_slot"), team.alias("team_number"),
                (p % 5).alias("team_slot"), (o * 10 + p).alias("account_id"),
                F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("p"), o * 10 + p)).alias("player_name"),
                (F.lit(1) + (o * 7 + p * 13) % 114).alias("hero_id"), (F.lit(10) + (o + p) % 20).alias("level"),
                ((o + p) % 20).alias("kills"), ((o + 2 * p) % 15).alias("deaths"), ((o + 3 * p) % 30).alias("assists"),
                F.when((o + p) % 11 != 0, 200 + (o * 3 + p * 17) % 500).alias("gold_per_min"),
                F.when((o + p) % 13 != 0, 300 + (o * 5 + p * 19) % 400).alias("xp_per_min"),
                ((o * 11 + p * 7) % 30000).alias("net_worth"), ((o + p) % 250).alias("item_0"),
                ((o + p * 3) % 250).alias("item_3"))

        def draft(i: Column) -> Column:
            hero = F.lit(1) + (o * 5 + i * 17) % 114
            text = F.when((i == 2) & (o % 5 == 0), F.concat(F.lit('"'), hero, F.lit('"'))).otherwise(hero.cast("string"))
            side = F.when((i == 3) & (o % 6 == 0), 2).otherwise(i % 2)
            return F.concat(F.lit('{"hero_id":'), text, F.lit(',"is_pick":'), F.when(i % 3 == 0, "false").otherwise("true"),
                            F.lit(',"team":'), side.cast("string"), F.lit("}"))

        lobby = _pick(o % 4, {0: "DOTA_LOBBY_TYPE_RANKED", 1: "DOTA_LOBBY_TYPE_PRACTICE", 2: "12", 3: "OTHER"})
        outcome = _pick(o % 3, {0: "k_EMatchOutcome_RadVictory", 1: "k_EMatchOutcome_DireVictory",
                                2: "k_EMatchOutcome_NotScored"})
        overview = F.to_json(F.struct(
            (o + 1).alias("match_id"), (F.lit(1700000000) + o).alias("starttime"),
            (F.lit(1200) + o % 2400).alias("duration"), F.lit("22").alias("game_mode"), lobby.alias("lobby_type"),
            outcome.alias("match_outcome"), (o % 60).alias("radiant_team_score"), (o % 55).alias("dire_team_score"),
            F.when(o % 2 == 0, F.concat(F.lit("team "), o % 40)).alias("radiant_team_name"), (o % 300).alias("cluster"),
            F.transform(F.sequence(F.lit(0), F.lit(9)), player).alias("players")))
        picks = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), draft), ",")
        payload = F.concat(F.expr("substring(overview, 1, length(overview) - 1)"), F.lit(',"picks_bans":['), "picks",
                           F.lit("]}"))
        # A key of a few bytes grows to kilobytes of JSON: spread the keys first.
        orders = self.table("orders").select("o_orderkey").repartition(self.spark.sparkContext.defaultParallelism)
        first = orders.select("o_orderkey", overview.alias("overview"), picks.alias("picks")).select(
            F.concat(F.lit("d"), "o_orderkey").alias("extraction_id"), (o * 2).alias("sequence"),
            F.lit(fixed.OVERVIEW_DOCUMENT).alias("record_type"), payload.alias("payload"))

        def team(code: int) -> Column:
            def entry(p: Column) -> Column:
                number = p + (code - 2) * 5
                return F.struct(
                    F.when((number == 4) & (o % 8 == 0), 3).otherwise(number).alias("game_player_id"),
                    F.when(number < 5, number).otherwise(number + 123).alias("player_slot"))

            minutes = F.sequence(F.lit(0), (o % 6).cast("int"))
            return F.struct(
                F.lit(code).alias("dota_team"),
                F.transform(F.sequence(F.lit(0), F.lit(4)), entry).alias("players"),
                F.transform(minutes, lambda m: (o % 1000 + m * 100 * code).cast("int")).alias("graph_net_worth"),
                F.transform(F.slice(minutes, 1, 3), lambda m: m * 50 + code).alias("graph_gold_earned"),
                F.transform(minutes, lambda m: m * 70 + code).alias("graph_experience"))

        second = orders.select(
            F.concat(F.lit("d"), "o_orderkey").alias("extraction_id"), (o * 2 + 1).alias("sequence"),
            F.lit(fixed.METADATA_DOCUMENT).alias("record_type"),
            F.to_json(F.struct((o % 30).alias("version"), F.struct(F.array(team(2), team(3)).alias("teams"))
                               .alias("metadata"))).alias("payload"))
        return first.unionByName(second)

    # --- sampler ----------------------------------------------------------------------------

    @cached_property
    def candidate_lines(self) -> DataFrame:
        """Provider rows as JSON text: users are matches, some rows are malformed."""
        k = F.col("k")
        seconds = F.lit(1704067200) + F.floor(F.col("t_ms") * 1080 / 1000).cast("bigint")
        body = F.to_json(F.struct(
            (F.col("sequence") + 1).alias("match_id"), seconds.alias("start_time"),
            F.when(k % 10 == 9, 0).otherwise(7).alias("lobby_type"), (k * 30).alias("duration"),
            F.when(k % 3 != 0, k).alias("avg_rank_tier"), F.when(k % 4 != 0, k % 12).alias("num_rank_tier")))
        text = F.col("body")
        broken = F.when(k % 20 == 7, F.regexp_replace(text, '"start_time":', '"start_at":')).when(
            k % 20 == 8, F.regexp_replace(text, '"lobby_type":(\\d+)', '"lobby_type":"$1"')).otherwise(text)
        return self.ev.select("sequence", "k", body.alias("body")).select("sequence", broken.alias("value"))
